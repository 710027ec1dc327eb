"""Unit conversion as a dimension of rules: value * factor + shift in the standard unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: (aliases, factor, shift, standard unit, factor of the historical results where it differs, its unit)
RULES = (
    (("K",), 1.0, -273.15, "°C", None, None),
    (("kPa", "KPa"), 1e-3, 0.0, "MPa", None, None),
    (("GPa",), 1e3, 0.0, "MPa", None, None),
    (("Pa",), 1e-6, 0.0, "MPa", None, None),
    (("mS/cm", "mS cm^{-1}", "mS / cm", "mS*cm^{-1}"), 1e-3, 0.0, "S/cm", None, None),
    (("S/m", "S m^{-1}"), 1e-2, 0.0, "S cm^{-1}", None, None),
    (("mV",), 1e-3, 0.0, "V", None, None),
    (("kg/mol", "kg mol^{-1}", "KDa", "kDa"), 1e3, 0.0, "g/mol", None, None),
    (("mW/mK", "mW m^{-1} K^{-1}", "mW/m*K", "mW*m^{-1}*K^{-1}", "mW/(m*K)", "mW/m K", "mW/m * K"), 1e-3, 0.0, "W m^{-1} K^{-1}", None, None),
    (("kW kg^{-1}", "kW/kg", "kW*kg^{-1}", "W g^{-1}"), 1e3, 0.0, "W kg^{-1}", None, None),
    (("kW g^{-1}",), 1e6, 0.0, "W kg^{-1}", None, None),
    (("mA g^{-1}", "mA/g", "mA*g^{-1}", "mAg^{-1}"), 1e-3, 0.0, "A g^{-1}", None, None),
    (("μA cm^{-2}", "μA/cm^{2}", "μA*cm^{-2}", "uA cm^{-2}"), 1e-3, 0.0, "mA cm^{-2}", None, None),
    (("mA m^{-2}", "mA/m^{2}"), 1e-4, 0.0, "mA cm^{-2}", None, None),
    (("A/m^{2}", "A m^{-2}"), 1e-1, 0.0, "mA cm^{-2}", None, None),
    (("nA/cm^{2}", "nA cm^{-2}"), 1e-6, 0.0, "mA cm^{-2}", None, None),
    (("A*cm^{-2}", "A cm^{-2}"), 1e3, 0.0, "mA cm^{-2}", None, None),
    (("mW m^{-2}", "mW/m^{2}", "mW*m^{-2}", "mWm^{-2}"), 1e-4, 0.0, "mW cm^{-2}", None, None),
    (("W cm^{-2}", "W/cm^{2}", "Wcm^{-2}"), 1e3, 0.0, "mW cm^{-2}", None, None),
    (("μW cm^{-2}", "μW/cm^{2}", "uW cm^{-2}", "μW*cm^{-2}", "μWcm^{-2}", "uW/cm^{2}", "μ W/cm^{2}"), 1e-3, 0.0, "mW cm^{-2}", None, None),
    (("W/m^{2}", "W m^{-2}", "μW.mm^{-2}", "μW mm^{-2}"), 1e-1, 0.0, "mW cm^{-2}", None, None),
    (("mW/mm^{2}",), 1e2, 0.0, "mW cm^{-2}", None, None),
    (("kW/cm^{2}",), 1e6, 0.0, "mW cm^{-2}", None, None),
    (("cm^{3}(STP) cm/cm^{2} s cmHg", "cm^{3}(STP) cm/(cm^{2} s cmHg)"), 1e10, 0.0, "Barrer", None, None),
    (("mol m m^{-2} s^{-1} Pa^{-1}( barrer)", "mol m m^{-2} s^{-1} Pa^{-1}"), 1e16 / 3.35, 0.0, "Barrer", None, None),
    (("μg g^{-1}", "μg/g"), 1e-3, 0.0, "mg/g", None, None),
    (("g g^{-1}", "g/g", "g/ g"), 1e3, 0.0, "mg/g", None, None),
    (("kg m^{-3}", "kg/m^{3}"), 1e-3, 0.0, "g/cm^{3}", None, None),
    (("mg/cm^{3}", "mg cm^{-3}", "g/dm^{3}", "g/L", "mg/cc", "kg*m^{-3}", "mg*cm^{-3}", "kgm^{-3}"), 1e-3, 0.0, "g/cm^{3}", None, None),
    (("μM", "uM", "μmol L^{-1}"), 1e-6, 0.0, "M", None, None),
    (("nM", "nmol L^{-1}"), 1e-9, 0.0, "M", None, None),
    (("pM",), 1e-12, 0.0, "M", 1e-15, None),
    (("mM",), 1e-3, 0.0, "M", None, None),
    (("kcal/mol", "kcal mol^{-1}", "kcal/mole"), 4.184, 0.0, "kJ/mol", 4.18, None),
    (("μA μM^{-1} cm^{-2}", "μA cm^{-2} μM^{-1}", "uA uM^{-1} cm^{-2}", "mA mM^{-1} cm^{-2}", "mA cm^{-2} mM^{-1}", "μAμM^{-1}cm^{-2}"), 1e3, 0.0, "μA mM^{-1} cm^{-2}", None, None),
    (("nA mM^{-1} cm^{-2}",), 1e-3, 0.0, "μA mM^{-1} cm^{-2}", None, None),
    (("Pa*s", "Pa.s", "Pa s", "Pas", "Pa s^{-1}"), 1e3, 0.0, "mPa s", None, None),
    (("kΩ/sq", "kΩ/ #", "kΩ sq^{-1}", "kΩ/square"), 1e3, 0.0, "Ω/sq", None, None),
    (("MV/cm",), 1e2, 0.0, "kV/mm", 1e3, None),
    (("kV/cm",), 1e-1, 0.0, "kV/mm", None, None),
    (("μΩ cm", "μΩ*cm", "μΩcm"), 1e-6, 0.0, "Ω cm", None, None),
    (("Ω m", "Ωm"), 1e2, 0.0, "Ω cm", None, None),
    (("L m^{-2} h^{-1} MPa^{-1}", "L*m^{-2}*h^{-1}*MPa^{-1}"), 1e-1, 0.0, "L m^{-2} h^{-1} bar^{-1}", 1e2, "Ω cm"),
    (("μW cm^{-1} K^{-2}", "uW cm^{-1} K^{-2}", "μW/cm⋅K^{2}", "uW/cmK^{2}", "μWcm^{-1} K^{-2}", "μWcm^{-1}K^{-2}"), 1e2, 0.0, "μW m^{-1} K^{-2}", None, None),
)


def rules(compat: bool = False) -> list[tuple[str, float, float, str]]:
    """(alias, factor, shift, standard unit); ``compat`` keeps the historical factors, 273 among them."""
    out = []
    for aliases, factor, shift, std, old, old_std in RULES:
        f, s, u = (old or factor, -273.0 if shift else 0.0, old_std or std) if compat else (factor, shift, std)
        out += [(a, f, s, u) for a in aliases]
    return out


def unit_rules(spark: SparkSession, compat: bool = False) -> DataFrame:
    """The dimension: some hundred rows, whatever the data."""
    return spark.createDataFrame(rules(compat), "alias string, factor double, shift double, std_unit string")


def without_dot(unit: Column) -> Column:
    """A unit's trailing full stop goes."""
    return F.when(unit.endswith("."), F.trim(F.substring(unit, F.lit(1), F.length(unit) - 1))).otherwise(unit)


def convert(rows: DataFrame, value: str = "numeric_value", error: str = "numeric_error", unit: str = "unit", compat: bool = False) -> DataFrame:
    """``rows`` with value, error and unit in standard units; unknown units and null values stay as they are.

    ``compat`` also leaves values of 0 as they are. Errors scale but never shift.
    """
    dim = F.broadcast(unit_rules(rows.sparkSession, compat))
    plain = without_dot(F.col(unit))
    out = rows.withColumn("__unit", plain).join(dim, F.col("__unit") == F.col("alias"), "left")
    known = F.col("alias").isNotNull() & F.col(value).isNotNull()
    known = known & (F.col(value) != 0) if compat else known
    return out.withColumns(
        {
            value: F.when(known, F.col(value) * F.col("factor") + F.col("shift")).otherwise(F.col(value)),
            error: F.when(known, F.col(error) * F.col("factor")).otherwise(F.col(error)),
            unit: F.when(known, F.col("std_unit")).otherwise(F.col("__unit")),
        }
    ).drop("__unit", "alias", "factor", "shift", "std_unit")


def percent(value: Column, unit: Column, name: Column, percent_names: Column) -> Column:
    """A bare fraction of a property measured in percent, times 100."""
    fraction = (unit == "") & value.between(0.0, 1.0) & F.array_contains(percent_names, name)
    return F.when(fraction, value * 100).otherwise(value)
