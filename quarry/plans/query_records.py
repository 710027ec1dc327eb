"""Queries on extracted records: flags, scores, valid data, metrics, conversion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import numbers as N
from quarry.functions import units
from quarry.functions.numbers import precision_recall
from quarry.operators import answers as A
from quarry.operators import metrics as M
from quarry.operators import predicates as P
from quarry.operators import scoring as S
from quarry.plans.common import PROPERTIES, Registry, materials, properties, read, texts

query = Registry()

RULES = {"other_names": ["o"], "units": ["a", "n"], "lower_limit": 2000.0, "upper_limit": 80000.0}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties beside their metadata."""
    rows = properties(spark, sf_dir).withColumn("text", F.when(F.col("quantity") > 45, "1 2 3 4 5 6 7 8 9 10").otherwise("no table"))
    rows = rows.withColumn("material_class", F.when(F.col("numeric_error") > 0.05, "Polymer").otherwise(""))
    return rows.withColumns({k: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in RULES.items()})


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.all_flags(records(spark, sf_dir), "price")


FLAGS = f"""{PROPERTIES},
flags AS (
  SELECT id AS table_row, 'invalid_property_name' AS filter_name FROM properties WHERE lower(entity_name) <> 'o'
  UNION ALL SELECT id, 'out_of_range' FROM properties WHERE NOT numeric_value BETWEEN 2000 AND 80000
  UNION ALL SELECT id, 'invalid_property_unit' FROM properties WHERE lower(unit) NOT IN ('a', 'n')
  UNION ALL SELECT id, 'is_polymer' FROM properties WHERE numeric_error > 0.05
  UNION ALL SELECT id, 'is_table' FROM properties WHERE quantity > 45),
scores AS (
  SELECT table_row AS prop_id,
    CAST(-count(*) FILTER (filter_name = 'invalid_property_unit') AS BIGINT) AS unit,
    CAST(-count(*) FILTER (filter_name = 'invalid_property_name') AS BIGINT) AS prop,
    CAST(-count(*) FILTER (filter_name = 'is_table') AS BIGINT) AS tabl,
    CAST(-count(*) FILTER (filter_name = 'out_of_range') AS BIGINT) AS rang,
    count(*) FILTER (filter_name = 'is_polymer') AS poly
  FROM flags GROUP BY table_row)"""


@query(f"WITH {FLAGS} SELECT *, unit + prop + tabl + rang AS error, poly AS score FROM scores")
def score_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scores(flags(spark, sf_dir))


@query(f"""WITH {FLAGS}
SELECT d.source AS doi, 'm' AS method, m.p_name AS material, 'price' AS property, p.numeric_value AS value, p.unit, p.id AS prop_id,
  coalesce(s.unit + s.prop + s.tabl + s.rang, 0) AS error, coalesce(s.poly, 0) AS score
FROM properties p JOIN part m ON m.p_partkey = p.material_id JOIN documents d ON d.doc_id = m.p_partkey LEFT JOIN scores s ON s.prop_id = p.id
WHERE coalesce(s.unit + s.prop + s.tabl + s.rang, 0) = 0""")
def valid_data_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scored(properties(spark, sf_dir), materials(spark, sf_dir), texts(spark, sf_dir), S.scores(flags(spark, sf_dir)), "m", "price")
    return rows.where("error = 0").withColumns({"error": F.col("error").cast("long"), "score": F.col("score").cast("long")})


@query(f"""WITH {FLAGS}, own AS (
  SELECT 'price' AS filter_on, s.prop_id, s.unit, s.tabl, s.rang, s.poly, CAST(0 AS BIGINT) AS prop, s.unit + s.tabl + s.rang AS error, s.poly AS score
  FROM scores s JOIN properties p ON p.id = s.prop_id WHERE p.method_id = 3)
SELECT d.source AS doi, 'm' AS method, m.p_name AS material, 'price' AS property, p.numeric_value AS value, p.unit, p.id AS prop_id, s.error, s.score
FROM properties p JOIN part m ON m.p_partkey = p.material_id JOIN documents d ON d.doc_id = m.p_partkey JOIN own s ON s.prop_id = p.id""")
def valid_data_inner_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = properties(spark, sf_dir)
    return S.scored(p, materials(spark, sf_dir), texts(spark, sf_dir), S.selected_scores(flags(spark, sf_dir), p, 3, "price"), "m", "price", flagged_only=True)


@query(f"""WITH {FLAGS}
SELECT p.id AS property_id, 'm' AS method, m.p_name AS material, 'price' AS property, p.numeric_value AS value, p.unit, d.source AS doi, CAST(coalesce(s.poly, 0) AS INTEGER) AS confidence
FROM properties p JOIN part m ON m.p_partkey = p.material_id JOIN documents d ON d.doc_id = m.p_partkey LEFT JOIN scores s ON s.prop_id = p.id
WHERE coalesce(s.unit + s.prop + s.tabl + s.rang, 0) = 0 AND NOT EXISTS (SELECT 1 FROM properties e WHERE e.id = p.id AND e.quantity < 10)""")
def insert_valid_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scored(properties(spark, sf_dir), materials(spark, sf_dir), texts(spark, sf_dir), S.scores(flags(spark, sf_dir)), "m", "price")
    existing = properties(spark, sf_dir).where("quantity < 10").select(F.col("id").alias("property_id"))
    return S.new_valid(rows, existing)


@query(f"""WITH {FLAGS}, named AS (SELECT id FROM properties WHERE lower(entity_name) = 'o')
SELECT 'extracted_properties' AS table_name, f.table_row, 'price' AS filter_on, f.filter_name
FROM (SELECT * FROM flags WHERE filter_name <> 'invalid_property_name' UNION ALL SELECT id, 'valid_property_name' FROM named) f JOIN named n ON n.id = f.table_row""")
def selected_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.all_flags(records(spark, sf_dir), "price", S.SELECTED_VALIDATORS)


@query(f"""WITH {FLAGS}
SELECT 'extracted_properties' AS table_name, id AS table_row, 'price' AS filter_on, 'out_of_range' AS filter_name FROM properties
WHERE NOT numeric_value BETWEEN 2000 AND 80000 AND id NOT IN (SELECT f.table_row FROM flags f JOIN properties p ON p.id = f.table_row WHERE f.filter_name = 'out_of_range' AND p.quantity < 10)""")
def flag_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = properties(spark, sf_dir).where("quantity < 10").select(F.col("id").alias("table_row"))
    there = flags(spark, sf_dir).where("filter_name = 'out_of_range'").join(few, "table_row", "left_semi")
    return S.RANGE.flagged(records(spark, sf_dir), "price", there)


@query("SELECT p_partkey, p_brand, list_contains(['brand#1', 'brand#12', 'brand#2'], lower(p_brand)) AS known FROM part")
def name_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["Brand#1", "BRAND#12", "brand#2"]))
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", P.known_name("p_brand", names).alias("known"))


@query("""SELECT l_orderkey, l_linenumber, NOT l_extendedprice BETWEEN p_retailprice * 2 AND p_retailprice * 40 AS bad
FROM lineitem JOIN part ON p_partkey = l_partkey""")
def range_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    bad = P.out_of_range("l_extendedprice", F.col("p_retailprice") * 2, F.col("p_retailprice") * 40)
    return rows.select("l_orderkey", "l_linenumber", bad.alias("bad"))


@query("SELECT l_orderkey, l_linenumber, lower(l_returnflag) NOT IN ('a', 'n') AS bad, l_returnflag <> 'N' AS bad_without_units FROM lineitem")
def unit_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    units_ = F.array(F.lit("A"), F.lit("N"))
    bare = P.bad_unit(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.array().cast("array<string>"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.bad_unit("l_returnflag", units_).alias("bad"), bare.alias("bad_without_units"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'economy'")
def class_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(P.is_class("p_type", "economy")).select("p_partkey", "p_type")


_UNITS = "CASE l_returnflag WHEN 'A' THEN 'K' WHEN 'N' THEN 'kPa.' ELSE 'furlong' END"


@query(f"""WITH r(alias, factor, shift, std) AS (VALUES ('K', 1.0::DOUBLE, -273.15::DOUBLE, '°C'), ('kPa', 0.001::DOUBLE, 0.0::DOUBLE, 'MPa'))
SELECT l_orderkey, l_linenumber, coalesce(l_extendedprice * factor + shift, l_extendedprice) AS numeric_value, coalesce(l_discount * factor, l_discount) AS numeric_error,
  coalesce(std, {_UNITS}) AS unit
FROM lineitem LEFT JOIN r ON alias = rtrim({_UNITS}, '.')""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_returnflag") == "A", "K").when(F.col("l_returnflag") == "N", "kPa.").otherwise("furlong")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("numeric_value"), F.col("l_discount").alias("numeric_error"), unit.alias("unit"))
    return units.convert(rows)


@query("""WITH c AS (
  SELECT CAST(count(*) FILTER (toxic = 1 AND bad) AS BIGINT) AS tp, CAST(count(*) FILTER (toxic = 0 AND bad) AS BIGINT) AS fp, CAST(count(*) FILTER (toxic = 1 AND NOT bad) AS BIGINT) AS fn
  FROM (SELECT toxic, n_chars > 1000 AS bad FROM labels JOIN documents USING (doc_id)))
SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM c""")
def f1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("bad")), "doc_id")
    t = F.col("toxic") == 1
    return rows.agg(F.count_if(t & F.col("bad")).alias("tp"), F.count_if(~t & F.col("bad")).alias("fp"), F.count_if(t & ~F.col("bad")).alias("fn")).withColumns(precision_recall("tp", "fp", "fn"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    value = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" K"))
    return rows.select(
        F.col("l_orderkey").alias("para_id"), F.col("p_name").alias("material"), F.array(F.upper(F.substring_index("p_name", " ", -1))).alias("material_coreferents"),
        F.col("l_returnflag").alias("property_name"), value.alias("property_value"), "l_linenumber",
    )


_MATCH = """(replace(e.p_name, ' ', '') = replace(c.p_name, ' ', '') OR (length(replace(e.p_name, ' ', '')) > 2 AND contains(replace(c.p_name, ' ', ''), replace(e.p_name, ' ', '')))
  OR (length(replace(c.p_name, ' ', '')) > 2 AND contains(replace(e.p_name, ' ', ''), replace(c.p_name, ' ', '')))
  OR replace(c.p_name, ' ', '') = e.coref OR replace(e.p_name, ' ', '') = c.coref)"""
_SAME = "(contains(c.value, e.value) OR contains(e.value, c.value))"
_PARTS = ("material", _MATCH), ("value", _SAME), ("property", f"{_MATCH} AND {_SAME}")


@query(f"""WITH j AS (
  SELECT l_orderkey AS para_id, l_linenumber AS n, p_name, lower(split_part(p_name, ' ', -1)) AS coref, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'k' AS value, l_returnflag
  FROM lineitem JOIN part ON p_partkey = l_partkey),
e AS (SELECT row_number() OVER () AS id, * FROM j WHERE n % 2 = 0 AND l_returnflag = 'A' AND para_id IN (SELECT para_id FROM j WHERE n % 2 = 1)),
c AS (SELECT row_number() OVER () AS id, * FROM j WHERE n % 2 = 1 AND l_returnflag = 'A'),
es AS (SELECT e.id, {", ".join(f"coalesce(bool_or({x}), false) AS {p}" for p, x in _PARTS)} FROM e LEFT JOIN c USING (para_id) GROUP BY e.id),
cs AS (SELECT c.id, {", ".join(f"coalesce(bool_or({x}), false) AS {p}" for p, x in _PARTS)} FROM c LEFT JOIN e USING (para_id) GROUP BY c.id),
r AS ({" UNION ALL ".join(f"SELECT '{p}' AS part, (SELECT count(*) FROM es WHERE {p}) AS tp, (SELECT count(*) FROM es WHERE NOT {p}) AS fp, (SELECT count(*) FROM cs WHERE NOT {p}) AS fn" for p, _ in _PARTS)})
SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM r""")
def f1_by_any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    return M.metrics(rows.where("l_linenumber % 2 = 0").drop("l_linenumber"), rows.where("l_linenumber % 2 = 1").drop("l_linenumber"), ["A"])


@query("""SELECT part, n AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1
FROM (SELECT count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'), (VALUES ('material'), ('value'), ('property')) AS p(part)""")
def f1_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).drop("l_linenumber")
    return M.metrics(rows, rows, ["A"])


@query("""WITH e AS (SELECT l_orderkey, l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY ALL),
t AS (SELECT l_orderkey, l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 40 GROUP BY ALL),
s AS (SELECT CAST(sum(least(coalesce(e.n, 0), coalesce(t.n, 0))) AS BIGINT) AS tp, CAST(sum(coalesce(e.n, 0) - least(coalesce(e.n, 0), coalesce(t.n, 0))) AS BIGINT) AS fp,
  CAST(sum(coalesce(t.n, 0) - least(coalesce(e.n, 0), coalesce(t.n, 0))) AS BIGINT) AS fn FROM e FULL JOIN t USING (l_orderkey, l_partkey, l_returnflag))
SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM s""")
def f1_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doi"), F.col("l_partkey").alias("material"), F.col("l_returnflag").alias("property"), F.lit("v").alias("value"), "l_quantity")
    return M.by_document(rows.where("l_quantity > 10"), rows.where("l_quantity < 40"))


#: Value strings of a and b, by kind, and what they must read as: value, error, unit, average, descriptor, condition.
VALUE_KINDS = [
    ("{a} ± {b} MPa", "a", "b", "MPa", False, "", ""),
    ("{a}-{c} °C", "(a + c) / 2.0", "NULL", "°C", False, "", ""),
    ("{a} MPa at {b} °C", "a", "NULL", "MPa", False, "", "at {b} °C"),
    ("{a} K for A and {c} K for B", "(a + c) / 2.0", "NULL", "K", True, "", "avg for A and B"),
    ("{a} GPa in air", "a", "NULL", "GPa", False, "", "in air"),
    ("~ {a} wt %, {b} K", "a", "NULL", "wt %", False, "~", ""),
    ("{a} (see {b}) foo", "a", "NULL", "foo", False, "", ""),
    ("{a} and {c} bar", "(a + c) / 2.0", "NULL", "bar", True, "and", ""),
    ("{a}/{b}", "a / b", "NULL", "", False, "", ""),
    ("{a}x10^{{b}} S cm^{-1}", "a * pow(10.0, b)", "NULL", "S cm^{-1}", False, "", ""),
    ("no number", "NULL", "NULL", None, False, "", ""),
]


def _filled(form: str) -> str:
    """SQL that fills a, b and c into a form."""
    parts = re.split(r"\{([abc])\}", form)
    return " || ".join(f"CAST({x} AS STRING)" if i % 2 else f"'{x}'" for i, x in enumerate(parts) if x)


def _by_kind(values: list[str]) -> str:
    return "CASE kind " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_PARTS = f"SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, CAST(l_linenumber AS INT) AS b, CAST(l_quantity AS INT) + l_linenumber AS c, CAST((l_orderkey + l_linenumber) % {len(VALUE_KINDS)} AS INT) AS kind FROM lineitem"


def _value_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("quarry_lineitem")
    return spark.sql(f"SELECT l_orderkey, l_linenumber, {_by_kind([_filled(v[0]) for v in VALUE_KINDS])} AS raw FROM ({_PARTS.replace('FROM lineitem', 'FROM quarry_lineitem')})")


_text = lambda v: "NULL" if v is None else f"'{v}'"
_EXPECTED = f"""SELECT l_orderkey, l_linenumber, {_by_kind([_filled(v[0]).replace("STRING", "VARCHAR") for v in VALUE_KINDS])} AS raw,
  round(CAST({_by_kind([v[1] for v in VALUE_KINDS])} AS DOUBLE), 6) AS value, CAST({_by_kind([v[2] for v in VALUE_KINDS])} AS DOUBLE) AS error, {_by_kind([_text(v[3]) for v in VALUE_KINDS])} AS unit,
  {_by_kind([str(v[4]) for v in VALUE_KINDS])} AS average, {_by_kind([_text(v[5]) for v in VALUE_KINDS])} AS descriptor, {_by_kind([_filled(v[6]).replace("STRING", "VARCHAR") or "''" for v in VALUE_KINDS])} AS condition
FROM ({_PARTS})"""


@query(_EXPECTED)
def parse_property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.with_value_parts(_value_strings(spark, sf_dir), "raw")
    return rows.select("l_orderkey", "l_linenumber", "raw", F.round("p.value", 6).alias("value"), "p.error", "p.unit", "p.average", "p.descriptor", "p.condition")


@query(f"""SELECT l_orderkey, l_linenumber, round(CASE unit WHEN 'K' THEN value - 273.15 WHEN 'GPa' THEN value * 1000 ELSE value END, 6) AS numeric_value,
  CASE unit WHEN 'GPa' THEN error * 1000 ELSE error END AS numeric_error, CASE unit WHEN 'K' THEN '°C' WHEN 'GPa' THEN 'MPa' ELSE unit END AS unit, condition AS condition_str
FROM ({_EXPECTED}) WHERE value IS NOT NULL""")
def converted_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.parsed_properties(_value_strings(spark, sf_dir), "raw", distinct=True)
    return found.select("l_orderkey", "l_linenumber", F.round("numeric_value", 6).alias("numeric_value"), "numeric_error", "unit", "condition_str")


class Echo:
    """Answers with what the request says before its instruction."""

    def answer(self, messages: list[dict]) -> dict:
        return {"choices": [{"message": {"content": messages[-1]["content"].split("\n\n")[0]}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}}


@query("""SELECT p_partkey AS para_id, p_name AS entity_name, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_type = 'PROMO') THEN 'POLYMER' WHEN p_name = 'large widget' THEN 'SOLVENT' ELSE '' END AS material_class,
  CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_type = 'PROMO') THEN upper(p_name) ELSE '' END AS normalized_material_name, p_brand AS property, CAST(p_size - 273.15::DOUBLE AS DOUBLE) AS numeric_value, '°C' AS unit,
  'at ' || p_partkey || ' bar' AS condition FROM part""")
def answered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    value = F.concat(F.col("p_size").cast("string"), F.lit(" K at "), F.col("p_partkey").cast("string"), F.lit(" bar"))
    whole = F.to_json(F.array(F.struct(F.col("p_name").alias("material"), F.col("p_brand").alias("property"), value.alias("value"))))
    broken = F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), F.lit('] [{"material": "x", "property": "y", "value": "no number"}].'))
    paragraphs = part.select(F.col("p_partkey").alias("para_id"), F.when(F.col("p_size") % 2 == 0, whole).otherwise(broken).alias("text"))
    polymers = part.where("p_type = 'PROMO'").select(F.col("p_name").alias("name"), F.upper("p_name").alias("normalized_name")).distinct()
    crossrefs = spark.createDataFrame([("no such name at all", "NSN")], "name string, othername string")
    rows = A.answered_records(paragraphs, Echo(), polymers, crossrefs, "List all.", solvents=["Large Widget"])
    return rows.select("para_id", "entity_name", "material_class", "normalized_material_name", "property", "numeric_value", "unit", "condition")


QUERIES, ORACLES = query.queries, query.oracles
