"""Language-model requests and answers as columns: messages, unpacking, tolerant JSON, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import col, replaced

RECORD = "struct<material:string,property:string,value:string,`numeric value`:string,condition:string,conditions:string>"
# fixed values: textual repairs of almost-JSON, in order
JOINS = (("}][{", "}, {"), ("}] [{", "}, {"), ("}]  [{", "}, {"), ("}]\n[{", "}, {"))
COMMAS = (('""', '", "'), ('" "', '", "'), ('"\n"', '", "'), (': None, "', ': "None", "'), (": None}", ': "None"}'))
ESCAPES = (("\\%", "%"), ("\\*", "*"), ("\\α", "α"), ("\\mu", "\\\\mu"), ("\\beta", "\\\\beta"), ("\\zeta", "\\\\zeta"), ("\\alpha", "\\\\alpha"), ("\\gamma", "\\\\gamma"))


def repaired(text, cut: str | None = None) -> Column:
    """Almost-JSON made parseable; ``cut`` drops all from a marker on."""
    c = col(text)
    c = F.trim(F.substring_index(c, cut, 1)) if cut else c
    c = replaced(c, JOINS + COMMAS)
    c = F.when(c.endswith("."), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    c = F.when(c.endswith("}"), F.concat(c, F.lit("]"))).otherwise(c)
    c = F.when(c.contains("[{"), F.replace(c, F.lit('"]'), F.lit('"}]'))).otherwise(c)
    return replaced(c, ESCAPES)


def records_of(text, cut: str | None = None) -> Column:
    """Array of records: the text as it is if it parses, else repaired; null if neither does."""
    kind = f"array<{RECORD}>"
    c = col(text)
    sections = F.lit(False)
    for a, _ in JOINS:
        sections = sections | c.contains(a)
    first = F.when(~sections, F.from_json(c, kind))  # the parser would stop after the first section
    return F.coalesce(first, F.from_json(repaired(c, cut), kind))


def extracted(rows: DataFrame, text: str = "response", cut: str | None = None) -> DataFrame:
    """One row per complete record: material, property and value present; the condition empty if absent or None."""
    kept = [F.col(c) for c in rows.columns]
    one = rows.select(*kept, F.explode(records_of(text, cut)).alias("__r"))
    filled = lambda name: F.nullif(F.col(f"__r.`{name}`"), F.lit(""))
    condition = F.coalesce(F.col("__r.condition"), F.col("__r.conditions"))
    out = one.select(
        *kept,
        filled("material").alias("material"),
        filled("property").alias("property"),
        F.coalesce(filled("value"), filled("numeric value")).alias("value"),
        F.when(condition.isNull() | (condition == "None"), "").otherwise(condition).alias("condition"),
    )
    return out.where("material IS NOT NULL AND property IS NOT NULL AND value IS NOT NULL")


def unpacked(rows: DataFrame, body: str = "response_obj") -> DataFrame:
    """Content and token counts of a stored answer."""
    path = lambda p: F.get_json_object(F.col(body), p)
    return rows.withColumns(
        {
            "response": path("$.choices[0].message.content"),
            "request_tokens": path("$.usage.prompt_tokens").cast("int"),
            "response_tokens": path("$.usage.completion_tokens").cast("int"),
        }
    )


def with_defaults(settings, defaults: dict[str, str]) -> Column:
    """A map of settings completed by defaults."""
    own = F.coalesce(col(settings), F.create_map().cast("map<string,string>"))
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def conditions_map(**parts) -> Column:
    """The non-empty conditions by name."""
    full = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), col(v))])
    return F.map_filter(full, lambda k, v: F.coalesce(v, F.lit("")) != "")


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), col(content).alias("content"))


def few_shot_messages(shots, request, instruction: str) -> Column:
    """user and assistant messages of each shot (text, records), then the request.

    shots: array<struct<text:string, records:string>>, records as JSON.
    """
    ask = lambda t: F.concat(t, F.lit("\n\n" + instruction))
    pairs = F.transform(shots, lambda s: F.array(message("user", ask(s["text"])), message("assistant", s["records"])))
    return F.concat(F.flatten(pairs), F.array(message("user", ask(col(request)))))


def listed(value) -> Column:
    """One entity or an array of them as an array; null as an empty one."""
    c = col(value)
    return F.when(c.isNull(), F.array()).otherwise(F.array(c))


def without_indexes(entities, indexes) -> Column:
    """An array without the elements at the given positions."""
    return F.filter(entities, lambda e, i: ~F.array_contains(indexes, i))


def synonyms(rows: DataFrame, metadata: DataFrame, name: str = "property") -> DataFrame:
    """``rows`` with the property's other names, empty where there are none."""
    dim = metadata.select(F.col("name").alias("__n"), F.col("other_names").alias("__o"))
    return rows.join(dim, F.col(name) == F.col("__n"), "left").withColumn("other_names", F.coalesce("__o", F.array().cast("array<string>"))).drop("__n", "__o")
