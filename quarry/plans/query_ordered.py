"""Queries that depend on order: runs, sentences, nearest neighbours in a sequence, record assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import extraction as R
from quarry.operators import ordered as O
from quarry.plans.common import Registry, read

query = Registry()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")


@query("""SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island
FROM (SELECT user_id, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.islands(_events(spark, sf_dir), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "island")


_TOKENS = "tokens AS (SELECT user_id, event_id, event_type AS text, CASE event_type WHEN 'view' THEN 'POLYMER' WHEN 'purchase' THEN 'PROP_NAME' WHEN 'click' THEN 'PROP_VALUE' WHEN 'error' THEN 'MATERIAL_AMOUNT' ELSE 'O' END AS label FROM events)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"view": "POLYMER", "purchase": "PROP_NAME", "click": "PROP_VALUE", "error": "MATERIAL_AMOUNT"}
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("O"))
    return _events(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("text"), label.alias("label"))


@query(f"""WITH {_TOKENS}, m AS (SELECT *, CASE WHEN label <> 'O' AND label = lag(label) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM tokens),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM m)
SELECT user_id, string_agg(text, ' ' ORDER BY event_id) AS text, any_value(label) AS label, min(event_id) AS token_start, max(event_id) AS token_end FROM g GROUP BY user_id, g.g""")
def grouped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.grouped_tokens(_tokens(spark, sf_dir), ["user_id"], "event_id")


@query("""SELECT user_id, event_id, CAST(coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence FROM events""")
def sentence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("text", F.when(F.col("event_type") == "signup", "end.").otherwise("word"))
    return O.with_sentence(rows, ["user_id"], "event_id").select("user_id", "event_id", "sentence")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM events""")
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return O.nearest_before(_events(spark, sf_dir), ["user_id"], "event_id", named, "near").select("user_id", "event_id", "near")


_NEAR = """SELECT *, last_value(CASE WHEN label = 'POLYMER' {first} THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp,
  first_value(CASE WHEN label = 'POLYMER' THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rp
  FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""


@query(f"""WITH {_TOKENS}, n AS ({_NEAR.format(first="", source="tokens")})
SELECT user_id, event_id, 'view' AS entity_name, text AS material_amount FROM n WHERE label = 'MATERIAL_AMOUNT' AND (lp IS NOT NULL OR rp IS NOT NULL)""")
def material_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.material_amounts(_tokens(spark, sf_dir), ["user_id"], "event_id")


@query(f"""WITH {_TOKENS}, n AS ({_NEAR.format(first="", source="tokens")})
SELECT user_id, event_id, CASE WHEN lp IS NOT NULL AND (rp IS NULL OR event_id - lp <= rp - event_id) THEN lp ELSE rp END AS material FROM n""")
def nearest_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.when(F.col("label") == "POLYMER", F.col("event_id"))
    return O.nearest_around(_tokens(spark, sf_dir), ["user_id"], "event_id", near, "material").select("user_id", "event_id", "material")


@query(f"""WITH {_TOKENS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM tokens), n AS ({_NEAR.format(first="AND n > 1", source="numbered")}),
named AS (SELECT *, last_value(CASE WHEN label = 'PROP_NAME' THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS name_at,
  last_value(CASE WHEN label = 'PROP_NAME' THEN lp IS NOT NULL OR rp IS NOT NULL END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS has FROM n WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, 'purchase' AS property, text AS value, CASE WHEN has THEN 'view' END AS material FROM named WHERE label = 'PROP_VALUE' AND name_at IS NOT NULL""")
def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.property_values(_tokens(spark, sf_dir), ["user_id"], "event_id")


@query("""SELECT user_id, event_id, CASE WHEN u = '' AND lead(event_type) OVER w = event_type AND lead(u) OVER w <> '' THEN lead(u) OVER w ELSE u END AS unit
FROM (SELECT *, CASE WHEN value < 20 THEN '' ELSE 'u' || CAST(floor(value) AS BIGINT) END AS u FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def unit_from_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("value") < 20, "").otherwise(F.concat(F.lit("u"), F.floor("value").cast("string")))
    return O.unit_from_next(_events(spark, sf_dir).withColumn("unit", unit), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "unit")


@query("""SELECT user_id, event_id, context FROM (SELECT user_id, event_id, event_type, string_agg(event_type, ' ' ORDER BY event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM events) WHERE event_type = 'purchase'""".replace("string_agg(event_type, ' ' ORDER BY event_id)", "string_agg(event_type, ' ')"))
def context_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_context(_events(spark, sf_dir), ["user_id"], "event_id", "event_type", F.col("event_type") == "purchase").select("user_id", "event_id", "context")


@query("""WITH s AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag = 'A') AS n, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag = 'N') AS v FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey, n, v, least(len(n), len(v)) AS k FROM s)
SELECT l_orderkey, coalesce(array_to_string([n[len(n) - k + i] || '=' || v[len(v) - k + i] FOR i IN range(1, k + 1)], ','), '') AS pairs FROM p""")
def respectively(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == f, F.struct("l_linenumber", "l_partkey", "l_suppkey")))), lambda s: s["l_linenumber"].cast("string"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of("A").alias("names"), of("N").alias("values"))
    return O.respectively(rows).select("l_orderkey", F.array_join(F.transform("pairs", lambda p: F.concat_ws("=", p["name"], p["value"])), ",").alias("pairs"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_rows(read(spark, sf_dir, "orders"), 20, [F.desc("o_totalprice"), "o_orderkey"], o_orderstatus="F").select("o_orderkey", "o_totalprice")


@query()
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sample_by_hash(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100, "o_orderkey", 7)


@query()
def tagged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("para_id"), "text")
    return R.records(R.tagged(docs, R.LexiconTagger({"POLYMER": ("the", "les", "der"), "PROP_NAME": ("and", "est", "und")})), {}, polymer_only=False)


QUERIES, ORACLES = query.queries, query.oracles
