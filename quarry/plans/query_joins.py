"""Queries that join, exclude, insert, update and look up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import norm_name
from quarry.operators import joins as J
from quarry.operators import ordered as O
from quarry.operators import predicates as P
from quarry.operators import shots as H
from quarry.plans.common import Registry, read, texts
from quarry.sources import tables as T
from quarry.streaming import incremental as I

query = Registry()

KEYWORDS = [("rights", "license"), ("rights", "permission"), ("contact", "@"), ("contact", "Phone"), ("links", "http"), ("greeting", "The ")]


@query("""SELECT o_orderkey, o_custkey FROM (SELECT * FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 5000)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)""")
def pending_anti_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "lineitem").where("l_quantity > 40")
    return J.pending(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey", 100, 5000, "l_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def not_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return J.not_in(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), listed, "c_custkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderstatus = 'F' THEN o_custkey END FROM orders)")
def not_in_list_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("k"))
    return J.not_in(read(spark, sf_dir, "customer").select("c_custkey"), listed, "c_custkey", "k")


@query("""SELECT doc_id AS id, source AS pid FROM documents d
WHERE EXISTS (SELECT 1 FROM documents e JOIN labels l USING (doc_id) WHERE e.source = d.source AND l.toxic = 1 AND l.quality = 0)
AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def semi_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    chosen = labels.where("toxic = 1 AND quality = 0")
    return J.siblings(texts(spark, sf_dir).select("id", "pid"), chosen).join(labels, "id", "left_anti").select("id", "pid")


@query("SELECT doc_id AS id, source AS doi FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 20000)")
def paragraphs_of_filtered_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = read(spark, sf_dir, "documents").where("lang = 'es' AND n_chars > 20000").select(F.col("source").alias("doi"))
    return J.of_filtered_papers(texts(spark, sf_dir).select("id", "doi"), long.union(long))


@query("SELECT doc_id FROM documents WHERE contains(text, 'license') OR contains(lower(text), 'license') OR contains(text, 'Phone') OR contains(lower(text), 'Phone')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(P.has_keyword("text", ["license", "Phone"])).select("doc_id")


@query("SELECT doc_id, property, count(*)::INTEGER AS hits FROM documents, (VALUES " + ", ".join(f"('{p}', '{k}')" for p, k in KEYWORDS) + ") AS k(property, keyword) WHERE contains(text, keyword) OR contains(lower(text), keyword) GROUP BY ALL")
def keyword_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keyword_hits(read(spark, sf_dir, "documents"), spark.createDataFrame(KEYWORDS, "property string, keyword string")).select("doc_id", "property", "hits")


@query("SELECT p_partkey FROM part WHERE contains(lower(coalesce(p_name, '')), 'ring') OR contains(lower(coalesce(p_type, '')), 'ring')")
def paper_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(P.mentions("ring", "p_name", "p_type")).select("p_partkey")


LINES = "lines AS (SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS pos, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


@query(f"""WITH {LINES}, first AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) = 1)
SELECT doc_id, pos FROM first a WHERE NOT EXISTS (SELECT 1 FROM first b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND length(b.text) >= length(a.text) AND contains(b.text, a.text))""")
def paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.without_contained(lines(spark, sf_dir), "doc_id", "pos", "text").select("doc_id", "pos")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def exact_duplicates_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return O.keep_first(rows, ["digest"], ["doc_id"])


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
WHERE n = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    return T.new_rows(rows.select("o_orderkey", "o_custkey"), rows.where("o_orderstatus = 'P'"), ["o_custkey"], ["o_orderkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'NEW' ELSE o_orderstatus END AS status FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT'""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority")
    new = rows.where("o_orderpriority = '1-URGENT'").withColumn("status", F.lit("NEW"))
    return T.upserted(rows.where("status <> 'P'"), new, ["o_orderkey"]).drop("o_orderpriority")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS unit, CASE WHEN l_discount = 0 THEN 0.01::DOUBLE ELSE l_discount END AS error FROM lineitem""")
def update_case_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("unit"), F.col("l_discount").alias("error"))
    return T.updated(T.updated(rows, F.col("unit") == "R", unit=F.lit("")), F.col("error") == 0, error=F.lit(0.01))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def delete_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return T.without(read(spark, sf_dir, "lineitem"), gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END) IS DISTINCT FROM 'O'")
def is_distinct_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("section", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return rows.where(P.not_section("section", "O")).select("o_orderkey")


@query("SELECT n_nationkey, CASE r_name WHEN 'ASIA' THEN 'as' WHEN 'EUROPE' THEN 'eu' ELSE n_name END AS directory FROM nation JOIN region ON r_regionkey = n_regionkey")
def publisher_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = rows.select("n_nationkey", F.col("r_name").alias("publisher"), F.col("n_name").alias("directory"))
    return T.by_directory(rows, {"ASIA": "as", "EUROPE": "eu"}).select("n_nationkey", "directory")


@query("SELECT event_type AS name, 'events' AS \"table\", max(event_id) AS row FROM events GROUP BY ALL")
def cursor_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.lit("events").alias("table"), F.col("event_id").alias("row"))
    return I.high_waters(log)


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.windowed_counts(read(spark, sf_dir, "events"), "ts", ["event_type"])


@query("SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(o_orderkey) >= 10")
def count_at_least_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n")).where("n >= 10")


@query("""SELECT l_orderkey AS para_id, list_sort(list({'material': l_partkey::VARCHAR, 'property': l_returnflag, 'value': l_quantity::BIGINT::VARCHAR}))::VARCHAR AS records,
  array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS keywords
FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2""".replace("::VARCHAR AS records", " AS rec").replace("SELECT l_orderkey", "SELECT para_id, array_to_string([r.material || '/' || r.property || '/' || r.value FOR r IN rec], ';') AS records, keywords FROM (SELECT l_orderkey").replace(">= 2", ">= 2)"))
def collect_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("para_id"), F.col("l_partkey").cast("string").alias("material"), F.col("l_returnflag").alias("property_name"), F.col("l_quantity").cast("long").cast("string").alias("property_value")
    )
    out = H.records_by_paragraph(rows, 2)
    flat = F.array_join(F.transform("records", lambda r: F.concat_ws("/", r["material"], r["property"], r["value"])), ";")
    return out.select("para_id", flat.alias("records"), F.array_join("keywords", ",").alias("keywords"))


@query("""SELECT l.p_partkey AS a, r.p_partkey AS b, CAST(levenshtein(l.p_name, r.p_name) AS INTEGER) AS edits FROM part l JOIN part r
ON l.p_brand = r.p_brand AND l.p_size = r.p_size AND l.p_partkey < r.p_partkey AND levenshtein(l.p_name, r.p_name) <= 3""")
def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return J.edit_distance_pairs(part, ["p_brand", "p_size"], "id", "name", 3)


@query()
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    known = part.select(F.concat("name", F.lit("s")).alias("known"))
    return J.fuzzy_matches(part, known, "name", "known", 90.0, best=2)


@query("""WITH d AS (SELECT p_partkey AS ord, p_name AS name, [upper(p_name), p_brand] AS c FROM part WHERE p_type = 'ECONOMY')
SELECT p.p_partkey, (SELECT arg_min(d.name, d.ord) FROM d WHERE list_has_any(d.c, [p.p_name, upper(p.p_name), lower(p.p_name), upper(p.p_name[1]) || p.p_name[2:], lower(p.p_name[1]) || p.p_name[2:]])) AS normalized_material_name FROM part p""")
def dictionary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    dim = part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.array(F.upper("p_name"), F.col("p_brand")).alias("coreferents"))
    return J.normalised(part.select("p_partkey", F.array("p_name").alias("coreferents")), dim, "p_partkey").select("p_partkey", "normalized_material_name")


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'BLEND' WHEN k.name IS NOT NULL THEN 'POLYMER' ELSE '' END AS material_class
FROM part LEFT JOIN (SELECT DISTINCT p_name AS name FROM part WHERE p_type = 'PROMO') k ON k.name = p_name""".replace("'ring'", "'blend'"))
def known_polymers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.col("p_name").alias("entity_name"), F.lit("").alias("material_class"), F.lit("").alias("normalized_material_name"), F.array().cast("array<string>").alias("coreferents"))
    dim = part.where("p_type = 'PROMO'").select(F.col("p_name").alias("name"), norm_name("p_name").alias("norm_name"), F.lit(True).alias("is_polymer")).distinct()
    return J.polymers_of(rows, dim, "p_partkey").select("p_partkey", "material_class")


def _data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extracted data, properties and materials, as order lines, orders' lines and parts."""
    rows = read(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    data = rows.where("l_discount > 0.05").select(
        F.col("id").alias("property_id"), F.col("l_linestatus").alias("method"), F.col("l_suppkey").cast("string").alias("material"), F.col("l_returnflag").alias("property"),
        F.col("l_extendedprice").alias("value"), F.lit("K").alias("unit"), (F.col("l_quantity") > 25).cast("int").alias("confidence"),
    )
    properties = rows.where("l_tax > 0.02").select("id", F.col("l_partkey").alias("material_id"), (F.col("l_suppkey") % 3).cast("int").alias("method_id"), F.col("l_returnflag").alias("entity_name"), F.col("l_shipdate").cast("string").alias("value"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("para_id"), F.col("p_name").alias("entity_name"), F.array("p_brand").alias("coreferents"))
    return data, properties, parts


@query("""WITH rows AS (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM lineitem)
SELECT DISTINCT CAST(p_size AS BIGINT) AS para_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM rows WHERE l_tax > 0.02
AND id IN (SELECT id FROM rows WHERE l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity <= 25 AND l_discount > 0.05))""")
def paragraphs_of_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.paragraphs_of_data(*_data(spark, sf_dir), "O", "N")


@query("""SELECT CAST(p_size AS BIGINT) AS para_id, p_name AS material, p_brand AS coreferent, l_returnflag AS property_name, count(*) AS n
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_tax > 0.02 AND l_suppkey % 3 = 1 GROUP BY ALL""")
def extracted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, properties, parts = _data(spark, sf_dir)
    rows = J.extracted_rows(properties, parts, 1).withColumn("coreferent", F.element_at("material_coreferents", 1))
    return rows.groupBy("para_id", "material", "coreferent", "property_name").agg(F.count("property_value").alias("n"))


@query("""WITH rows AS (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM lineitem)
SELECT CAST(0 AS INTEGER) AS point, l_linestatus AS method, l_suppkey::VARCHAR AS material, l_returnflag AS property, l_extendedprice AS value, 'K' AS unit
FROM rows WHERE l_discount > 0.05 AND l_returnflag IN ('A', 'R') AND id IN (SELECT id FROM rows WHERE l_tax > 0.02)""")
def plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, properties, _ = _data(spark, sf_dir)
    return J.plot_points(data, properties, ["A", "R"])


@query("SELECT DISTINCT p_type, p_size FROM part")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_type", "p_size").distinct()


@query("SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def stacked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return T.stacked(s, c)


_DISTANCE = "round(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9)"
_CENTRES = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
centres AS (SELECT label AS cluster, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(v[pos]) AS m FROM e, range(1, 65) AS r(pos) GROUP BY ALL) GROUP BY label)"""


@query(f"WITH {_CENTRES} SELECT vec_id, cluster FROM e, centres QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_DISTANCE}, cluster) = 1")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return H.nearest_centroid(rows, H.label_means(rows)).select("vec_id", "cluster")


@query(f"WITH {_CENTRES} SELECT cluster, vec_id AS id FROM e, centres QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY {_DISTANCE}, vec_id) = 1 ORDER BY cluster LIMIT 5")
def diverse_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return H.diverse_shots(rows, H.label_means(rows), 5).select("cluster", "id")


@query(f"""WITH {_CENTRES}, reps AS (SELECT cluster, c, vec_id AS id FROM e, centres QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY {_DISTANCE}, vec_id) = 1)
SELECT vec_id AS query_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY {_DISTANCE}, cluster) AS INTEGER) AS rank, id FROM e, reps QUALIFY rank <= 3""")
def similar_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return H.similar_shots(rows, H.label_means(rows), rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3)


@query()
def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.centroids(read(spark, sf_dir, "embeddings"))


@query()
def evaluation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doi"), F.col("o_orderpriority").alias("text"))
    return O.evaluation_sample(rows, read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("doi")), 100)


QUERIES, ORACLES = query.queries, query.oracles
