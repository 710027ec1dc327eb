"""Queries on paragraphs, names, values, pages and model output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import model_output as Y
from quarry.functions import numbers as N
from quarry.functions import text as X
from quarry.operators import metrics as M
from quarry.operators import predicates as P
from quarry.plans.common import Registry, read, values_sql
from quarry.plans.query_joins import LINES, lines
from quarry.sources import documents as D

query = Registry()


def _literals(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


@query(f"""WITH {LINES}, g AS (SELECT doc_id, pos, string_split_regex(text, '\\s?\\d+\\s+\\d+[%\\s]?')[2:-2] AS gaps FROM lines)
SELECT doc_id, pos, len(list_filter(gaps, lambda x: length(x) < 20)) >= 3 AS is_table FROM g""")
def is_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", P.looks_like_table("text").alias("is_table"))


@query(f"""WITH {LINES} SELECT doc_id, pos, text FROM lines
WHERE contains(text, '.') AND length(text) > 10 AND len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) > 5""")
def valid_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where(P.valid_paragraph("text"))


@query("SELECT doc_id, regexp_matches(text, 'http|doi') AS reference FROM documents")
def reference_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", P.is_reference("text").alias("reference"))


_NAME = "replace(split_part(split_part(url, '?', 1), '//', 2), '/', '@') || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.xml' END"


@query(f"""SELECT page_id, regexp_replace(replace(f, '@', '/'), '\\.(html|xml)$', '') AS doi, rtrim(rtrim(replace(f, '@', '/'), '.html'), '.xml') AS stripped,
replace(replace(f, '@', '/'), '/', '@') || '.x' AS back FROM (SELECT page_id, {_NAME} AS f FROM pages)""")
def filename_to_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.replace(F.split(F.split("url", r"\?")[0], "//")[1], F.lit("/"), F.lit("@"))
    name = F.concat(host, F.when(F.col("page_id") % 2 == 0, ".html").otherwise(".xml"))
    rows = read(spark, sf_dir, "pages").select("page_id", name.alias("f"))
    plain = F.replace("f", F.lit("@"), F.lit("/"))
    return rows.select("page_id", X.filename_to_doi("f").alias("doi"), X.filename_to_doi("f", compat=True).alias("stripped"), X.doi_to_filename(plain, F.lit("x")).alias("back"))


_COUNT = lambda c, x: f"(length({c}) - length(replace({c}, '{x}', '')))"


@query(f"""WITH {LINES}, a AS (SELECT doc_id, pos, text, CASE WHEN {_COUNT('text', '}')} = {_COUNT('text', '{')} - 1 THEN text || '}}' ELSE text END AS t FROM lines)
SELECT doc_id, pos, CASE WHEN {_COUNT('t', ')')} = {_COUNT('t', '(')} - 1 THEN t || ')' WHEN {_COUNT('t', ')')} = {_COUNT('t', '(')} + 1 THEN left(t, length(t) - 1) ELSE t END AS text FROM a""")
def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", X.close_pairs("text").alias("text"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, 'th', 'SulPh'), 'sulph', 'sulf', 'gi'), 'aluminum', 'aluminium', 'gi'), 'cesium', 'caesium', 'gi')) AS digest FROM documents")
def chemical_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.chemical_spelling(F.replace("text", F.lit("th"), F.lit("SulPh")))).alias("digest"))


@query("""SELECT p_partkey, replace(replace(lower(trim(p_name)), ' ', ''), 'α', '\\alpha') AS name,
replace(replace(replace(replace(lower(trim(p_size || ' ± ' || p_brand)), ' ± ', '±'), '+/-', '±'), '° C', '°C'), ' ', '') AS value FROM part""")
def normal_names_and_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat_ws(" ± ", F.col("p_size").cast("string"), "p_brand")
    return read(spark, sf_dir, "part").select("p_partkey", X.norm_name("p_name").alias("name"), X.norm_value(value).alias("value"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{N.NUMBER}'), '|') AS numbers FROM documents")
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(N.extract_numbers("text"), "|").alias("numbers"))


NUMBERS = [("1.5x10^{-3}", 0.0015), ("10^{7}", 1e7), ("12.5", 12.5), ("100 - 200", 150.0), ("3/4", 0.75), ("1 + 2", 3.0), ("2x10^4", 20000.0), ("1 2", None), ("abc", None), ("-5.", -5.0), ("1/0", None)]


@query(values_sql(NUMBERS, ["raw", "value"], ["VARCHAR", "DOUBLE"]))
def read_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, [(a,) for a, _ in NUMBERS], "raw string").select("raw", F.round(N.number("raw"), 12).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * pow(10.0::DOUBLE, -3) ELSE p_size::DOUBLE END AS value FROM part")
def scientific_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("x10^{-3}"))).otherwise(F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", N.scientific(raw).alias("value"))


ERRORS = [("10 +/- 2 K", 10.0, 2.0), ("~1,200 +/- 30", 1200.0, 30.0), ("(5.5 +/- 0.5) MPa", 5.5, 0.5), ("(5 +/- 1) x 10", None, None), ("a +/- b", None, None), ("7", None, None)]


@query(values_sql(ERRORS, ["raw", "value", "error"], ["VARCHAR", "DOUBLE", "DOUBLE"]))
def split_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, [(e[0],) for e in ERRORS], "raw string").withColumn("e", X.split_error("raw")).select("raw", "e.value", "e.error")


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'star') THEN 'star_polymer' WHEN contains(p_name, 'g-') OR contains(p_name, 'block') OR (contains(p_name, '-') AND upper(p_name) = p_name)
  OR length(p_name) - length(replace(p_name, 'poly', 'xxx')) > 1 THEN 'copolymer' ELSE 'homopolymer' END AS polymer_type
FROM (SELECT p_partkey, replace(replace(replace(p_name, 'red', 'star-ring'), 'small', 'big-'), 'blue', 'polypoly') AS p_name FROM part)""")
def polymer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = X.replaced(F.col("p_name"), [("red", "star-ring"), ("small", "big-"), ("blue", "polypoly")])
    return read(spark, sf_dir, "part").select("p_partkey", X.polymer_type(name).alias("polymer_type"))


CAPTIONS = [("Table 3 Values of x", "Table 3"), ("Table IV. Data", "Table IV"), ("Figure 2", None), ("see Table 1", None)]


@query(values_sql(CAPTIONS, ["caption", "number"], ["VARCHAR", "VARCHAR"]))
def caption_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, [(c,) for c, _ in CAPTIONS], "caption string").select("caption", X.caption_number("caption").alias("number"))


@query("""SELECT p_partkey, TRY_CAST(c AS BIGINT) AS whole, CASE WHEN TRY_CAST(c AS BIGINT) IS NULL OR contains(c, '.') THEN TRY_CAST(c AS DOUBLE) END AS real, CASE WHEN TRY_CAST(c AS DOUBLE) IS NULL THEN c END AS text
FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_name ELSE NULL END AS c FROM part)""")
def coerce_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", X.coerce_cell(cell).alias("c")).select("p_partkey", "c.whole", "c.real", "c.text")


CHARACTERS = [("10 µm ± 2", "10 \\mum +/-2"), ("a−b", "a-b"), ("αβ(x)", "\\alpha\\beta (x)"), ("x²  y", "x^{2} y"), ("Î¼g", "\\mu g"), ("f( x )", "f (x)")]


@query(values_sql(CHARACTERS, ["raw", "text"], ["VARCHAR", "VARCHAR"]))
def normalize_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, [(c,) for c, _ in CHARACTERS], "raw string").select("raw", X.normalize_chars("raw").alias("text"))


TEXTS = [
    ("Sulphur &amp; aluminum [1] at 20 ° C, see Fig. 3.", "sulfur & aluminium [1] at 20 °C, see Figure 3."), ("x=3 and 1,200 é", "x = 3 and 1200 e"),
    ("write to a.b@c.org ()", "write to _EMAIL_"), ("50% i.e. half © 2001 Some Press", "50 % ie half"),
]


@query(values_sql(TEXTS, ["raw", "text"], ["VARCHAR", "VARCHAR"]))
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, [(c,) for c, _ in TEXTS], "raw string").select("raw", X.normalize_text("raw").alias("text"))


ABBREVIATIONS = [("We made poly(ethylene oxide) (PEO) and polystyrene (PS).", "PEO=poly(ethylene oxide)|PS=polystyrene"), ("The glass transition temperature (Tg) rose.", "Tg=transition temperature"), ("Nothing (see below).", "")]


@query()
def abbreviation_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", X.abbreviations("text").alias("a"))
    return rows.select("doc_id", F.transform("a", lambda p: F.concat_ws("=", p["short"], p["long"])).alias("pairs"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS tokens, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) / 1000.0::DOUBLE * 0.0015::DOUBLE AS cost FROM documents")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.token_costs(read(spark, sf_dir, "documents"), F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+"))).select("doc_id", "tokens", "cost")


@query("""SELECT count(*) AS requests, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) / 1000.0::DOUBLE * 0.0015::DOUBLE AS cost, CAST(sum(n) AS BIGINT) / 1000.0::DOUBLE * 0.0015::DOUBLE * 3.5::DOUBLE AS one_shot_cost
FROM (SELECT len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS n FROM documents)""")
def token_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.token_total(read(spark, sf_dir, "documents"), F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")))


@query("SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n FROM (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text || chr(10) || chr(10) || 'List all.' ELSE text END AS text FROM conversations WHERE role IN ('user', 'assistant'))")
def few_shot_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    shots = F.array(F.struct(F.col("text").alias("text"), F.col("text").alias("records")))
    one = rows.select("conv_id", "turn", "role", Y.few_shot_messages(shots, F.lit("x"), "List all.").alias("m"))
    mine = F.filter("m", lambda m: m["role"] == F.col("role"))[0]["content"]
    return one.select("conv_id", "turn", "role", F.length(mine).alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, 'out ' || event_type AS response, CAST(json_extract(props, '$.k') AS INTEGER) AS request_tokens, 7::INTEGER AS response_tokens FROM events")
def unpack_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    choice = F.struct(F.struct(F.concat(F.lit("out "), "event_type").alias("content")).alias("message"))
    body = F.to_json(F.struct(F.array(choice).alias("choices"), F.struct(k.alias("prompt_tokens"), F.lit(7).alias("completion_tokens")).alias("usage")))
    return Y.unpacked(read(spark, sf_dir, "events").select("event_id", body.alias("response_obj"))).drop("response_obj")


OUTPUTS = [
    (1, '[{"material": "A", "property": "Tg", "value": "10 K"}]'), (2, '{"material": "B", "property": "Tg", "numeric value": "5", "conditions": "at 1 bar"}'),
    (3, '[{"material": "C", "property": "Tm", "value": "1"}][{"material": "D", "property": "Tm", "value": "2"}]'), (4, '[{"material": "E" "property": "Tm", "value": "3", "condition": None}]'),
    (5, 'none at all'), (6, '[{"material": "F", "property": "", "value": "3"}]'), (7, '[{"material": "G", "property": "Tg", "value": "4"}].'),
]
RECORDS = [(1, "A", "Tg", "10 K", ""), (2, "B", "Tg", "5", "at 1 bar"), (3, "C", "Tm", "1", ""), (3, "D", "Tm", "2", ""), (4, "E", "Tm", "3", ""), (7, "G", "Tg", "4", "")]


@query(values_sql(RECORDS, ["id", "material", "property", "value", "condition"], ["BIGINT", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR"]))
def repair_model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.extracted(_literals(spark, OUTPUTS, "id long, response string")).drop("response")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag AS temperature, CASE WHEN l_linestatus = 'O' THEN 'O' END AS measurement FROM lineitem""")
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Y.conditions_map(temperature="l_returnflag", measurement=F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).otherwise(""))
    return read(spark, sf_dir, "lineitem").withColumn("m", m).select("l_orderkey", "l_linenumber", F.col("m")["temperature"].alias("temperature"), F.col("m")["measurement"].alias("measurement"))


@query("SELECT l_orderkey, l_linenumber, year(l_shipdate) + dayofyear(l_shipdate) / (CASE WHEN dayofyear(make_date(year(l_shipdate), 12, 31)) = 366 THEN 366.0::DOUBLE ELSE 365.0::DOUBLE END) AS y FROM lineitem")
def year_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.year_fraction("l_shipdate").alias("y"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\bthe\\b')) AS INTEGER) AS n FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", D.word_count("text", "the").alias("n"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"))


@query()
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.paragraphs_of(_pages(spark, sf_dir), "page_id", publisher=None)


@query()
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tables_of(_pages(spark, sf_dir), "page_id", publisher=None)


@query("SELECT page_id, contains(html, '<title>') AS titled FROM pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", D.part_of(F.col("content"), F.lit(""), "title").alias("title"))
    return rows.select("page_id", F.col("title").isNotNull().alias("titled"))


QUERIES, ORACLES = query.queries, query.oracles
