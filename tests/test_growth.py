"""Steps that grew faster than their input: their results, and what kept them from growing."""

import gc
import weakref

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import numbers as N
from quarry.operators import joins as J
from quarry.operators import answers as A
from quarry.operators import extraction as R
from quarry.operators import scoring as S
from quarry.sources import documents as D


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def optimized(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_paragraphs_parse_once_and_meet_in_no_pairs(spark):
    page = "<p>One long paragraph, with more than five words in it.<p>more than five words in it.<p>Another. With six words and more.<p>short"
    docs = spark.createDataFrame([(1, page), (1, "<p>x<p>x<p>x<p>One long paragraph, with more than five words in it."), (2, "<p>more than five words in it."), (3, None)], "k long, content string")
    rows = D.paragraphs_of(docs, "k", publisher=None)
    assert "Join" not in plan(rows) and plan(rows).count("ArrowEvalPython") == 1
    assert sorted((r.k, r.pos, r.text) for r in rows.collect()) == [(1, 0, "One long paragraph, with more than five words in it."), (1, 2, "Another. With six words and more."), (2, 0, "more than five words in it.")]


def test_parts_go_within_their_document_only(spark):
    rows = [("a", 2, "bc", 1), ("a", 1, "abcd", 2), ("a", 1, "bc", 3), ("a", 3, "abcd", 4), ("a", 4, None, 5), ("a", 5, None, 6), ("b", 1, "bc", 7), (None, 1, "abcd", 8), (None, 2, "bc", 9), (None, 3, "bc", 10), ("c", 1, "b", 11), ("c", 2, "abc", 12)]
    got = J.without_contained(spark.createDataFrame(rows, "doc string, pos int, text string, n int"), "doc", "pos", "text")
    assert got.columns == ["doc", "pos", "text", "n"]
    assert sorted(r.n for r in got.collect()) == [2, 3, 5, 7, 8, 9, 11, 12]


def test_a_tree_is_freed_when_it_is_read():
    gc.disable()
    try:
        root = D.tree("<div><table><tr><td>1</table></div>")
        seen = weakref.ref(next(root.find("table")))
        del root
        assert seen() is None
    finally:
        gc.enable()


def test_documents_are_handed_over_in_chunks(spark, monkeypatch):
    assert list(D.chunks(["ab", None, "c", "defg", ""], 3)) == [(0, 3), (3, 4), (4, 5)] and list(D.chunks([], 3)) == []
    monkeypatch.setattr(D, "CHUNK", 30)
    html = "<table><caption>Table {0}</caption><tr><th>a<tr><td>{0}</table>"
    docs = spark.createDataFrame([(i, html.format(i)) for i in range(40)], "k long, content string").coalesce(1)
    assert [(r.k, r.caption, r.body) for r in D.tables_of(docs, "k", publisher=None).orderBy("k").collect()] == [(i, f"Table {i}", [[str(i)]]) for i in range(40)]


def test_tables_in_wraps_count_once():
    tables = D.parse("<table-wrap><caption>A</caption><table><tr><td>1<tr><td>2</table></table-wrap><table><caption>B</caption><tr><td>3</table>", parts=("tables",))
    assert [t["caption"] for t in tables["tables"]] == ["A", "B"] and tables["paragraphs"] == [] and tables["title"] is None


def test_titles_are_read_alone(spark):
    docs = spark.createDataFrame([(1, "<title>T</title><p>x"), (2, "<p>x"), (3, None)], "k long, content string")
    assert [r.t for r in docs.select("k", D.part_of(F.col("content"), F.lit(""), "title").alias("t")).orderBy("k").collect()] == ["T", None, None]


def test_entries_of_one_variant_are_met_once(spark):
    dictionary = spark.createDataFrame([(i, f"n{i}", ["PE", "pe"]) for i in range(50, 0, -1)] + [(None, "none", ["PP"]), (60, "first", ["PS", "PE"])], "ord int, name string, coreferents array<string>")
    asked = spark.createDataFrame([(k, ["pe"]) for k in range(40)] + [(40, ["PP"]), (41, ["ps", "xx"]), (42, []), (43, None)], "id int, coreferents array<string>")
    rows = J.normalised(asked, dictionary, "id")
    got = {r.id: r.normalized_material_name for r in rows.collect()}
    assert got == {k: "n1" for k in range(40)} | {40: None, 41: "first", 42: None, 43: None}
    assert "min_by(name" in plan(J.normalised(asked, dictionary, "id")).split("Join")[-1]


def test_edits_are_counted_once_for_different_names(spark):
    names = [("x", i, n) for i, n in enumerate(["abc", "abd", "abc", "zzzzzz", None, "abc", "abcdef"])] + [("y", 10, "abc"), (None, 11, "abc"), (None, 12, "abc")]
    rows = J.edit_distance_pairs(spark.createDataFrame(names, "g string, id int, n string"), ["g"], "id", "n", 2)
    assert sorted(map(tuple, rows.collect())) == [(0, 1, 1), (0, 2, 0), (0, 5, 0), (1, 2, 1), (1, 5, 1), (2, 5, 0)]
    names = optimized(J.edit_distance_pairs(spark.range(9).select(F.lit("x").alias("g"), "id", F.col("id").cast("string").alias("n")), ["g"], "id", "n", 2)).split("levenshtein", 1)[1]
    assert names.count("Aggregate") == 2


def test_values_that_repeat_are_read_once(spark):
    raw = ["10 ± 2 K", "10 ± 2 K", "5 GPa at 25 °C", "no number", None, "2 to 4 %"]
    rows = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(raw)], "id int, raw string, other string")
    got, want = N.with_value_parts(rows, "raw"), rows.withColumn("p", N.value_parts("raw"))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    once, each = (sorted(N.parsed_properties(rows, "raw", distinct=x).collect()) for x in (True, False))
    assert once == each and [r.id for r in once] == [0, 1, 2, 5]
    below = optimized(got).split("Generate", 1)[1]
    assert "Aggregate [__value" in below


def test_flagged_records_are_chosen_before_their_texts(spark, monkeypatch):
    kind = "id long, material_id long, method_id int, numeric_value double, unit string"
    properties = spark.createDataFrame([(1, 1, 3, 1.0, "K"), (1, 2, 4, 2.0, "K"), (2, 1, 3, 3.0, "K"), (3, 1, 4, 4.0, "K"), (4, 9, 3, 5.0, "K")], kind)
    flags = spark.createDataFrame([(1, "x", "is_polymer"), (1, "x", "is_polymer"), (1, "y", "is_polymer"), (3, "x", "is_table"), (4, "x", "is_table")], "table_row long, filter_on string, filter_name string")
    materials = spark.createDataFrame([(1, "A", "", 1), (2, "B", "", 1)], "id long, entity_name string, material_class string, para_id long")
    texts = spark.createDataFrame([(1, "d", "t")], "id long, doi string, text string")

    def rows():
        return S.scored(properties, materials, texts, S.selected_scores(flags, properties, 3, "x"), "m", "x", flagged_only=True)

    want = [(1, "A", 0, 2), (1, "B", 0, 2)]
    assert sorted((r.prop_id, r.material, r.error, r.score) for r in rows().collect()) == want
    assert optimized(rows()).count("broadcast") >= 2  # of the ids, and of the scores
    monkeypatch.setattr(S, "FEW", 1)
    assert sorted((r.prop_id, r.material, r.error, r.score) for r in rows().collect()) == want
    assert "broadcast" not in optimized(rows())


def test_paragraphs_are_tagged_and_read_in_slices(spark, monkeypatch):
    assert [*R.slices(pa.array(["é", None, "c", "defg", ""]))] == [(0, 5)] and [*R.slices(pa.array([], pa.string()))] == []
    monkeypatch.setattr(R, "CHUNK", 3)
    assert [*R.slices(pa.array(["é", None, "c", "defg", ""]))] == [(0, 3), (3, 1), (4, 1)]
    text = "PS has Tg of 100 K . PS has Tg of 101 K ."
    rows = spark.createDataFrame([(i, text if i % 3 else None) for i in range(30)], "para_id long, text string").coalesce(1)
    tagged = R.tagged(rows, R.LexiconTagger({"POLYMER": ("PS",), "PROP_NAME": ("Tg",)}))
    got = sorted((r.para_id, r.material, r.numeric_value, r.unit) for r in R.records(tagged, {}, units=(" K",)).collect())
    assert got == [(i, "PS", v, "K") for i in range(30) if i % 3 for v in (100.0, 101.0)]


def test_values_of_many_properties_are_read_once_each(spark):
    fields = "entity_name:string,value:string,coreferents:array<string>,material_name:string,material_amount_entity:string,material_amount:string,temperature_condition:string,frequency_condition:string,entity_start:int,value_start:int"
    many = [("Tg", f"{i}" if i % 2 else f"{i} K", [], "", "", "", "", "", i, i) for i in range(200)]
    rows = spark.createDataFrame([(many,)], f"p array<struct<{fields}>>")
    made = rows.select(R.with_numbers(F.col("p"), (" K",)).alias("p"))
    assert [(x.numeric_value, x.unit) for x in made.first().p] == [(float(i), "K") for i in range(199)] + [(199.0, "")]


def test_each_paragraph_is_asked_once_and_by_many_tasks(spark, tmp_path):
    def counting(folder):
        class Counting:
            def answer(self, messages):
                import os
                import uuid

                (open(f"{folder}/{os.getpid()}-{uuid.uuid4()}", "w")).close()
                return {"choices": [{"message": {"content": '[{"material": "PS", "property": "Tg", "value": "1 K"}]'}}]}

        return Counting()

    paragraphs = spark.range(40).select(F.col("id").alias("para_id"), F.col("id").cast("string").alias("text")).coalesce(1)
    polymers, crossrefs = spark.createDataFrame([("PS", "PS!")], "name string, normalized_name string"), spark.createDataFrame([], "name string, othername string")
    rows = A.answered_records(paragraphs, counting(str(tmp_path)), polymers, crossrefs, "List all.").collect()
    assert sorted(r.para_id for r in rows) == list(range(40)) and {r.normalized_material_name for r in rows} == {"PS!"}
    asked = [x.name for x in tmp_path.iterdir()]
    assert len(asked) == 40
    spark.catalog.clearCache()
