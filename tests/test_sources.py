import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import extraction as R
from quarry.operators import ordered as O
from quarry.sources import documents as D
from quarry.sources import settings, tables
from quarry.streaming import incremental as I


def test_store(spark, tmp_path):
    s = tables.Store(spark, str(tmp_path))
    s.create_all()
    row = spark.createDataFrame([(1, 2, "test_material", "POLYMER"), (1, 2, "test_material", "OTHER")], "para_id long, method_id long, entity_name string, material_class string")
    assert s.insert_new("extracted_materials", row, ["material_class"]).count() == 1
    assert s.insert_new("extracted_materials", row).count() == 0
    got = s.get_one("extracted_materials", entity_name="test_material")
    assert (got.para_id, got.material_class) == (1, "OTHER") and isinstance(got.id, int)
    assert s.exists("extracted_materials", para_id=1) and s.get_id("extracted_materials", para_id=1) == got.id
    s.update("extracted_materials", F.col("para_id") == 1, material_class=F.lit("POLYMER"))
    assert s.query("SELECT material_class FROM extracted_materials WHERE para_id = :p;", p=1).first()[0] == "POLYMER"
    s.upsert("extracted_materials", row.limit(1).withColumn("material_class", F.lit("NEW")))
    assert [r.material_class for r in s.get_all("extracted_materials").collect()] == ["NEW"]
    s.export(str(tmp_path / "out"), ["extracted_materials"], "csv")
    s.delete("extracted_materials", F.col("entity_name") == "test_material")
    assert s.get_one("extracted_materials", entity_name="test_material") is None
    assert all(schemas.table(n).schema for n in schemas.names())


def test_grid_and_text():
    root = D.tree("<table><caption>Table 1 x</caption><tr><th>a<th>b<tr><td rowspan=2>1<td>2<tr><td>H<sub>2</sub>O</table>")
    (t,) = list(root.find("table"))
    assert D.grid(t) == [["a", "b"], ["1", "2"], ["1", "H_{2}O"]]
    got = D.parse("<html><head><title>T</title><meta name=citation_doi content='doi:10.1/x'></head><body><script>var p='<p>'</script><p>One<p>Two <b>x<sup>3</sup></b></body>")
    assert (got["title"], got["doi"], got["paragraphs"]) == ("T", "10.1/x", ["One", "Two x^{3}"])
    xml = D.parse("<article><front><article-title>A</article-title><abstract>B c</abstract></front><ce:para>text</ce:para></article>", D.RULES[3])
    assert (xml["title"], xml["abstract"], xml["paragraphs"]) == ("A", "B c", ["text"])
    assert D.parse(None)["paragraphs"] == [] and D.parse("<" * 1000)["title"] is None


def test_files(spark, tmp_path):
    folder = tmp_path / "corpus" / "wiley"
    folder.mkdir(parents=True)
    (folder / "10.1@abc.html").write_text("<h1>Title</h1><p>A paragraph with more than five words in it.</p><p>more than five words in it.</p>")
    docs = D.read_documents(spark, str(tmp_path / "corpus"))
    assert [(r.publisher, r.doi, r.doctype) for r in docs.collect()] == [("wiley", "10.1/abc", "html")]
    known, unknown = D.of_known_publishers(docs)
    assert (known.count(), unknown.count()) == (1, 0)
    assert [r.text for r in D.paragraphs_of(docs, "doi").collect()] == ["A paragraph with more than five words in it."]
    files = tables.list_files(spark, str(tmp_path / "corpus")).collect()
    assert [(r.relpath, r.directory, r.doctype) for r in files] == [("wiley/10.1@abc.html", "wiley", "html")]


def test_settings(spark, tmp_path):
    s = settings.Settings().with_overrides({"extraction.shots": "3", "run.directory": "x"})
    settings.save(spark, s, str(tmp_path / "s"))
    assert settings.load(spark, str(tmp_path / "s")).extraction.shots == 3
    methods = settings.methods_with(settings.methods_with(spark.createDataFrame([], schemas.table("extraction_methods").schema), "m", model="a", shots=1), "m", shots=2, mean=0.5)
    (row,) = methods.collect()
    assert (row.model, row.extraction_info) == ("a", {"shots": "2", "mean": "0.5"})


def test_incremental(spark, tmp_path):
    rows = spark.range(1, 11).withColumnRenamed("id", "id")
    done = spark.createDataFrame([(3,), (4,)], "id long")
    made, mark = I.run_once(rows, done, lambda r: r, last=2, limit=4)
    assert ([r.id for r in made.orderBy("id").collect()], mark) == ([5, 6], 6)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([1, 2], [2, 3]):
        spark.createDataFrame([(x,) for x in batch], "id long").write.mode("append").parquet(source)
        for _ in range(2):
            I.stream_new(spark, source, "id long", target, str(tmp_path / "ck"), lambda r: r.withColumn("twice", F.col("id") * 2), ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]
    log = I.advanced(spark.createDataFrame([], "name string, `table` string, row long, comments map<string,string>"), "a", "t", 3)
    log = log.union(I.advanced(log, "a", "t", 7, {"x": "y"})).union(I.advanced(log, "b", "t", 1))
    assert [(r.name, r.row) for r in I.checkpoints(log).collect()] == [("a", 7), ("a", 3), ("b", 1)]
    assert I.checkpoint(log, "a", "t").comments == {"x": "y"} and I.checkpoint(log, "c", "t") is None


def test_a_target_that_cannot_be_read_ends_the_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), tmp_path / "out"
    target.mkdir()
    (target / "part-0.parquet").write_text("not parquet")
    spark.createDataFrame([(1,)], "id long").write.parquet(source)
    with pytest.raises(StreamingQueryException):
        I.stream_new(spark, source, "id long", str(target), str(tmp_path / "ck"), lambda r: r, ["id"]).awaitTermination()
    assert len(list(target.glob("*.parquet"))) == 1


TAGS = [("Polystyrene", "POLYMER"), ("(", "O"), ("PS", "POLYMER"), (")", "O"), ("has", "O"), ("Tg", "PROP_NAME"), ("of", "O"), ("100 K", "PROP_VALUE"), (".", "O")]


def test_records(spark):
    text = "Polystyrene (PS) has Tg of 100 K."
    rows = spark.createDataFrame([(1, text, [{"text": a, "label": b} for a, b in TAGS]), (2, "nothing", []), (3, None, [])], f"para_id long, text string, spans {R.SPANS}")
    (got,) = R.records(rows, {"PS!": ["PS"]}, units=(" K",)).collect()
    assert (got.para_id, got.material, got.property, got.numeric_value, got.unit) == (1, "Polystyrene", "Tg", 100.0, "K")
    m = R.extracted(rows, {"PS!": ["PS"]}).first().result.materials[0]
    assert m.normalized_material_name == "PS!" and m.coreferents == ["Polystyrene", "PS"] and m.polymer_type == "homopolymer"
    assert [x["label"] for x in [dict(zip(("text", "label"), t)) for t in R.align(["ab", "c"], [("a", "X"), ("##b", "X"), ("c", "Y")])]] == ["X", "Y"]


def test_client_and_crossrefs(spark):
    rows = spark.createDataFrame([(1, [("user", "ask")]), (2, [("user", "fail")])], "para_id long, messages array<struct<role:string,content:string>>")

    class Flaky:
        def answer(self, messages):
            if messages[-1]["content"] == "fail":
                raise OSError
            return {"choices": [{"message": {"content": "[]"}}]}

    got = {r.para_id: r for r in R.asked(rows, Flaky()).collect()}
    assert got[1].status == "done" and json.loads(got[1].response_obj)["choices"] and got[2].status == "error: OSError" and got[2].response_obj is None
    paras = spark.createDataFrame([(1, 9, "polystyrene (PS) and again polystyrene (PS)"), (2, 9, "polystyrene (PS)")], "id long, pid long, text string")
    refs = R.crossrefs(paras)
    assert sorted((r.para_id, r.name, r.othername) for r in refs.collect()) == [(1, "PS", "polystyrene"), (1, "polystyrene", "PS")]
    assert R.crossrefs(paras, refs).count() == 0


def test_samples_are_the_same_in_every_run(spark):
    rows = spark.range(1000)
    a, b = (sorted(r.id for r in O.sample_by_hash(rows.repartition(n), 20, "id", 3).collect()) for n in (1, 7))
    assert a == b and len(a) == 20
