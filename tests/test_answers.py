import json

from quarry.operators import answers as A
from quarry.operators import metrics as M
from quarry.sources import tables as T

POLYMERS = "name string, normalized_name string"


def recorded(answers):
    """A client that is made here, so that it travels to the workers whole."""

    class Recorded:
        def answer(self, messages):
            text = messages[-1]["content"].split("\n\n")[0]
            if text not in answers:
                raise OSError
            return {"choices": [{"message": {"content": answers[text]}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}}

    return Recorded()


def test_materials_are_classed_by_names_coreferents_and_solvents(spark):
    polymers = spark.createDataFrame([("polystyrene", "PS!"), ("Nafion", "N!")], POLYMERS)
    crossrefs = spark.createDataFrame([("polyaniline", "PANI"), ("water", "H2O")], "name string, othername string")
    rows = spark.createDataFrame([("polystyrene",), ("Nafion",), ("PANI",), ("Water",), ("silica filler",), ("polyfoo",), (None,), ("PANI",)], "material string")
    got = {r.material: r for r in A.parsed_materials(rows, polymers, crossrefs, ["Water"]).collect()}
    kinds = {m: (r.material_class, r.normalized_material_name, r.role) for m, r in got.items()}
    assert kinds == {"polystyrene": ("POLYMER", "PS!", ""), "Nafion": ("POLYMER", "N!", ""), "PANI": ("POLYMER", "", ""), "Water": ("SOLVENT", "", ""), "silica filler": ("", "", "filler"), "polyfoo": ("POLYMER", "", "")}
    assert got["PANI"].coreferents == ["PANI", "polyaniline"] and got["PANI"].polymer_type == ""
    assert A.parsed_materials(rows, polymers, crossrefs, []).count() == 7


def test_answers_become_records(spark):
    answers = {
        "one": json.dumps([{"material": "Nafion", "property": "Tg", "value": "300 K"}, {"material": "Nafion", "property": "Tg", "value": "high"}, {"material": "", "property": "Tg", "value": "1 K"}]),
        "two": '{"material": "foo", "property": "E", "value": "2 GPa at 25 °C", "condition": "dry"}',
        "three": "nothing here",
    }
    paragraphs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "fails")], "para_id long, text string")
    polymers = spark.createDataFrame([("Nafion", "N!")], POLYMERS)
    crossrefs = spark.createDataFrame([], "name string, othername string")
    rows = A.answered_records(paragraphs, recorded(answers), polymers, crossrefs, "List all.").collect()
    got = {(r.para_id, r.entity_name, r.material_class, r.property, round(r.numeric_value, 9), r.unit, r.condition) for r in rows}
    assert got == {(1, "Nafion", "POLYMER", "Tg", 26.85, "°C", ""), (2, "foo", "", "E", 2000.0, "MPa", "dry")}


def test_counters(spark):
    kind = "para_id long, material string, material_coreferents array<string>, property_name string, property_value string"
    found = spark.createDataFrame([(1, "PS", ["PS"], "Tg", "10 K"), (1, "PE", ["PE"], "Tg", "10 K"), (1, "PS", ["PS"], "Tm", "5"), (9, "PS", ["PS"], "Tg", "1")], kind)
    truth = spark.createDataFrame([(1, "PS", ["PS"], "Tg", "10 K"), (2, "PP", ["PP"], "Tg", "20 K")], kind)
    row = M.counters(found, truth, ["Tg"]).first().asDict()
    assert len(row) == 26
    assert (row["relevant_extracted_rows"], row["prop_extracted_rows"], row["total_curated_rows"], row["prop_curated_rows"], row["para_from_curated"]) == (3, 2, 2, 2, 2)
    assert (row["tp_mat"], row["fp_mat"], row["fn_mat"]) == (1, 1, 1) and (row["tp_val"], row["fp_val"], row["fn_val"]) == (2, 0, 1) and (row["tp_prop"], row["fp_prop"], row["fn_prop"]) == (1, 1, 1)


def test_partitions_are_replaced_and_dropped_alone(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, property string, method string")
    T.replace_partitions(rows((1, "tg", "a"), (2, "tg", "b"), (3, "tm", "a")), path, ["property", "method"])
    T.replace_partitions(rows((4, "tg", "a")), path, ["property", "method"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert T.drop_partition(spark, path, property="tg", method="b") and not T.drop_partition(spark, path, property="x", method="b")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
