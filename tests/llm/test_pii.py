import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")) if k == "ip" else True,
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[k]
            if ok:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def base(text):
    return pii.listed([s for s in pii.find_spans(text) if s[0] < 4])


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="ab.@+-() 0123455é\n%_", max_size=60))
def test_base_kinds_equal_a_regex_scan(text):
    assert base(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "1.2.3.4", ".5", "256.1.1.1", "a.b@c.d", "@x.y", "+1 (017) 555-7713", " ", "-", "0", "é"]), max_size=12))
def test_joined_items_equal_a_regex_scan(parts):
    assert base("".join(parts)) == brute("".join(parts))


def test_digit_runs_of_any_length():
    for zeros in (1, 3, 4299, 5000):
        for text in ("0" * zeros + "1.2.3.4", "1.2.3." + "0" * zeros, "1." + "9" * zeros + ".3.4", "4" * zeros, "+1" + "2" * zeros):
            assert base(text) == brute(text)


def test_added_kinds_and_masks():
    text = 'see http://ann:pw1@host.example/x now. token = "04dbebab91ab85687d33" IBAN: GB82 WEST 1234 5698 7654 32, account no: 12-345678.'
    spans = pii.find_spans(text)
    got = {pii.KINDS[k]: text[a:b] for k, a, b in spans}
    assert got["address"] == "http://ann:pw1@host.example/x"
    assert got["iban"] == "GB82 WEST 1234 5698 7654 32"
    assert [text[a:b] for k, a, b in spans if k == 5] == ["04dbebab91ab85687d33", "12-345678."]
    assert "pw1" not in pii.masked(text, spans) and "GB82" not in pii.masked(text, spans)
    assert pii.find_spans("the account of a token was secret") == []


def test_query_edges(spark):
    long = "x " * 300_000 + "a@b.c"
    rows = [(1, None, "k"), (2, "", "k"), (2, "", "k"), (None, "a@b.c", "k"), (5, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email string")
    got = {(r.doc_id, r.n_email, r.spans) for r in pii.digest(docs).collect()}
    assert got == {(1, 0, ""), (2, 0, ""), (None, 1, "email:0:5"), (5, 1, "email:600000:600005")}
    assert pii.digest(docs.limit(0)).count() == 0
    clashing = docs.withColumnsRenamed({"n_email": "__text"}).withColumn("TEXT_", F.lit(1))
    assert {(r["__text"], r.TEXT_) for r in pii.digest(clashing).collect()} == {("k", 1), (None, 1)}
    kept = pii.redact(docs.select("text", "doc_id")).collect()
    assert [r.text for r in kept if r.doc_id is None] == ["[EMAIL]"]
    assert [r.text for r in kept if r.doc_id == 1] == [None]
    assert pii.detect(docs).schema["pii_spans"].dataType.simpleString() == "array<struct<kind:string,start:bigint,end:bigint>>"


def test_whole_table(spark):
    rows = pii.op1_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == 200
    for r in rows:
        b = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [b.count(f"{k}:") for k in PATTERNS]
