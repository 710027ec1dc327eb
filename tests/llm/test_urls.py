import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from sql_check import same_rows

from quarry.llm import urls


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))]
    fit = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, best[0], best[1]


URLS = [None, "", "no scheme", "http://", "http://com/en/", "HTTP://A.Example.COM/en/7#x", "x://example.com/en/8?/en/7", "x://y.example.net/de/8", "x://y.example.net/de/9", "x://net/de", "x://anet/de/", "x://a.b.c.org/es/ü", "x://É.org?/es/", "a://b://org/es/", "x://.org/es/\nq", "x://org:80/es/", "x://" + "a." * 50_000 + "org/es/" + "z" * 100_000, "x://org/es/", "x://org/es/"]


def test_edges(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    listed = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    assert urls.judge(pages.limit(0), listed).count() == 0
    clashing = pages.withColumnsRenamed({"verdict": "__key"}).withColumns({"row": F.lit(4), "n": F.lit(5), "hits": F.lit(6), "HOST": F.lit("gone")})
    for most in (urls.MAX_LISTED_BYTES, 0):
        found = urls.judge(clashing, listed, max_bytes=most)
        assert found.columns == ["page_id", "url", "__key", "row", "n", "hits", "host", "path", "rule", "verdict"]
        assert sorted(((r.page_id, r.url, r["__key"], r.row, r.n, r.hits, (r.host, r.path, r.rule, r.verdict)) for r in found.collect()), key=lambda x: x[0]) == [(i, u, "old", 4, 5, 6, brute(u)) for i, u in enumerate(URLS)]
    assert {r.verdict for r in urls.judge(pages, listed.limit(0)).collect()} == {"allow"}
    both = spark.createDataFrame([("allow", "org", "/es/"), ("block", "org", "/es/"), (None, "net", None)], "verdict string, host string, path string")
    assert {r.verdict for r in urls.judge(pages.where("page_id >= 17"), both).collect()} == {"block"}


def test_filter_passes_every_listed_key_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("concat('h', id, '.example/') AS k")
    bloom = urls.BlockedBloom.build(keys, "k")
    assert all(bloom.may_hold(f"h{i}.example/") for i in range(20_000))
    assert np.mean([bloom.may_hold(f"q{i}.example/") for i in range(20_000)]) < 0.01


def test_sql(spark):
    same_rows(spark, urls.op5_urls, urls.ORACLES["op5_urls"], "/root/testdata/sf0.01")
