import math
import random

import numpy as np

from ledgerspark.llm import topk_search, url_filters
from ledgerspark.llm.common import Scratch, connected_components
from ledgerspark.llm.signatures import parity_sketch, rare_signatures, signatures, sketch_distance, spare


def test_topk_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.uniform(-2, 2)]) for _ in range(8)], "x") for i in range(400)]
    rows += [(400 + i, list(rows[3][1]), "x") for i in range(60)]
    rows += [(900, None, "x"), (901, [None] * 8, "x"), (902, [float("nan")] * 8, "x"), (903, [float("inf")] + [0.0] * 7, "x"), (None, [1.0] * 8, "x"), (904, [1.0] * 3, "x"), (905, [], "x"), (940, [1e17] * 8, "x"), (941, [-1e18] + [0.0] * 7, "x"), (942, [1e7] * 8, "x"), (960, [-1e7] * 8, "x"), (3, list(rows[5][1]), "x")]
    rows += [(20, list(rows[20][1]), "y"), (40, list(rows[7][1]), "x")]  # a query repeated in full, one of two vectors
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    got = topk_search.exact_topk(df, df.where("vec_id % 20 = 0"), top=7, shard_rows=100, block_queries=8).collect()
    vec = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    vec = [(i, v) for i, v in vec if sum(x * x for x in v) < 2**62]
    assert {940, 941} & {i for i, _ in vec} == set() and {942, 960} <= {i for i, _ in vec}
    want, asked = [], []
    for q, v in vec:
        if q % 20 == 0 and (q, v) not in asked:
            asked.append((q, v))
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vec if i != q and len(w) == len(v))[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk_search.exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_url_filter_rules_and_aliases(spark):
    canonical = '<html><LINK href="https://b.example.org/x" rel=canonical></html>'
    refresh = '<meta http-equiv="refresh" content="0; url=http://c.example.edu/y">'
    rows = [
        (1, "https://www.Example.COM/en/1?x#y", None, 1), (2, "http://a.com/en/7", "", 1), (3, "http://example.com/en/77", "", 1), (4, "http://notexample.com", "", 1),
        (5, None, canonical, 1), (6, "nohost", canonical, 1), (7, "ftp://a.example.edu/1", canonical, 1), (8, "https://b.example.org/x", refresh, 1),
        (9, "http://c.example.edu/y", "", 1), (10, "http://z.org/es/1", "", 1), (10, "http://z.org/es/1", "", 1),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, rule int")
    links = spark.createDataFrame([("http://c.example.edu/y", "http://z.org/es/1"), (None, "x")], "src string, dst string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_filter(pages, url_filters.RULES, links).collect()}
    assert got[1] == ("www.example.com", "/en/1", "com/en/", "block")
    assert got[3] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[4] == ("notexample.com", "", None, "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    # the block on z.org reaches every alias of its component
    assert got[7][3] == got[8][3] == got[9][3] == got[10][3] == "block"
    allowed = url_filters.url_filter(pages, [*url_filters.RULES, ("allow", "b.example.org/")], links)
    assert {r["page_id"]: r["verdict"] for r in allowed.collect() if r["page_id"] in (7, 8, 9, 10)} == {7: "allow", 8: "allow", 9: "allow", 10: "block"}
    assert url_filters.url_filter(pages.limit(0), url_filters.RULES).count() == 0


def test_a_block_reaches_aliases_named_in_every_form(spark):
    canonical, refresh = "<link rel='canonical' href='{}'>", '<meta http-equiv="refresh" content="0; url={}">'
    blocked = "http://h{}.org/es/x"
    forms = [
        canonical.format("/es/x"), canonical.format("../es/x"), canonical.format("./../a/../es/x"), refresh.format("'/es/x'"), refresh.format("/es/x"),
        canonical.format("//h{}.org/es/x"), canonical.format("HTTP://H{}.ORG/es/x"), refresh.format("'http://h{}.org/es/x'"), refresh.format(" ../es/x#top"),
        "<meta http-equiv=refresh content='0; URL=\"http://h{}.org/es/x\"'>",
    ]
    rows = []
    for i, form in enumerate(forms):
        rows += [(2 * i, f"http://H{i}.org/q/a?b#c", form.replace("{}", str(i))), (2 * i + 1, blocked.format(i), "")]
    rows += [(100, "http://free.org", canonical.format("mailto:a@b.org")), (101, "http://free.org/a", canonical.format("")), (102, "http://free.org", canonical.format("es/1"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["alias_of"]) for r in url_filters.url_filter(pages, [("block", "org/es/")]).collect()}
    assert all(got[2 * i][0] == got[2 * i + 1][0] == "block" and got[2 * i][1] == blocked.format(i) for i in range(len(forms)))
    # both pages of one url are its aliases
    assert got[100][0] == got[102][0] == "block" and got[101] == ("allow", None)
    allowed = {r["page_id"]: r["verdict"] for r in url_filters.url_filter(pages, [("block", "org/q/"), ("allow", "org/es/")]).collect()}
    assert all(allowed[2 * i] == "block" and allowed[2 * i + 1] == "allow" for i in range(len(forms)))


def test_many_rules_are_joined(spark, monkeypatch):
    rows = [(1, "http://a.b.com/p/1"), (2, "http://com/p"), (3, "http://x.net/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").select("page_id", url_filters.host_of("url").alias("host"), url_filters.path_of("url").alias("path"))
    rules = [("block", "com/"), ("allow", "b.com/p"), ("block", "net/q"), ("allow", "com/")]
    inline = url_filters.match_rules(df, rules).orderBy("page_id").collect()
    monkeypatch.setattr(url_filters, "MAX_INLINE_RULES", 1)
    joined = url_filters.match_rules(df, rules).select(*inline[0].asDict()).orderBy("page_id").collect()
    assert [tuple(r) for r in inline] == [tuple(r) for r in joined]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[501] == 500
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_linked_sets_share_signatures():
    rng = np.random.default_rng(0)
    for n in [*range(1, 60), 100, 333, 2000]:
        for _ in range(12):
            a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
            k = int(rng.integers(0, max(1, len(a) // 4) + 1))
            b = np.unique(np.concatenate([a[k // 2 :], rng.integers(1, 2**63, k - k // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            least = 1 + min(spare(len(a)), spare(len(b)))
            assert len(np.intersect1d(signatures(a), signatures(b))) >= least
            assert sketch_distance(parity_sketch(a), parity_sketch(b)) <= len(a) + len(b) - 2 * both
            common = a[::3]
            (x, enough), (y, _) = (rare_signatures(np.setdiff1d(s, common), len(s)) for s in (a, b))
            assert not enough or len(np.intersect1d(x, y)) >= 1
    assert len(signatures(np.empty(0, np.uint64))) == 0
