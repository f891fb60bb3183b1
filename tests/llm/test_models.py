"""Held-out accuracy, exact small solutions, long texts, and rules without switches."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import mixing, quality_classifier, quality_rules, toxicity, url_filters
from ledgerspark.llm.url_filters import MIRRORS_SQL

from .conftest import prose

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    values, first, count = np.unique(np.asarray(score)[order], return_index=True, return_counts=True)
    for f, c in zip(first, count):
        rank[order[f : f + c]] = f + (c + 1) / 2
    good = np.asarray(label) == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("op,label,folds,fold,floor", [
    (quality_classifier.op5_quality_classifier, "quality", 5, 0, 0.97), (toxicity.op6_toxicity, "toxic", 4, 2, 0.93),
])
def test_held_out_accuracy(spark, op, label, folds, fold, floor):
    rows = {r["doc_id"]: r for r in op(spark, SF).collect()}
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i in list(rows)[:200]:
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % folds == fold)
    test = [i for i in known if i in rows and rows[i]["held_out"] and known[i] in (0, 1)]
    score, y = np.array([rows[i]["score"] for i in test]), np.array([known[i] for i in test])
    assert len(test) > 300 and auc(score, y) > floor
    assert np.mean((score >= 0.3) == y) > 0.9


def test_a_long_text_scores_like_the_whole():
    rng = np.random.default_rng(4)
    net = quality_classifier.Network(rng)
    for n in (quality_classifier.PART_BYTES + 1, 3 << 20, (3 << 20) + 5):
        for text in (rng.integers(1, 255, n, dtype=np.uint8).tobytes(), (b"some words again and again " * (n // 27 + 1))[:n]):
            assert net.pooled_in_parts(text) == pytest.approx(net.pooled([text])[0], abs=1e-4)


def test_every_term_that_stands_out_votes():
    bad = [f"vile{chr(97 + i // 26)}{chr(97 + i % 26)}word" for i in range(400)]
    rng = random.Random(2)
    texts = [prose(rng, 30) + " " + " ".join(rng.sample(bad, 60)) for _ in range(150)] + [prose(rng, 60) for _ in range(900)]
    y = np.array([1] * 150 + [0] * 900, np.float32)
    voters = toxicity.find_voters([toxicity.words_of(t) for t in texts], y)
    assert set(bad) <= set(voters.words)


def test_rules_of_equal_length_go_one_way(spark, monkeypatch):
    df = spark.createDataFrame([("a.b.com", "/p/1"), ("b.com", "/p/1"), ("x.com", "/q")], "host string, path string")
    rules = [("block", "b.com/p"), ("block", "com/p/1"), ("block", "x.com/q"), ("allow", "x.com/q"), ("allow", "com/q")]
    inline = {tuple(r) for r in url_filters.match_rules(df, rules).collect()}
    monkeypatch.setattr(url_filters, "MAX_INLINE_RULES", 1)
    assert inline == {tuple(r) for r in url_filters.match_rules(df, rules).select("host", "path", "rule", "ruled").collect()}
    assert ("a.b.com", "/p/1", "b.com/p", "block") in inline and ("x.com", "/q", "x.com/q", "allow") in inline


def test_mirrors_pass_verdicts_on(spark):
    urls = ["http://a.com/en/1", "http://b.net/en/1/", "http://c.net/en/1.html", "http://example.com/en/77", "http://d.net/en/77", "http://e.org/es/2", "http://f.edu/es/2", "http://g.edu/es/3"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.url_filter(pages, url_filters.RULES, url_filters.path_aliases(pages)).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow"}
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, NULL)", list(enumerate(urls)))
    assert {r[0]: r[4] for r in c.execute(MIRRORS_SQL).fetchall()} == got


def test_host_verdicts_reach_their_documents(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80) if i % 4 == 0 else "too short", "bad") for i in range(40)]
    rows += [(100 + i, prose(rng, 80) if i % 10 else "too short", "good") for i in range(60)] + [(200, prose(rng, 80), "one"), (201, prose(rng, 80), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    share = {"bad": (30, 40), "good": (6, 60), "one": (0, 1), None: (0, 1)}
    raw = np.array([f / n for f, n in share.values()])
    mean, spread = raw.mean(), raw.var(ddof=1) - raw.mean() * (1 - raw.mean()) * np.mean([1 / n for _, n in share.values()])
    strength = max(0.01, min(1e6, mean * (1 - mean) / max(spread, 1e-9) - 1))
    for i, text, source in rows:
        f, n = share[source]
        rate = (f + mean * strength) / (n + strength)
        failed = len(text.split()) < 50
        assert got[i]["host_rate"] == pytest.approx(rate, abs=1e-8) and got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not failed and rate <= 0.5)
    assert not got[0]["base_failed"] and not got[0]["kept"] and got[101]["kept"]


def least_squares(p, tokens, target, weight, cap):
    """Slow exact solution: projected gradient with momentum on whole documents, until nothing moves."""
    a = (p * tokens[:, None]).T * np.sqrt(weight)[:, None]
    b = target * np.sqrt(weight)
    step = 1 / np.linalg.norm(a, 2) ** 2
    r, y, k = np.ones(len(tokens)), np.ones(len(tokens)), 1.0
    for _ in range(20_000):
        new = np.clip(y - step * (a.T @ (a @ y - b)), 0, cap)
        n = (1 + np.sqrt(1 + 4 * k * k)) / 2
        y, r, k = new + (k - 1) / n * (new - r), new, n
    return ((a @ r - b) ** 2).sum()


@pytest.mark.parametrize("weights,cap", [((0.3, 0.3, 0.4), 1.0), ((0.9, 0.05, 0.05), 1.0), ((0.2, 0.1, 0.7), None)])
def test_rates_solve_the_least_squares(docs, labels, weights, cap):
    fitted, state = mixing.fit(docs, labels, dict(zip(mixing.DOMAINS, weights)), max_rate=cap)
    rows = state.collect()
    p, tokens = np.array([[r["p0"], r["p1"], r["p2"]] for r in rows]), np.array([r["tokens"] for r in rows], float)
    rate, target = np.array([r["rate"] for r in rows]), np.array(fitted.totals)
    now = p.T @ tokens
    weight = 1 / np.maximum(np.maximum(target, now), 1e-6 * tokens.sum())
    loss = (weight * (p.T @ (tokens * rate) - target) ** 2).sum()
    best = least_squares(p, tokens, target, weight, cap or 1e9)
    start = (weight * (now - target) ** 2).sum()
    assert loss <= best + 0.01 * max(start, 1e-9)


def test_kept_tokens_come_to_the_weights(spark, docs, labels):
    want = mixing.up_to_weights({"clean": 0.8, "low": 0.15, "toxic": 0.05})
    assert want(np.array([800.0, 400.0, 10.0])) == pytest.approx([800, 150, 10])
    fitted, state = mixing.fit(docs, labels, want, max_rate=1.0)
    kept = state.agg(*[F.sum(F.col("tokens") * F.col(f"p{d}") * F.col("rate")) for d in range(3)]).first()
    assert list(kept) == pytest.approx(fitted.totals, rel=0.05)
    assert kept[1] / sum(kept) == pytest.approx(0.15, abs=0.02) or kept[1] < 0.15 * sum(kept)


def test_columns_with_clashing_names(spark, labels):
    rows = [(i, "plain words " * 30, "old", 7.5, 3, "c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, rate double, tokens int, cell string")
    for op in (quality_classifier.quality_scores, toxicity.toxicity_scores):
        assert [c for c in op(docs, labels).columns] == ["doc_id", "text", "rate", "tokens", "cell", "score"]
        assert {r["score"] for r in op(docs, labels, name="mine").collect()} == {"old"}
    fitted, _ = mixing.fit(docs, labels)
    got = fitted.rated(docs, docs.columns, "my_rate").first()
    assert (got["tokens"], got["cell"], got["rate"]) == (3, "c", 7.5) and got["my_rate"] >= 0


def planted_votes(rng, n, voters):
    """Texts with a class, and for each (hit, false) rate the texts in which the voter votes."""
    y = rng.random(n) < 0.25
    return y, [np.where(y, rng.random(n) < hit, rng.random(n) < false) for hit, false in voters]


def as_votes(columns):
    dense = np.column_stack(columns)
    return dense.astype(float), toxicity.Votes([np.flatnonzero(row) for row in dense], dense.shape[1])


def test_the_label_model_recovers_planted_voters():
    # silence is no evidence in the model, which therefore counts on false votes being rare
    rates = [(0.7, 0.003), (0.5, 0.002), (0.6, 0.005), (0.4, 0.001), (0.8, 0.004), (0.5, 0.003)]
    y, columns = planted_votes(np.random.default_rng(5), 6000, rates)
    dense, votes = as_votes([*columns, columns[1]])  # the last voter is a copy of the second
    model = toxicity.LabelModel(votes, np.zeros(len(y)), 0.25, np.minimum(1, dense.sum(1) / 2))
    assert model.hit[:6] == pytest.approx([h for h, _ in rates], abs=0.08)
    assert model.false[:6] == pytest.approx([f for _, f in rates], abs=0.01)
    assert np.mean((model.posterior(votes, np.zeros(len(y))) > 0.5) == y) > 0.93
    pairs = {(a, b): c for a, b, c in zip(*model.correlated)}
    assert pairs[1, 6] == pairs[6, 1] == pytest.approx(1) and max(c for p, c in pairs.items() if set(p) != {1, 6}) < 0.5
    assert model.share[1] == model.share[6] == pytest.approx(0.5) and model.share[[0, 2, 3, 4, 5]] == pytest.approx(1)


def test_sparse_sums_equal_dense_ones():
    rng = np.random.default_rng(6)
    y, columns = planted_votes(rng, 800, [(0.5, 0.1)] * 12)
    dense, votes = as_votes([*columns, columns[0], columns[0] & (rng.random(800) < 0.8), np.zeros(800, bool)])
    weight = rng.random(800)
    assert votes.by_voter(weight) == pytest.approx(dense.T @ weight) and votes.by_row(weight[:15]) == pytest.approx(dense @ weight[:15])
    i, j, both = votes.together()
    want = dense.T @ dense
    often = (want >= 2) & (want >= 0.25 * np.sqrt(np.outer(np.diag(want), np.diag(want)))) & ~np.eye(15, dtype=bool)
    assert sorted(zip(i, j)) == [tuple(p) for p in np.argwhere(often)] and both == pytest.approx(want[i, j])
    model = toxicity.LabelModel(votes, np.zeros(800), 0.25, np.minimum(1, dense.sum(1) / 2), rounds=1)
    post = np.minimum(1, dense.sum(1) / 2)
    rest = dense - (np.outer(post, model.hit) + np.outer(1 - post, model.false))
    cov = rest.T @ rest
    assert model.correlated[2] == pytest.approx((np.abs(cov) / np.sqrt(np.outer(np.diag(cov), np.diag(cov))))[i, j])


def test_conjugate_steps_solve_the_dense_system():
    rng = np.random.default_rng(7)
    y, columns = planted_votes(rng, 500, [(0.4, 0.1)] * 20)
    dense, votes = as_votes(columns)
    rest, soft = rng.random((500, 3)), np.clip(y + rng.normal(0, 0.1, 500), 0, 1)
    got = toxicity.Classifier(toxicity.Voters([f"w{k}" for k in range(20)], []), votes, rest, soft)
    x = np.column_stack([dense, rest])
    p = 1 / (1 + np.exp(-(x @ got.w + got.c)))
    assert x.T @ (soft - p) == pytest.approx(0.1 * got.w, abs=1e-4) and (soft - p).sum() == pytest.approx(0, abs=1e-4)


def test_the_network_equals_a_plain_loop_over_chunks():
    q = quality_classifier
    rng = np.random.default_rng(8)
    net = q.Network(rng)
    texts = [b"", b"x", b"the the the cat sat", rng.integers(1, 255, 100, dtype=np.uint8).tobytes(), b"abcabcabc " * 30]
    for text, got in zip(texts, net.pooled(texts)):
        blocks = -(-len(text) // q.STRIDE) + 1
        padded = bytes(q.LEAD) + text + bytes(q.STRIDE * (blocks + 1))
        best = np.full(q.FILTERS, -np.inf)
        for k in range(-1, blocks - 1):
            answer = np.zeros(q.FILTERS)
            for side, at in (("left", k), ("right", k + 1)):
                begin = q.LEAD + q.STRIDE * at
                row = [v for b in padded[begin : begin + q.STRIDE] for v in net.p["embed"][b]]
                for lag in q.LAGS:
                    same = [padded[m] != 0 and m >= lag and padded[m] == padded[m - lag] for m in range(begin, begin + q.STRIDE)]
                    row.append(sum(same) / q.STRIDE)
                answer += np.array(row) @ net.p[side]
            best = np.maximum(best, answer)
        assert got == pytest.approx(best + net.p["bias"], abs=1e-4)
