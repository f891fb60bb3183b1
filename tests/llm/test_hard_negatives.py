import math
import random

import numpy as np
import pytest

from ledgerspark.llm import hard_negatives, topk_search

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, v string"


def vectors() -> list[tuple]:
    rng = random.Random(13)
    rows = []
    for i in range(600):
        c = i % 4
        rows.append((i, [rng.gauss(0.3 if k == c else 0.25, 0.1) for k in range(6)], rng.choice([c, c, 1, None if i % 50 == 7 else 2]), "x", "y"))
    rows += [(1000 + i, list(rows[3][1]), 2, "x", "y") for i in range(300)]  # one vector, many ids
    rows += [(2000, list(rows[5][1]), 3, "x", "y")] * 90  # one row, many times
    rows += [(3000, None, 1, "x", "y"), (3001, [None] * 6, 1, "x", "y"), (3002, [float("nan")] * 6, 1, "x", "y"), (3003, [float("-inf")] * 6, 1, "x", "y"), (3100, [1e30] * 6, 1, "x", "y"),
             (3200, [0.5] * 3, 1, "x", "y"), (3300, [], 1, "x", "y"), (None, [0.3] * 6, 1, "x", "y"), (2**63 - 1, list(rows[9][1]), 2, "x", "y"), (-(2**63), list(rows[9][1]), 1, "x", "y")]
    rows += [(100, list(rows[100][1]), rows[100][2], "x", "y"), (200, list(rows[7][1]), 0, "x", "y"), (4000, [-0.3] * 6, 2, "x", "y"), (4100, [0.0] * 6, 2, "x", "y")]
    return rows


def brute(rows, positives, negatives, low=30, high=90):
    use = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if sum(x * x for x in v) < 2**56:
            use.append((i, label, v))
    out = []
    for a, label, v in {u for u in use if u[0] % 100 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in use if i != a and len(w) == len(v))
        for p, i, same in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, block, buckets, handful", [(10_000, 512, 256, 64), (90, 3, 256, 0), (300, 8, 40, 0)])
def test_mining_matches_brute_force(spark, shard_rows, block, buckets, handful):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.mine(df, df.where("vec_id % 100 = 0"), 3, 8, shard_rows=shard_rows, block_anchors=block, handful=handful, buckets=buckets)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 8)
    assert len({r[0] for r in brute(rows, 3, 8)}) > 8


def test_nothing_to_mine(spark):
    df = spark.createDataFrame(vectors(), SCHEMA)
    assert hard_negatives.mine(df.limit(0), df.limit(0)).count() == 0
    assert hard_negatives.mine(df, df.limit(0)).count() == 0
    assert hard_negatives.mine(df.where("label = 1"), df.where("vec_id % 100 = 0 AND label = 1")).count() == 0


def test_histograms_stop_where_enough_rows_are_reached():
    score, ids = np.array([9, 9, 5, 5, 5, 0]), np.array([4, 3, 2, 1, 0, 9])
    at, n = hard_negatives.histogram(score, ids, 0, 9, 3, 0, 9)
    assert at.tolist() == [0, 4] and n.tolist() == [2, 3]
    at, n = hard_negatives.histogram(score, ids, 5, 5, 1, 0, 9)
    assert at.tolist() == [0] and n.tolist() == [1]
    s, i = hard_negatives.first_rows(score, ids, 5, 9, 3, 9)
    assert s.tolist() == [9, 9, 5] and i.tolist() == [3, 4, 0]


def test_exact_products_in_every_range():
    rng = np.random.default_rng(1)
    for reach in (50, 2**20, 2**28):
        q, x = rng.integers(-reach, reach, (4, 6)), rng.integers(-reach, reach, (5, 6))
        assert (topk_search.products(q, x) == np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in q])).all()


def test_blocks_beside_shards_are_not_broadcast(spark):
    """A block's copies are many times the size of its file; 40 shards get it in lanes, each pair once."""
    rows = spark.range(400).selectExpr("id AS vec_id", "transform(sequence(1, 16), i -> CAST(pmod(xxhash64(id, i), 97) AS FLOAT)) AS embedding", "CAST(id % 3 AS INT) AS label")
    s = hard_negatives.Selector(rows, rows.where("vec_id % 20 = 0"), 1, 10, 8, 8, 16)
    pairs = s._against_shards(s.anchors.selectExpr("a AS w", "a", *[f"0L AS {c}" for c in hard_negatives._STATE[1:]]))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == s.shards * s.anchors.select("block").distinct().count()
