import random

from ledgerspark.operators import retrieval
from ledgerspark.operators.retrieval import QUERY_STOP_WORDS


def words(text):
    import re

    return {w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 2 and w not in QUERY_STOP_WORDS}


def test_each_query_finds_the_first_that_is_near_equal(spark):
    rng = random.Random(6)
    pool = [f"word{i}" for i in range(9)]
    rows = [(rng.choice([1, 1, 1, 2, None]), i, " ".join(rng.sample(pool, rng.randint(1, 6))) + rng.choice(["", " the of", " UP"])) for i in range(220)]
    rows += [(3, i, rng.choice(["yes", "yes please", "Yes, please!", None, "", "to of"])) for i in range(60)] + [(1, 500, rows[0][2]), (1, 500, "word1")]
    got = retrieval.repeated_queries(spark.createDataFrame(rows, "s bigint, t bigint, q string").repartition(3), "s", "t", "q").collect()
    want = []
    for s, t, q in rows:
        a, best = words(q), None
        for s2, t2, q2 in rows:
            b = words(q2)
            if s2 == s and t2 < t and not (a or b) and (q or "").strip() and (q or "").strip().lower() == (q2 or "").strip().lower():
                best = t2 if best is None else min(best, t2)
            if s2 == s and t2 < t and a and b:
                n = len(a & b)
                if n / len(a | b) >= 0.7 or (n >= 2 and n / min(len(a), len(b)) >= 0.75):
                    best = t2 if best is None else min(best, t2)
        want.append((s, t, best))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[2] is not None for r in want) > 50


def test_no_side_of_the_joins_is_broadcast(spark, tmp_path):
    """Words of small columns are many times their size, so a planner that goes by the file would broadcast them."""
    q = spark.range(20_000).selectExpr("id % 1000 AS s", "id AS t", "concat_ws(' ', transform(sequence(1, 12), i -> concat('question', pmod(xxhash64(id % 20, i), 40)))) AS q")
    q.coalesce(1).write.parquet(str(tmp_path / "q"))
    found = retrieval.repeated_queries(spark.read.parquet(str(tmp_path / "q")), "s", "t", "q")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
