"""The clustered index is exact: recall 1 against all distances, with few cells visited where data have clusters."""

import numpy as np
import pytest

from ledgerspark.operators.vector_index import VectorIndex, fit_centres, unit


def data(n=900, d=12, groups=15, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 4
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.5


@pytest.mark.parametrize("ring_rows, k", [(2048, 10), (30, 10)])
def test_exact_with_few_cells(spark, tmp_path, ring_rows, k):
    x = data()
    x[10:30] = x[5]  # ties go to the smaller key
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [None] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>").repartition(3)
    index = VectorIndex(spark, str(tmp_path), cells=15, ring_rows=ring_rows).build(df)
    hits, visited = index.search(df.withColumnRenamed("chunk_id", "query_id").where("query_id % 30 = 5 OR query_id > 1999"), k)
    u = unit(x.astype(np.float32).astype(np.float64))
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk"], r["distance"]))
    assert set(got) == set(range(5, 900, 30))
    for i, found in got.items():
        far = 1 - u @ u[i]
        want = sorted(range(900), key=lambda j: (round(far[j], 9), j))[:k]
        found.sort()
        assert [round(f[2], 6) for f in found] == [round(far[j], 6) for j in want]
        if i == 5:
            assert [f[1] for f in found] == [5, *range(10, 30)][:k]
    v = visited.collect()
    assert len(v) == len(got) and np.mean([r["cells"] for r in v]) < 8 and np.mean([r["rows"] for r in v]) < 500


def test_fewer_rows_than_wanted_and_none(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id bigint, embedding array<float>")
    index = VectorIndex(spark, f"{tmp_path}/a").build(df)
    hits, _ = index.search(df.withColumnRenamed("chunk_id", "query_id"), 10)
    assert sorted((r["query_id"], r["rank"], r["chunk"]) for r in hits.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    assert VectorIndex(spark, f"{tmp_path}/b").build(df.limit(0)).search(df.withColumnRenamed("chunk_id", "query_id"))[0].count() == 0


def test_centres_are_used_by_all_cells():
    x = unit(data())
    c = fit_centres(x, 15)
    assert len(np.unique((x @ c.T).argmax(1))) > 10 and np.allclose((c * c).sum(1), 1)
    assert len(fit_centres(x[:3], 15)) == 3
