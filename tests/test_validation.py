"""Duplicates by meaning, on planted groups."""

from ledgerspark.operators import validation


def test_every_content_of_a_group_is_compared(spark):
    rows = [(1, "d1", "t1"), (2, "d2", "t2"), (3, "d2", None), (4, "d2", None), (5, None, "t1"), (6, "d3", "t3"), (7, "d2", "t2")]
    df = spark.createDataFrame([(i, "NPO", " S ", "n", d, t) for i, d, t in rows], "id int, document_type string, seller string, number string, date string, total string")
    got = {(r["id"], r["other_id"], r["kind"]) for r in validation.semantic_duplicates(df).collect()}
    assert got == {(7, 2, "strong")} | {(i, j, "potential") for i, j in [(3, 2), (4, 2), (7, 3), (4, 3), (5, 1), (5, 3), (4, 5)]}
