"""Kept tables: versions, whole-key replacement, failures, replays; vendors and the star across batches."""

import decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import star_store
from ledgerspark.operators.components import components
from ledgerspark.operators.extraction import field
from ledgerspark.sources.keyed import Conflict, KeyedTable
from ledgerspark.sources.workspace import Workspace

SCHEMA = "k bigint, n int, word string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=5)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_keys_are_replaced_as_a_whole_and_versions_stay_readable(spark, table):
    df = lambda data: spark.createDataFrame(data, SCHEMA)
    assert table.read().count() == 0 and table.version() == 0
    table.upsert(df([(k, n, "a") for k in range(20) for n in range(3)] + [(None, 0, "null key")]))
    table.upsert(df([(3, 9, "b"), (99, 0, "new"), (None, 1, "null key again")]))
    want = [(k, n, "a") for k in range(20) if k != 3 for n in range(3)] + [(3, 9, "b"), (99, 0, "new"), (None, 1, "null key again")]
    assert rows(table.read()) == sorted(want, key=str)
    assert table.read(1).count() == 61 and table.version() == 2
    # an int key finds its bigint rows
    assert rows(table.rows_of(spark.createDataFrame([(3,), (4,)], "k int"))) == sorted([(3, 9, "b")] + [(4, n, "a") for n in range(3)], key=str)
    table.delete(spark.createDataFrame([(4,), (None,)], "k bigint"))
    assert {r[0] for r in rows(table.read())} == {*range(20), 99} - {4}
    table.delete(table.read().select("k"))
    assert table.read().count() == 0
    table.vacuum(1)
    with pytest.raises(ValueError):
        table.read(2)
    table.upsert(df([(1, 1, "after")]))
    assert rows(table.read()) == [(1, 1, "after")]


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("n"), F.lit("x").alias("word")))
    table.upsert(spark.createDataFrame([(7, 2, "y")], SCHEMA))
    holds = table._current()["holds"]
    assert sorted(v.split("-")[0] for v in holds.values()) == ["1", "1", "1", "1", "2"]
    assert table.read().count() == 100


def test_a_failure_between_write_and_swap_changes_nothing(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(1, 1, "old"), (2, 1, "old")], SCHEMA))
    new = spark.createDataFrame([(1, 1, "new")], SCHEMA)

    def lost(manifest):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(table, "_swap", lost)
    with pytest.raises(RuntimeError):
        table.upsert(new)
    monkeypatch.undo()
    assert rows(table.read()) == [(1, 1, "old"), (2, 1, "old")] and table.version() == 1
    # half a manifest is no version either
    (folder := __import__("pathlib").Path(table.path) / "_versions" / "2.json").write_text('{"version": 2, "ho')
    assert table.version() == 1 and rows(table.read())[0][2] == "old"
    table.upsert(new)
    assert table.version() == 3 and rows(table.read()) == [(1, 1, "new"), (2, 1, "old")] and folder.exists()


def test_batches_are_applied_once_and_writers_conflict(spark, table):
    new = spark.createDataFrame([(1, 1, "a")], SCHEMA)
    add = lambda old, fresh: old.unionByName(fresh)
    assert table.upsert(new, add, ("s", 0)) and not table.upsert(new, add, ("s", 0)) and table.upsert(new, add, ("s", 1)) and table.upsert(new, add, ("other", 0))
    assert table.read().count() == 3
    other = KeyedTable(spark, table.path, SCHEMA, ["k"], buckets=5)
    with pytest.raises(Conflict):
        table.upsert(new, lambda old, fresh: fresh.unionByName(fresh) if other.upsert(new) else fresh)
    assert table.read().count() == 1 and table._current()["taken"] == table.version() == 4


def test_components_of_chains_stars_and_lone_nodes(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("s000", f"t{i}") for i in range(9)] + [("lone", "lone"), ("half", None), (None, "other")]
    got = dict(components(spark.createDataFrame(links, "a string, b string"), Workspace(spark, "test")).collect())
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and {got[f"t{i}"] for i in range(9)} == {"s000"}
    assert got["lone"] == "lone" and got["half"] == "half" and got["other"] == "other" and len(got) == 61 + 10 + 3


FOUND = "document_id bigint, vendor_code string, seller_tax_id string, seller_name string, address string"


def test_vendors_across_batches(spark):
    work = Workspace(spark, "test")
    none = spark.createDataFrame([], star_store.VENDORS)
    one = [(1, "A", "T1", None, None), (2, None, "T1", "Acme", "Street 1"), (3, None, None, " ACME ", "Street 2"), (4, "B", None, "Beta", None), (5, None, None, None, "x"), (6, "", None, "", "x"), (7, None, "T7", None, None)]
    r = star_store.resolve_vendors(spark.createDataFrame(one, FOUND), none, work)
    vendors = {v["vendor_id"]: tuple(v) for v in r.vendors.collect()}
    assert dict(r.documents.collect()) == {1: 1, 2: 1, 3: 1, 4: 2, 7: 3}
    assert vendors == {1: (1, "Acme", "A", "T1", "Street 1"), 2: (2, "Beta", "B", None, None), 3: (3, "Vendor T7", None, "T7", None)}
    two = [
        (10, "B", "T1", None, "Road 2"),  # its code outweighs its tax id; the address is filled in, the code's missing tax id too
        (11, "X", "T1", None, "Road 3"),  # a new code with a known tax id: that vendor, whose code stays
        (12, "Z", "T9", None, None), (13, None, "T9", "Gamma", None), (14, None, None, "gamma", "Lane"),  # a chain of new ones
        (15, "Q", None, "Delta", None), (16, "Q", "T7", None, None),  # tied to an earlier vendor over a document of the batch
    ]
    existing = r.vendors
    r = star_store.resolve_vendors(spark.createDataFrame(two, FOUND), existing, work)
    assert dict(r.documents.collect()) == {10: 2, 11: 1, 12: 4, 13: 4, 14: 4, 15: 3, 16: 3}
    vendors = {v["vendor_id"]: tuple(v) for v in r.vendors.collect()}
    assert vendors[1] == (1, "Acme", "A", "T1", "Street 1") and vendors[2] == (2, "Beta", "B", "T1", "Road 2")
    assert vendors[3] == (3, "Vendor T7", "Q", "T7", None) and vendors[4] == (4, "Gamma", "Z", "T9", "Lane")


def _results(spark, data):
    """(id, document_id, number, total, lines)"""
    lines = "array<struct<description:string,quantity:decimal(15,4),unit_price:decimal(15,4),net_amount:decimal(15,2),gross_amount:decimal(15,2)>>"
    df = spark.createDataFrame(data, "id bigint, document_id bigint, number string, total string, n int")
    f = lambda c: field(c, F.lit(0.9), F.lit("x"))
    entries = F.array(F.struct(F.lit("invoice_number").alias("key"), f(F.col("number")).alias("value")), F.struct(F.lit("grand_total_amount").alias("key"), f(F.col("total")).alias("value")),
                      F.struct(F.lit("vendor_code").alias("key"), f(F.lit("V1")).alias("value")))
    item = F.struct(F.lit("item").alias("description"), F.lit(1).alias("quantity"), F.lit(2).alias("unit_price"), F.lit(2).alias("net_amount"), F.lit(2).alias("gross_amount"))
    return df.select("id", "document_id", F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.map_from_entries(entries).alias("fields"), F.array_repeat(item, F.col("n")).cast(lines).alias("line_items"))


def test_star_is_replaced_by_document_and_payments_stay(spark, tmp_path):
    store = star_store.StarStore(spark, str(tmp_path / "star"), buckets=3)
    store.sync(_results(spark, [(1, 1, "I-1", "100.00", 3), (2, 2, "I-2", None, 1), (3, 3, None, None, 0)]), ("r", 0))
    assert {r["document_id"] for r in store.invoices.read().collect()} == {1, 2}  # the third tells nothing
    paid = store.obligations.read().where("document_id = 1").withColumn("amount_paid", F.lit(30).cast("decimal(15,2)")).withColumn("status", F.lit("DISPUTED"))
    store.obligations.upsert(paid)
    before = store.obligations.version()
    again = _results(spark, [(9, 1, "I-1b", "150.00", 1), (8, 1, "I-1a", "140.00", 2), (10, 2, "I-2", "50.00", 0)])
    for _ in range(2):  # a replay changes nothing
        bad = store.sync(again, ("r", 1))
    assert bad.count() == 0 and store.obligations.version() == before + 1
    got = {r["document_id"]: r for r in store.obligations.read().collect()}
    assert (got[1]["amount_due"], got[1]["amount_outstanding"], got[1]["status"]) == (decimal.Decimal("150.00"), decimal.Decimal("120.00"), "DISPUTED")
    assert got[2]["status"] == "OPEN"  # was UNKNOWN
    inv = {r["document_id"]: r for r in store.invoices.read().collect()}
    assert inv[1]["source_extraction_result_id"] == 9 and inv[1]["invoice_number"] == "I-1b" and inv[1]["vendor_id"] == inv[2]["vendor_id"] == 1
    assert [r["document_id"] for r in store.lines.read().collect()] == [1]  # three lines became one, the other's went


def test_vendors_of_many_ranges_are_numbered_without_gaps(spark):
    """More new vendors than one range holds: bounds that are sampled twice would number some twice."""
    n = 250_000
    found = spark.range(n).select(
        (F.col("id") * 7919 % n).alias("document_id"), F.concat(F.lit("C"), F.col("id") * 7919 % n).alias("vendor_code"),
        *[F.lit(None).cast("string").alias(c) for c in ("seller_tax_id", "seller_name", "address")]).repartition(7)
    existing = spark.createDataFrame([], star_store.VENDORS)
    got = star_store.resolve_vendors(found, existing, Workspace(spark, "ranges")).documents
    assert got.count() == n and got.where("vendor_id <> document_id + 1").count() == 0
