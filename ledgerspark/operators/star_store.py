"""The star schema as kept tables: vendors, invoices, line items and obligations across batches (X-01 to X-06, J-08)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.operators import star
from ledgerspark.operators.components import components
from ledgerspark.sources.keyed import KeyedTable
from ledgerspark.sources.workspace import Workspace

VENDORS = "vendor_id bigint, canonical_name string, vendor_code string, tax_id string, address string"
INVOICES = (
    "document_id bigint, source_extraction_result_id bigint, vendor_id bigint, invoice_number string, invoice_date date, vendor_code string, seller_tax_id string, seller_name string, "
    "buyer_name string, currency string, subtotal_amount decimal(15,2), tax_amount decimal(15,2), grand_total_amount decimal(15,2), due_date date, payment_terms string"
)
LINES = "document_id bigint, line_number int, description string, quantity decimal(15,4), unit_price decimal(15,4), net_amount decimal(15,2), gross_amount decimal(15,2)"
OBLIGATIONS = (
    "document_id bigint, amount_due decimal(15,2), amount_paid decimal(15,2), amount_outstanding decimal(15,2), currency string, due_date date, payment_terms string, status string"
)


def _name_key(name):
    return F.lower(F.trim(name))


def _keys(code: str, tax: str, name: str):
    """Keys in the order of their weight; one that is null or empty is none."""
    key = lambda kind, c: F.when(F.trim(c) != "", F.concat(F.lit(kind), c))
    return [key("c:", F.col(code)), key("t:", F.col(tax)), key("n:", _name_key(F.col(name)))]


@dataclass
class Resolved:
    """``documents`` (document_id, vendor_id) and their ``vendors`` as they now are, earlier ones among them."""

    documents: DataFrame
    vendors: DataFrame


def resolve_vendors(found: DataFrame, existing: DataFrame, work: Workspace) -> Resolved:
    """X-02, J-08: found (document_id, vendor_code, seller_tax_id, seller_name, address) against vendors of earlier batches.

    A document is its code's vendor, else its tax id's, else its name's (in any case). Where no earlier
    vendor has any of its keys, documents of the batch that share a key, directly or over others, are one
    vendor: an earlier one if any document so tied belongs to one (the least such), else a new one. New
    vendors are numbered after the highest, by their least document. Attributes are filled in where they
    are null, from the least document that has them, and never overwritten; a new vendor's name falls back to its code,
    then its tax id. Documents without code, tax id and name have no vendor.
    """
    keys = _keys("vendor_code", "seller_tax_id", "seller_name")
    rows = work.keep(found.select(
        "document_id", "vendor_code", "seller_tax_id", "seller_name", "address", F.array_compact(F.array(*keys)).alias("keys"),
    ).where(F.size("keys") > 0))
    owners = existing.select("vendor_id", F.explode(F.array_compact(F.array(*_keys("vendor_code", "tax_id", "canonical_name")))).alias("key"))
    owners = owners.groupBy("key").agg(F.min("vendor_id").alias("vendor_id"))
    # keys are in the order of their weight
    hits = rows.select("document_id", F.posexplode("keys").alias("i", "key")).join(owners, "key").groupBy("document_id").agg(F.min_by("vendor_id", "i").alias("direct"))
    rows = work.keep(rows.join(hits, "document_id", "left"))

    first = F.element_at("keys", 1)
    links = rows.select(first.alias("a"), F.explode("keys").alias("b"))
    tied = components(links, work)
    rows = rows.withColumn("key", first).join(tied.withColumnRenamed("node", "key"), "key").drop("key")
    groups = rows.groupBy("component").agg(F.min("direct").alias("known"), F.min("document_id").alias("first"))
    top = existing.agg(F.max("vendor_id")).first()[0] or 0
    groups = work.keep(_numbered(groups, top, work))
    rows = work.keep(rows.join(groups.select("component", "own"), "component").withColumn("vendor_id", F.coalesce("direct", "own")))

    least = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.col("document_id")))
    told = rows.groupBy("vendor_id").agg(
        least("seller_name").alias("_name"), least("vendor_code").alias("_code"), least("seller_tax_id").alias("_tax"), least("address").alias("_address"))
    both = told.join(existing, "vendor_id", "left")
    name = F.coalesce("canonical_name", F.trim("_name"), F.concat(F.lit("Vendor "), F.coalesce("_code", "_tax")))
    vendors = both.select(
        "vendor_id", name.alias("canonical_name"), F.coalesce("vendor_code", "_code").alias("vendor_code"), F.coalesce("tax_id", "_tax").alias("tax_id"), F.coalesce("address", "_address").alias("address"))
    return Resolved(rows.select("document_id", "vendor_id"), vendors)


def _numbered(groups: DataFrame, top: int, work: Workspace) -> DataFrame:
    """Adds ``own``: the known vendor, or for new ones the numbers after ``top`` in the order of their first documents."""
    new = groups.where("known IS NULL")
    parts = max(1, -(-new.count() // 100_000))
    # ranks over sorted ranges: each range counts on from the rows of those before it; the bounds are sampled anew by every
    # reading, so the ranges are written before they are counted and ranked
    ranged = work.keep(new.repartitionByRange(parts, "first").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").count()
    ahead = sizes.withColumn("ahead", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("count")).drop("count")  # a row for each range
    rank = F.row_number().over(Window.partitionBy("part").orderBy("first"))
    numbered = ranged.withColumn("rank", rank).join(F.broadcast(ahead), "part").select("component", (F.col("rank") + F.col("ahead") + top).cast("long").alias("number"))
    return groups.join(numbered, "component", "left").withColumn("own", F.coalesce("known", "number")).drop("number")


class StarStore:
    """Kept tables below one folder. A batch is whole or not at all in each of them, and can be replayed under its number."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder = spark, folder
        table = lambda name, schema, key: KeyedTable(spark, f"{folder}/{name}", schema, [key], buckets)
        self.vendors = table("vendors", VENDORS, "vendor_id")
        self.invoices = table("invoices", INVOICES, "document_id")
        self.lines = table("lines", LINES, "document_id")
        self.obligations = table("obligations", OBLIGATIONS, "document_id")

    def sync(self, results: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Results (id, document_id, created_at, fields[, line_items]) -> tables; returns (document_id, error) of those that tell nothing.

        Each document's latest result counts. Vendors are changed before the invoices that name them, and
        the obligation, which ends a document's projection, last. What was paid and a status other than
        UNKNOWN are kept (X-04); line items are replaced as a whole, by none if there are none (X-03).
        """
        work = Workspace(self.spark, "star-sync")
        latest = star.latest_per_key(results, ["document_id"], ["created_at", "id"])
        good, bad = star.isolated(latest, star.invoices)
        good = work.keep(good.join(latest.select("document_id", star.value("seller.address", "seller_address").alias("address")), "document_id"))
        resolved = resolve_vendors(good, self.vendors.read(), work)
        self.vendors.upsert(resolved.vendors, batch=batch)
        invoices = work.keep(good.join(resolved.documents, "document_id", "left"))
        self.invoices.upsert(invoices, batch=batch)
        self.lines.upsert(self._lines(latest, invoices), merge=lambda old, new: new.where("line_number IS NOT NULL"), batch=batch)
        self.obligations.upsert(star.obligations(invoices), merge=lambda old, new: star.obligations(_due(new), old), batch=batch)
        return bad

    def _lines(self, latest: DataFrame, invoices: DataFrame) -> DataFrame:
        """Lines of the documents, and for each a row without a number, so that documents without lines lose their old ones."""
        none = self.spark.createDataFrame([], LINES).unionByName(invoices.select("document_id"), allowMissingColumns=True)
        if "line_items" not in latest.columns:
            return none
        lines = star.line_items(latest.join(none, "document_id", "left_semi"))
        return none.unionByName(lines, allowMissingColumns=True).select(*none.columns)


def _due(obligations: DataFrame) -> DataFrame:
    return obligations.select("document_id", F.col("amount_due").alias("grand_total_amount"), "currency", "due_date", "payment_terms")
