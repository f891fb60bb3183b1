"""Extraction results to the star schema (X-01 to X-06, J-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.dates import stored_date
from ledgerspark.functions.numbers import stored_decimal
from ledgerspark.operators.tables import latest_per_key


def value(*keys: str) -> Column:
    """X-05: the first key that has a value: the path, then flat keys."""
    options = [F.try_element_at(F.col("fields"), F.lit(k))["value"] for k in keys]
    return F.coalesce(*[F.when(F.trim(v) != "", F.trim(v)) for v in options])


def invoices(results: DataFrame) -> DataFrame:
    """X-01: one invoice for each document, from its latest result."""
    r = latest_per_key(results.select("id", "document_id", "created_at", "fields"), ["document_id"], ["created_at", "id"])
    money = lambda *k: stored_decimal(value(*k))
    return r.select(
        "document_id", F.col("id").alias("source_extraction_result_id"),
        value("invoice_information.invoice_number", "invoice_number", "sales_invoice_number").alias("invoice_number"),
        stored_date(value("invoice_information.invoice_date", "invoice_date", "sales_invoice_date")).alias("invoice_date"),
        value("metadata.vendor_code", "vendor_code").alias("vendor_code"), value("seller.tax_id", "seller_tax_id").alias("seller_tax_id"),
        value("seller.name", "seller_name").alias("seller_name"), value("buyer.name", "buyer_name").alias("buyer_name"),
        value("invoice_information.currency", "currency").alias("currency"),
        money("totals.subtotal", "subtotal_net_amount").alias("subtotal_amount"), money("totals.total_tax", "total_tax_amount").alias("tax_amount"),
        money("totals.grand_total", "grand_total_amount").alias("grand_total_amount"),
        stored_date(value("payment.due_date", "due_date")).alias("due_date"), value("payment.payment_terms", "payment_terms").alias("payment_terms"),
    )


def vendors(found: DataFrame) -> DataFrame:
    """X-02, J-08: (vendor_key, canonical_name, vendor_code, tax_id): rows identified by code, else tax id, else name.

    Attributes come from the earliest document that has them; a code's missing tax id never matches another vendor.
    """
    d = found.where("vendor_code IS NOT NULL OR seller_tax_id IS NOT NULL OR seller_name IS NOT NULL")
    by_tax = d.where("vendor_code IS NOT NULL AND seller_tax_id IS NOT NULL").groupBy("seller_tax_id").agg(F.min_by("vendor_code", "document_id").alias("code_of_tax"))
    d = d.join(by_tax, "seller_tax_id", "left").withColumn("code", F.coalesce("vendor_code", "code_of_tax"))
    key = F.coalesce(F.concat(F.lit("code:"), "code"), F.concat(F.lit("tax:"), "seller_tax_id"), F.concat(F.lit("name:"), F.lower(F.trim("seller_name"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("document_id")))
    out = d.withColumn("vendor_key", key).groupBy("vendor_key").agg(first("seller_name").alias("canonical_name"), first("code").alias("vendor_code"), first("seller_tax_id").alias("tax_id"), F.count("*").alias("documents"))
    return out.withColumn("canonical_name", F.coalesce("canonical_name", F.concat(F.lit("Vendor "), "vendor_code"), F.concat(F.lit("Vendor "), "tax_id")))


def line_items(results: DataFrame, items: str = "line_items") -> DataFrame:
    """X-03: numbered lines that say something; zero amounts count as nothing."""
    r = results.select("document_id", F.posexplode(items).alias("i", "x"))
    says = lambda c: F.coalesce(F.col(f"x.{c}") != 0, F.lit(False))
    some = F.coalesce(F.trim("x.description") != "", F.lit(False)) | says("quantity") | says("unit_price") | says("net_amount") | says("gross_amount")
    return r.where(some).select("document_id", (F.col("i") + 1).alias("line_number"), "x.*")


def isolated(results: DataFrame, project) -> tuple[DataFrame, DataFrame]:
    """X-06: (projected rows, (document_id, error)): rows whose facts can't be projected are listed, the others go on.

    ``project`` maps results to rows with document_id; a document without a usable number, date or total is an error.
    """
    rows = project(results)
    empty = F.col("invoice_number").isNull() & F.col("invoice_date").isNull() & F.col("grand_total_amount").isNull()
    return rows.where(~empty), rows.where(empty).select("document_id", F.lit("no number, date or total").alias("error"))


def obligations(invs: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """X-04: due, paid (kept), outstanding, status; UNKNOWN becomes OPEN, other states stay."""
    paid = F.lit(0).cast("decimal(15,2)")
    if previous is not None:
        p = previous.select("document_id", F.col("amount_paid").alias("_paid"), F.col("status").alias("_status"))
        invs, paid, old = invs.join(p, "document_id", "left"), F.coalesce("_paid", paid), F.col("_status")
    else:
        old = F.lit(None).cast("string")
    known = F.col("due_date").isNotNull() | F.col("grand_total_amount").isNotNull()
    fresh = F.when(known, "OPEN").otherwise("UNKNOWN")
    return invs.select(
        "document_id", F.col("grand_total_amount").alias("amount_due"), paid.alias("amount_paid"),
        (F.col("grand_total_amount") - paid).cast("decimal(15,2)").alias("amount_outstanding"), "currency", "due_date", "payment_terms",
        F.when(old.isNull() | (old == "UNKNOWN"), fresh).otherwise(old).alias("status"),
    )
