"""Exact-decimal finance kernels (A-09, A-10, F-26 to F-28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import discount, percentage


_KINDS = {
    "sum": F.sum, "total": F.sum, "avg": F.avg, "average": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "var": F.var_pop, "variance": F.var_pop,
}


def column_aggregates(df: DataFrame, value: str, kinds: dict[str, str]) -> DataFrame:
    """A-09: {name: kind} -> one row of the named results and ``n``; values that don't parse are skipped, no values give 0.00."""
    unknown = set(kinds.values()) - set(_KINDS)
    if unknown:
        raise ValueError(f"unknown aggregates {sorted(unknown)}")
    clean = F.regexp_replace(F.col(value).cast("string"), r"[^0-9.\-]", "").try_cast("decimal(18,4)")
    result = lambda k: F.round(_KINDS[k](clean).cast("decimal(38,10)"), 2).cast("decimal(38,2)")
    return df.agg(*[F.coalesce(result(k), F.lit(0).cast("decimal(38,2)")).alias(n) for n, k in kinds.items()], F.count(clean).alias("n"))


def column_aggregate(df: DataFrame, value: str, kind: str) -> DataFrame:
    """A-09: (result, count) of one kind."""
    return column_aggregates(df, value, {"result": kind}).withColumnRenamed("n", "count")


def discounted(df: DataFrame, gross: Column, percent: Column, base_date: Column | None = None, days: Column | int | None = None) -> DataFrame:
    """F-27: adds savings, payable and, with a date, the deadline."""
    g = gross.cast("decimal(18,2)")
    savings = discount(g, percent)
    out = df.withColumns({"gross": g, "savings": savings, "payable": (g - savings).cast("decimal(18,2)")})
    return out if base_date is None else out.withColumn("deadline", F.date_add(base_date.cast("date"), days))


def batch_discounts(df: DataFrame, gross: str, percent: str, currency: str) -> DataFrame:
    """A-10: totals of each currency; currencies are never added up."""
    rows = discounted(df, F.col(gross), percentage(F.col(percent).cast("string")))
    return rows.groupBy(F.col(currency).alias("currency")).agg(
        F.sum("gross").alias("total_gross"), F.sum("savings").alias("total_savings"), F.sum("payable").alias("total_payable"), F.count("*").alias("items"),
    )
