"""Table operators: latest rows, pages, searches, replacement by key (S-*, P-*, T-*, W-01, W-02, A-01 to A-08)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.text import like


def by_key(df: DataFrame, key: str, value, include_deleted: bool = True) -> DataFrame:
    """S-01, S-02: the rows of a key; soft-deleted ones only on request."""
    out = df.where(F.col(key) == F.lit(value))
    return out if include_deleted or "is_deleted" not in df.columns else out.where(~F.col("is_deleted"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W-01: the newest row of each key; the last order column breaks ties.

    max_by over a struct combines map-side, unlike a window, so that a hot key never gathers its rows.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(newest).select(*keys, "row.*").select(*df.columns)


def earliest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W-02."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*").select(*df.columns)


def search(df: DataFrame, equals: dict | None = None, contains: dict[str, str] | None = None, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """P-01, P-03: every given filter holds; None means "no filter", bounds are inclusive."""
    conditions: list[Column] = []
    for c, v in (equals or {}).items():
        if v is not None:
            conditions.append(F.col(c) == F.lit(v))
    for c, v in (contains or {}).items():
        if v is not None:
            conditions.append(like(F.col(c), v))
    for c, (low, high) in (ranges or {}).items():
        if low is not None:
            conditions.append(F.col(c) >= F.lit(low))
        if high is not None:
            conditions.append(F.col(c) <= F.lit(high))
    return df.where(reduce(Column.__and__, conditions)) if conditions else df


def in_ids(df: DataFrame, column: str, ids: list | None) -> DataFrame:
    """P-05: None is no filter, an empty list matches nothing."""
    if ids is None:
        return df
    return df.where(F.col(column).isin(ids)) if ids else df.where(F.lit(False))


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """T-01: an ordered page of 1 to 200 rows."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("a page has 1 to 200 rows from an offset of 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """S-16, X-03: all rows of a key that occurs in ``new`` are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """S-19: the rows of other keys."""
    return df.join(keys.select(key), key, "left_anti")


def cleared(df: DataFrame, key: str, value) -> tuple[DataFrame, int]:
    """S-19: the rows left without those of a key, and how many went."""
    return df.where(~F.col(key).eqNullSafe(F.lit(value))), df.where(F.col(key) == F.lit(value)).count()


def soft_deleted(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """S-17: the flag is set, the row stays."""
    gone = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    return df.join(gone, key, "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).select(*df.columns)


def appended(log: DataFrame, entries: DataFrame) -> DataFrame:
    """ST-05, S-15: entries under a log; columns that an entry lacks are null."""
    return log.unionByName(entries, allowMissingColumns=True)


def vendor_match(name: Column, code: Column, wanted: str, how: str = "partial") -> Column:
    """P-11: part of the name in any case by default, the whole name if ``exact``, else the ``code``."""
    if how not in ("partial", "exact", "code"):
        raise ValueError(f"unknown match {how!r}")
    return like(name, wanted) if how == "partial" else name == wanted if how == "exact" else code == wanted


def access(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """P-15: (document_id, user_id, role, …) requests with ``access``: granted, not_found or forbidden (analysts see their own)."""
    d = documents.where(~F.col("is_deleted")).select(F.col("id").alias("document_id"), F.col("uploaded_by").alias("_owner"), F.lit(True).alias("_there"))
    found = requests.join(d, "document_id", "left")
    own = (F.col("role") != "FINANCE_ANALYST") | (F.col("_owner") == F.col("user_id"))
    return found.withColumn("access", F.when(F.col("_there").isNull(), "not_found").when(F.coalesce(own, F.lit(False)), "granted").otherwise("forbidden")).drop("_owner", "_there")


# Roles that may use each group of actions.
GATES = {
    "review": ["FINANCE_MANAGER", "AUDITOR", "ADMIN"], "audit": ["AUDITOR", "ADMIN"], "administer": ["ADMIN"],
    "work": ["FINANCE_ANALYST", "FINANCE_MANAGER", "ADMIN"], "read": ["FINANCE_ANALYST", "FINANCE_MANAGER", "AUDITOR", "ADMIN"],
}


def allowed(role: Column, gate: str) -> Column:
    """P-16."""
    return role.isin(GATES[gate])


def newest(df: DataFrame, at: str, n: int = 50, key: str = "id") -> DataFrame:
    """T-09: the newest rows, ties by the greater key; the limit is the feature (duplicates are compared with all rows elsewhere)."""
    return df.orderBy(F.desc_nulls_last(at), F.desc(key)).limit(n)


def with_activity(documents: DataFrame, activity: DataFrame, user_id, n: int = 5) -> DataFrame:
    """J-02, T-08: a user's documents by last activity, deleted ones left out."""
    mine = activity.where(F.col("user_id") == F.lit(user_id)).select(F.col("document_id").alias("id"), "last_activity_at")
    return documents.where(~F.col("is_deleted")).join(mine, "id").orderBy(F.desc("last_activity_at"), "id").limit(n)


def history(df: DataFrame, key: str, value, at: str, ascending: bool = True) -> DataFrame:
    """T-12: the rows of a key by time, oldest or newest first, ties by id."""
    order = [F.asc(at), F.asc("id")] if ascending else [F.desc(at), F.desc("id")]
    return df.where(F.col(key) == F.lit(value)).orderBy(*order)


def awaiting_review(status: Column) -> Column:
    """P-10."""
    return status == "PENDING_APPROVAL"


def processed(status: Column, is_deleted: Column) -> Column:
    """P-10: counts as spend."""
    return status.isin("VALIDATED", "PENDING_APPROVAL", "APPROVED") & ~is_deleted


def overdue(due: Column, outstanding: Column, status: Column, as_of: str) -> Column:
    """P-09: past due, not paid, and something or something unknown outstanding."""
    return (due < F.lit(as_of).cast("date")) & ((outstanding > 0) | outstanding.isNull()) & (status != "PAID")


def last_turns(df: DataFrame, session: str, order: str, n: int = 10) -> DataFrame:
    """W-06: the last turns of each session; callers order them by time."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def top_per_group(df: DataFrame, group: str, value: str, n: int, ties: str) -> DataFrame:
    """W-04: rank within a group, never across groups."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(ties))
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
