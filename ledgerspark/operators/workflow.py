"""Approval workflow, progress and training captures (ST-02 to ST-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Action, required status, resulting status, roles (None: any), whether a comment is needed.
TRANSITIONS = [
    ("REQUEST_APPROVAL", "VALIDATED", "PENDING_APPROVAL", None, False),
    ("APPROVE", "PENDING_APPROVAL", "APPROVED", ["FINANCE_MANAGER", "AUDITOR", "ADMIN"], False),
    ("REJECT", "PENDING_APPROVAL", "REJECTED", ["FINANCE_MANAGER", "AUDITOR", "ADMIN"], True),
]


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "action string, from_status string, to_status string, roles array<string>, needs_comment boolean")


def fold_actions(start: DataFrame, actions: DataFrame) -> DataFrame:
    """ST-03: each document's actions in order against its status: (document_id, status, accepted, refused).

    (document_id, status) and (document_id, seq, action, role, comment); one document's actions are
    folded by an expression, refused ones leave the status as it was.
    """
    spark = start.sparkSession
    t = transitions(spark)
    a = actions.join(F.broadcast(t), "action", "left")  # three rows
    allowed = (F.col("roles").isNull() | F.array_contains("roles", F.col("role"))) & (~F.col("needs_comment") | (F.trim(F.coalesce("comment", F.lit(""))) != ""))
    one = F.struct("seq", F.col("from_status").alias("f"), F.col("to_status").alias("t"), F.coalesce(allowed & F.col("from_status").isNotNull(), F.lit(False)).alias("ok"))
    every = a.groupBy("document_id").agg(F.array_sort(F.collect_list(one)).alias("steps"))
    zero = F.struct(F.col("status").alias("status"), F.lit(0).alias("accepted"), F.lit(0).alias("refused"))

    def step(s, x):
        go = x["ok"] & (s["status"] == x["f"])
        return F.struct(F.when(go, x["t"]).otherwise(s["status"]).alias("status"), (s["accepted"] + go.cast("int")).alias("accepted"), (s["refused"] + (~go).cast("int")).alias("refused"))

    none = F.array().cast("array<struct<seq:bigint,f:string,t:string,ok:boolean>>")
    return start.join(every, "document_id", "left").select("document_id", F.aggregate(F.coalesce("steps", none), zero, step).alias("s")).select("document_id", "s.*")


def progress(has_text: Column, extracted: Column, is_valid: Column) -> Column:
    """ST-04."""
    return F.when(~has_text, "REJECTED").when(is_valid, "VALIDATED").when(extracted, "EXTRACTED").otherwise("OCR_COMPLETED")


def recently_viewed(activity: DataFrame, user: str, document: str, at: str, n: int = 5) -> DataFrame:
    """ST-07, T-08: the last visit of each user to each document, the newest n of each user."""
    from ledgerspark.operators.tables import top_per_group

    last = activity.groupBy(user, document).agg(F.max(at).alias("last_activity_at"))
    return top_per_group(last, user, "last_activity_at", n, document)


def overrides(results: DataFrame) -> DataFrame:
    """ST-06, C-09: a training row for each warning that an approval overrode."""
    w = F.filter("issues", lambda i: i["severity"] == "WARNING")
    return results.select("document_id", F.explode(w).alias("i")).select("document_id", "i.rule_type", "i.field_key", "i.message")


def training_captures(extraction: DataFrame, classification: DataFrame, warnings: DataFrame, rejections: DataFrame) -> DataFrame:
    """ST-06: four kinds of corrections in one table."""
    cols = ["document_id", "task_type", "field_key", "predicted_value", "corrected_value"]
    none = F.lit(None).cast("string")
    frames = [
        extraction.select("document_id", F.lit("extraction").alias("task_type"), "field_key", "predicted_value", "corrected_value"),
        classification.select("document_id", F.lit("classification").alias("task_type"), none.alias("field_key"), "predicted_value", "corrected_value"),
        warnings.select("document_id", F.lit("validation_override").alias("task_type"), "field_key", F.col("message").alias("predicted_value"), none.alias("corrected_value")),
        rejections.select("document_id", F.lit("rejection").alias("task_type"), none.alias("field_key"), none.alias("predicted_value"), F.col("comment").alias("corrected_value")),
    ]
    out = frames[0].select(*cols)
    for f in frames[1:]:
        out = out.unionByName(f.select(*cols))
    return out


def session_state(updates: DataFrame, session: str, order: str, state: str) -> DataFrame:
    """ST-08, F-55: later keys win over earlier ones (map of strings for each session)."""
    kv = updates.select(session, order, F.explode(state).alias("k", "v")).groupBy(session, "k").agg(F.max_by("v", order).alias("v"))
    return kv.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("state"))
