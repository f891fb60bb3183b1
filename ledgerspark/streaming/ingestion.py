"""Ingestion of document texts into kept chunks, by batch or stream (S-16, ST-01, ST-02)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerspark.operators import chunking, sections
from ledgerspark.operators.tables import latest_per_key
from ledgerspark.sources.keyed import KeyedTable
from ledgerspark.sources.workspace import Workspace

CHUNKS = "document_id bigint, page_number int, chunk int, chunk_type string, section string, content string"
STATUS = (
    "document_id bigint, result_id bigint, created_at timestamp, status string, reason string, "
    "held_id bigint, held_at timestamp, held_hash string, chunk_count bigint, deleted_previous_chunks bigint"
)


def page_chunks(texts: DataFrame) -> DataFrame:
    """(document_id, full_text) -> typed sections of its pages (C-01 to C-05)."""
    return sections.chunks(chunking.pages(texts.select("document_id", "full_text"), "full_text"))


def guarded(cut: Callable[[str], list[dict]]) -> Callable[[DataFrame], DataFrame]:
    """A chunker made of a Python function of one text; where it raises, the document has one row with the ``error`` alone."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for document, text in zip(batch["document_id"], batch["full_text"]):
                try:
                    out += [{"chunk": i, **c, "document_id": document} for i, c in enumerate(cut(text))]
                except Exception as e:  # the next document is not its fault
                    out.append({"document_id": document, "error": str(e) or type(e).__name__})
            yield pd.DataFrame(out, columns=[*names, "error"], dtype=object)

    return lambda texts: texts.select("document_id", "full_text").mapInPandas(rows, CHUNKS + ", error string")


class Ingestor:
    """Kept chunks and, for each document, what became of its newest text.

    ``documents`` (id, is_deleted) are those known; ``chunk`` cuts (document_id, full_text) into rows of
    chunks, with an ``error`` where a document failed. The newest result of a document (by created_at,
    then id) decides its status: ``skipped`` with a reason (not_found, soft_deleted, no_ocr_text, zero_chunks),
    ``failed`` with the error, or ``success``. Its newest result that gave chunks holds the chunks, so
    that skipped and failed texts leave earlier chunks alone. A batch may come again, late or out of
    order: applied batches are known by their number, and results older than what is held change nothing.
    A text that is equal to the one held is not cut again. Results without a document id are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, documents: DataFrame, chunk: Callable[[DataFrame], DataFrame] = page_chunks, buckets: int = 16):
        self.spark, self.documents, self.chunk = spark, documents, chunk
        self.chunks = KeyedTable(spark, f"{folder}/chunks", CHUNKS, ["document_id"], buckets)
        self.status = KeyedTable(spark, f"{folder}/status", STATUS, ["document_id"], buckets)

    def apply(self, results: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """results (id, document_id, created_at, full_text)."""
        work = Workspace(self.spark, "ingest")
        known = self.documents.select(F.col("id").alias("document_id"), F.coalesce("is_deleted", F.lit(False)).alias("gone"))
        told = results.select("id", "document_id", "created_at", "full_text").where("document_id IS NOT NULL").join(known, "document_id", "left")
        blank = ~F.coalesce(F.col("full_text"), F.lit("")).rlike(r"\S")
        told = told.withColumn("reason", F.when(F.col("gone").isNull(), "not_found").when(F.col("gone"), "soft_deleted").when(blank, "no_ocr_text"))
        told = work.keep(told.drop("gone").withColumn("hash", F.sha2("full_text", 256)))
        before = work.keep(self.status.rows_of(told))

        # every usable text newer than the one held is tried, so that a newer one that fails does not hide it
        held = before.select("document_id", "held_at", "held_id", "held_hash")
        newer = self._after("created_at", "id", "held_at", "held_id")
        usable = told.where("reason IS NULL").join(held, "document_id", "left").where(F.col("held_id").isNull() | newer)
        same = usable.where("hash = held_hash").select("document_id", "id", F.lit(None).cast("string").alias("error"), F.lit(-1).cast("long").alias("n"))
        fresh = usable.where("held_hash IS NULL OR hash <> held_hash")
        # one row for each text: results are cut under a number of their own, as a document may have several
        cut = self.chunk(fresh.select(F.col("id").alias("document_id"), "full_text")).withColumnRenamed("document_id", "id")
        cut = work.keep(cut if "error" in cut.columns else cut.withColumn("error", F.lit(None).cast("string")))
        counts = cut.groupBy("id").agg(F.max("error").alias("error"), F.count("*").alias("n"))
        tried = fresh.select("document_id", "id").join(counts, "id", "left").select("document_id", "id", "error", F.coalesce("n", F.lit(0)).alias("n"))
        tried = work.keep(told.join(tried.unionByName(same).drop("document_id"), "id", "left").select(
            "document_id", "id", "created_at", "hash", "reason", "error", "n"))

        good = tried.where("reason IS NULL AND error IS NULL AND n <> 0")
        holds = latest_per_key(good, ["document_id"], ["created_at", "id"])
        replaced = holds.where("n > 0").select("document_id", "id")
        self.chunks.upsert(cut.drop("error").join(replaced, "id").drop("id").select(*[f for f in self._columns(cut)]), batch=batch)
        self.status.upsert(self._status(tried, holds, before), batch=batch)

    def _columns(self, cut: DataFrame) -> list[Column]:
        """The chunk columns, null where the chunker has none."""
        have = set(cut.columns) - {"id"} | {"document_id"}
        return [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.chunks.schema.fields]

    @staticmethod
    def _after(at: str, number: str, old_at: str, old_number: str) -> Column:
        return (F.col(at) > F.col(old_at)) | ((F.col(at) == F.col(old_at)) & (F.col(number) > F.col(old_number)))

    def _status(self, tried: DataFrame, holds: DataFrame, before: DataFrame) -> DataFrame:
        newest = latest_per_key(tried, ["document_id"], ["created_at", "id"])
        status = F.when(F.col("reason").isNotNull(), "skipped").when(F.col("error").isNotNull(), "failed").when(F.col("n") == 0, "skipped").otherwise("success")
        reason = F.coalesce("reason", "error", F.when(F.col("n") == 0, "zero_chunks"))
        new = newest.select("document_id", F.col("id").alias("new_id"), F.col("created_at").alias("new_at"), status.alias("new_status"), reason.alias("new_reason"))
        got = holds.select("document_id", F.col("id").alias("got_id"), F.col("created_at").alias("got_at"), F.col("hash").alias("got_hash"), "n")
        both = new.join(before, "document_id", "left").join(got, "document_id", "left")
        later = F.col("result_id").isNull() | self._after("new_at", "new_id", "created_at", "result_id")
        # a result that is older than the one held was not tried: it counts as it would have then
        pick = lambda new, old: F.when(later, F.col(new)).otherwise(F.col(old))
        took, cut = F.col("got_id").isNotNull(), F.col("n") > 0
        return both.select(
            "document_id", pick("new_id", "result_id").alias("result_id"), pick("new_at", "created_at").alias("created_at"),
            pick("new_status", "status").alias("status"), pick("new_reason", "reason").alias("reason"),
            F.when(took, F.col("got_id")).otherwise(F.col("held_id")).alias("held_id"), F.when(took, F.col("got_at")).otherwise(F.col("held_at")).alias("held_at"),
            F.when(took, F.col("got_hash")).otherwise(F.col("held_hash")).alias("held_hash"),
            F.when(cut, F.col("n")).otherwise(F.coalesce("chunk_count", F.lit(0))).alias("chunk_count"),
            F.when(cut, F.coalesce("chunk_count", F.lit(0))).otherwise(F.coalesce("deleted_previous_chunks", F.lit(0))).alias("deleted_previous_chunks"))

    def outcomes(self) -> DataFrame:
        return self.status.read().groupBy("status", "reason").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))

    def start(self, stream: DataFrame, checkpoint: str, source: str = "stream") -> StreamingQuery:
        """Each micro-batch is applied once under its number, also if it runs again."""

        def each(batch: DataFrame, number: int) -> None:
            self.apply(batch, (source, number))

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
