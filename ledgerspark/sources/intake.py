"""File intake and exports (S-04 to S-09, S-14, P-14, A-20)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_FILES = 25 * 1024 * 1024, 100
#: What a sheet holds beside its heading.
SHEET_ROWS = 1_048_575
# Accepted extensions and their types.
MIME = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg"}


def mime_of(path: Column) -> Column:
    """S-09."""
    ext = F.lower(F.regexp_extract(path, r"(\.\w+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in MIME.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def contained(root: str, sub: str) -> str:
    """S-08: a folder below the root, or ValueError."""
    top = Path(root).resolve()
    at = (top / sub).resolve()
    if at != top and top not in at.parents:
        raise ValueError("outside the intake folder")
    return str(at)


def check_upload(files: DataFrame, name: str = "filename", mime: str = "mime_type", size: str = "size_bytes") -> DataFrame:
    """S-04, S-06: adds ``success`` and ``error``; one bad file never fails the batch."""
    error = (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "a file name is required")
        .when(~F.coalesce(F.col(mime).isin(*MIME.values()), F.lit(False)), "this type is not accepted")
        .when(F.coalesce(F.col(size), F.lit(0)) <= 0, "the file is empty")
        .when(F.col(size) > MAX_BYTES, "the file is larger than 25 MB")
    )
    return files.withColumn("error", error).withColumn("success", F.col("error").isNull())


def bulk_totals(checked: DataFrame) -> DataFrame:
    """A-20."""
    return checked.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def scan_folder(spark: SparkSession, folder: str, limit: int = MAX_FILES) -> DataFrame:
    """S-05, S-07: (path, mime_type, size_bytes, file_hash) of the first files by path, not recursive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    good = files.withColumn("mime_type", mime_of(F.col("path"))).where("mime_type IS NOT NULL")
    some = good.orderBy("path").limit(limit)  # the feature's own limit
    return some.select("path", "mime_type", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("file_hash"))


def export_rows(results: DataFrame, schema: DataFrame) -> DataFrame:
    """P-14, S-14: (document_id, ord, key, label, value, confidence) of the latest results, in schema order."""
    f = results.select("document_id", "document_type", F.explode("fields").alias("key", "f")).where("key <> 'canonical'")
    return f.join(F.broadcast(schema), ["document_type", "key"], "left").select(
        "document_id", F.coalesce("ord", F.lit(999)).alias("ord"), "key", F.coalesce("label", "key").alias("label"), "f.value", "f.confidence")


def write_export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """S-14: JSON or CSV files; spreadsheets only where openpyxl is installed, from a bounded export."""
    if kind == "json":
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "xlsx":
        if rows.limit(SHEET_ROWS + 1).count() > SHEET_ROWS:
            raise ValueError(f"a sheet holds {SHEET_ROWS} rows; write csv or json")
        rows.toPandas().to_excel(path, index=False)
    else:
        raise ValueError(f"unknown export format {kind!r}")
