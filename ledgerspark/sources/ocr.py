"""Pluggable text sources (S-10 to S-13, E-19). The default reads text that is already in a table; the stub invents it deterministically."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "stub"


def stub(files: DataFrame) -> DataFrame:
    """S-11: text made of the content's digest, with confidence 0.42."""
    return files.withColumns({"full_text": F.concat(F.lit("stub text "), F.col("file_hash")), "confidence": F.lit(0.42), "engine_name": F.lit("stub")})


ENGINES: dict[str, Callable[[DataFrame], DataFrame]] = {"stub": stub}


def register(name: str, engine: Callable[[DataFrame], DataFrame]) -> None:
    """An engine maps a table of files to the same table with full_text, confidence and engine_name."""
    ENGINES[name] = engine


def run(files: DataFrame, name: str | None = None) -> DataFrame:
    return ENGINES[name if name in ENGINES else DEFAULT](files)


def status(spark: SparkSession) -> DataFrame:
    """S-12."""
    return spark.createDataFrame([(n, True, n == DEFAULT) for n in sorted(ENGINES)], "engine string, available boolean, is_default boolean")


def setting(value: Column, default: str = DEFAULT) -> Column:
    """S-13."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))
