"""Vector expressions (R-01 to R-03)."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size)


def hashed_embedding(text: Column, dimension: int = 384) -> Column:
    """R-01's offline default: a signed count of hashed words, scaled to length 1; deterministic on every worker.

    Texts travel in Arrow batches; a text without words is the zero vector.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            codes = np.fromiter((zlib.crc32(w.encode()) for w in WORD.findall((t or "").lower())), np.int64)
            v = np.bincount(codes % dimension, np.where(codes >> 20 & 1, -1.0, 1.0), dimension)
            size = np.sqrt(v @ v)
            out.append((v / size if size else v).astype(np.float32))
        return pd.Series(out)

    return embed(text)
