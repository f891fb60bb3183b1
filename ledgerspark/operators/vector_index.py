"""Nearest neighbours of many queries at once over a kept, clustered index; exact (R-02, R-03, T-03)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.operators.retrieval import CANDIDATES
from ledgerspark.sources.workspace import Workspace

#: Vectors that the cells' centres are fitted on; every vector is then put into a cell.
SAMPLE = 20_000
RING_ROWS = 2048
PACK_QUERIES = 512
#: Doubles are off by less than this; bounds give so much way.
SLACK = 1e-9

_RINGS = "cell int, ring int, n int, d int, near double, far double, ids binary, x binary"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def fit_centres(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds over unit vectors; an empty cell takes the vector that is farthest from its own centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        score = x @ c.T
        best = score.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        n = np.bincount(best, minlength=len(c))
        for empty in np.flatnonzero(n == 0):
            sums[empty] = x[score[np.arange(len(x)), best].argmin()]
        sums[(sums * sums).sum(1) == 0] = x[0]
        c = unit(sums)
    return c


def gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances on the unit sphere."""
    return np.sqrt(np.maximum(2 - 2 * (x @ c.T), 0))


class VectorIndex:
    """Vectors in cells around centres, each cell in rings by the distance to its centre.

    For a query at distance q from a centre, every vector of a ring lies at least max(q - far, near - q)
    away (triangle inequality). The rings of a query's nearest cell give a first kth distance; then all rings
    whose bound does not exceed it are read, and no others: the result is exact. Rings are packed
    matrices of bounded size; queries are packed too, and a task multiplies one by the other.

    The centres (``cells`` of them) are known to the driver and broadcast; vectors never are. Rows without key, and
    vectors that are null, hold null or non-finite components or have no length are not indexed; all vectors have one length.
    """

    def __init__(self, spark: SparkSession, folder: str, cells: int = 64, ring_rows: int = RING_ROWS, sample: int = SAMPLE):
        self.spark, self.folder, self.cells, self.ring_rows, self.sample = spark, folder, cells, ring_rows, sample
        self.centres: np.ndarray | None = None

    @staticmethod
    def _usable(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
        good = F.forall(vector, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False))) & F.exists(vector, lambda c: c != 0)
        return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & good).select(
            F.col(key).cast("long").alias("id"), F.transform(vector, lambda c: c.cast("double")).alias("v"), *more)

    def build(self, rows: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> VectorIndex:
        work = Workspace(self.spark, "vector-index")
        x = work.keep(self._usable(rows, key, vector))
        picked = x.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(self.sample).collect()  # the bound of the fit
        if not picked:
            self.centres = np.zeros((0, 0))
            return self
        self.centres = centres = fit_centres(unit(np.array([r["v"] for r in picked])), self.cells)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    g = gaps(unit(np.stack(b["v"].to_numpy())), centres)
                    cell = g.argmin(1)
                    yield pd.DataFrame({"id": b["id"], "cell": cell.astype(np.int32), "gap": g[np.arange(len(b)), cell], "v": b["v"]})

        placed = work.keep(x.mapInPandas(place, "id bigint, cell int, gap double, v array<double>"))
        # rings are ranges of (cell, distance) of bounded size, however full a cell is
        parts = max(1, -(-placed.count() // self.ring_rows))
        ringed = placed.repartitionByRange(parts, "cell", "gap", "id").withColumn("ring", F.spark_partition_id())

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.stack(pdf["v"].to_numpy()))
            return pd.DataFrame([{
                "cell": pdf["cell"].iloc[0], "ring": pdf["ring"].iloc[0], "n": len(pdf), "d": x.shape[1], "near": pdf["gap"].min(), "far": pdf["gap"].max(),
                "ids": pdf["id"].to_numpy(np.int64).tobytes(), "x": x.tobytes()}])

        ringed.groupBy("cell", "ring").applyInPandas(pack, _RINGS).write.mode("overwrite").parquet(f"{self.folder}/rings")
        return self

    def search(self, queries: DataFrame, k: int = CANDIDATES, key: str = "query_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
        """-> (query_id, chunk, distance, rank), nearest first, ties by key; and (query_id, cells, rings, rows) that each query visited."""
        empty = self.spark.createDataFrame([], "query_id bigint, chunk bigint, distance double, rank int"), self.spark.createDataFrame([], "query_id bigint, cells bigint, rings bigint, rows bigint")
        if self.centres is None:
            raise ValueError("build the index first")
        if not len(self.centres):
            return empty
        work = Workspace(self.spark, "vector-search")
        q = work.keep(self._usable(queries, key, vector))
        rings = self.spark.read.parquet(f"{self.folder}/rings")
        shape = rings.select("cell", "ring", "near", "far", "n")
        centres = self.centres

        def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    g = gaps(unit(np.stack(b["v"].to_numpy())), centres)
                    yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), len(centres)), "cell": np.tile(np.arange(len(centres), dtype=np.int32), len(b)), "q": g.ravel()})

        bounds = q.mapInPandas(to_cells, "id bigint, cell int, q double").join(shape, "cell")
        bounds = work.keep(bounds.withColumn("least", F.greatest(F.col("q") - F.col("far"), F.col("near") - F.col("q"), F.lit(0.0)) - SLACK))
        # first the most promising rings that hold k rows
        order = Window.partitionBy("id").orderBy("least", "q", "ring").rowsBetween(Window.unboundedPreceding, -1)
        first = work.keep(bounds.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < k).select("id", "cell", "ring"))
        found = work.keep(self._best(self._visit(first, q, rings, k), k))
        kth = found.groupBy("id").agg(F.max("gap").alias("kth"), F.count("*").alias("n"))
        limit = kth.select("id", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
        rest = bounds.join(limit, "id", "left").where("kth IS NULL OR least <= kth").join(first, ["id", "cell", "ring"], "left_anti").select("id", "cell", "ring")
        rest = work.keep(rest)
        best = self._best(found.drop("rank").unionByName(self._visit(rest, q, rings, k)), k)
        hits = best.select(F.col("id").alias("query_id"), "chunk", (F.col("gap") * F.col("gap") / 2).alias("distance"), "rank")
        visited = first.unionByName(rest).join(shape, ["cell", "ring"]).groupBy(F.col("id").alias("query_id")).agg(
            F.count_distinct("cell").alias("cells"), F.count("*").alias("rings"), F.sum("n").alias("rows"))
        return hits, visited

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("id").orderBy("gap", "chunk")
        found = found.select("id", "chunk", "gap").withColumn("rank", F.row_number().over(order).cast("int"))
        return found.where(F.col("rank") <= k)

    @staticmethod
    def _visit(pairs: DataFrame, q: DataFrame, rings: DataFrame, k: int) -> DataFrame:
        """The k nearest rows of each ring to the queries that visit it."""
        packs = pairs.join(q, "id").withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(16)))
        # a ring that many visit meets them in packs
        order = Window.partitionBy("cell", "ring", "pack").orderBy("id")
        packs = packs.withColumn("part", F.floor((F.row_number().over(order) - 1) / PACK_QUERIES))

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"cell": pdf["cell"].iloc[0], "ring": pdf["ring"].iloc[0], "qids": pdf["id"].to_numpy(np.int64).tobytes(), "q": unit(np.stack(pdf["v"].to_numpy())).tobytes()}])

        packed = packs.groupBy("cell", "ring", "pack", "part").applyInPandas(pack, "cell int, ring int, qids binary, q binary")

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.to_dict("records"):
                    ids, qids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                    x, y = np.frombuffer(r["x"]).reshape(len(ids), -1), np.frombuffer(r["q"]).reshape(len(qids), -1)
                    g = gaps(y, x)
                    line = np.partition(g, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                    for i in range(len(qids)):
                        at = np.flatnonzero(g[i] <= line[i])  # all ties of the kth
                        at = at[np.lexsort((ids[at], g[i][at]))[:k]]
                        yield pd.DataFrame({"id": qids[i], "chunk": ids[at], "gap": g[i][at]})

        return rings.select("cell", "ring", "ids", "x").join(packed, ["cell", "ring"]).select("ids", "x", "qids", "q").mapInPandas(nearest, "id bigint, chunk bigint, gap double")
