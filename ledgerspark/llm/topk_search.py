"""Operator 9, exact top-k inner-product search with ball trees.

Vectors are dealt into shards of bounded size and each shard's ball tree is built once and kept as a
row of a table. Queries are dealt into blocks and waves of bounded size; a task holds one shard and
one wave, and each block walks the tree in the order of the nodes' upper bounds (query . centre +
|query| * radius), leaving a subtree once its bound is below every query's kth score. Shards are
visited in three rounds (one, a few, the rest): the kth scores reached so far are shared with every
shard of the next round, which returns only what can still count.

Components become floor(scale * x), so scores are exact integers: products are taken in float32 or
float64 where their sums stay exact, else in int64. Defined cases: vectors that are null, or hold
null or non-finite components, and rows without an id take no part, nor do vectors so long (2^31 in these
units) that a score would not fit 64 bits; vectors of unlike length are
never compared; a query's own id is no candidate; repeated ids are candidates of their own; queries
repeated in id and vector are asked once, and of one id with several vectors each is ranked by
itself; ties go to the smaller id; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import Scratch

SCALE, TOP, EVERY = 64, 20, 20
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
#: Blocks that share a task.
WAVE_BLOCKS = 4
#: Squared length from which on a vector takes no part.
LONGEST = float(2**62)
LEAF = 256
#: Below every score; its negative is a number too.
NONE = -(2**62)


class BallTree:
    """Rows of integer vectors, permuted so that each node is a run; children split the widest direction.

    ``runs`` holds (first row, end, left child, right child) of each node, -1 for no child.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        f = x.astype(np.float64)
        runs, centres, radii = [], [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            rows = f[self.order[a:b]]
            centre = rows.mean(0)
            away_sq = ((rows - centre) ** 2).sum(1)
            radius = float(np.sqrt(away_sq.max()))
            me = len(runs)
            runs.append([a, b, -1, -1])
            centres.append(centre)
            radii.append(radius)
            if parent >= 0:
                runs[parent][2 + side] = me
            if b - a > leaf and radius > 0:
                away = rows[np.argmax(away_sq)]
                far = rows[np.argmax(((rows - away) ** 2).sum(1))]
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows @ (far - away), mid)]
                stack += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.runs, self.centres, self.radii = np.array(runs), np.array(centres), np.array(radii)


def narrowest(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as they need."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    q, x = q.astype(np.int64, copy=False), x.astype(np.int64, copy=False)
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if reach < 2**24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if reach < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Shard:
    """A shard's vectors and ids in the order of its tree."""

    def __init__(self, runs: np.ndarray, centres: np.ndarray, radii: np.ndarray, x: np.ndarray, x_id: np.ndarray):
        self.runs, self.centres, self.radii, self.x, self.x_id = runs, centres, radii, x, x_id

    @classmethod
    def build(cls, x: np.ndarray, x_id: np.ndarray) -> Shard:
        tree = BallTree(x)
        return cls(tree.runs, tree.centres, tree.radii, x[tree.order], x_id[tree.order])

    def pack(self) -> dict[str, bytes | str]:
        x = narrowest(self.x)
        return {"kind": x.dtype.name, "runs": self.runs.astype(np.int64).tobytes(), "balls": np.column_stack([self.centres, self.radii]).tobytes(),
                "x": x.tobytes(), "x_id": self.x_id.astype(np.int64).tobytes()}

    @classmethod
    def unpack(cls, row) -> Shard:
        ids = np.frombuffer(row["x_id"], np.int64)
        balls = np.frombuffer(row["balls"]).reshape(-1, row["d"] + 1)
        return cls(np.frombuffer(row["runs"], np.int64).reshape(-1, 4), balls[:, :-1], balls[:, -1], np.frombuffer(row["x"], row["kind"]).reshape(len(ids), -1), ids)


def search(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, shard: Shard, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, score) of a block's best rows of one shard; ``floor``: kth scores known so far."""
    x, x_id = shard.x, shard.x_id
    best = np.full((len(q), top), NONE)
    best_id = np.full((len(q), top), np.iinfo(np.int64).max)
    kth = floor.astype(np.float64)
    bound = q.astype(np.float64) @ shard.centres.T + np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None] * shard.radii
    bound += 1e-6 * np.abs(bound) + 1e-6
    best_first = bound.max(0)
    heap = [0]
    while heap:
        heap.sort(key=lambda n: best_first[n])
        n = heap.pop()
        a, b, left, right = shard.runs[n]
        alive = np.flatnonzero(bound[:, n] >= kth)  # equal scores may still win by their ids
        if not len(alive):
            continue
        if left >= 0:
            heap += [left, right]
            continue
        s = products(q[alive], x[a:b])
        s[x_id[a:b][None, :] == q_id[alive][:, None]] = NONE
        both = np.concatenate([best[alive], s], 1)
        ids = np.concatenate([best_id[alive], np.broadcast_to(x_id[a:b], s.shape)], 1)
        if both.shape[1] > 2 * top:  # rows tied with the kth score all stay for the ordering by id
            line = np.partition(both, -top, axis=1)[:, -top]
            wide = max(top, int((both >= line[:, None]).sum(1).max()))
            some = np.argpartition(-both, min(wide, both.shape[1]) - 1, axis=1)[:, :wide]
            both, ids = np.take_along_axis(both, some, 1), np.take_along_axis(ids, some, 1)
        order = np.lexsort((ids, -both), axis=1)[:, :top]
        best[alive], best_id[alive] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
        kth[alive] = np.maximum(kth[alive], best[alive, -1])
    keep = (best > NONE) & (best >= floor[:, None])
    at = np.nonzero(keep)[0]
    return at, best_id[keep], best[keep]


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """embeddings(vec_id, embedding) -> (vec_id, v array<bigint>, d) of the usable rows."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    # an infinite or undefined component fails both comparisons; a null one makes them null
    good = F.forall("embedding", lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(good).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"), F.size("embedding").alias("d"),
    )
    return rows.where(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) < LONGEST)


_FOUND = "q bigint, vec_id bigint, score bigint"
_TREES = "shard int, d int, kind string, runs binary, balls binary, x binary, x_id binary"


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(np.int64).reshape(len(pdf), -1)


def _tree(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    shard = Shard.build(_matrix(pdf), pdf["vec_id"].to_numpy())
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "d": pdf["d"].iloc[0], **shard.pack()}])


def exact_topk(vectors: DataFrame, queries: DataFrame, top: int = TOP, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    row = F.monotonically_increasing_id()
    x = scratch.keep(integer_vectors(vectors, scale).withColumn("row", row))
    q = scratch.keep(integer_vectors(queries, scale).distinct().withColumn("q", row))
    shards, blocks = max(1, -(-x.count() // shard_rows)), max(1, -(-q.count() // block_queries))
    # rows are dealt by their place, so that a repeated id or vector fills no shard
    x = x.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    trees = scratch.keep(x.select("shard", "d", "vec_id", "v").groupBy("shard", "d").applyInPandas(_tree, _TREES))
    q = q.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("wave", F.expr(f"block div {WAVE_BLOCKS}").cast("int"))
    waves = -(-blocks // WAVE_BLOCKS)

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            shard = Shard.unpack(left.iloc[0])
            for _, some in right.groupby("block"):
                number, query_id, floor = some["q"].to_numpy(), some["vec_id"].to_numpy(), some["kth"].to_numpy()
                at, found, score = search(_matrix(some), query_id, floor, shard, top)
                out.append(pd.DataFrame({"q": number[at], "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "vec_id": [], "score": []}, dtype="int64")

    key = ["shard", "d", "wave"]
    spread = trees.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    some = max(1, math.isqrt(shards))
    found = None
    # the stated queries against every shard, in waves and rounds: never pairs of rows
    for first, last in ((0, 0), (1, some), (some + 1, shards - 1)):
        if first > min(last, shards - 1):
            continue
        if found is None:
            asked = q.withColumn("kth", F.lit(NONE).cast("long"))
        else:
            known = found.groupBy("q").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= top).select("q", "kth")
            asked = q.join(known, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE).cast("long")))
        step = F.explode(F.sequence(F.lit(first), F.lit(min(last, shards - 1))))
        asked = asked.withColumn("step", step).withColumn("shard", F.pmod(F.col("wave") + F.col("step"), F.lit(shards)).cast("int"))
        got = spread.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(walk, _FOUND)
        found = got if found is None else found.unionByName(got)
        found = scratch.keep(found.withColumn("rank", best).where(F.col("rank") <= top).select("q", "vec_id", "score"))
    return found.withColumn("rank", best.cast("int")).join(q.select("q", F.col("vec_id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0), p AS (
  SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM q, v c WHERE q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""
