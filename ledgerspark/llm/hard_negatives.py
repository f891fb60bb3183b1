"""Operator 13, hard negatives by distributed radix selection.

For each anchor the best rows of its own label are its positives; for each anchor and positive the
best rows of other labels whose score lies in a window below the positive's are its hard negatives.
Both are a selection of the k first rows of a window (score falling, then id rising), made without
sorting or moving the scores:

1. Rows are dealt into shards and anchors into blocks of bounded size; a task scores one block
   against one shard and returns, for each window, a histogram of 256 buckets over the scores in
   play, from the best bucket down to where the shard alone has reached k (what lies lower cannot
   hold the kth row).
2. The histograms are summed by window; the bucket of the kth row is the new range in play. When only
   one score is left in play, the ids are refined in the same way.
3. This is repeated until what is above and in play is a handful of rows; then those rows alone are
   gathered and ranked.

Every row is scored against every anchor of the stated set, in blocks: the work is their product.

Components become floor(scale * x), scores are exact integers. Defined cases: rows without an id or
a label, vectors that are null or hold null or non-finite components take no part, nor do vectors so
long (2^28 in these units) that a hundredfold score would not fit 64 bits; vectors of unlike length are
never compared; rows of an anchor's own id are never its positives or negatives; repeated rows are
candidates of their own; anchors repeated in full are asked once, and of one id with several vectors
or labels each is mined by itself; an anchor with fewer positives has fewer windows, a window with fewer rows
returns them all; ties go to the smaller id; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import Scratch
from ledgerspark.llm.topk_search import narrowest, products

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 100, 5, 10, 30, 90
SHARD_ROWS, BLOCK_ANCHORS = 8192, 512
BUCKETS = 256
#: Shares of the shards to which each block of anchors is sent.
LANES = 96
#: Squared length from which on a vector takes no part.
LONGEST = float(2**56)

_SHARD = "shard int, d int, kind string, x binary, x_id binary, x_label binary"
_ASKED = "block int, d int, q_kind string, q binary, of binary, anchor binary, label binary, windows binary"
#: Of each window: its number, the range of scores and ids in play, rows wanted from it, and the whole window's upper end and rows.
_STATE = ["w", "lo", "hi", "want", "id_lo", "id_hi", "top", "k"]


def labelled_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, label, v array<bigint>, d, norm) of the rows that take part."""
    good = F.forall("embedding", lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", "embedding", "label").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(good)
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("v"), F.size("embedding").alias("d"),
    )
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.withColumn("norm", norm).where(F.col("norm") < LONGEST)


def _packed_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    x = narrowest(np.stack(pdf["v"].to_numpy()).astype(np.int64).reshape(len(pdf), -1))
    return pd.DataFrame([{
        "shard": pdf["shard"].iloc[0], "d": pdf["d"].iloc[0], "kind": x.dtype.name, "x": x.tobytes(),
        "x_id": pdf["vec_id"].to_numpy(np.int64).tobytes(), "x_label": pdf["label"].to_numpy(np.int64).tobytes(),
    }])


def _packed_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of a block and the vectors of its anchors, each once."""
    first, of = np.unique(pdf["a"].to_numpy(np.int64), return_index=True, return_inverse=True)[1:]
    some = pdf.iloc[first]
    q = narrowest(np.stack(some["v"].to_numpy()).astype(np.int64).reshape(len(some), -1))
    return pd.DataFrame([{
        "block": pdf["block"].iloc[0], "d": pdf["d"].iloc[0],
        "q_kind": q.dtype.name, "q": q.tobytes(), "of": of.astype(np.int64).tobytes(),
        "anchor": some["vec_id"].to_numpy(np.int64).tobytes(), "label": some["label"].to_numpy(np.int64).tobytes(),
        "windows": pdf[_STATE].to_numpy(np.int64).tobytes(),
    }])


def _eligible(row, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor of a block: its windows, and the scores and ids of the shard's rows that they choose from."""
    x_id, x_label = (np.frombuffer(row[c], np.int64) for c in ("x_id", "x_label"))
    x = np.frombuffer(row["x"], row["kind"]).reshape(len(x_id), -1)
    anchor, label, of = (np.frombuffer(row[c], np.int64) for c in ("anchor", "label", "of"))
    windows = np.frombuffer(row["windows"], np.int64).reshape(len(of), len(_STATE))
    scores = products(np.frombuffer(row["q"], row["q_kind"]).reshape(len(anchor), -1).astype(np.int64), x)
    order = np.argsort(of, kind="stable")
    for i, mine in enumerate(np.split(order, np.searchsorted(of[order], np.arange(1, len(anchor))))):
        fits = ((x_label == label[i]) == same) & (x_id != anchor[i])
        yield windows[mine], scores[i][fits], x_id[fits]


def histogram(score: np.ndarray, ids: np.ndarray, lo: int, hi: int, want: int, id_lo: int, id_hi: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, rows), best bucket first, down to where ``want`` rows are reached."""
    play = (score >= lo) & (score <= hi)
    if hi > lo:
        bucket = (hi - score[play]) // ((hi - lo) // buckets + 1)
    else:
        some = ids[play]
        some = some[(some >= id_lo) & (some <= id_hi)]
        bucket = (some.astype(np.uint64) - np.array(id_lo).astype(np.uint64)) // np.uint64((id_hi - id_lo) // buckets + 1)
    n = np.bincount(bucket.astype(np.int64), minlength=1)
    last = int(np.searchsorted(np.cumsum(n), want)) + 1
    at = np.flatnonzero(n[:last])
    return at, n[at]


def first_rows(score: np.ndarray, ids: np.ndarray, lo: int, top: int, k: int, id_hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's rows that can still be among the k first of a window whose kth row is known to lie at ``lo`` or above."""
    play = (score > lo) & (score <= top) | (score == lo) & (ids <= id_hi)
    score, ids = score[play], ids[play]
    if len(score) > k:  # the k best, with all ties of the last
        score, ids = (z[score >= np.partition(score, len(score) - k)[len(score) - k]] for z in (score, ids))
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _counter(same: bool, buckets: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                w, bucket, n = [], [], []
                for windows, score, ids in _eligible(row, same):
                    for number, lo, hi, want, id_lo, id_hi, _, _ in windows.tolist():
                        at, many = histogram(score, ids, lo, hi, want, id_lo, id_hi, buckets)
                        w += [number] * len(at)
                        bucket += at.tolist()
                        n += many.tolist()
                yield pd.DataFrame({"w": w, "bucket": bucket, "n": n}, dtype="int64")

    return count


def _gatherer(same: bool):
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                w, found, scores = [], [], []
                for windows, score, ids in _eligible(row, same):
                    for number, lo, hi, _, _, id_hi, top, k in windows.tolist():
                        s, i = first_rows(score, ids, lo, top, k, id_hi)
                        w += [number] * len(s)
                        found += i.tolist()
                        scores += s.tolist()
                yield pd.DataFrame({"w": w, "vec_id": found, "score": scores}, dtype="int64")

    return gather


class Selector:
    """Radix selection over the shards of one table of vectors."""

    def __init__(self, vectors: DataFrame, anchors: DataFrame, scale: int, shard_rows: int, block_anchors: int, handful: int, buckets: int):
        self.scratch = Scratch(vectors.sparkSession, "hard-negatives")
        row = F.monotonically_increasing_id()
        x = self.scratch.keep(labelled_vectors(vectors, scale).withColumn("row", row))
        ends = x.agg(F.count("*").alias("n"), F.min("vec_id").alias("a"), F.max("vec_id").alias("b"), F.max("norm").alias("norm")).first()
        self.rows, self.ids, self.longest, self.handful = ends["n"], (ends["a"] or 0, ends["b"] or 0), ends["norm"] or 0.0, handful
        self.buckets = buckets
        self.shards = max(1, -(-self.rows // shard_rows))
        # dealt by their place, so that a repeated id or vector fills no shard
        dealt = x.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(self.shards)).cast("int"))
        self.packed = self.scratch.keep(dealt.select("shard", "d", "vec_id", "label", "v").groupBy("shard", "d").applyInPandas(_packed_shard, _SHARD))
        self.scratch.drop(x)
        a = self.scratch.keep(labelled_vectors(anchors, scale).distinct().withColumn("a", row))
        blocks = max(1, -(-a.count() // block_anchors))
        self.anchors = a.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int"))

    def _against_shards(self, windows: DataFrame) -> DataFrame:
        """Each block of windows beside each shard: the stated anchors against all rows, in blocks.

        Blocks go to each lane of shards, not to each shard, and are shuffled there: by the size of their files, which tells
        nothing of their copies, they would be broadcast.
        """
        asked = windows.join(self.anchors.select("a", "block", "d", "vec_id", "label", "v").hint("merge"), "a").groupBy("block", "d").applyInPandas(_packed_block, _ASKED)
        lanes = min(self.shards, LANES)
        asked = self.scratch.keep(asked).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        packed = self.packed.withColumn("lane", F.col("shard") % lanes)
        return packed.join(asked.hint("merge"), ["lane", "d"]).drop("lane", "shard", "block", "d")

    def select(self, windows: DataFrame, same: bool) -> DataFrame:
        """windows(w, a, lo, hi, k) -> (w, rank, vec_id, score): the k first rows of each, of the anchor's label or of the others."""
        keep = self.scratch.keep
        state = keep(windows.select(
            "w", "a", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("k").cast("long").alias("want"),
            F.lit(self.ids[0]).cast("long").alias("id_lo"), F.lit(self.ids[1]).cast("long").alias("id_hi"),
            F.col("hi").cast("long").alias("top"), F.col("k").cast("long").alias("k"), F.lit(False).alias("done"),
        ))
        while state.where("NOT done").limit(1).count():
            counted = self._against_shards(state.where("NOT done")).mapInPandas(_counter(same, self.buckets), "w bigint, bucket bigint, n bigint")
            summed = counted.groupBy("w", "bucket").agg(F.sum("n").alias("n"))
            # a window's histogram has as many rows as buckets at most
            running = summed.withColumn("upto", F.sum("n").over(Window.partitionBy("w").orderBy("bucket")))
            kth = running.join(state.select("w", "want"), "w").where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))).drop("want")
            state = keep(self._narrowed(state.join(kth, "w", "left")))
        found = self._against_shards(state).mapInPandas(_gatherer(same), "w bigint, vec_id bigint, score bigint")
        order = Window.partitionBy("w").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).join(state.select("w", "k"), "w").where("rank <= k").select("w", "rank", "vec_id", "score")
        return keep(ranked)

    def _narrowed(self, s: DataFrame) -> DataFrame:
        """The bucket of the kth row becomes the range in play; a window with fewer rows than wanted returns all that it has."""
        by_score = F.col("hi") > F.col("lo")
        wide = F.expr(f"(hi - lo) div {self.buckets} + 1")
        hi = F.when(by_score, F.col("hi") - F.col("bucket") * wide).otherwise(F.col("hi"))
        lo = F.when(by_score, F.greatest(F.col("lo"), F.col("hi") - F.col("bucket") * wide - wide + 1)).otherwise(F.col("lo"))
        # ids may span all of 64 bits
        id_wide = F.expr(f"(CAST(id_hi AS DECIMAL(38, 0)) - id_lo) div {self.buckets} + 1").cast("decimal(20,0)")
        id_lo = F.col("id_lo").cast("decimal(38,0)") + F.col("bucket") * id_wide
        id_hi = F.least(F.col("id_hi").cast("decimal(38,0)"), id_lo + id_wide - 1)
        found = F.col("n").isNotNull()
        moved = s.select(
            "w", "a", F.when(found, lo).otherwise(F.col("lo")).alias("lo"), F.when(found, hi).otherwise(F.col("hi")).alias("hi"),
            F.when(found, F.col("want") - (F.col("upto") - F.col("n"))).otherwise(F.col("want")).alias("want"),
            F.when(found & ~by_score, id_lo.cast("long")).otherwise(F.col("id_lo")).alias("id_lo"),
            F.when(found & ~by_score, id_hi.cast("long")).otherwise(F.col("id_hi")).alias("id_hi"),
            "top", "k", "done", "n",
        )
        one = (F.col("lo") == F.col("hi")) & (F.col("id_lo") == F.col("id_hi"))
        few = F.col("k") - F.col("want") + F.col("n") <= F.greatest(F.lit(self.handful), F.col("k"))
        return moved.withColumn("done", F.col("done") | F.col("n").isNull() | few | one).drop("n")


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS, handful: int = 64, buckets: int = BUCKETS,
) -> DataFrame:
    """vectors, anchors (vec_id, embedding, label) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Negatives satisfy low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    s = Selector(vectors, anchors, scale, shard_rows, block_anchors, handful, buckets)
    # no score is beyond the product of the lengths
    most = F.ceil(F.sqrt("norm") * float(s.longest) ** 0.5 * 1.000001 + 1).cast("long")
    best = s.select(s.anchors.select(F.col("a").alias("w"), "a", (-most).alias("lo"), most.alias("hi"), F.lit(positives).alias("k")), True)
    best = s.scratch.keep(best.select(
        F.monotonically_increasing_id().alias("w"), F.col("w").alias("a"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    floor = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    windows = best.select("w", "a", (-floor(f"(-{low} * positive_score)")).alias("lo"), floor(f"({high} * positive_score)").alias("hi"), F.lit(negatives).alias("k")).where("lo <= hi")
    found = s.select(windows, False)
    return found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(best, "w").join(
        s.anchors.select("a", F.col("vec_id").alias("anchor_id")), "a",
    ).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (SELECT DISTINCT vec_id, label, v FROM v WHERE vec_id % 100 = 0), s AS (
  SELECT a.vec_id AS anchor_id, a.label = x.label AS same, x.vec_id, a.label, a.v,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * x.v[i])) AS BIGINT) AS score
  FROM a, v x WHERE a.vec_id <> x.vec_id AND len(a.v) = len(x.v)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id, label, v ORDER BY score DESC, vec_id) AS n FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.label, p.v, p.n ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.label = s.label AND p.v = s.v AND NOT s.same
  WHERE p.n <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
