"""Operator 5, quality classifier: a byte-level convolutional network in numpy.

A text's bytes (embedded, and compared with the bytes a few places before them, so that repeated
words show) pass through learned filters over chunks of 16 bytes that overlap by half and cover
the whole text; each filter's largest answer is kept and a logistic layer combines them into one
probability.

Training takes at most ``TRAIN_ROWS`` labelled rows (those with the smallest hashes of their ids) and
``TRAIN_BYTES`` bytes of text, documented bounds; scoring reads every byte of every text, however
long. Defined cases: null and empty texts are one chunk of padding and get the network's answer to
it; labels that are null or not 0/1 are not learned from; with labels of one class only, or none,
every score is 0.5; repeated rows are scored alike; of the input's other columns only the named ones
are carried along, and the result's column takes the name ``name``, replacing one of that name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import crc_bucket, small_batches
from ledgerspark.llm.textscan import blocks

TRAIN_ROWS = 3000
EPOCHS, RATE, SEED = 14, 0.01, 7
STRIDE, DIM, FILTERS = 8, 4, 24
LAGS = tuple(range(2, 26))
#: Zero bytes before each text, so that no lag reaches into the text before it.
LEAD = 32
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
WIDTH = STRIDE * DIM + len(LAGS)
#: A text beyond this is scanned in parts, whose chunks are together just those of the whole text.
PART_BYTES = 256 << 10
#: Training texts are taken in the order of their ids' hashes up to so many bytes.
TRAIN_BYTES = 64 << 20


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes, first block of each text, number of its blocks); a block is STRIDE bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    room = LEAD + (sizes + STRIDE - 1) // STRIDE * STRIDE + STRIDE
    first = np.concatenate(([0], np.cumsum(room)))
    data = np.zeros(first[-1], np.uint8)
    for t, at in zip(texts, first):
        data[at + LEAD : at + LEAD + len(t)] = np.frombuffer(t, np.uint8)
    return data, (first[:-1] + LEAD - STRIDE) // STRIDE, (room - LEAD) // STRIDE


def block_features(data: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """(blocks, WIDTH): the embedded bytes of each block and, for each lag, how many bytes repeat."""
    n = len(data) // STRIDE
    out = np.empty((n, WIDTH), np.float32)
    out[:, : STRIDE * DIM] = embed[data].reshape(n, STRIDE * DIM)
    out[:, STRIDE * DIM :] = lag_counts(data)
    out[:, STRIDE * DIM :] *= 1 / STRIDE
    return out


def lag_counts(data: np.ndarray) -> np.ndarray:
    """(blocks, lags): how many of a block's bytes equal the byte so many places before, one byte a count."""
    n = len(data) // STRIDE
    out = np.zeros((n, len(LAGS)), np.uint8)
    live = data != 0
    same = np.zeros(len(data), bool)
    for k, lag in enumerate(LAGS):
        np.equal(data[lag:], data[:-lag], out=same[lag:])
        same[:lag] = False
        same &= live
        # eight bytes of 0/1 summed as one 64-bit word: the top byte of the product
        out[:, k] = (same.view(np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)
    return out


class Network:
    """Embedding (256, DIM), two half-chunk filters (WIDTH, FILTERS), their bias, the output layer."""

    def __init__(self, rng: np.random.Generator):
        f = np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(f),
            "left": rng.normal(0, 0.15, (WIDTH, FILTERS)).astype(f),
            "right": rng.normal(0, 0.15, (WIDTH, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f), "out": rng.normal(0, 0.3, FILTERS).astype(f), "c": np.zeros(1, f),
        }
        self.p["embed"][0] = 0

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, FILTERS): each filter's largest answer over all chunks of a text."""
        data, first, n = layout(texts)
        x = block_features(data, self.p["embed"])
        y = x @ self.p["left"]
        y[:-1] += (x @ self.p["right"])[1:]
        # chunks start at each block of a text but its last; the lead of the next text is left out
        edges = np.empty(2 * len(texts), np.int64)
        edges[0::2], edges[1::2] = first, first + n
        edges = edges[:-1] if edges[-1] >= len(y) else edges
        return np.maximum.reduceat(y, edges, axis=0)[0::2] + self.p["bias"]

    def pooled_in_parts(self, text: bytes) -> np.ndarray:
        """The same for one long text: chunks start at its blocks -1 (the last of the lead) to the last, a run of them at a time."""
        blocks_in = -(-len(text) // STRIDE)
        best = np.full(FILTERS, -np.inf, np.float32)
        for a in range(-1, blocks_in, PART_BYTES // STRIDE):
            b = min(blocks_in, a + PART_BYTES // STRIDE)
            begin, end = STRIDE * a - LEAD, STRIDE * (b + 1)  # the blocks a to b and what lags reach before them
            some = text[max(0, begin) : end]
            data = np.zeros(end - begin, np.uint8)
            data[max(0, -begin) : max(0, -begin) + len(some)] = np.frombuffer(some, np.uint8)
            x = block_features(data, self.p["embed"])[LEAD // STRIDE :]
            best = np.maximum(best, (x[:-1] @ self.p["left"] + x[1:] @ self.p["right"]).max(0))
        return best + self.p["bias"]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.empty((len(texts), FILTERS), np.float32)
        long = np.fromiter((len(t) > PART_BYTES for t in texts), bool, len(texts))
        if not long.all():
            z[~long] = self.pooled([t for t in texts if len(t) <= PART_BYTES])
        for i in np.flatnonzero(long):
            z[i] = self.pooled_in_parts(texts[i])
        return 1 / (1 + np.exp(-(np.tanh(z) @ self.p["out"] + self.p["c"][0]).astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray) -> Network | None:
    """Adam on the log loss; a text's gradient flows through the one chunk that each filter keeps."""
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(SEED)
    net = Network(rng)
    p = net.p
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    laid = [layout([t])[0] for t in texts]
    lags = [lag_counts(d) for d in laid]
    weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean())) ** 0.5
    first, step, cut = LEAD // STRIDE - 1, 0, STRIDE * DIM
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 16)):
            g = {k: np.zeros_like(v) for k, v in p.items()}
            for i in batch:
                b = laid[i].reshape(-1, STRIDE)
                x = np.concatenate([p["embed"][b].reshape(len(b), cut), lags[i] * np.float32(1 / STRIDE)], axis=1)
                y = (x[:-1] @ p["left"] + x[1:] @ p["right"])[first:]
                top = y.argmax(0)
                z = np.tanh(y[top, np.arange(FILTERS)] + p["bias"])
                s = 1 / (1 + np.exp(-float(z @ p["out"] + p["c"][0])))
                d = np.float32((s - labels[i]) * weight[i])
                g["out"] += d * z
                g["c"] += d
                dz = d * p["out"] * (1 - z * z)
                g["bias"] += dz
                a, c = x[top + first], x[top + first + 1]
                g["left"] += a.T * dz
                g["right"] += c.T * dz
                for blk, side in ((top + first, "left"), (top + first + 1, "right")):
                    de = (p[side][:cut] * dz).T.reshape(-1, DIM)
                    np.add.at(g["embed"], b[blk].reshape(-1), de)
            step += 1
            for k in p:
                q = g[k] / len(batch) + 1e-4 * p[k]
                mean[k] = 0.9 * mean[k] + 0.1 * q
                square[k] = 0.99 * square[k] + 0.01 * q * q
                p[k] = p[k] - np.float32(rate) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
            p["embed"][0] = 0
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, rows: int) -> DataFrame:
    """(text binary, y): texts and 0/1 labels of at most ``rows`` labelled documents, those whose ids hash lowest, and of ``TRAIN_BYTES`` bytes together.

    Of several texts of one id the one with the smallest hash is taken.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & allowed & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded by ``rows``, hence the broadcast
    text = F.coalesce("text", F.lit(""))
    got = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("t")).select("doc_id", "t.text", "t.y")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over ``rows`` rows at most
    got = got.withColumn("sum", F.sum(F.octet_length("text").cast("long")).over(before)).where(F.col("sum") <= TRAIN_BYTES)
    return got.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select(F.col("text").cast("binary").alias("text"), "y")


def fitted(sample: DataFrame, train):
    """The model that ``train`` learns from a bounded sample, in one task: the driver gets the model, never a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(y, np.float32)))], pa.binary())], names=["model"])

    with small_batches(sample.sparkSession):
        found = sample.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network | None:
    """Learn ``labels.quality`` from the rows outside the held-out fold."""
    return fitted(labelled_sample(docs, labels, "quality", crc_bucket("doc_id", FOLDS) != HELD_OUT, rows), train)


def score(docs: DataFrame, net: Network | None, columns: list[str], name: str = "score") -> DataFrame:
    """Append the score, as column ``name``, to the named columns of every document."""
    columns = [c for c in columns if c.lower() != name.lower()]
    extra = [] if "text" in columns else ["text"]
    kept = docs.select(*[F.col(f"`{c}`") for c in [*columns, *extra]])
    fields, at, n = kept.schema.fields[: len(columns)], [*columns, *extra].index("text"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            for first, some in blocks(texts):
                s = net.scores(some) if net else np.full(len(some), 0.5)
                head = batch.slice(first, len(some))
                yield pa.RecordBatch.from_arrays([*head.columns[:n], pa.array(s)], names=[*columns, name])

    return kept.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """documents + labels -> the named columns (all by default) and ``name``, the probability of label 1."""
    return score(docs, fit(docs, labels), columns or docs.columns, name)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels, ["doc_id"]).select(
        "doc_id", (crc_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
