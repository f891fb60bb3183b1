"""Operator 7, best-fit packing with several capacities.

Each sequence has room for tokens, for documents and for attention cost (the sum of squared piece
lengths); a piece goes to the open sequence with the best score among those where it fits every
capacity. The score is the weighted norm of what would be left over (``norm``), or the weighted
dot product of the piece with the room left (``dot``).

How well pieces fit depends on their lengths alone, so best fit decreasing runs on the histogram of
lengths (at most ``capacity`` entries, whatever the corpus): sequences with equal room form one class
with a multiplicity, and a step moves as many pieces of one length into one class as there are of
either. Pieces then find their places by their rank within their length, which is a running number
inside the task that tokenised them plus the count of earlier tasks: no sort, no task that sees all
rows, no text or token in a shuffle. The counts (a row for each task and length) are joined back:
Spark broadcasts them while they are small, else the pieces' few numbers are shuffled.

Defined cases: a null text is empty, and an empty text is its closing id alone; null doc_ids are
packed like others; repeated rows are packed as often as they occur; a text of any length is
tokenised whole, by the task that reads it, and cut into pieces that no capacity refuses; other columns
are ignored; no rows give no rows.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import Scratch

SEQUENCE_TOKENS = 2048
#: Production capacities for documents and attention: every piece has a token, and squares of
#: parts never exceed the square of their sum, so that neither costs a sequence here.
SEQUENCE_DOCS = 2048
SEQUENCE_ATTENTION = 2048 * 2048
WEIGHTS = (1.0, 0.05, 0.05)
END_ID = 0


class Run(NamedTuple):
    """``count`` pieces of one length, from rank ``rank``: one in each of the sequences from ``sequence``, at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def best_fit(histogram: dict[int, int], capacity: tuple[int, int, int], weights=WEIGHTS, score: str = "norm") -> list[Run]:
    """Vector best fit decreasing over a histogram of lengths.

    Open classes are rows (tokens left, documents left, attention left, first sequence, sequences).
    Each step ends a length or uses a class up, and adds at most one class, so the number of steps
    follows the number of lengths, not of pieces.
    """
    cap = np.array(capacity, np.float64)
    w = np.array(weights) / cap**2
    runs: list[Run] = []
    opened = 0
    left = np.empty((0, 3), np.int64)
    span = np.empty((0, 2), np.int64)
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        count, rank = histogram[length], 0
        while count:
            fits = np.flatnonzero((left >= need).all(1))
            if len(fits):
                room = left[fits].astype(np.float64)
                value = ((room - need) ** 2 @ w) if score == "norm" else -(room * need @ w)
                k = fits[np.argmin(value)]
            else:
                sequences = -(-count // max(1, int((cap // need).min())))
                left = np.vstack([left, np.array([capacity], np.int64)])
                span = np.vstack([span, np.array([[opened, sequences]], np.int64)])
                opened += sequences
                k = len(left) - 1
            n = min(count, int(span[k, 1]))
            runs.append(Run(length, rank, n, int(span[k, 0]), int(capacity[0] - left[k, 0])))
            after = left[k] - need
            if n < span[k, 1]:  # the class splits
                span[k] += (n, -n)
                left, span = np.vstack([left, after]), np.vstack([span, [runs[-1].sequence, n]])
            else:
                left[k] = after
            alive = left[:, :2].min(1) > 0
            if not alive.all():
                left, span = left[alive], span[alive]
            count, rank = count - n, rank + n
    return runs


@functools.cache
def _encoder():
    """Once for each Python worker, whatever its number of tasks. The public byte-level BPE of 50,257 ids; its ranks give the same ids as its tokenizers file, in a third of the time."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _whole_encoder():
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@functools.cache
def _added_tokens() -> list[str]:
    """Strings that the tokenizers file takes for one token wherever they stand in a text; the ranks don't know them."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def token_ids(text: str) -> np.ndarray:
    """The ids of a text by the tokenizers file. Texts that hold one of its added tokens, and those on which the faster encoder gives up (runs of white space beyond its pattern's stack), go to that file's own encoder."""
    if any(t in text for t in _added_tokens()):
        return np.array(_whole_encoder().encode(text, add_special_tokens=False).ids, np.uint32)
    try:
        return _encoder().encode_to_numpy(text)
    except ValueError:
        return np.array(_whole_encoder().encode(text, add_special_tokens=False).ids, np.uint32)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole capacities from the end, the first piece takes what is left."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def pieces(docs: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, piece, start, length, ids_crc32, part, nth).

    ``nth`` counts the pieces of one length within ``part``, the task that tokenised them. The
    result must be kept before it is read twice: it is a table's content that ties the two together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, rows = batch.column(0), ([], [], [], [], [], [])
            take, n_piece, start, length, crc, nth = rows
            for i, text in enumerate(batch.column(1)):
                tokens = np.append(token_ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                    take.append(i)
                    n_piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(tokens[s : s + n].tobytes()))
                    nth.append(int(seen[n]))
                    seen[n] += 1
            columns = [ids.take(pa.array(take, pa.int64())), pa.array(n_piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(take), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


def pack(
    docs: DataFrame, capacity: tuple[int, int, int] = (SEQUENCE_TOKENS, SEQUENCE_DOCS, SEQUENCE_ATTENTION),
    weights=WEIGHTS, score: str = "norm",
) -> DataFrame:
    """-> (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    # no piece is larger than any capacity
    cut_up = scratch.keep(pieces(docs, min(capacity[0], math.isqrt(capacity[2]))))
    counts = scratch.keep(cut_up.groupBy("part", "length").agg(F.count("*").alias("n")))
    # at most capacity[0] rows reach the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit(histogram, capacity, weights, score)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut_up.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"),
    )
    # runs by length: first ranks ascending, so that a search finds a piece's run
    table: dict[int, tuple[np.ndarray, ...]] = {}
    by: dict[int, list[Run]] = {}
    for r in runs:
        by.setdefault(r.length, []).append(r)
    for n, some in by.items():
        table[n] = tuple(np.array([getattr(r, f) for r in some], np.int64) for f in ("rank", "sequence", "offset"))
    shared = spark.sparkContext.broadcast(table)  # follows the number of lengths, at most a few per token of capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(some):
                    first, sequence, offset = shared.value[int(length[some[0]])]
                    k = np.searchsorted(first, rank[some], side="right") - 1
                    seq[some], off[some] = sequence[k] + rank[some] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Capacities of :func:`packing_by_cost`, all of which bind: documents, and attention of half a full sequence's.
COST_DOCS, COST_ATTENTION = 8, SEQUENCE_TOKENS**2 // 2


def packing_by_cost(spark, sf_dir: str) -> DataFrame:
    """The same with few documents in a sequence and half the attention cost: pieces are cut to what the cost allows."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), (SEQUENCE_TOKENS, COST_DOCS, COST_ATTENTION))
