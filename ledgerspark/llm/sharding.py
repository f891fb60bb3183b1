"""Operator 10, sharding by balanced label propagation.

Documents are nodes, keys that several of them share (the text itself, or any table of (node, key)
links) are what links them, and a key stands where most of its documents are. Labels start even, dealt
by place. In each round two joins move documents: links meet the documents' labels and give each key
its label, keys meet their links and give each document the votes of its neighbours by label, and a
document that another label would suit better asks to move there. Quotas decide how many of those
that ask may go from each shard to each other one: linked documents never outgrow a shard's share, and
room that others leave is used in the same round. Documents are admitted by distributed ranks, so that
just as many move as the quota says. Rounds end when the number of cut edges no longer falls.

Documents without links hold no label: they fill every shard up to its share at the end, which makes
the ``rows`` law exact without cutting any edge. A key's edges are a star around the label where most
of its documents are; an edge to a document elsewhere is cut.

Ranks are counts by one of ``BUCKETS`` hash buckets and a running number inside it: no task sees all
rows, a hot key's documents spread over all buckets, and what is broadcast (a number for each bucket
and move, or key class) does not follow the corpus. Defined cases: null texts are equal to each other
and have size 1; null ids take part; repeated rows are documents of their own, linked by their text;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import Scratch

SHARDS = 16
ROUNDS = 12
BUCKETS = 256


def nodes_of(docs: DataFrame) -> DataFrame:
    """documents -> (node, doc_id, size, text_crc32, grp); ``grp`` names the text exactly (sha-256)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        F.monotonically_increasing_id().alias("node"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.sha2(text, 256)).alias("grp"),
    )


def equal_text_links(nodes: DataFrame) -> DataFrame:
    """(node, key) of the documents whose text others have, too; counted by text before anything is joined."""
    several = nodes.groupBy("grp").agg(F.count("*").alias("n"), F.min("node").alias("key")).where("n > 1").select("grp", "key")
    return nodes.select("node", "grp").join(several, "grp").select("node", "key")


def ranked(rows: DataFrame, groups: list[str], name: str, first: list[Column] | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each value of ``groups``, in the order of ``first`` (small whole numbers), then of hash buckets."""
    order = [c.alias(f"_o{i}") for i, c in enumerate(first or [])]
    inner = [f"_o{i}" for i in range(len(order))]
    dealt = rows.select("*", *order, F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).cast("int").alias("_bucket"))
    counts = dealt.groupBy(*groups, *inner, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy(*inner, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, *inner, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*groups, *inner, "_bucket").orderBy("node")) - 1
    out = dealt.withColumn("_inside", inside).join(F.broadcast(offsets), [*groups, *inner, "_bucket"])
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop(*inner, "_bucket", "_n", "_before", "_inside")


def admitted(asked: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many may move from each label to each other one: no label takes in more than its room and what leaves it."""
    moves = asked.astype(np.float64)
    for _ in range(200):
        short = np.flatnonzero(moves.sum(0) > room + moves.sum(1) + 1e-9)
        if not len(short):
            break
        for t in short:
            moves[:, t] *= (room[t] + moves[t].sum()) / max(moves[:, t].sum(), 1e-9)
    moves = np.floor(moves + 1e-9).astype(np.int64)
    while True:  # whole numbers may leave one too many
        over = moves.sum(0) - room - moves.sum(1)
        t = int(np.argmax(over))
        if over[t] <= 0:
            break
        s = int(np.argmax(moves[:, t]))
        moves[s, t] -= min(moves[s, t], int(np.ceil(over[t])))
    for t in np.argsort(-room):  # or places free
        for s in np.argsort(moves[:, t] - asked[:, t]):
            moves[s, t] += max(0, min(asked[s, t] - moves[s, t], int(room[t] + moves[t].sum() - moves[:, t].sum())))
    return moves


def key_labels(linked: DataFrame, room: np.ndarray) -> DataFrame:
    """(node, key, label) -> (key, spot, held, n): where most of a key's documents are, of equals a label with room, then a hash of the key."""
    free = F.element_at(F.array(*[F.lit(int(r)) for r in np.maximum(room, 0)]), F.col("label") + 1)
    votes = linked.groupBy("key", "label").agg(F.count("*").alias("c"))
    rank = F.struct("c", (free > 0).cast("int").alias("r"), F.xxhash64("key", "label").alias("h"))
    return votes.groupBy("key").agg(F.max_by("label", rank).alias("spot"), F.max("c").alias("held"), F.sum("c").alias("n"))


def propagate(labels: DataFrame, links: DataFrame, share: np.ndarray, rounds: int, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """(node, label), (node, key) -> (node, label), cut edges before and after each round."""
    shards = len(share)
    cuts: list[int] = []
    best = labels
    for _ in range(rounds + 1):
        held = np.zeros(shards, np.int64)
        for r in labels.groupBy("label").count().collect():  # a row for each shard
            held[r["label"]] = r["count"]
        linked = links.join(labels, "node")
        keys = scratch.keep(key_labels(linked, share - held))
        cut = keys.agg(F.sum(F.col("n") - F.col("held"))).first()[0] or 0
        if cuts and cut >= cuts[-1]:
            return best, cuts
        cuts.append(int(cut))
        best = labels
        if not cut or len(cuts) > rounds:
            return best, cuts
        # a document's neighbours by label: of each key it has, all that stand at the key's spot
        votes = links.join(keys.select("key", "spot"), "key").groupBy("node", F.col("spot").alias("to")).agg(F.count("*").alias("v"))
        stays = votes.join(labels, "node").groupBy("node").agg(
            F.min("label").alias("label"), F.max(F.struct("v", F.xxhash64("node", "to").alias("h"), "to")).alias("b"),
            F.max(F.when(F.col("to") == F.col("label"), F.col("v")).otherwise(0)).alias("own"))
        wants = scratch.keep(stays.where(F.col("b.v") > F.col("own")).select("node", "label", F.col("b.to").alias("to")))
        asked = np.zeros((shards, shards), np.int64)
        for r in wants.groupBy("label", "to").count().collect():  # at most shards * (shards - 1) rows
            asked[r["label"], r["to"]] = r["count"]
        quota = admitted(asked, share - held)
        grant = F.element_at(F.array(*[F.lit(int(x)) for x in quota.ravel()]), F.col("label") * shards + F.col("to") + 1)
        moved = ranked(wants, ["label", "to"], "nth").where(F.col("nth") < grant).select("node", "to")
        labels = scratch.keep(labels.join(moved, "node", "left").select("node", F.coalesce("to", "label").alias("label")))
    return best, cuts


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, links: DataFrame | None = None) -> DataFrame:
    """-> (doc_id, size, text_crc32, law, shard, slot, grown_shard); the law is ``rows``.

    ``links``: (doc_id, key) of documents to be kept together; equal texts, by default.
    """
    return shard_with_cuts(docs, shards, rounds, links)[0]


def shard_with_cuts(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, links: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """The same, and the number of cut edges at the start and after each round that lowered it."""
    scratch = Scratch(docs.sparkSession, "sharding")
    nodes = scratch.keep(nodes_of(docs))
    if links is None:
        linked = equal_text_links(nodes)
    else:
        given = links.select("doc_id", F.xxhash64("key").alias("key")).where("doc_id IS NOT NULL AND key IS NOT NULL").distinct()
        linked = nodes.select("node", "doc_id").join(given, "doc_id").select("node", "key")
    linked = scratch.keep(linked)
    total = nodes.count()
    share = np.full(shards, total // shards, np.int64)
    share[: total % shards] += 1
    # linked documents start evenly, so that none holds more than its share of them
    known = linked.select("node").distinct()
    start = ranked(known.withColumn("one", F.lit(0)), ["one"], "nth").select("node", F.pmod("nth", F.lit(shards)).cast("int").alias("label"))
    labels, cuts = propagate(scratch.keep(start), linked, share, rounds, scratch)
    held = np.zeros(shards, np.int64)
    for r in labels.groupBy("label").count().collect():
        held[r["label"]] = r["count"]
    # documents without links take the places left, one shard after the other
    loose = ranked(nodes.select("node").join(labels, "node", "left_anti").withColumn("one", F.lit(0)), ["one"], "nth")
    at = F.lit(shards - 1)
    ends = np.cumsum(share - held)
    for s in range(shards - 2, -1, -1):
        at = F.when(F.col("nth") < int(ends[s]), s).otherwise(at)
    placed = scratch.keep(labels.unionByName(loose.select("node", at.cast("int").alias("label"))))
    slots = ranked(placed, ["label"], "slot")
    return nodes.drop("grp").join(slots, "node").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("label").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    ), cuts


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
