"""Operator 11, a prefix trie of conversations as succinct level-order tries.

A node is a distinct sequence of first turns, known by a 128-bit hash of its turns and their places.
Nodes whose subtrees hold many turns are the heavy upper levels; below them every subtree is small,
and small subtrees are dealt into shards of bounded size. numpy builds a LOUDS trie of each shard:
a bit vector that gives each node, in level order, a one for every child and then a zero, beside arrays
of labels, members and bytes in the same order. Parents are read from the bit vector, and rollups
run through the levels from the last to the first with ``np.add.at``. The upper levels are merged by
Spark alone: what each small subtree and each heavy node adds is summed along the conversation
that stands for it, and then by node.

Turns of one conversation, however many, are ranked and hashed in runs of bounded size. Texts are
sorted once, to find the turns' places, and then dropped.

Defined cases: rows without a conversation id take no part; turns in the same place are ordered by
role and text; repeated rows are turns of their own; null roles and texts are empty ones; texts of any
length count whole; a conversation may have no turn left and then ends at the root; other columns are
ignored; no rows give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import Scratch, union_all

GROUP, HEADS = 5, 9
#: Turns below a node from which on it is an upper node, and turns in a shard, about.
SHARD_TURNS = 1 << 16
#: Turns of one conversation that are summed by one task.
RUN_TURNS = 4096
#: Turns in a partition of the sort by place.
SORTED_TURNS = 1 << 18

KEY = ["depth", "k1", "k2"]


class Louds:
    """A forest in level order: node 0 is above all, ``bits`` has a one for each child and a zero after each node's children."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.ones, self.zeros = np.flatnonzero(bits), np.flatnonzero(bits == 0)
        #: of node i + 1: zeros before its one
        self.parent = self.ones - np.arange(len(self.ones))

    @classmethod
    def build(cls, parent: np.ndarray, level: np.ndarray, first: np.ndarray) -> tuple[Louds, np.ndarray]:
        """parent (row number, -1 for a top), level and order among siblings -> trie, and the rows in level order."""
        n = len(parent)
        place = np.zeros(n + 1, np.int64)  # of a row in level order; the last is the node above all
        order = np.empty(n, np.int64)
        by_level = np.argsort(level, kind="stable")
        ends = np.searchsorted(level[by_level], np.arange(level.max(initial=-1) + 2))
        done = 0
        for a, b in zip(ends[:-1], ends[1:]):
            rows = by_level[a:b]
            rows = rows[np.lexsort((first[rows], place[parent[rows]]))]
            order[done : done + len(rows)] = rows
            place[rows] = np.arange(done + 1, done + len(rows) + 1)
            done += len(rows)
        degree = np.bincount(place[parent], minlength=n + 1)
        bits = np.ones(2 * n + 1, np.uint8)
        bits[np.cumsum(degree + 1) - 1] = 0
        return cls(bits), order

    def children(self, node: int) -> range:
        """Numbers of a node's children, which are neighbours."""
        a = self.zeros[node - 1] + 1 if node else 0
        return range(a - node + 1, self.zeros[node] - node + 1)

    def degrees(self) -> np.ndarray:
        return np.diff(self.zeros, prepend=-1) - 1

    def rollup(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees; ``own`` has a value for node 0 too."""
        total = own.copy()
        levels, node = [], np.array([0])
        while len(node):
            a, b = self.children(int(node[0])).start, self.children(int(node[-1])).stop
            node = np.arange(a, b)
            levels.append(node)
        for node in reversed(levels):
            np.add.at(total, self.parent[node - 1], total[node])
        return total

    def pack(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, packed: bytes, nodes: int) -> Louds:
        return cls(np.unpackbits(np.frombuffer(packed, np.uint8), count=2 * nodes + 1))

    def find(self, labels: np.ndarray, path: list) -> int | None:
        """The node at the end of a path of labels, or None."""
        node = 0
        for label in path:
            node = next((c for c in self.children(node) if tuple(labels[c - 1]) == tuple(label)), None)
            if node is None:
                return None
        return node


_TRIE = "shard int, n int, louds binary, k1 binary, k2 binary, conv binary, depth binary, members binary, bytes binary"
_ARRAYS = ["k1", "k2", "conv", "depth", "members", "bytes"]
_NODES = "conv bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, top boolean"


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    """(conv, depth, k1, k2, bytes) of a shard's turns -> its trie."""
    conv, depth, k1, k2, size = (pdf[c].to_numpy(np.int64) for c in ("conv", "depth", "k1", "k2", "bytes"))
    rows = np.lexsort((conv, k2, k1, depth))
    key = np.stack([depth, k1, k2], 1)[rows]
    new = np.r_[True, (key[1:] != key[:-1]).any(1)]
    node = np.empty(len(rows), np.int64)
    node[rows] = np.cumsum(new) - 1
    stands = rows[new]  # rows are in the order of ids, so each node's first is its smallest member
    path = np.lexsort((depth, conv))
    follows = np.r_[False, conv[path][1:] == conv[path][:-1]]
    before, level = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
    before[path[1:]] = np.where(follows[1:], node[path[:-1]], -1)
    starts = np.maximum.accumulate(np.where(follows, 0, np.arange(len(path))))
    level[path] = np.arange(len(path)) - starts
    trie, order = Louds.build(before[stands], level[stands], conv[stands])
    at = stands[order]
    members = np.bincount(node)[order]
    columns = {"k1": k1[at], "k2": k2[at], "conv": conv[at], "depth": depth[at], "members": members, "bytes": size[at]}
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "n": len(at), "louds": trie.pack(), **{k: v.astype(np.int64).tobytes() for k, v in columns.items()}}])


def unpacked(row) -> tuple[Louds, dict[str, np.ndarray]]:
    return Louds.unpack(row["louds"], row["n"]), {c: np.frombuffer(row[c], np.int64) for c in _ARRAYS}


def _rolled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.to_dict("records"):
            trie, x = unpacked(row)
            degree = trie.degrees()
            leaves = trie.rollup((degree == 0).astype(np.int64))[1:]
            saved = trie.rollup(np.r_[0, (x["members"] - 1) * x["bytes"]])[1:]
            top = trie.parent == 0
            yield pd.DataFrame({
                "conv": x["conv"], "depth": x["depth"], "parent": np.where(top, 0, x["conv"][trie.parent - 1]), "n_convs": x["members"],
                "n_children": degree[1:], "n_leaves": leaves, "saved": saved, "top": top,
            })


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (depth, k1, k2, conv) -> a digest for each key; of a long list only the hash's state is held."""
    key, state, out = None, None, []
    for batch in batches:
        for now, ids in batch.groupby(KEY, sort=False)["conv"]:
            told = ",".join(map(str, ids.tolist())).encode()
            if now == key:
                state.update(b"," + told)
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = now, hashlib.sha256(told)
        yield pd.DataFrame(out, columns=[*KEY, "digest"])
        out = []
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "digest"])


def heads_of(conv: Column) -> Column:
    """Turns that a conversation takes over from the first of its group."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def placed_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """-> turns (conv, run, seq, h1, h2, bytes), and runs (conv, run, first_seq, ahead, n): a conversation's turns in one sorted partition are a run."""
    t = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    order = ["conv", "turn", "role", "text"]
    parts = max(1, -(-t.count() // SORTED_TURNS), t.sparkSession.sparkContext.defaultParallelism)
    # ids given in sorted partitions rise with the order; a long conversation is spread over several partitions
    t = t.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "conv", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("seq"),
        F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    t = scratch.keep(t)
    runs = t.groupBy("conv", "run").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    ahead = Window.partitionBy("conv").orderBy("run")
    return t, scratch.keep(runs.withColumn("ahead", F.sum("n").over(ahead) - F.col("n")))


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """-> turns (conv, depth, length, h1, h2, bytes) of the rebuilt conversations, and all conversations (conv, length)."""
    t, runs = placed_turns(conversations, scratch)
    size = runs.groupBy("conv").agg(F.sum("n").alias("n"))
    base = F.col("conv") - F.col("conv") % GROUP
    info = size.select("conv", "n", base.alias("base"), heads_of(F.col("conv")).alias("heads"))
    known = info.join(size.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    lead = F.least("heads", F.coalesce("base_n", F.lit(0)))
    itself = F.col("conv") == F.col("base")
    known = scratch.keep(known.select(
        "conv", "base", "heads", lead.alias("lead"), itself.alias("itself"),
        F.when(itself, F.col("n")).otherwise(lead + F.greatest(F.col("n") - F.col("heads"), F.lit(0))).alias("length"),
    ))
    place = F.col("seq") - F.col("first_seq") + F.col("ahead") + 1
    own = t.join(runs.drop("n").join(known.drop("base"), "conv"), ["conv", "run"]).withColumn("place", place)
    first = own.where(f"itself AND place < {HEADS}").select(F.col("conv").alias("base"), F.col("place").alias("depth"), "h1", "h2", "bytes")
    taken = known.where("NOT itself").join(first, "base").where("depth <= heads")
    own = own.where("itself OR place > heads").withColumn("depth", F.when(F.col("itself"), F.col("place")).otherwise(F.col("lead") + F.col("place") - F.col("heads")))
    columns = ["conv", "depth", "length", "h1", "h2", "bytes"]
    return own.select(*columns).unionByName(taken.select(*columns)), known.select("conv", "length")


def running(rows: DataFrame, combine, columns: list[str], falling: bool = False) -> DataFrame:
    """Running totals over a conversation's depths (from the deepest up, if falling), in runs of bounded size whose totals are then added."""
    run = F.expr(f"(depth - 1) div {RUN_TURNS}")
    ordered = lambda w, c: w.orderBy(F.desc(c) if falling else c)
    within = ordered(Window.partitionBy("conv", "run"), "depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", run)
    part = rows.groupBy("conv", "run").agg(*(combine(c).alias(f"all_{c}") for c in columns))
    over_runs = ordered(Window.partitionBy("conv"), "run").rowsBetween(Window.unboundedPreceding, -1)
    ahead = part.select("conv", "run", *(combine(f"all_{c}").over(over_runs).alias(f"ahead_{c}") for c in columns)).where(F.col(f"ahead_{columns[0]}").isNotNull())
    return rows.select("*", *(combine(c).over(within).alias(f"to_{c}") for c in columns)).join(ahead, ["conv", "run"], "left")


def prefix_keys(turns: DataFrame) -> DataFrame:
    """Adds (k1, k2): the hash of all turns up to this one, each with its place."""
    mixed = turns.withColumn("m1", F.xxhash64("depth", "h1", "h2", F.lit(1))).withColumn("m2", F.xxhash64("depth", "h2", "h1", F.lit(2)))
    out = running(mixed, F.bit_xor, ["m1", "m2"])
    whole = lambda c: F.col(f"to_{c}").bitwiseXOR(F.coalesce(f"ahead_{c}", F.lit(0).cast("long")))
    return out.select("conv", "depth", "length", "bytes", whole("m1").alias("k1"), whole("m2").alias("k2"))


def trie_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conversations (conv_id, turn, role, text), rebuilt -> a row for each node of their trie."""
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    turns, convs = rebuilt(conversations, scratch)
    rows = scratch.keep(prefix_keys(turns))
    found = scratch.keep(rows.groupBy(*KEY).agg(
        F.min("conv").alias("first"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum(F.col("length") - F.col("depth") + 1).alias("below")))

    # upper nodes are closed upwards: what lies below a node lies below its parent too
    upper = scratch.keep(found.where(F.col("below") > shard_turns).drop("below"))
    flagged = scratch.keep(rows.join(upper.select(*KEY, "first"), KEY, "left"))
    ends = flagged.groupBy("conv").agg(
        F.count("first").alias("cut"), F.min_by(F.struct(*KEY), F.when(F.col("first").isNull(), F.col("depth"))).alias("top"),
    ).where("top IS NOT NULL")
    light = flagged.where("first IS NULL").drop("first")
    shards = max(1, -(-light.count() // shard_turns))
    dealt = light.join(ends.select("conv", F.pmod(F.xxhash64("top"), F.lit(shards)).cast("int").alias("shard")), "conv")
    tries = scratch.keep(dealt.select("shard", "conv", "depth", "k1", "k2", "bytes").groupBy("shard").applyInPandas(_built, _TRIE))
    lower = scratch.keep(tries.mapInPandas(_rolled, _NODES))

    every = _with_upper(lower, upper, flagged.where("first IS NOT NULL").select("conv", "depth", "first"), convs, scratch)
    at_end = rows.where("depth = length").select(*KEY, "conv").unionByName(
        convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv"))
    digests = at_end.repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInPandas(_digests, "depth bigint, k1 bigint, k2 bigint, digest string")
    smallest = convs.agg(F.min("conv").alias("first")).where("first IS NOT NULL").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "first")
    named = digests.join(found.select(*KEY, "first").unionByName(smallest), KEY).select(F.col("first").alias("conv"), "depth", "digest")
    return every.join(named, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _with_upper(lower: DataFrame, upper: DataFrame, paths: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The shards' nodes, those of the upper levels (known by paths (conv, depth, first)) and the root."""
    smallest, n_convs = convs.agg(F.min("conv"), F.count("*")).first()
    heavy = upper.select(F.col("first").alias("conv"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("first").alias("parent")).unionByName(
        convs.select("conv", F.lit(1).cast("long").alias("depth"), F.lit(smallest).cast("long").alias("parent")))
    tops = scratch.keep(lower.where("top").drop("parent").join(above, ["conv", "depth"]))
    heavy = scratch.keep(heavy.join(above, ["conv", "depth"]))
    degree = tops.select("parent", "depth").unionByName(heavy.select("parent", "depth")).groupBy(
        F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    degree = scratch.keep(degree)
    heavy = heavy.join(degree, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    heavy = scratch.keep(heavy.withColumn("leaf", (F.col("n_children") == 0).cast("long")))
    # what is added at a place counts for all upper nodes on the path to it; a small subtree's share is added at its parent's place
    added = tops.select("conv", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaf"), F.col("saved").alias("own")).unionByName(
        heavy.select("conv", "depth", "leaf", "own")).groupBy("conv", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    added = scratch.keep(added)
    on_path = paths.join(added.select("conv").distinct(), "conv").join(added, ["conv", "depth"], "left").fillna(0, ["leaf", "own"])
    total = lambda c: F.col(f"to_{c}") + F.coalesce(f"ahead_{c}", F.lit(0))
    sums = running(on_path, F.sum, ["leaf", "own"], falling=True).groupBy(F.col("first").alias("conv"), "depth").agg(
        F.sum(total("leaf")).alias("n_leaves"), F.sum(total("own")).alias("saved"))
    columns = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved"]
    merged = heavy.join(sums, ["conv", "depth"]).select(*columns)
    leaves, saved = added.agg(F.sum("leaf"), F.sum("own")).first()
    root = [] if not n_convs else [(smallest, 0, None, n_convs, degree.where("depth = 0").agg(F.sum("n_children")).first()[0] or 0, leaves or 1, saved or 0)]
    root = convs.sparkSession.createDataFrame(root, "conv bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint")
    return union_all([lower.where("NOT top").select(*columns), tops.select(*columns), merged, root])


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS t),
o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT c, c - c % 5 AS b, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM o GROUP BY c), tab
), k AS (SELECT n.c, n.b, n.h, least(n.h, coalesce(m.n, 0)) AS lead FROM n LEFT JOIN n m ON m.c = n.b),
r AS (
  SELECT k.c, CASE WHEN k.c = k.b THEN i ELSE lead + i - h END AS d, role, text FROM k JOIN o ON o.c = k.c WHERE k.c = k.b OR i > h
  UNION ALL SELECT k.c, i, role, text FROM k JOIN o ON o.c = k.b WHERE k.c <> k.b AND i <= h
), p AS (
  SELECT c, d, strlen(text) AS bytes, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS k FROM r
), p0 AS (SELECT * FROM p UNION ALL SELECT c, 0, 0, '' FROM n),
u AS (SELECT d, k, min(c) AS v, count(*) AS n_convs, max(bytes) AS bytes FROM p0 GROUP BY d, k),
q AS (SELECT p0.c, p0.d, u.v FROM p0 JOIN u USING (d, k)),
w AS (SELECT u.*, q.v AS parent FROM u LEFT JOIN q ON q.c = u.v AND q.d = u.d - 1),
x AS (SELECT w.*, coalesce(y.n, 0) AS n_children FROM w LEFT JOIN (SELECT parent AS v, d - 1 AS d, count(*) AS n FROM w GROUP BY ALL) y USING (v, d)),
s AS (
  SELECT q.v, q.d, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved
  FROM x JOIN q ON q.c = x.v AND q.d <= x.d GROUP BY ALL
), e AS (
  SELECT q.v, q.d, sha256(string_agg(CAST(q.c AS VARCHAR), ',' ORDER BY q.c)) AS h FROM q JOIN (SELECT c, max(d) AS d FROM p0 GROUP BY c) m USING (c, d) GROUP BY ALL
)
SELECT v AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM x JOIN s USING (v, d) LEFT JOIN e USING (v, d)
"""
