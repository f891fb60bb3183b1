"""Operator 4, n-gram Jaccard join with PartEnum signatures.

Documents are sets of five-word shingles (64-bit hashes of lower-cased words over whole texts); two
link when 100 * intersection >= 80 * union. Equal sets are one class, so that copies never make
pairs. Classes that share a signature (see ``signatures``) are candidates, in four steps, each of
which leaves less to the next:

1. every class against the least class of each of its signature groups (as many pairs as members);
2. in groups of up to ``SMALL_GROUP`` classes that still hold several components, the pairs of
   different components, unless they share fewer signatures than a linked pair has, even if all the
   larger groups of either were shared, too;
3. a linked pair that shares no small group shares as many large ones as it needs, so only classes of
   that many large groups go on; they get new signatures, made only of shingles that at most
   ``RARE_HELD`` of these classes have, so that no group is large;
4. those with too few rare shingles for that (families of near copies) are compared in blocks, matrix
   by matrix, with whole sets, and only links between different components come back.

Candidates pass a parity sketch, which cannot lose a link, and then the exact test on whole sets.
Components come from distributed contraction; nothing but counts reaches the driver. Signatures that
very many classes share are told apart beforehand (see ``members``), so that their groups are reduced
where they are read and never meet in one task.

Defined cases: null and empty texts, and texts without words, have no shingles and link with
nothing; a text of fewer than five words has one shingle; null ids take part and a component's id is
its smallest non-null id; rows repeated in full share a class; other columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import Scratch, connected_components, union_all
from ledgerspark.llm.signatures import SPARE_SHARE, parity_sketch, rare_signatures, signatures, sketch_distance
from ledgerspark.llm.textscan import Block, blocks, mix, shingle_sets

WORDS = 5
SMALL_GROUP = 16
#: Step 3 builds signatures of shingles that so many classes hold at most.
RARE_HELD = 64
#: A signature counts as hot if one of HOT_SHARE classes has it; so a set's signatures times HOT_SHARE bound their number.
HOT_SHARE, HOT_LEAST = 2000, 32
#: Hot signatures are looked for in one of so many classes; that decides where a group is reduced, never what is in it.
HOT_LOOK = 32
#: Rows of a block in step 4.
BLOCK_ROWS = 256
#: Ids up to this count (16 bytes each) are broadcast to find their texts; more are joined.
BROADCAST_ROWS = 500_000


def class_of(elements: np.ndarray) -> int:
    """A 64-bit hash of a whole set; 0 for the empty one."""
    if not len(elements):
        return 0
    with np.errstate(over="ignore"):
        s = np.array([len(elements)], np.uint64)
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + mix(elements ^ np.uint64(0xA5A5A5A5)).sum()) ^ mix(elements * np.uint64(3) + np.uint64(7)).sum()
    return int(s.view(np.int64)[0]) or 1


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(rows, sets of their texts); the text is the last column."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()
        for first, run in blocks(texts):
            yield batch.slice(first, len(run)), shingle_sets(Block(run, lower=True), WORDS)


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint64).view(np.int64)))


def scan(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n, cls, sketch, sigs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays(
                [head.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()),
                 pa.array([parity_sketch(s) for s in sets], pa.binary()), _longs([signatures(s) for s in sets])],
                names=["doc_id", "n", "cls", "sketch", "sigs"],
            )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n bigint, cls bigint, sketch binary, sigs array<bigint>")


def needed(n: Column) -> Column:
    """Signatures that two linked sets have in common at least, the smaller of ``n`` elements."""
    return 1 + F.floor(n / SPARE_SHARE)


class Join:
    """One run: the documents, the table of classes and the links found so far."""

    def __init__(self, docs: DataFrame, small_group: int, block_rows: int, rare_held: int = RARE_HELD):
        self.docs, self.small, self.block_rows, self.rare_held = docs.select("doc_id", "text"), small_group, block_rows, rare_held
        self.scratch = Scratch(docs.sparkSession, "ngram-join")
        self.rows = self.scratch.keep(scan(self.docs).withColumn("row", F.monotonically_increasing_id()))
        sets = self.rows.where("n > 0")
        self.classes = self.scratch.keep(sets.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("row").alias("first"), F.min("n").alias("n")))
        # one row of each class: rows that repeat an earlier row's set are put aside before signatures are dealt out
        again = self.scratch.keep(sets.select("row", "cls").join(self.classes.select("cls", "first"), "cls").where("row <> first").select("row"))
        few = again.count() <= BROADCAST_ROWS
        self.one = sets.join(F.broadcast(again) if few else again, "row", "left_anti")
        self.found: list[DataFrame] = []
        self.waiting: list[DataFrame] = []
        self.stars: DataFrame | None = None

    def whole_sets(self, classes: DataFrame) -> DataFrame:
        """(cls) -> (cls, n, elements binary), from the text of one document of each class."""
        wanted = self.scratch.keep(classes.distinct().join(self.classes, "cls").select(F.col("rep").alias("doc_id"), "cls"))
        size = wanted.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
        few = (lambda df: F.broadcast(df)) if size["n"] <= BROADCAST_ROWS else (lambda df: df)
        # an id may stand on several rows: the class decides which of them is meant
        texts = self.docs.join(few(wanted.where("doc_id IS NOT NULL")), "doc_id").select("cls", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for head, sets in _sets(batches):
                good = [i for i, (c, s) in enumerate(zip(head.column(0).to_pylist(), sets)) if class_of(s) == c]
                yield pa.RecordBatch.from_arrays(
                    [head.column(0).take(pa.array(good, pa.int64())), pa.array([len(sets[i]) for i in good], pa.int64()),
                     pa.array([sets[i].tobytes() for i in good], pa.binary())], names=["cls", "n", "elements"])

        def nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, sets in _sets(batches):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "n", "elements"])

        schema = "cls bigint, n bigint, elements binary"
        found = texts.mapInArrow(run, schema)
        if size["named"] < size["n"]:
            # classes all of whose rows lack an id are found among such rows
            rows = self.docs.where("doc_id IS NULL").select("text").mapInArrow(nameless, schema)
            found = found.unionByName(rows.join(few(wanted.where("doc_id IS NULL").select("cls")), "cls", "left_semi"))
        return found.dropDuplicates(["cls"])

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, an, b, bn) candidates -> (src, dst) links: sizes and sketches first, whole sets for those that remain."""
        c = self.one.select("cls", "sketch")
        near = self.scratch.keep(pairs.where("5 * least(an, bn) >= 4 * greatest(an, bn)").select("a", "b", "an", "bn"))
        sketched = near.join(c.select(F.col("cls").alias("a"), F.col("sketch").alias("ask")), "a").join(
            c.select(F.col("cls").alias("b"), F.col("sketch").alias("bsk")), "b").select("a", "b", "an", "bn", "ask", "bsk")

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) // 9
                ok = [sketch_distance(x, y) <= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most)]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        left = self.scratch.keep(sketched.mapInArrow(close, "a bigint, b bigint"))
        sets = self.scratch.keep(self.whole_sets(union_all([left.select(F.col(k).alias("cls")) for k in "ab"])))
        both = left.join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("x")), "a").join(
            sets.select(F.col("cls").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    ok.append(100 * both >= 80 * (len(u) + len(v) - both))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["src", "dst"]).filter(pa.array(ok, pa.bool_()))

        return self.scratch.keep(both.mapInArrow(exact, "src bigint, dst bigint"))

    def add(self, links: DataFrame) -> None:
        """Links found by a step; they wait until components are asked for."""
        self.found.append(links)
        self.waiting.append(links)

    def components(self) -> DataFrame:
        """(node, component) over all links so far: those that waited are contracted together with the stars found before."""
        some = [x for x in self.waiting if self.stars is None or not x.isEmpty()]
        self.waiting = []
        if some:
            if self.stars is not None:
                some.append(self.stars.select(F.col("node").alias("src"), F.col("component").alias("dst")))
            self.stars = self.scratch.keep(connected_components(union_all(some), self.scratch))
        return self.stars

    def labelled(self, members: DataFrame) -> DataFrame:
        """Adds ``comp``, the component of ``cls`` so far."""
        comps = self.stars.select(F.col("node").alias("cls"), "component")
        return members.join(comps, "cls", "left").select(*members.columns, F.coalesce("component", "cls").alias("comp"))

    def members(self) -> DataFrame:
        """(sig, cls, lo) of every signature that several classes have; ``lo`` is the least of them.

        Groups of hot signatures are reduced by a combined aggregation and a broadcast of its bounded
        result, all others by a window over the signature.
        """
        keep = self.scratch.keep
        some = self.one.where(F.pmod(F.xxhash64("cls"), F.lit(HOT_LOOK)) == 0)
        least = max(HOT_LEAST, some.count() // HOT_SHARE)
        hot = keep(some.select(F.explode("sigs").alias("sig")).groupBy("sig").count().where(F.col("count") >= least).select("sig"))
        any_hot = not hot.isEmpty()
        postings = self.one.select("cls", F.explode("sigs").alias("sig"))
        by_sig = Window.partitionBy("sig")
        cold = postings.join(F.broadcast(hot), "sig", "left_anti") if any_hot else postings
        shared = cold.withColumns({"lo": F.min("cls").over(by_sig), "hi": F.max("cls").over(by_sig)}).where("lo < hi").select("sig", "cls", "lo")
        if any_hot:
            warm = postings.join(F.broadcast(hot), "sig")
            ends = keep(warm.groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("sig", "lo"))
            shared = shared.unionByName(warm.join(F.broadcast(ends), "sig").select("sig", "cls", "lo"))
        return keep(shared)

    def undecided(self, members: DataFrame) -> DataFrame:
        """(sig, cls, ...) -> plus (comp, size), of the groups that hold several components."""
        labelled = self.labelled(members)
        mixed = labelled.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi")
        return labelled.join(mixed.select("sig", "size"), "sig")

    def within_groups(self, groups: DataFrame) -> DataFrame:
        """(sig, cls, comp, n, elsewhere) of groups that are known to be small -> pairs of different components that may be linked.

        A linked pair has ``needed`` signatures in common at least. All are here but for those of larger
        groups, of which ``elsewhere`` counts a class's memberships.
        """
        a, b = (groups.select("sig", *[F.col(c).alias(f"{k}_{c}") for c in ("cls", "comp", "n", "elsewhere")]) for k in "ab")
        met = a.join(b, "sig").where("a_cls < b_cls AND a_comp <> b_comp AND 5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)")
        shared = met.groupBy(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).agg(
            F.count("*").alias("m"), F.min("a_n").alias("an"), F.min("b_n").alias("bn"), F.min(F.least("a_elsewhere", "b_elsewhere")).alias("more"))
        return shared.where(F.col("m") + F.col("more") >= needed(F.least("an", "bn"))).select("a", "an", "b", "bn")

    def links(self) -> DataFrame:
        keep = self.scratch.keep
        members = self.members()
        size = lambda k: self.classes.select(F.col("cls").alias(k), F.col("n").alias(f"{k}n"))
        pairs = members.where("cls <> lo").select(F.col("lo").alias("a"), F.col("cls").alias("b")).distinct()
        self.add(self.verified(pairs.join(size("a"), "a").join(size("b"), "b")))
        self.components()
        rest = keep(self.undecided(members.select("sig", "cls")).join(self.classes.select("cls", "n"), "cls"))
        large = rest.where(F.col("size") > self.small)
        elsewhere = keep(large.groupBy("cls").agg(F.count("*").alias("elsewhere"), F.min("n").alias("n")))
        sized = rest.where(F.col("size") <= self.small).join(elsewhere.select("cls", "elsewhere"), "cls", "left")
        # from here on components only spare comparisons: they are brought up to date where that pays
        self.add(self.verified(self.within_groups(sized.select("sig", "cls", "comp", "n", F.coalesce("elsewhere", F.lit(0)).alias("elsewhere")))))
        # the smaller of a linked pair has four fifths of the larger's shingles at least
        crowd = keep(elsewhere.where(F.col("elsewhere") >= needed(F.expr("4 * n div 5"))).select("cls"))
        if crowd.isEmpty():
            return union_all(self.found)
        sets = keep(self.labelled(self.whole_sets(crowd)))
        signed = keep(self.rare_signed(sets))
        groups = signed.select("cls", "comp", "n", F.lit(0).alias("elsewhere"), F.explode("sigs").alias("sig"))
        self.add(self.verified(self.within_groups(groups)))
        poor = keep(signed.where("NOT enough").select("cls"))
        if not poor.isEmpty():
            self.components()
            self.add(self.blockwise(large.select("sig", "cls").join(poor, "cls"), sets))
        return union_all(self.found)

    def rare_signed(self, sets: DataFrame) -> DataFrame:
        """(cls, n, elements, comp) -> (cls, n, comp, sigs, enough): signatures of shingles that at most ``rare_held`` of these classes have."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    some = batch.slice(i, 256)
                    e = [np.frombuffer(x.as_py(), np.int64) for x in some.column(2)]
                    size = [len(x) for x in e]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(e)), pa.array(np.repeat(some.column(0).to_numpy(), size))], names=["shingle", "cls"])

        shingles = sets.select("cls", "n", "elements").mapInArrow(spread, "shingle bigint, cls bigint")
        # the holders of a common shingle are counted where they are read; its rows are then left out before anything else is dealt by class
        common = self.scratch.keep(shingles.groupBy("shingle").count().where(F.col("count") > self.rare_held).select("shingle"))
        few = common.count() <= BROADCAST_ROWS
        rare = shingles.join(F.broadcast(common) if few else common, "shingle", "left_anti")
        by_class = rare.groupBy("cls").agg(F.collect_list("shingle").alias("rare"))  # at most the shingles of one text
        whole = sets.select("cls", "n", "comp").join(by_class, "cls", "left").select("cls", "n", "comp", F.coalesce("rare", F.array().cast("array<bigint>")).alias("rare"))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [rare_signatures(np.array(r, np.int64).view(np.uint64), n) for n, r in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _longs([s for s, _ in got]), pa.array([d for _, d in got], pa.bool_())], names=["cls", "n", "comp", "sigs", "enough"])

        return whole.mapInArrow(sign, "cls bigint, n bigint, comp bigint, sigs array<bigint>, enough boolean")

    def blockwise(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between different components among classes that meet in large groups of near copies."""
        keep = self.scratch.keep
        members = keep(members)
        nothing = self.docs.sparkSession.createDataFrame([], "src bigint, dst bigint")
        if members.isEmpty():
            return nothing
        rest = keep(self.undecided(members))
        pivot = rest.groupBy("sig").agg(F.min("cls").alias("dst"))
        # families: classes tied together by large groups
        families = keep(connected_components(rest.join(pivot, "sig").select(F.col("cls").alias("src"), "dst").distinct(), self.scratch))
        one = rest.select("cls", "comp").distinct().join(families.select(F.col("node").alias("cls"), F.col("component").alias("family")), "cls")
        size = one.groupBy("family").agg(F.count("*").alias("size"))
        one = one.join(size, "family").withColumn("n_blocks", F.expr(f"CAST((size + {self.block_rows - 1}) DIV {self.block_rows} AS INT)"))
        one = one.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int"))
        sent = one.join(sets.select("cls", "elements"), "cls")
        i, j = F.least(F.col("block"), F.col("other")), F.greatest(F.col("block"), F.col("other"))
        sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("family", i.alias("i"), j.alias("j"), "block", "cls", "comp", "elements")

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            return _block_links(pdf)

        return keep(sent.groupBy("family", "i", "j").applyInPandas(compare, "src bigint, dst bigint"))


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between different components of two blocks (or of one with itself), a spanning set of them."""
    cls, comp = pdf["cls"].to_numpy(), pdf["comp"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in pdf["elements"]]
    sizes = np.array([len(s) for s in sets], np.float32)
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for a in range(0, int(code[-1]) + 1, 4096):
        lo, hi = np.searchsorted(code, [a, a + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[lo:hi], code[lo:hi] - a] = 1
        common += m @ m.T
    linked = 100 * common >= 80 * (sizes[:, None] + sizes[None, :] - common)
    root = {c: c for c in set(comp.tolist())}

    def top(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    src, dst = [], []
    for x, y in zip(*np.nonzero(np.triu(linked, 1))):
        p, q = top(int(comp[x])), top(int(comp[y]))
        if p != q:
            root[max(p, q)] = min(p, q)
            src.append(int(cls[x]))
            dst.append(int(cls[y]))
    return pd.DataFrame({"src": src, "dst": dst}, dtype="int64")


def ngram_join(docs: DataFrame, small_group: int = SMALL_GROUP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_shingles, component_id, class_id, n_links).

    ``n_links`` counts the verified links of the row's class to other classes, out of a set of links
    that connects everything that is connected.
    """
    join = Join(docs, small_group, block_rows)
    links = join.scratch.keep(join.links())
    comps = join.components().select(F.col("node").alias("cls"), "component")
    degree = union_all([links.select(F.col(k).alias("cls")) for k in ("src", "dst")]).groupBy("cls").agg(F.count("*").alias("n_links"))
    classes = join.classes.select("cls", "rep").join(comps, "cls", "left").join(degree, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = join.scratch.keep(classes.join(least, "component").select("cls", "component_id", "n_links"))
    return join.rows.select("doc_id", "n", "cls").join(classes, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.when(F.col("n") > 0, F.col("cls")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component of links, the one with the smallest id.

    Rows without an id stay. Of rows with one id, one for each text stays if the id does.
    """
    scratch = Scratch(docs.sparkSession, "deduplicated")
    found = scratch.keep(ngram_join(docs).select("doc_id", "component_id"))
    by_id = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("n"))
    by_id = scratch.keep(by_id.where("stays = 0 OR n > 1"))
    gone, repeated = by_id.where("stays = 0").select("doc_id"), by_id.where("stays = 1").select("doc_id")
    few = by_id.count() <= BROADCAST_ROWS
    out = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    if repeated.isEmpty():
        return out
    other = out.join(F.broadcast(repeated) if few else repeated, "doc_id", "left_anti")
    again = out.join(F.broadcast(repeated) if few else repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return other.unionByName(again)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
