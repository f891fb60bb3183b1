"""The corpus pipeline: quality, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents; all but the last keep the columns of ``documents``.

Defined cases, for every stage: null and empty texts are judged like others (quality and toxicity
score them, they have no shingles and so no duplicates, their rate is that of a text without tokens,
and each packs as its closing id alone); rows with a null ``doc_id`` take part; rows repeated in full
are duplicates of each other; of texts with equal claims the row with the smallest id stays; columns
that the documents have beyond the known ones, of whatever names, are handed on untouched; without
rows a stage returns none; without usable labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import mixing, ngram_join, packing, quality_classifier, toxicity
from ledgerspark.llm.common import Scratch, fresh

#: No SQL expresses trained models; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores below its threshold go; ties with the threshold stay."""
    name = fresh("score", docs.columns)
    scored = quality_classifier.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name=name)
    return scored.where(F.col(name) >= quality_classifier.THRESHOLD).select(*_own(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier finds toxic go; ties with the threshold go too."""
    name = fresh("score", docs.columns)
    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name=name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(*_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays; rows without an id stay."""
    return ngram_join.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Towards the target weights ``mixing.TARGETS``: a document stays with the probability of its rate, by a hash of its id and text.

    Nothing can be added here, so all clean tokens stay and the other domains are cut down to their
    weights beside them; a domain that has less than its weight stays whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted, _ = mixing.fit(docs, labels, targets=mixing.up_to_weights(), max_rate=1.0)
    rate = fresh("rate", docs.columns)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return fitted.rated(docs, docs.columns, rate).where(draw < F.col(rate) + 1e-6).select(*_own(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", clean),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
