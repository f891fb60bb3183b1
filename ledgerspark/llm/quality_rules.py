"""Operator 2, quality rules with host-level verdicts.

Every document is measured over its whole text; rule failures are summed by domain, each domain's
failure rate is shrunk towards the corpus with a beta prior whose two parameters are fitted to the
domains themselves (moments), and the domain's verdict is joined back to its documents.

Defined cases: null and empty texts have no words and fail; a null domain is a domain of its own;
repeated rows count as often as they occur; other columns of the input are ignored; no rows give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Scratch
from ledgerspark.llm.textscan import Block, blocks

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A domain goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeats(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is one of several equal items of its text, is not the first of them)."""
    order = np.lexsort((h, owner))
    o, k = owner[order], h[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    several = same.copy()
    several[:-1] |= same[1:]
    a, b = np.empty_like(same), np.empty_like(same)
    a[order], b[order] = several, same  # lexsort is stable: the first in sorted order stands first in the text
    return a, b


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    b = Block(texts, lower=False)
    at, h = b.windows(3)
    covered = np.zeros(len(b.start) + 3, bool)
    if len(at):
        hit = at[_repeats(b.doc[at], h)[0]]
        for k in range(3):
            covered[hit + k] = True
    newline = np.flatnonzero(b.data == 10)
    start = np.concatenate(([0], newline[:-1] + 1))
    worded = np.searchsorted(b.start, newline) > np.searchsorted(b.start, start)
    start, end, owner = start[worded], newline[worded], np.searchsorted(b.text_end, newline[worded], side="right")
    again = _repeats(owner, b.span_hash(start, end))[1] if len(start) else np.zeros(0, bool)
    return {
        "n_words": b.n_words,
        "word_chars": b.count_in(~b.space & ((b.data & 0xC0) != 0x80)),
        "n_symbols": b.count_in(_SYMBOL[b.data]),
        "n_dup_lines": np.bincount(owner[again], minlength=b.n),
        "n_repeat_words": np.bincount(b.doc[covered[: len(b.start)]], minlength=b.n),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary()).to_pylist()
        for first, run in blocks(texts):
            m = measure(run)
            head = batch.slice(first, len(run))
            yield pa.RecordBatch.from_arrays(
                [head.column(0), head.column(1), *(pa.array(m[k].astype(np.int64)) for k in _FIELDS)],
                names=["doc_id", "domain", *_FIELDS],
            )


def text_measures(docs: DataFrame, domain: str = "source") -> DataFrame:
    """documents(doc_id, text, <domain>) -> (doc_id, domain, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    rows = docs.select("doc_id", F.col(domain).cast("string").alias("domain"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_measured, f"doc_id {kind}, domain string, " + ", ".join(f"{k} bigint" for k in _FIELDS))


def host_rates(measured: DataFrame) -> DataFrame:
    """(domain, base_failed) -> (domain, n, failed, rate): rates shrunk with an empirical beta prior.

    The prior's mean is the mean of the domains' rates and its strength follows from how far they
    spread beyond binomial noise; domains that spread no further than noise are all drawn to the mean.
    """
    hosts = measured.groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    raw = F.col("failed") / F.col("n")
    m = hosts.agg(
        F.avg(raw).alias("mean"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("var"), F.avg(1 / F.col("n")).alias("inv"),
    )
    m = m.first()  # three numbers
    mean = m["mean"] or 0.0
    spread = max((m["var"] or 0.0) - mean * (1 - mean) * (m["inv"] or 0.0), 1e-9)
    strength = max(0.01, min(1e6, mean * (1 - mean) / spread - 1))
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("domain", "n", "failed", rate.alias("rate"), F.lit(mean).alias("prior_mean"))


def quality_rules(docs: DataFrame, domain: str = "source", max_host_rate: float = MAX_HOST_RATE, times_mean: float | None = None) -> DataFrame:
    """-> (doc_id, measures, base_failed, kept, host_rate).

    A host is bad beyond ``max_host_rate``, or, where ``times_mean`` is given, beyond so many times the prior's mean.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = scratch.keep(text_measures(docs, domain).withColumn("base_failed", failed))
    limit = F.lit(max_host_rate) if times_mean is None else F.col("prior_mean") * times_mean
    rate = F.round("rate", 9)
    hosts = host_rates(measured).select(F.col("domain").alias("host"), rate.alias("host_rate"), (rate <= limit).alias("good_host"))
    return measured.join(hosts, F.col("domain").eqNullSafe(F.col("host"))).select(
        "doc_id", *_FIELDS, "base_failed", (~F.col("base_failed") & F.col("good_host")).alias("kept"), "host_rate",
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source AS domain, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, domain, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM pos),
many AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM many, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, domain, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT domain, count(*) AS n, sum(CAST(base_failed AS INT)) AS failed FROM b GROUP BY domain),
p AS (SELECT avg(failed / n) AS mean, coalesce(var_samp(failed / n), 0) AS var, avg(1 / n) AS inv FROM h),
s AS (SELECT mean, greatest(0.01, least(1e6, mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-9) - 1)) AS strength FROM p),
r AS (SELECT domain, round((failed + mean * strength) / (n + strength), 9) AS host_rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_rate <= 0.5 AS kept, host_rate
FROM b JOIN r ON b.domain IS NOT DISTINCT FROM r.domain
"""

#: A host of :func:`language_hosts` is bad beyond so many times the mean.
TIMES_MEAN = 1.05


def language_hosts(spark, sf_dir: str) -> DataFrame:
    """The same with a host for each source and language, held against the prior's mean: the host verdict decides over whole hosts here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    host = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return quality_rules(docs.withColumn("host", host), "host", times_mean=TIMES_MEAN)


LANGUAGE_HOSTS_SQL = OP2_SQL.replace("source AS domain", "coalesce(source, '') || '/' || coalesce(lang, '') AS domain").replace("host_rate <= 0.5 AS kept", "host_rate <= (SELECT mean FROM s) * 1.05 AS kept")
