"""Operator 3, mixing to target weights with soft domain memberships; DataFrame functions only.

A naive Bayes classifier, whose counts come from the labelled table, gives each document posteriors
over the domains ``clean``, ``low`` and ``toxic``. Nonnegative document rates r then minimise

    sum over domains d of w_d * (sum_i tokens_i * p_id * r_i - target_d) ** 2

by projected gradient steps: a step needs a few numbers for each domain, summed over all documents,
and moves every rate by its own posteriors times those numbers, cut off at 0 (and at ``max_rate``,
where one is given). w_d = 1 / max(target_d, current_d) makes the errors relative; the
gradient is scaled by the inverse of the (slightly enlarged) second moments of the posteriors of the
rates that can move, so that few passes do; where the bounds bend that step, a plain gradient step of
guaranteed descent is tried beside it.

Posteriors take one value for each combination of binned features (a cell), so documents of a cell
move alike: their tokens are summed by cell in one pass over all documents, with a combined
aggregation, and each step is a distributed aggregation over that table of ``N_CELLS`` rows at most,
joined with the cells' posteriors and rates. The corpus is read twice, however many steps there are.
The lexicon for the toxic domain is drawn from at most ``TRAIN_ROWS`` labelled rows (those with the
smallest hashes of their ids), a documented bound; every word that stands out there counts; class
counts use every labelled row. Defined cases: null and empty texts have no tokens, the features of an
empty text and a rate like others; null or other labels are not learned from; without labelled rows
all posteriors are equal; targets that are all zero give rates of 0; repeated rows count as often as
they occur; other columns are ignored, and columns of the input that are carried along keep their
names and contents whatever these are; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Scratch, fresh

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
TRAIN_ROWS = 4000
#: How far a word must stand out: log odds against its being there by chance.
LEXICON_ODDS = 7
PASSES, TOLERANCE, RIDGE = 80, 1e-6, 1e-8
_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _cuts(value: Column, cuts: list[float]) -> Column:
    """0 to len(cuts): how many of the ascending cuts the value reaches."""
    out = F.lit(0)
    for c in cuts:
        out = out + (value >= c).cast("int")
    return out


#: Bins of the features, the last one varying fastest in a cell's number.
BINS = (4, 3, 24, 4)
N_CELLS = math.prod(BINS)


def _cell(bins: list[Column]) -> Column:
    out = bins[0]
    for b, size in zip(bins[1:], BINS[1:]):
        out = out * size + b
    return out.cast("int")


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> (doc_id, domain 0 to 2), one row for each id."""
    good = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)")
    d = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return good.select("doc_id", d.alias("domain")).groupBy("doc_id").agg(F.max("domain").alias("domain"))


def find_lexicon(docs: DataFrame, domains: DataFrame, rows: int) -> list[str]:
    """Words that stand out in the toxic rows of a bounded sample of labelled rows."""
    some = domains.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded by ``rows``, hence the broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    words = texts.select("domain", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), _SEP))).alias("w"))
    sizes = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("domain") == 2).cast("int")), F.lit(0)).alias("t")).first()
    if not sizes["t"]:
        return []
    base = sizes["t"] / sizes["n"]
    seen = words.where("length(w) > 2").groupBy("w").agg(F.sum((F.col("domain") == 2).cast("int")).alias("a"), F.count("*").alias("n"))
    # far beyond what the base rate would give; a word seen in n texts by chance is toxic in all with base ** n
    odds = F.col("a") * F.lit(math.log(1 / base)) - (F.col("n") - F.col("a")) * 4.0
    best = seen.where("a >= 4").withColumn("odds", odds).where(F.col("odds") > LEXICON_ODDS).orderBy("w")
    return [r["w"] for r in best.collect()]  # words of at most ``rows`` texts, four times each


def features(docs: DataFrame, lexicon: list[str], keep: list[str], tokens: str = "tokens", cell: str = "cell") -> DataFrame:
    """The named columns, ``tokens`` and ``cell``, the number of the combination of the binned features."""
    text, t, w = F.coalesce("text", F.lit("")), fresh("t", keep), fresh("w", keep)
    base = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias(t), F.filter(F.split(text, _SEP), lambda w: w != "").alias(w))
    n = F.greatest(F.size(w), F.lit(1))
    low = F.array_distinct(F.transform(w, F.lower))
    symbols = F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>!]", ""))
    shouted = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]{3,}", ""))
    hits = F.size(F.array_intersect(low, F.array(*[F.lit(w) for w in lexicon]).cast("array<string>")))
    long = F.when(F.size(w) < 60, 0).when(F.size(w) < 400, 1).otherwise(2)
    distinct = _cuts(F.size(low) / n, [0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6])
    return base.select(
        *[F.col(f"`{c}`") for c in keep], F.size(w).cast("long").alias(tokens),
        _cell([_cuts(symbols / n, [0.02, 0.1, 0.3]), _cuts(shouted / n, [0.5, 2.0]), distinct * 3 + long, _cuts(hits, [1, 2, 3])]).alias(cell),
    )


class Mixture:
    """A fitted classifier and the rates reached so far.

    Features are binned, so posteriors and rates belong to cells, of which there are ``N_CELLS``
    whatever the corpus; a document finds both by the number of its cell.
    """

    def __init__(self, lexicon: list[str], log_prior: np.ndarray, log_likelihood: list[np.ndarray]):
        self.lexicon, self.max_rate = lexicon, None
        at = np.arange(N_CELLS)
        z = np.tile(log_prior, (N_CELLS, 1))
        for bins, table in zip(BINS[::-1], log_likelihood[::-1]):  # for each feature (domain, bin)
            z += table.T[at % bins]
            at = at // bins
        p = np.exp(z - z.max(1, keepdims=True))
        self.p = p / p.sum(1, keepdims=True)
        self.rate = np.ones(N_CELLS)
        self.totals: list[float] = []
        self.passes = 0

    def cells(self, spark, of: np.ndarray | None = None) -> DataFrame:
        """(cell, p0, p1, p2, cell_rate, counts) of every cell, a table of fixed size; ``counts``: whether it is among ``of``."""
        rows = [(c, *map(float, self.p[c]), float(self.rate[c]), of is None or bool(of[c])) for c in range(N_CELLS)]
        return spark.createDataFrame(rows, "cell int, p0 double, p1 double, p2 double, cell_rate double, counts boolean")

    def moved(self, step: np.ndarray) -> np.ndarray:
        """The rates after a step against ``step``, projected onto the bounds."""
        return np.clip(self.rate - self.p @ step, 0.0, self.max_rate)

    def rated(self, docs: DataFrame, keep: list[str], name: str = "rate") -> DataFrame:
        """The named columns and, as column ``name``, the rate of each row; its cell finds it in the table of fixed size."""
        cell = fresh("cell", [*keep, name])
        rates = self.cells(docs.sparkSession).select(F.col("cell").alias(cell), F.col("cell_rate").alias(name))
        found = features(docs, self.lexicon, keep, fresh("tokens", [*keep, name]), cell).join(F.broadcast(rates), cell)
        return found.select(*[F.col(f"`{c}`") for c in [*keep, name]])


def classify(labelled: DataFrame, lexicon: list[str]) -> Mixture:
    """(domain, cell) of the labelled rows -> a naive Bayes classifier with Laplace smoothing."""
    counts = labelled.groupBy("domain", "cell").agg(F.count("*").alias("n")).collect()  # domains times cells at most
    tables = [np.full((len(DOMAINS), b), 0.5) for b in BINS]
    for r in counts:
        at = r["cell"]
        for bins, table in zip(BINS[::-1], tables[::-1]):
            table[r["domain"], at % bins] += r["n"]
            at //= bins
    size = tables[0].sum(1)
    return Mixture(lexicon, np.log(size / size.sum()), [np.log(t / t.sum(1, keepdims=True)) for t in tables])


def domain_sums(scored: DataFrame, mixture: Mixture, of: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(all tokens, expected tokens of each domain, tokens * p_d * p_e over the cells ``of``, all by default).

    ``scored``: (tokens, cell) of documents, or of cells with the tokens of their documents.
    """
    k = range(len(DOMAINS))
    t, rate = F.col("tokens").cast("double"), F.col("cell_rate")
    free = t if of is None else F.when(F.col("counts"), t).otherwise(0.0)
    r = scored.join(F.broadcast(mixture.cells(scored.sparkSession, of)), "cell").agg(
        F.sum(t).alias("all"), *[F.sum(t * F.col(f"p{d}") * rate).alias(f"t{d}") for d in k],
        *[F.sum(free * F.col(f"p{d}") * F.col(f"p{e}")).alias(f"m{d}{e}") for d in k for e in k],
    ).first()
    return r["all"] or 0.0, np.array([r[f"t{d}"] or 0.0 for d in k]), np.array([[r[f"m{d}{e}"] or 0.0 for e in k] for d in k])


def up_to_weights(weights: dict[str, float] | None = None):
    """Target totals for a mixture that only leaves documents out: of the domain with the largest weight
    every token stays, and of each other domain as many as its weight gives beside it, or all it has.
    """
    w = np.array([(weights or TARGETS)[d] for d in DOMAINS], float)
    lead = int(np.argmax(w))
    return lambda now: np.minimum(now, w * (now[lead] / max(w[lead], 1e-12))).tolist()


def fit(docs: DataFrame, labels: DataFrame, targets=None, budget: float | None = None, max_rate: float | None = None, train_rows: int = TRAIN_ROWS) -> tuple[Mixture, DataFrame]:
    """-> (mixture, table of doc_id, tokens, posteriors and rate).

    ``targets``: weights by domain, of ``budget`` tokens (as many as there are, by default), or a
    function from the domains' current totals to their target totals (``up_to_weights``, for one).
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    domains = scratch.keep(domain_of_labels(labels))
    lexicon = find_lexicon(docs, domains, train_rows)
    scored = scratch.keep(features(docs, lexicon, ["doc_id"]))
    mixture = classify(scored.join(domains, "doc_id"), lexicon)
    by_cell = scratch.keep(scored.groupBy("cell").agg(F.sum("tokens").alias("tokens")))
    whole, current, gram = domain_sums(by_cell, mixture)
    mixture.max_rate = max_rate
    if callable(targets):
        target = np.array(targets(current), float)
    else:
        weights = np.array([(targets or TARGETS)[d] for d in DOMAINS], float)
        target = weights / max(weights.sum(), 1e-12) * (whole if budget is None else budget)
    mixture.totals = target.tolist()
    if whole > 0:
        root = 1 / np.sqrt(np.maximum(np.maximum(target, current), 1e-6 * whole))
        ridge = RIDGE * np.trace(root[:, None] * gram * root[None, :])
        error, size = current - target, 1.0
        steepest = float(np.linalg.eigvalsh(root[:, None] * gram * root[None, :])[-1]) or 1.0
        loss = float(((root * error) ** 2).sum())
        for mixture.passes in range(1, PASSES + 1):
            # cells at a bound whose gradient points outwards stay there
            slope, before = mixture.p @ (root**2 * error), mixture.rate
            top = np.inf if max_rate is None else max_rate
            free = ((before > 0) | (slope < 0)) & ((before < top) | (slope > 0))
            _, _, gram = domain_sums(by_cell, mixture, free)
            metric = root[:, None] * gram * root[None, :] + ridge * np.eye(len(DOMAINS))
            scaled = np.where(free, mixture.moved(size * root * np.linalg.solve(metric, root * error)), before)
            best = None
            for rates in (scaled, mixture.moved(root**2 * error / steepest)):
                mixture.rate = rates
                _, reached, _ = domain_sums(by_cell, mixture)
                after = float(((root * (reached - target)) ** 2).sum())
                if best is None or after < best[0]:
                    best = after, rates, reached
                if best[0] < 0.9 * loss:
                    break  # the plain step is for where the bounds bend the scaled one
            after, mixture.rate, reached = best
            if after >= loss:
                mixture.rate, size = before, size / 4
                if size < 1e-3:
                    break
                continue
            settled = loss - after <= TOLERANCE * loss
            error, loss, size = reached - target, after, min(1.0, 2 * size)
            if settled or np.abs(error).max() <= TOLERANCE * whole:
                break
    rated = scored.join(F.broadcast(mixture.cells(docs.sparkSession)), "cell")
    return mixture, rated.select("doc_id", "tokens", "p0", "p1", "p2", F.col("cell_rate").alias("rate"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    _, state = fit(docs, labels)
    return state.select("doc_id", "tokens", *[F.round(f"p{d}", 9).alias(f"p_{name}") for d, name in enumerate(DOMAINS)], F.round("rate", 9).alias("rate"))
