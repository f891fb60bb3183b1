"""Operator 6, toxicity by weak supervision.

Many voters read a text: lexicon voters (a word occurs) and pattern voters (words with a given
stem occur at least twice). A generative model with a latent class estimates, without labels, how
accurate every voter is and which voters are correlated beyond what the class explains (their
evidence is shared out); its posteriors are the soft labels on which a linear classifier is trained,
and that classifier scores the whole of every text.

Voters are found in, and the models fitted on, at most ``TRAIN_ROWS`` labelled rows (those with the
smallest hashes of their ids), a documented bound; every term that stands out there is a voter. The
driver holds those texts as bytes, a count for each of their terms, and the votes as pairs of text and
voter; correlations are kept for voters that speak together (in two texts, and in a quarter of the
geometric mean of their texts), and the classifier's steps are solved by conjugate gradients, so that
nothing grows with the square of the number of voters.
Defined cases: null and empty texts get no votes and the classifier's intercept; labels that are null
or not 0/1 are not learned from; where no voter stands out every score is 0; repeated rows are scored
alike; of a very long text all words count, its distinct ones are held at a time; of the input's other columns only the named ones are carried along, and the result's column
takes the name ``name``, replacing one of that name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import crc_bucket
from ledgerspark.llm.quality_classifier import fitted, labelled_sample

TRAIN_ROWS = 8000
MIN_SUPPORT = 3
STEMS = (5, 6, 7)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(m.group() for m in WORD.finditer((text or "").lower()))


def _stems(words: Counter) -> Counter:
    """How many words of the text have each stem; a word is not its own stem."""
    out: Counter = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                out[w[:k]] += n
    return out


class Voters:
    """Lexicon words and stems, each with a vote for "toxic" or none."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = words, stems
        self.word_at = {w: i for i, w in enumerate(words)}
        self.stem_at = {s: len(words) + i for i, s in enumerate(stems)}

    def __len__(self) -> int:
        return len(self.words) + len(self.stems)

    def hits(self, words: Counter) -> np.ndarray:
        """The voters that vote for "toxic", in order."""
        at, stem_at = self.word_at, self.stem_at
        got = [at[w] for w in at.keys() & words.keys()]
        if stem_at:
            seen: Counter = Counter()
            for w, n in words.items():
                for k in STEMS:
                    if len(w) > k and w[:k] in stem_at:
                        seen[w[:k]] += n
            got += [stem_at[s] for s, n in seen.items() if n >= 2]
        return np.array(sorted(got), np.int64)


class Votes:
    """The votes of many texts as pairs of text and voter, in the texts' order; whatever is not listed is silence."""

    def __init__(self, hits: list[np.ndarray], voters: int):
        self.rows, self.voters = len(hits), voters
        self.count = np.fromiter(map(len, hits), np.int64, len(hits))
        self.row = np.repeat(np.arange(len(hits)), self.count)
        self.voter = np.concatenate([*hits, np.zeros(0, np.int64)])
        self.size = np.bincount(self.voter, minlength=voters)

    def by_row(self, of_voter: np.ndarray) -> np.ndarray:
        """For each text the sum over its votes."""
        return np.bincount(self.row, of_voter[self.voter], minlength=self.rows)

    def by_voter(self, of_row: np.ndarray) -> np.ndarray:
        """For each voter the sum over the texts that it votes in."""
        return np.bincount(self.voter, of_row[self.row], minlength=self.voters)

    def together(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, texts in which both vote) of the pairs that do so often enough to be correlated, one voter's row at a time."""
        first = np.cumsum(self.count) - self.count
        texts = np.split(self.row[np.argsort(self.voter, kind="stable")], np.cumsum(self.size)[:-1])
        left, right, both = [], [], []
        for i, own in enumerate(texts):
            n = self.count[own]
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            seen = np.bincount(self.voter[at], minlength=self.voters)
            seen[i] = 0
            j = np.flatnonzero((seen >= 2) & (16.0 * seen * seen >= float(self.size[i]) * self.size))
            left.append(np.full(len(j), i))
            right.append(j)
            both.append(seen[j])
        return np.concatenate(left), np.concatenate(right), np.concatenate(both)


def copy_keys(text: bytes) -> tuple[int, int]:
    """Two keys that copies of a text, near ones mostly too, have in common: its least hashes of three words in a row."""
    w = text.lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    return min(map(zlib.crc32, grams)), min(map(zlib.adler32, (g[::-1] for g in grams)))


def find_voters(texts: Iterable[Counter], y: np.ndarray) -> Voters:
    """Words and stems (in two words or more) that occur mostly in toxic training rows."""
    good: tuple[Counter, Counter] = (Counter(), Counter())
    bad: tuple[Counter, Counter] = (Counter(), Counter())
    for words, toxic in zip(texts, y):
        into = bad if toxic else good
        into[0].update(words.keys())
        into[1].update(s for s, n in _stems(words).items() if n >= 2)
    base = math.log(max(1e-9, float((y == 1).sum()) / max(1, len(y))))
    picked = []
    for kind in (0, 1):
        found = []
        spread = np.sort([n + good[kind][w] for w, n in bad[kind].items()] or [0])
        for w, n in bad[kind].items():
            g = good[kind][w]
            # log of the chance that one of the terms as common as this would stand out so by accident
            chance = math.lgamma(n + g + 1) - math.lgamma(n + 1) - math.lgamma(g + 1) + n * base
            chance += math.log(len(spread) - np.searchsorted(spread, n + g) + 1)
            if n >= MIN_SUPPORT and chance < -1 and n >= 2 * g:
                found.append((chance, w))
        picked.append([w for _, w in sorted(found)])
    return Voters(*picked)


class LabelModel:
    """Latent class with a rate for each voter and class, by EM; correlated voters share their evidence.

    One more voter says "clean" where no other voter speaks; the others abstain instead.
    """

    def __init__(self, votes: Votes, length: np.ndarray, prior: float, start: np.ndarray, rounds: int = 25):
        post = start.astype(np.float64)
        silent = (votes.count == 0).astype(np.float64)
        pairs = votes.together()
        for _ in range(rounds):
            said = votes.by_voter(post)
            self.hit = (said + 0.5) / (post.sum() + 1.0)
            self.false = np.minimum((votes.size - said + 0.05) / ((1 - post).sum() + 1.0), 0.9 * self.hit)
            self.missed = (silent @ post + 0.5) / (post.sum() + 1.0)
            self.quiet = (silent @ (1 - post) + 0.5) / ((1 - post).sum() + 1.0)
            self.share = self._shares(votes, pairs, said, post)
            self.prior = float(np.clip(0.5 * prior + 0.5 * post.mean(), 1e-4, 0.9))
            post = self.posterior(votes, length)
        self.accuracy = self.hit * self.prior + (1 - self.false) * (1 - self.prior)

    def _shares(self, votes: Votes, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], said: np.ndarray, post: np.ndarray) -> np.ndarray:
        """1 over 1 plus a voter's correlations within the classes."""
        base, more = self.false, self.hit - self.false  # a vote's expectation is base + more * posterior

        def products(i: np.ndarray, j: np.ndarray, both: np.ndarray) -> np.ndarray:
            """Sum over the texts of what is left of vote i times what is left of vote j."""
            cross = base[j] * votes.size[i] + more[j] * said[i] + base[i] * votes.size[j] + more[i] * said[j]
            expected = len(post) * base[i] * base[j] + (base[i] * more[j] + base[j] * more[i]) * post.sum() + more[i] * more[j] * (post @ post)
            return both - cross + expected

        each = np.arange(votes.voters)
        scale = np.sqrt(np.maximum(products(each, each, votes.size), 1e-12 * len(post)))
        i, j, both = pairs
        corr = np.abs(products(i, j, both)) / (scale[i] * scale[j])
        self.correlated = (i, j, corr)
        return 1 / (1 + np.bincount(i, np.where(corr > 0.5, corr, 0), minlength=votes.voters))

    def posterior(self, votes: Votes, length: np.ndarray) -> np.ndarray:
        """A false vote is likelier in a longer text, which counts once against its votes."""
        yes = self.share * (np.log(self.hit) - np.log(self.false))
        none = np.log(self.missed / self.quiet)
        z = votes.by_row(yes) - (votes.count > 0) * length + (votes.count == 0) * none + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_length(words: Counter) -> float:
    return math.log(max(20, words.total()) / 400)


def summary(hits: np.ndarray, lexicon: int, length: float) -> tuple[float, float, float]:
    """What the classifier sees of a text beside its votes: words that vote, voters, and the length where there are any."""
    return min(3, np.searchsorted(hits, lexicon)) / 3, min(6, len(hits)) / 6, length if len(hits) else 0.0


class Classifier:
    """Logistic regression on votes, trained on the label model's posteriors."""

    def __init__(self, voters: Voters, votes: Votes, rest: np.ndarray, soft: np.ndarray):
        self.voters = voters
        rest = np.column_stack([rest, np.ones(len(rest))])
        w, n, ridge = np.zeros(votes.voters + rest.shape[1]), votes.voters, np.full(votes.voters + rest.shape[1], 0.1)
        ridge[-1] = 1e-7
        held = np.append(ridge[:-1], 0)

        def times(v: np.ndarray) -> np.ndarray:
            return votes.by_row(v[:n]) + rest @ v[n:]

        def back(r: np.ndarray) -> np.ndarray:
            return np.concatenate([votes.by_voter(r), rest.T @ r])

        for _ in range(40):  # Newton steps on a concave objective
            p = 1 / (1 + np.exp(-times(w)))
            r = np.maximum(p * (1 - p), 1e-6)
            diagonal = np.concatenate([votes.by_voter(r), (rest * rest).T @ r]) + ridge
            step = conjugate(lambda v: back(r * times(v)) + ridge * v, diagonal, back(soft - p) - held * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.w, self.c = w[:-1], float(w[-1])

    def score(self, text: str | None) -> float:
        words = words_of(text)
        hits = self.voters.hits(words)
        z = self.c + float(self.w[hits].sum() + np.dot(self.w[-3:], summary(hits, len(self.voters.words), log_length(words))))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def conjugate(product, diagonal: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve a positive definite system, given as its product with a vector, by conjugate gradients scaled with its diagonal."""
    x, left = np.zeros(len(right)), right.copy()
    y = left / diagonal
    way, size = y, left @ y
    enough = 1e-20 * size
    for _ in range(2 * len(right)):
        if size <= enough:
            break
        turned = product(way)
        a = size / (way @ turned)
        x, left = x + a * way, left - a * turned
        y = left / diagonal
        size, before = left @ y, size
        way = y + size / before * way
    return x


def train(texts: list[bytes], y: np.ndarray) -> Classifier | None:
    """Texts are cut into words once for the voters and once for the votes: no words of all texts are held."""
    seen: set = set()
    single = np.zeros(len(texts), bool)  # copies of one text would make its chance words stand out
    for i, t in enumerate(texts):
        a, b = copy_keys(t)
        single[i] = ("a", a) not in seen and ("b", b) not in seen
        seen |= {("a", a), ("b", b)}
    voters = find_voters((words_of(t.decode()) for t, one in zip(texts, single) if one), y[single])
    if not len(voters):
        return None
    hits, length = [], np.zeros(len(texts))
    for i, t in enumerate(texts):
        words = words_of(t.decode())
        hits.append(voters.hits(words))
        length[i] = log_length(words)
    votes = Votes(hits, len(voters))
    model = LabelModel(votes, length, float(y.mean()), np.minimum(1, votes.count / 2))
    rest = np.array([summary(h, len(voters.words), n) for h, n in zip(hits, length)])
    return Classifier(voters, votes, rest, model.posterior(votes, length))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier | None:
    """Learn ``labels.toxic`` from the rows outside the held-out fold."""
    return fitted(labelled_sample(docs, labels, "toxic", crc_bucket("doc_id", FOLDS) != HELD_OUT, rows), train)


def score(docs: DataFrame, model: Classifier | None, columns: list[str], name: str = "score") -> DataFrame:
    """Append the score, as column ``name``, to the named columns of every document."""
    columns = [c for c in columns if c.lower() != name.lower()]
    extra = [] if "text" in columns else ["text"]
    kept = docs.select(*[F.col(f"`{c}`") for c in [*columns, *extra]])
    fields, at, n = kept.schema.fields[: len(columns)], [*columns, *extra].index("text"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [model.score(t) if model else 0.0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(s, pa.float64())], names=[*columns, name])

    return kept.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """documents + labels -> the named columns (all by default) and ``name``, the probability of being toxic."""
    return score(docs, fit(docs, labels), columns or docs.columns, name)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(docs, labels, ["doc_id"]).select(
        "doc_id", (crc_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
