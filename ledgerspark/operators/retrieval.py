"""Hybrid retrieval: dense and sparse candidates, reciprocal-rank fusion, re-ranking (R-01 to R-11, U-*, J-06)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.text import like, once
from ledgerspark.functions.vectors import cosine_distance
from ledgerspark.operators.tables import in_ids
from ledgerspark.sources.workspace import Workspace

RRF_K, CANDIDATES, RERANKED, FINAL = 60, 30, 25, 5
# Words that full-text search leaves out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with"]


def dense(chunks: DataFrame, query: list[float], k: int = CANDIDATES, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """R-02, R-03, T-03: the k nearest by cosine distance; filters and scoping stand before the ranking."""
    q = F.array(*[F.lit(float(v)) for v in query])
    scored = chunks.select("*", cosine_distance(F.col(vector), q).alias("distance")).where("distance IS NOT NULL")
    return ranked(scored, [F.col("distance"), F.col(key)], k, "dense_rank")


def ranked(df: DataFrame, order: list[Column], k: int, name: str) -> DataFrame:
    """Top k first (each task keeps k rows), then positions over those k rows alone."""
    some = df.orderBy(*order).limit(k)
    return some.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def parse_query(query: str) -> list[list[tuple[str, bool]]]:
    """R-04: a web-style query as alternatives (``or``) of (term or phrase, wanted); stop words go."""
    out: list[list[tuple[str, bool]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]+)"|([^\s"]+))', query.lower()):
        if not phrase and not minus and word == "or":
            out.append([])
            continue
        term = " ".join(re.findall(r"[\w']+", phrase or word))
        if term and term not in STOP_WORDS:
            out[-1].append((term, not minus))
    return [terms for terms in out if terms]


def stem(word: Column) -> Column:
    """A light suffix stripper, the same for queries and texts."""
    return F.regexp_replace(word, r"(?<=\w{3})(ings?|ed|ies|es|s|e)$", "")


def term_places(words: Column, term: str) -> Column:
    """Places (from 0) of a term, or of a phrase's first word, among stemmed words."""
    parts = term.split()
    wanted = [stem(F.lit(p)) for p in parts]

    def here(i: Column) -> Column:
        fits = F.get(words, i) == wanted[0]
        for k, w in enumerate(wanted[1:], 1):
            fits = fits & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return fits

    return F.filter(F.transform(words, lambda w, i: i), here)


def cover_density(places: list[Column]) -> Column:
    """R-04's rank: 0.1 / length for every shortest run of words that holds all terms (as many as there are, overlapping ones included)."""
    def marked(p: Column, term: int) -> Column:
        return F.transform(p, lambda i: F.struct(i.alias("at"), F.lit(term).alias("term")))

    return covers(F.array_sort(F.concat(*[marked(p, k) for k, p in enumerate(places)])), F.lit(len(places)))


def covers(marks: Column, terms: Column) -> Column:
    """The same over sorted places array<struct<at int, term int>> of ``terms`` terms, numbered from 0."""
    start = F.struct(F.array_repeat(F.lit(-1), terms).alias("last"), F.lit(-1).alias("from"), F.lit(0.0).alias("sum"))

    def step(s, m):
        last = F.transform(s["last"], lambda v, k: F.when(k == m["term"], m["at"]).otherwise(v))
        return once(last, lambda new: once(F.array_min(new), lambda low: F.struct(
            new.alias("last"), F.greatest(s["from"], low).alias("from"),
            # a run counts when its earliest word has moved on: it can't be shortened from the left any more
            (s["sum"] + F.when((low >= 0) & (low > s["from"]), 0.1 / (m["at"] - low + 1)).otherwise(0.0)).alias("sum"))))

    # sums of the same runs in another order are ties, not better or worse by a last bit
    return F.aggregate(marks, start, step, lambda s: F.round(s["sum"], 9))


def sparse(chunks: DataFrame, query: str, k: int = CANDIDATES, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """R-04, T-04: texts with all wanted terms (and no unwanted one) of an alternative, or the raw query as substring.

    The score is the best alternative's cover density; hits of the raw query alone score 0 and come last.
    """
    alternatives = parse_query(query)
    if not query.strip():
        return chunks.where(F.lit(False)).withColumns({"score": F.lit(0.0), "sparse_rank": F.lit(0)})
    low = F.lower(text)
    words = F.transform(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}']+"), F.lit(0)), stem)
    terms = list(dict.fromkeys(t for a in alternatives for t, _ in a))
    # only texts that hold the first letters of a term, or the raw query, are cut into words
    hint = F.contains(low, F.lit(query.lower().strip()))
    for t in terms:
        hint = hint | F.contains(low, F.lit(re.split(r"\W", t)[0][:3]))
    if any(all(not wanted for _, wanted in a) for a in alternatives):
        hint = F.lit(True)
    # the text is cut once, however many terms are looked for in it
    places = once(words, lambda w: F.array(*[term_places(w, t) for t in terms])) if terms else F.array().cast("array<array<int>>")
    placed = chunks.where(hint).withColumn("_p", places)
    at = lambda t: F.get("_p", F.lit(terms.index(t)))
    match, score = F.lit(False), F.lit(0.0)
    for a in alternatives:
        fits = F.lit(True)
        for t, wanted in a:
            fits = fits & ((F.size(at(t)) > 0) if wanted else (F.size(at(t)) == 0))
        good = [t for t, wanted in a if wanted]
        match = match | fits
        if good:
            score = F.greatest(score, F.when(fits, cover_density([at(t) for t in good])).otherwise(0.0))
    scored = placed.withColumns({"_m": match, "score": score})
    return ranked(scored.where(F.col("_m") | F.contains(low, F.lit(query.lower().strip()))).drop("_p", "_m"), [F.col("score").desc(), F.col(key)], k, "sparse_rank")


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, key: str = "chunk_id", k: int = RRF_K, top: int = RERANKED) -> DataFrame:
    """R-05, J-06, U-03, T-05: reciprocal ranks added up; ties go to the dense list, then to the smaller key."""
    both = dense_hits.select(key, "dense_rank").join(sparse_hits.select(key, "sparse_rank"), key, "full_outer")
    score = F.coalesce(1.0 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("sparse_rank")), F.lit(0.0))
    return both.withColumn("rrf", score).orderBy(F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), key).limit(top)


def rerank(hits: DataFrame, score: Column, threshold: float = -3.0, k: int = FINAL, key: str = "chunk_id") -> DataFrame:
    """R-06, T-06: rows over the threshold, or the best one if there are none, at most k."""
    w = Window.orderBy(F.desc("rerank_score"), key)
    best = hits.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), key).limit(max(k, 1))
    return best.withColumn("position", F.row_number().over(w)).where((F.col("rerank_score") >= threshold) | (F.col("position") == 1))


def overlap_score(text: Column, query: str) -> Column:
    """The offline scorer: the share of query words that the text has."""
    words = sorted({w for a in parse_query(query) for w, wanted in a if wanted})
    if not words:
        return F.lit(0.0)
    has = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}']+"), F.lit(0)))
    return F.size(F.array_intersect(has, F.array(*[F.lit(w) for w in words]))) / F.lit(float(len(words)))


def final_size(top_k: int | None, ids: list | None, scope: str = "global") -> int:
    """R-07."""
    if scope == "document":
        return FINAL
    return top_k or (FINAL if ids and len(ids) == 1 else max(FINAL, 10))


# Words that tell nothing in a query to a document.
QUERY_STOP_WORDS = ["the", "for", "and", "or", "in", "of", "to", "document", "details", "any", "other", "is", "a", "an"]


def similar_queries(a: Column, b: Column) -> Column:
    """U-06: word sets (over two letters) with Jaccard 0.70 or more, or containment 0.75 with two words in common."""
    sets = [query_words(x) for x in (a, b)]
    both, either = F.size(F.array_intersect(*sets)), F.size(F.array_union(*sets))
    least = F.least(F.size(sets[0]), F.size(sets[1]))
    return F.coalesce((both / F.when(either > 0, either) >= 0.70) | ((both >= 2) & (both / F.when(least > 0, least) >= 0.75)), F.lit(False))


def unseen(hits: DataFrame, seen: DataFrame, key: str = "chunk_id") -> DataFrame:
    """U-07, R-11."""
    return hits.join(seen.select(key), key, "left_anti")


def scoped_chunks(chunks: DataFrame, documents: DataFrame, ids: list | None = None, section: str | None = None, document_type: str | None = None, vendor_code: str | None = None, uploaded_by: int | None = None) -> DataFrame:
    """R-03, J-01, P-05 to P-08: chunks of live documents in scope; the scope stands before any ranking.

    ``section`` may stand in a chunk's section or type, ``document_type`` in the document's; None is no filter, an empty list matches nothing.
    """
    d = in_ids(documents.where(~F.col("is_deleted")), "id", ids)
    if document_type is not None:
        d = d.where(like(F.col("document_type"), document_type))
    if vendor_code is not None:
        d = d.where(F.col("vendor_code") == vendor_code)
    if uploaded_by is not None:
        d = d.where(F.col("uploaded_by") == uploaded_by)
    c = chunks if section is None else chunks.where(like(F.col("section"), section) | like(F.col("chunk_type"), section))
    return c.join(d.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def in_page_order(chunks: DataFrame, key: str = "id") -> DataFrame:
    """T-02: by page, unknown pages first, then by id."""
    return chunks.orderBy(F.asc_nulls_first("page_number"), key)


def exhausted(seen: DataFrame, chunks: DataFrame, keys: str = "document_id") -> DataFrame:
    """R-11: (document_id, exhausted): whether as many chunks have been seen as there are."""
    total = chunks.groupBy(keys).agg(F.count("*").alias("_t"))
    got = seen.dropDuplicates().groupBy(keys).agg(F.count("*").alias("_s"))
    return total.join(got, keys, "left").select(keys, (F.coalesce("_s", F.lit(0)) >= F.col("_t")).alias("exhausted"))


def query_words(text: Column) -> Column:
    """U-06: the distinct words of a query that tell something: over two letters, no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & ~w.isin(QUERY_STOP_WORDS))


#: Classes of a session that are compared with each other within one row.
SESSION_CLASSES = 64


def _near(both: Column, n: Column, n2: Column) -> Column:
    """Near-equality of sets of ``n`` and ``n2`` words, the first not the larger one, with ``both`` in common."""
    return (both / (n + n2 - both) >= 0.70) | ((both >= 2) & (both / n >= 0.75))


def _earliest_within(classes: DataFrame) -> DataFrame:
    """(session, words, first, n) of small sessions -> (session, words, other): the first turn of each class and those near it."""
    sessions = classes.groupBy("session").agg(F.collect_list(F.struct("words", "first", "n")).alias("cs"))

    def close(c: Column, d: Column) -> Column:
        both = F.size(F.array_intersect(c["words"], d["words"]))
        return (c["words"] == d["words"]) | once(both, lambda b: _near(b, F.least(c["n"], d["n"]), F.greatest(c["n"], d["n"])))

    def seen(c: Column) -> Column:
        return F.array_min(F.transform(F.filter("cs", lambda d: close(c, d)), lambda d: d["first"]))

    return sessions.select("session", F.inline(F.transform("cs", lambda c: F.struct(c["words"].alias("words"), seen(c).alias("other")))))


def repeated_queries(queries: DataFrame, session: str, turn: str, text: str) -> DataFrame:
    """U-06 over whole sessions: (session, turn, similar_to): the first earlier query of the session that is equal in words or near-equal, or null.

    Near-equal is ``similar_queries``. Queries with the same words are one class, so copies are never
    compared. Classes meet by a word: two sets of which the smaller has s words and which are near-equal share
    at least 70 % of these, so one of the smaller set's rarest s - ceil(0.7 s) + 1 words must be in the larger one;
    words are ranked by how many classes of the session have them. What meets is compared by its counts of words.
    Queries without such words are like those of the same text alone, blank ones like none; a repeated turn number is ordered with the others of its number.

    Sessions of up to SESSION_CLASSES classes are compared each within a row, larger ones by joins. All sides of these grow
    with the queries, far beyond the size of the columns that they are read from, by which a planner
    would choose one to be broadcast: the joins are shuffled.
    """
    plain = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    rows = queries.select(F.col(session).alias("session"), F.col(turn).alias("turn"), F.array_sort(query_words(F.col(text))).alias("words"), plain.alias("plain"))
    alone = F.when(F.col("plain") != "", F.array(F.concat(F.lit("="), "plain"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("session", "turn", F.when(F.size("words") > 0, F.col("words")).otherwise(alone).alias("words"))
    classes = rows.where(F.size("words") > 0).groupBy("session", "words").agg(F.min("turn").alias("first"))
    classes = classes.select("*", F.size("words").alias("n"), F.count("*").over(Window.partitionBy("session")).alias("of"))
    classes = Workspace(queries.sparkSession, "repeated-queries").keep(classes)
    few, classes = classes.where(F.col("of") <= SESSION_CLASSES), classes.where(F.col("of") > SESSION_CLASSES)
    words = classes.select("session", "words", "first", "n", F.explode("words").alias("w"))
    rarity = words.groupBy("session", "w").agg(F.count("*").alias("df"))
    # each class's words from its rarest on
    place = Window.partitionBy("session", "words").orderBy("df", "w")
    rarity = rarity.select(F.col("session").alias("s2"), F.col("w").alias("w2"), "df").hint("merge")
    ranked_words = words.join(rarity, [F.col("session").eqNullSafe(F.col("s2")), F.col("w") == F.col("w2")]).drop("s2", "w2").withColumn("place", F.row_number().over(place))
    key = [F.col("session").eqNullSafe(F.col("s2")), F.col("w") == F.col("w2")]
    small = ranked_words.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 0.7) + 1).select("session", "w", "words", "first", "n").distinct()
    large = words.select(F.col("session").alias("s2"), F.col("w").alias("w2"), F.col("words").alias("words2"), F.col("first").alias("first2"), F.col("n").alias("n2")).hint("merge")
    met = small.join(large, [key[0], key[1], F.col("n") <= F.col("n2"), F.col("words") != F.col("words2")]).select("session", "words", "first", "n", "words2", "first2", "n2").distinct()
    both = F.size(F.array_intersect("words", "words2"))
    near = met.where(_near(both, F.col("n"), F.col("n2")))
    seen = near.select("session", "words", F.col("first2").alias("other")).unionByName(near.select("session", F.col("words2").alias("words"), F.col("first").alias("other")))
    earliest = classes.select("session", "words", F.col("first").alias("other")).unionByName(seen).groupBy("session", "words").agg(F.min("other").alias("other"))
    earliest = earliest.unionByName(_earliest_within(few))
    e = earliest.select(F.col("session").alias("s2"), F.col("words").alias("words2"), "other").hint("merge")
    found = rows.join(e, [F.col("session").eqNullSafe(F.col("s2")), F.col("words") == F.col("words2")], "left")
    return found.select("session", "turn", F.when(F.col("other") < F.col("turn"), F.col("other")).alias("similar_to"))
