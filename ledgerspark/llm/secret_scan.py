"""Operator 12, secret scans with sliding-window entropy; DataFrame functions only.

Three plain patterns give the base spans. Beside them, every run of characters that a key could be
written in is a candidate. A window slides over the candidate's characters; the number of each
character in the window is kept as it moves (the character that enters is added, the one that leaves
is taken off), and with it the sum of k * log2(k) over these numbers, as an integer, so that nothing
drifts. Windows whose Shannon entropy reaches the limit of their character class are merged into
spans. Candidates on the allow-list, and spans inside a base span, are suppressed.

All of it is arrays within a row: nothing is shuffled, and a text's work follows its length.

Defined cases: null texts count as empty and have no spans; null ids are scanned like others;
repeated rows are rows of their own; a text of any length is scanned whole, with memory for its own
spans and the characters of one candidate; places are code points; other columns are ignored,
whatever their names; no rows give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import fresh

#: (kind, pattern, group that is measured, least length of it); kinds at one place come in this order.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs are maximal, so a shorter one can be left to the pattern
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]


@dataclass(frozen=True)
class CharacterClass:
    """Characters of one kind of key; windows of ``window`` of them count from ``bits`` of entropy on."""

    kind: str
    alphabet: str
    folded: bool
    window: int
    bits: float


_HEX, _LOWER, _DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = [
    CharacterClass("hex-entropy", _HEX, True, 20, 3.0),
    CharacterClass("base64-entropy", _LOWER + _LOWER.upper() + _DIGITS + "+/_=-", False, 20, 3.85),
]
#: Candidates of the first class whose characters they all are.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX_ONLY = r"^[0-9A-Fa-f]+$"
#: Candidates that are no secrets: words without digits, numbers, UUIDs, names made of short parts, placeholders.
ALLOW = [
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[-+/_=]*[A-Za-z0-9]{0,11}([-+/_=]+[A-Za-z0-9]{1,11})*[-+/_=]*$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp]laceholder|[Cc]hange[Mm]e|xxxxx|XXXXX|0123456789|1234567890|abcdefgh|ABCDEFGH",
]
#: Entropies are compared as integers: k * log2(k) in units of 2^-20 bits.
UNIT = 1 << 20
#: Prefix sums are taken in blocks of so many.
BLOCK = 256


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def sums_before(numbers: Column) -> Column:
    """array<int> -> array<bigint>: the sum of all earlier elements; blockwise, so that long arrays don't cost their square."""

    def add(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def block(a: Column, b: Column) -> Column:
        return F.slice(a, b * BLOCK + 1, BLOCK)

    def blocks(a: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / BLOCK).cast("int") - 1, F.lit(0)))

    def inside(a: Column, ahead: Column) -> Column:
        return F.flatten(F.transform(blocks(a), lambda b: once(
            block(a, b), lambda part: F.transform(part, lambda x, i: F.get(ahead, b) + add(F.slice(part, F.lit(1), i))))))

    return once(numbers, lambda a: once(
        F.transform(blocks(a), lambda b: add(block(a, b))),
        lambda totals: once(F.transform(totals, lambda t, b: add(F.slice(totals, F.lit(1), b))), lambda ahead: inside(a, ahead)),
    ))


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array<struct<start bigint, stop bigint, value string>>, ``value`` being the group."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.split(text, pattern, -1).alias("gap"),
    )

    def located(f: Column, before: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(f["gap"], i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("stop"), F.get(f["value"], i).alias("value"))

        return F.transform(f["whole"], one)

    steps = once(found, lambda f: once(
        sums_before(F.transform(f["whole"], lambda m, i: F.length(m) + F.length(F.get(f["gap"], i)))), lambda before: located(f, before)))
    return F.when(text.rlike(pattern), steps).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>"))


def entropy_table(window: int) -> list[int]:
    """round(k * log2(k)) in units, for k up to the window."""
    return [round(k * math.log2(k) * UNIT) if k else 0 for k in range(window + 1)]


def most_repeats(c: CharacterClass) -> int:
    """The entropy is log2(window) - sum / window: sums up to this reach the class's limit."""
    return math.floor(c.window * (math.log2(c.window) - c.bits) * UNIT)


def hot_windows(value: Column, c: CharacterClass) -> Column:
    """Merged windows of high entropy in a candidate: array<struct<a int, b int>>, places within the candidate."""
    table, limit = F.array(*map(F.lit, entropy_table(c.window))), most_repeats(c)
    span = "array<struct<a:int,b:int>>"
    number = lambda x: F.instr(F.lit(c.alphabet), x)
    entering = F.transform(F.split(F.lower(value) if c.folded else value, ""), lambda x: number(x).cast("int"))
    start = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet) + 1).alias("counts"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("at"),
        F.lit(0).alias("a"), F.lit(0).alias("b"), F.array().cast(span).alias("done"),
    )
    k_log_k = lambda k: F.get(table, k).cast("bigint")

    def moved(s: Column, x: Column) -> Column:
        came, went = x["came"], x["went"]
        leaving, held = F.get(s["counts"], went), F.get(s["counts"], came) - (came == went).cast("int")
        off = F.when(went > 0, k_log_k(leaving - 1) - k_log_k(leaving)).otherwise(F.lit(0).cast("bigint"))
        total = s["total"] + off + k_log_k(held + 1) - k_log_k(held)
        counts = F.transform(s["counts"], lambda n, i: n + (i == came).cast("int") - ((i == went) & (went > 0)).cast("int"))
        return F.struct(counts.alias("counts"), total.alias("total"), (s["at"] + 1).alias("at"), s["a"].alias("a"), s["b"].alias("b"), s["done"].alias("done"))

    def merged(s: Column) -> Column:
        hot = (s["at"] >= c.window) & (s["total"] <= limit)
        first = s["at"] - c.window
        apart = hot & ((s["b"] == 0) | (first > s["b"]))
        kept = F.when(apart & (s["b"] > 0), F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["done"])
        return F.struct(
            s["counts"].alias("counts"), s["total"].alias("total"), s["at"].alias("at"),
            F.when(apart, first).otherwise(s["a"]).alias("a"), F.when(hot, s["at"]).otherwise(s["b"]).alias("b"), kept.alias("done"),
        )

    def closed(s: Column) -> Column:
        return F.when(s["b"] > 0, F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["done"])

    steps = once(entering, lambda e: F.zip_with(
        e, F.concat(F.array_repeat(F.lit(0), c.window), e), lambda came, went: F.struct(came.alias("came"), went.alias("went"))))
    # the array of those that left is longer by a window: its end has nobody to enter
    return F.aggregate(F.filter(steps, lambda x: x["came"].isNotNull()), start, lambda s, x: once(moved(s, x), merged), closed)


def allowed(value: Column, known: list[str]) -> Column:
    out = value.isin(known) if known else F.lit(False)
    for pattern in ALLOW:
        out = out | value.rlike(pattern)
    return out


def entropy_spans(text: Column, known: list[str]) -> Column:
    """array<struct<start, kind, stop>> of the windows of high entropy that are not allowed; kinds are numbered after the base's."""
    ok = F.filter(places(text, CANDIDATE), lambda p: ~allowed(p["value"], known))

    def spans(p: Column) -> Column:
        def shifted(c: CharacterClass, kind: int) -> Column:
            return F.transform(hot_windows(p["value"], c), lambda w: F.struct(
                (p["start"] + w["a"]).alias("start"), F.lit(kind).alias("kind"), (p["start"] + w["b"]).alias("stop")))

        hexa, other = (shifted(c, len(BASE) + i) for i, c in enumerate(CLASSES))
        return F.when(p["value"].rlike(HEX_ONLY), hexa).otherwise(other)

    return F.flatten(F.transform(ok, spans))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, stop>> in order."""
    def one(kind: int, pattern: str, group: int, least: int) -> Column:
        long_enough = F.filter(places(text, pattern, group), lambda p: F.length(p["value"]) >= least)
        return F.transform(long_enough, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["stop"].alias("stop")))

    return F.array_sort(F.concat(*(one(i, *rule[1:]) for i, rule in enumerate(BASE))))


def _told(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, *_ in BASE), *(F.lit(c.kind) for c in CLASSES))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def secret_spans(docs: DataFrame, known: list[str] | None = None) -> DataFrame:
    """The documents with two more columns, ``base`` and ``added`` (or names that are free): array<struct<start, kind, stop>>.

    ``known`` are strings that are no secrets; they become part of the plan, so pass a bounded list.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base, added = fresh("base", docs.columns), fresh("added", docs.columns)
    out = docs.withColumn(base, base_spans(text)).withColumn(added, entropy_spans(text, known or []))
    inside = lambda s: F.exists(F.col(base), lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"]))
    return out.withColumn(added, F.filter(F.col(added), lambda s: ~inside(s)))


def secret_scan(docs: DataFrame, known: list[str] | None = None) -> DataFrame:
    """-> (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found = secret_spans(docs.select("doc_id", "text"), known)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(number(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)),
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Entropies are taken anew for each window here, from the numbers of its characters.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), k AS (
  SELECT * FROM (VALUES
    (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
    (1, 'access', '(AKIA[A-Z0-9]+)', 20), (2, 'hex', '([0-9a-f]{24,})', 24), (3, '', '([A-Za-z0-9+/_=-]{20,})', 20)) AS v(k, kind, p, least)
), m AS (
  SELECT r, 0 AS k, unnest(regexp_extract_all(t, (SELECT p FROM k WHERE k = 0), 0)) AS whole, unnest(regexp_extract_all(t, (SELECT p FROM k WHERE k = 0), 1)) AS value,
    unnest(string_split_regex(t, (SELECT p FROM k WHERE k = 0))) AS gap, generate_subscripts(string_split_regex(t, (SELECT p FROM k WHERE k = 0)), 1) AS i FROM d
  UNION ALL
  SELECT r, 1, unnest(regexp_extract_all(t, 'AKIA[A-Z0-9]+')), unnest(regexp_extract_all(t, 'AKIA[A-Z0-9]+')), unnest(string_split_regex(t, 'AKIA[A-Z0-9]+')), generate_subscripts(string_split_regex(t, 'AKIA[A-Z0-9]+'), 1) FROM d
  UNION ALL
  SELECT r, 2, unnest(regexp_extract_all(t, '[0-9a-f]{24,}')), unnest(regexp_extract_all(t, '[0-9a-f]{24,}')), unnest(string_split_regex(t, '[0-9a-f]{24,}')), generate_subscripts(string_split_regex(t, '[0-9a-f]{24,}'), 1) FROM d
  UNION ALL
  SELECT r, 3, unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}')), unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}')), unnest(string_split_regex(t, '[A-Za-z0-9+/_=-]{20,}')), generate_subscripts(string_split_regex(t, '[A-Za-z0-9+/_=-]{20,}'), 1) FROM d
), p AS (
  SELECT r, k, whole, value, CAST(sum(length(gap)) OVER w + sum(coalesce(length(whole), 0)) OVER w - coalesce(length(whole), 0) AS BIGINT) AS a
  FROM m WINDOW w AS (PARTITION BY r, k ORDER BY i)
), s AS (
  SELECT r, p.k, kind, a, a + length(whole) AS b FROM p JOIN k USING (k) WHERE whole IS NOT NULL AND p.k < 3 AND length(value) >= least
), c AS (
  SELECT row_number() OVER () AS c, r, a, CASE WHEN regexp_matches(value, '^[0-9A-Fa-f]+$') THEN 3 ELSE 4 END AS k, value FROM p
  WHERE k = 3 AND whole IS NOT NULL AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT regexp_matches(value, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
    AND regexp_matches(value, '[A-Za-z0-9]{12}')
    AND NOT regexp_matches(value, '[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp]laceholder|[Cc]hange[Mm]e|xxxxx|XXXXX|0123456789|1234567890|abcdefgh|ABCDEFGH')
), w AS (
  SELECT c, r, k, a + i AS a, substr(CASE WHEN k = 3 THEN lower(value) ELSE value END, CAST(i + 1 AS BIGINT), 20) AS part
  FROM (SELECT *, unnest(range(length(value) - 19)) AS i FROM c)
), n AS (
  SELECT c, r, k, a, sum(round(n * log2(n) * 1048576)) AS total
  FROM (SELECT c, r, k, a, x, count(*) AS n FROM (SELECT c, r, k, a, unnest(string_split(part, '')) AS x FROM w) GROUP BY ALL) GROUP BY ALL
), hot AS (
  SELECT c, r, k, a, sum(CASE WHEN a > before + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY a) AS island
  FROM (SELECT *, lag(a, 1, -100) OVER (PARTITION BY c ORDER BY a) AS before FROM n WHERE total <= floor(20 * (log2(20) - CASE WHEN k = 3 THEN 3.0 ELSE 3.85 END) * 1048576))
), e AS (
  SELECT r, k, CASE WHEN k = 3 THEN 'hex-entropy' ELSE 'base64-entropy' END AS kind, min(a) AS a, max(a) + 20 AS b FROM hot GROUP BY c, r, k, island
), every AS (
  SELECT * FROM s UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.r = e.r AND s.a <= e.a AND e.b <= s.b)
), told AS (SELECT r, k, a, b, kind || ':' || a || ':' || b AS x FROM every)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(x, ',' ORDER BY a, k, b) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY a, k, b) AS spans
  FROM told GROUP BY r
) USING (r)
"""
