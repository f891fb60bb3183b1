"""Pages to typed chunks (C-02, C-03, C-06, E-33): marked sections, pages without marks, headings given from outside.

Every rule is an expression over the page's array of lines, so a page becomes its chunks without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.text import lookup, once, some_word
from ledgerspark.operators.chunking import INTACT, STEP, TERM_TRIGGERS, WINDOW

CHUNK = "struct<chunk_type:string,section:string,content:string>"
# The marks of sections, the type of each and its section name.
MARK = r"(?m)^=== (HEADER & METADATA|PARTIES|LINE ITEMS|TOTALS & SUMMARY) ===$"
TYPES = {"HEADER & METADATA": "HEADER", "PARTIES": "PARTIES", "LINE ITEMS": "LINE_ITEMS", "TOTALS & SUMMARY": "SUMMARY"}
SECTIONS = {"HEADER & METADATA": "HEADER", "PARTIES": "SELLER", "LINE ITEMS": "LINE_ITEMS", "TOTALS & SUMMARY": "TOTALS"}


def _chunk(kind: str, section: str, content: Column) -> Column:
    return F.struct(F.lit(kind).alias("chunk_type"), F.lit(section).alias("section"), content.alias("content"))


def _strip(c: Column) -> Column:
    """White space of a pattern's kind off both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def _no_chunks() -> Column:
    return F.array().cast(f"array<{CHUNK}>")


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda s: _strip(s) != "")


def table_chunks(body: Column) -> Column:
    """C-04 on text: one chunk up to ``INTACT`` rows, else windows, each under the table's heading."""

    whole = lambda content: F.array(_chunk("LINE_ITEMS", "LINE_ITEMS", content))

    def cut(lines: Column) -> Column:
        rows, rest = F.filter(lines, lambda s: _strip(s).startswith("|")), F.filter(lines, lambda s: ~_strip(s).startswith("|"))
        return once(F.struct(rows.alias("rows"), rest.alias("rest")), sized)

    def sized(t: Column) -> Column:
        second = F.get(t["rows"], 1)
        n_head = F.when(F.contains(second, F.lit("---")) | F.contains(second, F.lit("===")), 2).otherwise(1)
        return once(n_head, lambda h: once(F.struct(t["rows"].alias("rows"), t["rest"].alias("rest"), h.alias("head"), F.greatest(F.size(t["rows"]) - h, F.lit(0)).alias("n")), by_rows))

    def by_rows(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(t["n"] - 1, F.lit(0)), F.lit(STEP)), lambda s: (s == 0) | (s - STEP + WINDOW < t["n"]))
        windows = once(F.slice(t["rows"], F.lit(1), t["head"]), lambda head: F.transform(
            starts, lambda s: _chunk("LINE_ITEMS", "LINE_ITEMS", _joined(F.concat(head, F.slice(t["rows"], t["head"] + s + 1, F.lit(WINDOW)))))))
        intact = F.concat(F.when(F.size(t["rest"]) > 0, F.concat(_joined(t["rest"]), F.lit("\n\n"))).otherwise(""), _joined(t["rows"]))
        return F.when(F.size(t["rows"]) == 0, whole(_strip(body))).when(t["n"] <= INTACT, whole(intact)).otherwise(windows)

    return once(_filled(F.split(body, "\n")), cut)


def summary_chunks(body: Column) -> Column:
    """C-05 on text: SUMMARY up to the first line with a trigger, TERMS from there on."""
    # as in the lower case of the text, where the Kelvin sign is a k
    trigger = "(?i)" + some_word(TERM_TRIGGERS).replace("k", "[k\u212a]")

    def cut(lines: Column) -> Column:
        return once(F.array_position(F.transform(lines, lambda s: s.rlike(trigger)), True).cast("int"), lambda at: parts(lines, at))

    def parts(lines: Column, at: Column) -> Column:
        before = F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines)
        after = F.when(at > 0, F.slice(lines, at, F.size(lines)))
        return F.array_compact(F.array(
            once(before, lambda b: F.when(F.size(b) > 0, _chunk("SUMMARY", "TOTALS", _joined(b)))), F.when(at > 0, _chunk("TERMS", "PAYMENT", _joined(after)))))

    return once(F.transform(_filled(F.split(body, "\n")), _strip), cut)


def marked_chunks(page: Column) -> Column:
    """C-02: the text before the first mark is a HEADER, each marked section its own chunks; empty sections go."""
    names = F.regexp_extract_all(page, F.lit(MARK), F.lit(1))

    def cut(parts: Column) -> Column:
        pieces = F.transform(names, lambda n, i: F.struct(n.alias("name"), _strip(F.get(parts, i + 1)).alias("body")))
        pieces = F.filter(pieces, lambda p: p["body"] != "")
        preamble = _strip(F.get(parts, 0))
        sections = F.transform(pieces, lambda p: F.when(p["name"] == "LINE ITEMS", table_chunks(p["body"])).when(
            p["name"] == "TOTALS & SUMMARY", summary_chunks(p["body"])).otherwise(F.array(F.struct(
                lookup(p["name"], TYPES).alias("chunk_type"), lookup(p["name"], SECTIONS).alias("section"),
                F.concat(F.lit("=== "), p["name"], F.lit(" ===\n"), p["body"]).alias("content")))))
        return F.concat(F.when(preamble != "", F.array(_chunk("HEADER", "HEADER", preamble))).otherwise(_no_chunks()), F.flatten(sections))

    return once(F.split(page, MARK), cut)


def plain_chunks(page: Column) -> Column:
    """C-03: a page without marks: HEADER, the first pipe table, then summary and terms; without a table, summary and terms alone."""

    def cut(lines: Column) -> Column:
        piped = F.transform(lines, lambda s: s.startswith("|") & s.rlike(r"^\|.*(---|\|)"))
        # the first such line, 1-based; what depends on it names it once
        return once(piped, lambda p: once(F.array_position(p, True).cast("int"), lambda first: F.when(first > 0, with_table(lines, p, first)).otherwise(summary_chunks(page))))

    def with_table(lines: Column, piped: Column, first: Column) -> Column:
        start = F.when((first > 1) & F.get(lines, first - 2).startswith("|"), first - 1).otherwise(first)
        below = F.transform(F.slice(lines, first, F.size(lines)), lambda s: s.startswith("|"))
        run = F.array_position(below, False).cast("int")  # the first line below that has no bar
        stop = once(run, lambda r: F.when(r > 0, first + r - 2).otherwise(F.size(lines)))
        last = once(stop, lambda e: e - F.array_position(F.reverse(F.slice(piped, first, F.greatest(e - first + 1, F.lit(1)))), True).cast("int") + 1)
        return once(F.struct(start.alias("start"), last.alias("last")), lambda t: placed(lines, t))

    def placed(lines: Column, t: Column) -> Column:
        above = _filled(F.slice(lines, F.lit(1), F.greatest(t["start"] - 1, F.lit(0))))
        head = once(above, lambda a: F.when(F.size(a) > 0, F.array(_chunk("HEADER", "HEADER", _joined(a)))).otherwise(_no_chunks()))
        table, below = F.slice(lines, t["start"], t["last"] - t["start"] + 1), F.slice(lines, t["last"] + 1, F.size(lines))
        return F.concat(head, table_chunks(_joined(table)), summary_chunks(_joined(below)))

    return once(F.transform(F.split(page, "\n"), _strip), cut)


def chunks(pages: DataFrame, text: str = "page_text") -> DataFrame:
    """C-02 to C-05: (…, chunk, chunk_type, section, content) of every page; blank pages give none."""
    t = F.col(text)
    found = F.when(_strip(t) == "", _no_chunks()).when(t.rlike(MARK), marked_chunks(t)).otherwise(plain_chunks(t))
    kept = [F.col(f"`{c}`") for c in pages.columns if c != text]
    return pages.select(*kept, F.posexplode(found).alias("chunk", "_c")).select(*kept, "chunk", "_c.*")


def heading_type(headings: Column, has_table: Column, index: Column) -> Column:
    """C-06: (chunk_type, section) of a chunk whose headings are given, by the first rule that fits."""
    has = lambda *words: F.exists(headings, lambda h: F.upper(h).rlike("|".join(words)))
    total = has("SUMMARY", "TOTAL")
    kind = lambda t, s: F.struct(F.lit(t).alias("chunk_type"), F.lit(s).alias("section"))
    return (
        F.when(has("ITEM") | (has_table & ~total), kind("LINE_ITEMS", "LINE_ITEMS")).when(total, kind("SUMMARY", "TOTALS"))
        .when(has("TERM", "CONDITION", "PAYMENT"), kind("TERMS", "PAYMENT")).when(has("SELLER", "CLIENT", "BILL TO", "BUYER"), kind("PARTIES", "SELLER"))
        .when(has("HEADER", "INVOICE") | (index == 0), kind("HEADER", "HEADER")).otherwise(kind("OTHER", "OTHER"))
    )


def box_references(chunk_rows: DataFrame, blocks: DataFrame, content: str = "content", most: int = 10) -> DataFrame:
    """J-13: adds ``references``, the boxes of up to ``most`` blocks of the page whose text a chunk contains, in block order.

    (document_id, page_number, …) and flat blocks (document_id, page_number, block, text, box); the limit is the feature.
    """
    page = blocks.where(F.trim("text") != "").groupBy("document_id", "page_number").agg(
        F.array_sort(F.collect_list(F.struct("block", "text", "box"))).alias("_b"))  # the blocks of one page
    inside = F.filter("_b", lambda b: F.contains(F.lower(content), F.lower(F.trim(b["text"]))))
    out = chunk_rows.join(page, ["document_id", "page_number"], "left")
    return out.withColumn("references", F.transform(F.slice(F.coalesce(inside, F.filter("_b", lambda b: F.lit(False))), F.lit(1), F.lit(most)), lambda b: b["box"])).drop("_b")
