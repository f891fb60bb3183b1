"""Page layout: geometry, reading order, table reconstruction, spatial label lookup (L-01 to L-10, E-17, J-11, J-12).

Geometry and zones are expressions. Row clustering depends on a running average of the row so far,
which no window frame expresses; it is a fold over one page's sorted blocks, a few hundred at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.text import once
from ledgerspark.operators import running
from ledgerspark.operators.chunking import heading

ROW_BAND, META_SHARE = 12.0, 0.12
RIGHT_GAP, BELOW_GAP = 450.0, 85.0
SUMMARY_WORDS = ["summary", "subtotal", "sub total", "grand total", "total", "amount due", "net worth", "gross worth"]


def bounds(polygon: Column) -> Column:
    """L-01: (left, top, right, bottom, cx, cy, height) of a polygon [[x, y], ...]."""
    def box(p: Column) -> Column:
        return F.struct(
            p["left"].alias("left"), p["top"].alias("top"), p["right"].alias("right"), p["bottom"].alias("bottom"),
            ((p["left"] + p["right"]) / 2).alias("cx"), ((p["top"] + p["bottom"]) / 2).alias("cy"), (p["bottom"] - p["top"]).alias("height"))

    def extent(xs: Column, ys: Column) -> Column:
        return F.struct(F.array_min(xs).alias("left"), F.array_max(xs).alias("right"), F.array_min(ys).alias("top"), F.array_max(ys).alias("bottom"))

    sides = F.struct(F.transform(polygon, lambda p: p[0]).alias("x"), F.transform(polygon, lambda p: p[1]).alias("y"))
    return once(sides, lambda s: once(extent(s["x"], s["y"]), box))


def flat_blocks(results: DataFrame, pages: str = "raw_blocks") -> DataFrame:
    """(document_id, page_number, page_width, page_height, block, text, confidence, box) of nested pages."""
    p = results.select("document_id", F.explode(pages).alias("p"))
    b = p.select("document_id", "p.page_number", "p.page_width", "p.page_height", F.posexplode("p.blocks").alias("block", "b"))
    return b.select("document_id", "page_number", "page_width", "page_height", "block", "b.text", "b.confidence", bounds(F.col("b.bounding_box")).alias("box"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """L-02, L-03: adds ``zone`` and ``position``: headings, left then right party column, then the body, in bands of rows."""
    page = Window.partitionBy("document_id", "page_number")
    party = F.col("text").rlike(r"(?i)^\s*(seller|client|buyer|bill to|ship to|vendor|customer)\b")
    words = "|".join(SUMMARY_WORDS)
    start = F.coalesce(F.min(F.when(party, F.col("box.top"))).over(page), F.col("page_height") * META_SHARE)
    body = F.coalesce(F.min(F.when(F.col("text").rlike(r"(?i)^\s*(items|description|qty|no\.?)\b"), F.col("box.top"))).over(page), F.col("page_height"))
    done = F.coalesce(F.min(F.when(F.col("text").rlike(rf"(?i)^\s*({words})\b") & (F.col("box.top") > body), F.col("box.top"))).over(page), F.col("page_height"))
    b = blocks.withColumns({"_start": start, "_body": body}).withColumn("_done", done)
    zone = (
        F.when(F.col("box.top") < F.col("_start"), "header").when(F.col("box.top") < F.col("_body"), "party")
        .when(F.col("box.top") < F.col("_done"), "table").otherwise("summary")
    )
    band = F.bround(F.col("box.cy") / ROW_BAND)
    right = (zone == "party") & (F.col("box.left") > F.col("page_width") / 2)
    rank = F.when(zone == "header", 0).when(zone == "party", F.when(right, 2).otherwise(1)).when(zone == "table", 3).otherwise(4)
    order = Window.partitionBy("document_id", "page_number").orderBy("_rank", "_band", F.col("box.left"), "block")
    return b.withColumns({"zone": zone, "_rank": rank, "_band": band}).withColumn("position", F.row_number().over(order)).drop("_start", "_body", "_done", "_rank", "_band")


def full_text(ordered: DataFrame) -> DataFrame:
    """L-04: text of each document in reading order; page markers only where there are several pages."""
    page = ordered.groupBy("document_id", "page_number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("t"))
    every = F.array_sort(F.collect_list(F.struct("page_number", "t")))
    marked = F.array_join(F.transform(every, lambda p: F.concat(F.lit("=== PAGE "), p["page_number"].cast("string"), F.lit(" ===\n"), p["t"])), "\n\n")
    return page.groupBy("document_id").agg(F.when(F.count("*") > 1, marked).otherwise(F.max("t")).alias("full_text"))


def cluster_rows(blocks: DataFrame) -> DataFrame:
    """L-08, W-08: adds ``row``: a block joins the row above while it is near the running mean of that row's centres."""
    sorted_blocks = F.array_sort(F.collect_list(F.struct(F.col("box.cy").alias("cy"), F.col("box.left").alias("left"), "block", "text", "box", "confidence")))
    page = blocks.groupBy("document_id", "page_number").agg(sorted_blocks.alias("_b"))  # the blocks of one page
    page = page.withColumn("_s", running.mean_lines(F.col("_b.cy"), F.col("_b.box.height")))
    fields = ("cy", "left", "block", "text", "box", "confidence")
    tagged = F.transform(running.segments(F.col("_b"), F.col("_s")), lambda part, i: F.transform(part, lambda b: F.struct(i.alias("row"), *[b[c].alias(c) for c in fields])))
    return page.select("document_id", "page_number", F.inline(F.flatten(tagged)))


def table_cells(blocks: DataFrame) -> DataFrame:
    """L-05 to L-09, J-12, A-19: (document_id, page_number, row, name, text, confidence): blocks between the headings and the summary, each in the column it overlaps most.

    The heading row has the most distinct headings (two at least), the first of equals. A page is gathered once; the steps are expressions over its rows.
    """
    words = "|".join(SUMMARY_WORDS)
    b = blocks.select("document_id", "page_number", F.struct(
        F.col("box.cy").alias("cy"), F.col("box.left").alias("left"), "block", "text", "box", "confidence", heading(F.col("text")).alias("name"),
        F.coalesce(F.col("text").rlike(rf"(?i)^\s*({words})\b"), F.lit(False)).alias("sums")).alias("_b"))
    page = b.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list("_b")).alias("_b"))  # the blocks of one page
    page = page.withColumn("_s", running.mean_lines(F.col("_b.cy"), F.col("_b.box.height")))
    names = lambda part: F.array_distinct(F.filter(F.transform(part, lambda x: x["name"]), lambda n: n.isNotNull()))

    def columns(part: Column) -> Column:
        def one(n: Column) -> Column:
            return once(F.filter(part, lambda x: x["name"] == n), lambda xs: F.struct(
                F.array_min(F.transform(xs, lambda x: x["box"]["left"])).alias("left"), n.alias("name"), F.array_max(F.transform(xs, lambda x: x["box"]["right"])).alias("right")))

        return once(F.array_sort(F.transform(names(part), one)), lambda cs: F.transform(cs, lambda c, i: F.struct(
            c["name"].alias("name"), F.when(i == 0, 0.0).otherwise((F.get(cs, i - 1)["right"] + c["left"]) / 2).alias("from_x"),
            F.coalesce((c["right"] + F.get(cs, i + 1)["left"]) / 2, F.lit(1e9)).alias("to_x"))))

    def placed(part: Column, cs: Column) -> Column:
        def best(x: Column) -> Column:
            by = lambda c: F.least(x["box"]["right"], c["to_x"]) - F.greatest(x["box"]["left"], c["from_x"]) + F.when(x["box"]["cx"].between(c["from_x"], c["to_x"]), 10.0).otherwise(0.0)
            top = F.array_max(F.transform(cs, lambda c: F.struct(by(c).alias("by"), c["name"].alias("name"))))
            return F.struct(x["left"].alias("left"), x["text"].alias("text"), x["confidence"].alias("confidence"), top["name"].alias("name"))

        return F.array_sort(F.transform(part, best))

    def cells(parts: Column, row: Column) -> Column:
        def cell(n: Column) -> Column:
            def made(xs: Column) -> Column:
                sure = F.filter(F.transform(xs, lambda x: x["confidence"]), lambda c: c.isNotNull())
                mean = once(sure, lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)))
                return F.struct(row.alias("row"), n.alias("name"), F.array_join(F.transform(xs, lambda x: x["text"]), " ").alias("text"), mean.alias("confidence"))

            return once(F.filter(parts, lambda x: x["name"] == n), made)

        return F.transform(names(parts), cell)

    def table(lines: Column) -> Column:
        best = F.array_max(F.transform(lines, lambda part, i: F.struct(F.size(names(part)).alias("n"), (-i).alias("up"))))
        ends = F.filter(F.transform(lines, lambda part, i: F.when(F.exists(part, lambda x: x["sums"]), i)), lambda i: i.isNotNull())
        def below(h: Column) -> Column:
            end = F.coalesce(F.array_min(F.filter(ends, lambda i: i > h)), F.size(lines))
            body = lambda t: F.transform(F.slice(lines, h + 2, t["end"] - h - 1), lambda part, i: once(placed(part, t["columns"]), lambda parts: cells(parts, h + 1 + i)))
            return F.flatten(once(F.struct(columns(F.get(lines, h)).alias("columns"), end.alias("end")), body))

        return once(best, lambda t: F.when(t["n"] >= 2, once(-t["up"], below)))

    return page.select("document_id", "page_number", F.inline(once(running.segments(F.col("_b"), F.col("_s")), table)))


def spatial_values(blocks: DataFrame, labels: list[str]) -> DataFrame:
    """E-17, J-11: (document_id, label, value, confidence): in the label's own block, else right of it, else below it.

    Blocks meet the labels of their page only.
    """
    b = blocks.select("document_id", "page_number", "block", "text", "box")
    text = F.lower(F.trim("text"))
    found = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("label")) for i, x in enumerate(labels)])
    hit = F.filter(found, lambda x: F.startswith(text, F.lower(x["label"])))
    # the few label blocks of a page come to each of its blocks by a window: a page's rows are dealt out once
    own = lambda label: F.trim(F.regexp_replace(F.substr(F.trim("text"), F.length(label) + 1), r"^[\s:\-=]+", ""))
    told = F.transform(hit, lambda x: F.struct(x["i"].alias("i"), x["label"].alias("label"), own(x["label"]).alias("own")))
    page = b.withColumn("_hit", once(told, lambda l: F.when(F.size(l) > 0, F.struct("block", "box", l.alias("l")))))
    page = page.withColumn("_hits", F.collect_list("_hit").over(Window.partitionBy("document_id", "page_number")))
    page = page.select("document_id", F.col("block").alias("ob"), F.col("text").alias("value"), F.col("box").alias("o"), F.explode("_hits").alias("h"))
    page = page.select("document_id", "ob", "value", "o", F.col("h.block").alias("block"), F.col("h.box").alias("box"), F.explode("h.l").alias("l"))
    right = F.col("o.left") - F.col("box.right")
    below = F.col("o.top") - F.col("box.bottom")
    is_right = right.between(0, RIGHT_GAP) & (F.abs(F.col("o.cy") - F.col("box.cy")) <= F.greatest(F.lit(18.0), 0.65 * F.col("box.height")))
    is_below = below.between(0, BELOW_GAP) & ((F.abs(F.col("o.left") - F.col("box.left")) <= 60) | (F.abs(F.col("o.cx") - F.col("box.cx")) <= 100))
    page = page.withColumn("_own", F.col("l.own"))
    self, beside = (F.col("_own") != "") & F.col("ob").eqNullSafe(F.col("block")), (F.col("_own") == "") & (F.col("ob") != F.col("block")) & (is_right | is_below)
    way = F.when(self, 0).when(is_right, 1).otherwise(2)
    every = page.where(self | beside).select(
        "document_id", F.col("l.label").alias("label"), F.col("l.i").alias("i"), F.when(self, F.col("_own")).otherwise(F.col("value")).alias("value"), way.alias("way"),
        F.when(self, 0.0).when(is_right, right).otherwise(below).alias("gap"))
    best = every.groupBy("document_id").agg(F.min_by(F.struct("label", "value", "way", "i"), F.struct("i", "way", "gap", "value")).alias("b"))
    confidence = F.element_at(F.array(F.lit(0.90), F.lit(0.86), F.lit(0.80)), F.col("b.way") + 1) - 0.05 * F.col("b.i")
    return best.select("document_id", "b.label", "b.value", F.round(confidence, 2).alias("confidence"))


def page_confidence(blocks: DataFrame) -> DataFrame:
    """A-12: the mean of the pages' means, not weighted by their blocks."""
    pages = blocks.groupBy("document_id", "page_number").agg(F.avg("confidence").alias("c"))
    return pages.groupBy("document_id").agg(F.avg("c").alias("average_confidence"), F.count("*").alias("pages"))
