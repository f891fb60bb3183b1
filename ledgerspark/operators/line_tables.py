"""Line items of a page's blocks: heading band, columns, table end, row lines, continued items (L-05 to L-09, W-08, J-12, A-19).

Blocks (document_id, page_number, page_width, page_height, block, text, confidence, box) as
``layout.flat_blocks`` gives them. They are dealt out once, page by page, so nothing is joined or dealt out again; numpy takes
each step (bands, gutters, lines, items) for many pages together, a whole page at least. The same
steps by themselves are expressions over a page's arrays. Pages without two known headings in one band have no table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.text import once, some_word
from ledgerspark.operators import running

# Headings of each column, and words that begin what follows a table.
HEADINGS = {
    "item_number": ["NO.", "NO_", "NO", "SL NO", "ITEM NO", "SR NO", "POS", "POS.", "POS NO", "ITEM", "ARTICLE", "ART.", "SR.", "SL.", "NO#", "#"],
    "description": ["DESCRIPTION", "ITEM DESCRIPTION", "PARTICULARS", "PRODUCT", "ITEMS", "DESIGNATION", "BEZEICHNUNG", "ARTIKEL", "DETAILS", "PRODUCT DESCRIPTION"],
    "quantity": ["QTY", "QUANTITY", "MENGE", "ANZAHL", "QTY.", "MENGE (STK)"],
    "unit": ["UM", "UNIT", "UOM", "EINHEIT", "U/M", "MEASURE", "UNIT OF MEASURE"],
    "unit_price": ["NET PRICE", "UNIT PRICE", "PRICE", "RATE", "PREIS", "EINZELPREIS", "NETTO-PREIS", "UNIT COST", "PRICE/UNIT", "PRICE (NET)"],
    "net_amount": ["NET WORTH", "NET AMOUNT", "AMOUNT", "TAXABLE VALUE", "BETRAG", "NETTOBETRAG", "NET", "TOTAL NET", "BASE AMOUNT", "NET PRICE TOTAL"],
    "vat_rate": ["VAT [%]", "VAT[%]", "VAT %", "VAT%", "TAX %", "TAX%", "GST %", "GST%", "MWST", "MWST%", "MWST %", "VAT RATE", "TAX RATE", "RATE %", "MWST. %", "VAT", "MWST.", "TAX RATE %"],
    "gross_amount": ["GROSS WORTH", "GROSS AMOUNT", "GROSS", "TOTAL AMOUNT", "GESAMT", "BRUTTOBETRAG", "BRUTTO", "TOTAL", "LINE TOTAL", "GROSS TOTAL"],
}
SUMMARY = [
    "TOTAL", "SUBTOTAL", "GRAND TOTAL", "SUMMARY", "BANK DETAILS", "TERMS & CONDITIONS", "PAYMENT TERMS", "NOTES", "THANK YOU", "GESAMTBETRAG", "TAX TOTAL", "VAT TOTAL",
    "BALANCE DUE", "AMOUNT DUE",
]
NUMERIC = ["quantity", "unit_price", "net_amount", "gross_amount", "vat_rate"]
FLOOR, DEFAULT_END, BAND, BELOW_HEADING, BELOW_END = 0.05, 0.95, 40, 15.0, 8.0
WIDTH, HEIGHT = 1000.0, 1400.0
PAGE = ["document_id", "page_number"]
#: Blocks that numpy takes together, the last page's aside.
BLOCKS_AT_ONCE = 200_000
_NAMES = list(HEADINGS)
_NUMERIC = [_NAMES.index(n) for n in NUMERIC]
_NAME_ORDER = np.argsort(np.argsort(_NAMES))


def column_of(up: Column) -> Column:
    """The column that a heading in capitals names: the longest known heading that it is, begins or ends with, or holds as words; null without one."""
    by_size = sorted(((h, c) for c, names in HEADINGS.items() for h in names), key=lambda x: -len(x[0]))
    exact: dict[str, str] = {}
    for h, c in by_size:
        exact.setdefault(h, c)
    whole = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])
    table = F.array(*[F.struct(F.lit(h).alias("name"), F.lit(f" {h} ").alias("words"), F.lit(len(h) >= 3).alias("long"), F.lit(c).alias("column")) for h, c in by_size])

    def part(t: Column) -> Column:
        # short headings stand alone, longer ones may be a part of a longer word at either end
        inside = lambda x: F.contains(t["words"], x["words"]) | (x["long"] & (F.startswith(t["up"], x["name"]) | F.endswith(t["up"], x["name"])))
        return F.coalesce(F.try_element_at(whole, t["up"]), F.get(F.filter(table, inside), 0)["column"])

    return once(F.struct(up.alias("up"), F.concat(F.lit(" "), up, F.lit(" ")).alias("words")), part)


def _wordy(up: Column) -> Column:
    """Whether a text is more than a number: all headings and summary words are."""
    return up.rlike("[^0-9.,]")


def heading_name(up: Column) -> Column:
    """The column that a block's capitals name, or null; sets and a pattern of all headings keep most texts from being looked at closely."""
    by_size = sorted(((h, c) for c, names in HEADINGS.items() for h in names), key=lambda x: -len(x[0]))
    exact: dict[str, str] = {}
    for h, c in by_size:
        exact.setdefault(h, c)
    out = F.when(~_wordy(up), None)
    for column in HEADINGS:
        out = out.when(up.isin([h for h, c in exact.items() if c == column]), column)
    return out.when(up.rlike(some_word(h for h, _ in by_size)), column_of(up))


def begins_summary(up: Column) -> Column:
    return _wordy(up) & up.rlike("^(?:" + "|".join(re.escape(w) for w in SUMMARY) + ")")


def _sized(blocks: DataFrame) -> DataFrame:
    """Pages without a size have the default one."""
    size = lambda c, default: F.when(F.col(c) > 0, F.col(c).cast("double")).otherwise(default)
    return blocks.withColumns({"page_width": size("page_width", WIDTH), "page_height": size("page_height", HEIGHT), "text": F.coalesce(F.trim("text"), F.lit(""))})


def _heading(up: Column, *more: str) -> Column:
    """A struct for a block that is a heading, else null (``_sized`` blocks)."""
    name = F.when(F.col("box.top") > F.col("page_height") * FLOOR, heading_name(up))
    return once(name, lambda n: F.when(n.isNotNull(), F.struct(
        F.col("box.cy").alias("cy"), "block", n.alias("name"), "page_width", "page_height", F.col("box.left").alias("left"), F.col("box.right").alias("right"),
        F.col("box.top").alias("top"), F.col("box.bottom").alias("bottom"), *more)))


def band(headings: Column) -> Column:
    """L-05 on a page's headings: of all bands of 40 above and below a heading the first with the most columns, if it has two; else empty."""
    near = lambda x: F.filter(headings, lambda y: y["cy"].between(x["cy"] - BAND, x["cy"] + BAND))
    counts = F.transform(headings, lambda x: F.struct(F.size(F.array_distinct(F.transform(near(x), lambda y: y["name"]))).alias("n"), (-x["cy"]).alias("up")))
    # the greatest count, the highest of equals; headings.cy - seed is cy + up
    best = lambda t: F.filter(headings, lambda x: (t["n"] >= 2) & (F.abs(x["cy"] + t["up"]) <= BAND))
    return once(F.array_max(counts), lambda t: F.coalesce(best(t), F.filter(headings, lambda x: F.lit(False))))


def ranges(headings: Column) -> Column:
    """L-06 on a page's heading band: columns from left to right; they share the page at their gutters, or between their centres where they touch."""
    size = lambda x: F.struct(x["page_width"].alias("w"), x["page_height"].alias("h"), x["name"].alias("name"))
    one = lambda f, part, c: f(F.transform(part, lambda x: x[c]))

    def column(key: Column) -> Column:
        return once(F.filter(headings, lambda x: size(x) == key), lambda part: F.struct(
            ((one(F.array_min, part, "left") + one(F.array_max, part, "right")) / 2).alias("cx"), F.array_min(F.transform(part, lambda x: F.struct(x["cy"].alias("cy"), x["block"].alias("block")))).alias("first"),
            key["name"].alias("name"), key["w"].alias("w"), key["h"].alias("h"), one(F.array_min, part, "left").alias("x0"), one(F.array_max, part, "right").alias("x1"),
            one(F.array_min, part, "top").alias("top"), one(F.array_max, part, "bottom").alias("bottom")))

    border = lambda a, b: F.when(a["x1"] < b["x0"], (a["x1"] + b["x0"]) / 2).otherwise((a["cx"] + b["cx"]) / 2)

    def placed(cs: Column) -> Column:
        def with_edges(c: Column, i: Column) -> Column:
            prev, after = F.get(cs, i - 1), F.get(cs, i + 1)
            left = F.when(i == 0, 0.0).otherwise(border(prev, c))
            right = F.when(after.isNull(), c["w"]).otherwise(border(c, after))
            right = F.when((c["name"] == "description") & after.isNotNull(), F.least(right, after["x0"] - 2)).otherwise(right)
            return F.struct(
                c["h"].alias("page_height"), c["name"].alias("name"), (i + 1).alias("place"), F.bround(left, 1).alias("x_min"), F.bround(right, 1).alias("x_max"),
                one(F.array_min, cs, "top").alias("heading_top"), (one(F.array_max, cs, "bottom") + BELOW_HEADING).alias("heading_bottom"))

        return F.transform(cs, with_edges)

    return once(F.array_sort(F.transform(F.array_distinct(F.transform(headings, size)), column)), placed)


def table_end(tops: Column, heading_bottom: Column, page_height: Column) -> Column:
    """L-07: down to the first summary word below the headings, or to 95 % of the page."""
    default = page_height * DEFAULT_END
    return F.coalesce(F.least(F.array_min(F.filter(tops, lambda y: y >= heading_bottom)), default), default)


def heading_bands(blocks: DataFrame) -> DataFrame:
    """L-05: (…, page_width, page_height, block, name, cy, box): the headings of each page's table."""
    b = _sized(blocks)
    page = b.select(*PAGE, once(F.upper(F.trim("text")), lambda up: _heading(up, "box")).alias("_h")).groupBy(*PAGE).agg(F.collect_list("_h").alias("_h"))
    return page.select(*PAGE, F.inline(band(F.col("_h")))).select(*PAGE, "page_width", "page_height", "block", "name", "cy", "box")


def column_ranges(bands: DataFrame) -> DataFrame:
    """L-06: (…, page_height, name, place, x_min, x_max, heading_top, heading_bottom) of each page's heading band."""
    h = F.struct("cy", "block", "name", "page_width", "page_height", F.col("box.left").alias("left"), F.col("box.right").alias("right"), F.col("box.top").alias("top"), F.col("box.bottom").alias("bottom"))
    return bands.groupBy(*PAGE).agg(F.collect_list(h).alias("_h")).select(*PAGE, F.inline(ranges(F.col("_h"))))


def table_regions(blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """L-07: (…, heading_top, heading_bottom, table_end) of each page with columns."""
    head = columns.groupBy(*PAGE).agg(F.first("page_height").alias("page_height"), F.first("heading_top").alias("heading_top"), F.first("heading_bottom").alias("heading_bottom"))
    tops = blocks.where(begins_summary(F.upper(F.trim("text")))).groupBy(*PAGE).agg(F.collect_list("box.top").alias("_y"))
    return head.join(tops, PAGE, "left").select(*PAGE, "heading_top", "heading_bottom", table_end(F.col("_y"), F.col("heading_bottom"), F.col("page_height")).alias("table_end"))


def _geometry() -> Column:
    return F.struct(F.col("box.cy").alias("cy"), F.col("box.left").alias("left"), "block", F.col("box.top").alias("top"), F.col("box.bottom").alias("bottom"), "text", "confidence", "box")


def _line_starts(body: Column) -> Column:
    """L-08, W-08 on a page's sorted blocks: where lines begin."""
    return running.extent_lines(body["cy"], body["top"], body["bottom"])


def row_lines(body: DataFrame) -> DataFrame:
    """L-08, W-08: adds ``line``: a block joins the running line if it overlaps it by over 30 % of its height, or its centre is near the line's mean centre."""
    page = body.groupBy(*PAGE).agg(F.array_sort(F.collect_list(_geometry())).alias("_b")).withColumn("_s", _line_starts(F.col("_b")))
    tagged = F.transform(running.segments(F.col("_b"), F.col("_s")), lambda part, i: F.transform(part, lambda b: F.struct(*[b[c].alias(c) for c in ("block", "text", "confidence", "box")], i.alias("line"))))
    return page.select(*PAGE, F.inline(F.flatten(tagged)))


def _counts(starts: np.ndarray, size: int) -> np.ndarray:
    """How many of the sorted starts there are for each number below ``size``."""
    return np.bincount(starts, minlength=size)


def _below(page: np.ndarray, value: np.ndarray, limit: np.ndarray, inclusive: bool) -> np.ndarray:
    """How many values of earlier pages, or of the same page below (or at) each limit; limits stand beside the values."""
    n = len(page)
    order = np.lexsort((np.repeat([0, 1] if inclusive else [1, 0], n), np.concatenate([value, limit]), np.concatenate([page, page])))
    before = np.cumsum(order < n)
    out = np.empty(n, np.int64)
    out[order[order >= n] - n] = before[order >= n]
    return out


def _band(page: np.ndarray, cy: np.ndarray, name: np.ndarray, pages: int) -> np.ndarray:
    """``band`` over the headings of many pages: which of them are in their page's band."""
    order = np.lexsort((cy, page))
    page, cy, name = page[order], cy[order], name[order]
    lo, hi = _below(page, cy, cy - BAND, False), _below(page, cy, cy + BAND, True)
    n = np.zeros(len(page), np.int64)
    for k in range(len(HEADINGS)):
        seen = np.append(0, np.cumsum(name == k))
        n += seen[hi] > seen[lo]
    first = np.lexsort((cy, -n, page))  # the greatest count, the highest of equals
    first = first[np.flatnonzero(np.diff(page[first], prepend=-1))]
    seed, most = np.full(pages, np.nan), np.zeros(pages, np.int64)
    seed[page[first]], most[page[first]] = cy[first], n[first]
    out = np.zeros(len(page), bool)
    out[order] = (most[page] >= 2) & (np.abs(cy - seed[page]) <= BAND)
    return out


def _to_tenths(x: np.ndarray) -> np.ndarray:
    """As Spark's ``bround``: halves of the decimal spelling go to the even tenth."""
    y = x * 10
    out = np.rint(y) / 10
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.1"), ROUND_HALF_EVEN))
    return out


def _ranges(b: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    """``ranges`` over the heading bands (blocks ``at``) of many pages: their columns by page and place."""
    order = at[np.lexsort((b["block"][at], b["cy"][at], b["name"][at], b["height"][at], b["width"][at], b["page"][at]))]
    key = [b[c][order] for c in ("page", "width", "height", "name")]
    new = np.flatnonzero(np.logical_or.reduce([np.append(True, k[1:] != k[:-1]) for k in key])) if len(order) else order
    over = lambda f, c: f.reduceat(b[c][order], new) if len(new) else b[c][order]
    c = {"page": key[0][new], "w": key[1][new], "h": key[2][new], "name": key[3][new], "x0": over(np.fmin, "left"), "x1": over(np.fmax, "right"), "top": over(np.fmin, "top"), "bottom": over(np.fmax, "bottom")}
    c["cx"] = (c["x0"] + c["x1"]) / 2
    place = np.lexsort((_NAME_ORDER[c["name"]], b["block"][order][new], b["cy"][order][new], c["cx"], c["page"]))
    c = {k: v[place] for k, v in c.items()}
    first = np.append(True, c["page"][1:] != c["page"][:-1])[: len(place)]
    last = np.append(first[1:], True)[: len(place)]
    x0, cx = np.append(c["x0"][1:], 0.0)[: len(place)], np.append(c["cx"][1:], 0.0)[: len(place)]
    border = np.where(c["x1"] < x0, (c["x1"] + x0) / 2, (c["cx"] + cx) / 2)
    right = np.where(last, c["w"], border)
    right = np.where(~last & (c["name"] == _NAMES.index("description")), np.fmin(right, x0 - 2), right)
    c["x_min"], c["x_max"] = _to_tenths(np.where(first, 0.0, np.append(0.0, border[:-1])[: len(place)])), _to_tenths(right)
    return c


def _joined(texts: pa.Array, of: np.ndarray, size: int) -> pa.Array:
    """The texts of each number below ``size`` (sorted), with spaces between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(_counts(of, size))).astype(np.int32)), texts), " ")


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut where a page begins, in larger tables."""
    kept, rows, limit = [], 0, BLOCKS_AT_ONCE
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= limit:
            table = pa.Table.from_batches(kept)
            last = int(np.flatnonzero(table["_i"].to_numpy() == 1)[-1])
            if last:
                yield table.slice(0, last)
            table = table.slice(last)
            kept, rows = table.to_batches(), table.num_rows
            limit = max(BLOCKS_AT_ONCE, 2 * rows)
    if rows:
        yield pa.Table.from_batches(kept)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, page after page, ``_i`` counting them in each -> line items: band, columns, table end, lines and items of many pages at once."""
    for blocks in _whole_pages(batches):
        opening = blocks["_i"].to_numpy() == 1
        pages, page_rows = int(opening.sum()), np.flatnonzero(opening)
        b = {c: blocks[c].to_numpy().astype(np.float64) for c in ("cy", "left", "top", "bottom", "right", "cx", "width", "height", "confidence")}
        b["page"] = np.cumsum(opening) - 1
        b["block"] = pc.fill_null(blocks["block"], -1).to_numpy()
        b["name"] = pc.fill_null(pc.index_in(blocks["name"], pa.array(_NAMES)), -1).to_numpy()
        text = blocks["text"].combine_chunks()

        heads = np.flatnonzero((b["name"] >= 0) & ~np.isnan(b["cy"]))
        c = _ranges(b, heads[_band(b["page"][heads], b["cy"][heads], b["name"][heads], pages)])
        n = _counts(c["page"], pages)
        begin = np.cumsum(n) - n
        some = np.flatnonzero(n)
        head, end = np.full(pages, np.nan), np.full(pages, np.nan)
        if not len(some):
            continue
        head[some] = np.fmax.reduceat(c["bottom"], begin[some]) + BELOW_HEADING
        end[some] = c["h"][begin[some]] * DEFAULT_END
        ends = np.flatnonzero(blocks["summary"].to_numpy().astype(bool) & (b["top"] >= head[b["page"]]))
        np.fmin.at(end, b["page"][ends], b["top"][ends])

        body = np.flatnonzero((b["top"] >= head[b["page"]]) & (b["bottom"] <= end[b["page"]] + BELOW_END))
        order = ["page", "cy", "left", "block", "top", "bottom"]
        body = body[np.lexsort([b[k][body] for k in reversed(order)])]
        if np.logical_and.reduce([b[k][body][1:] == b[k][body][:-1] for k in order]).any():  # blocks that only their texts tell apart
            body = body[np.lexsort([pc.rank(text.take(pa.array(body)), tiebreaker="dense").to_numpy(), *[b[k][body] for k in reversed(order)]])]
        b = {k: v[body] for k, v in b.items()}
        text, page = text.take(pa.array(body)), b["page"]
        size = _counts(page, pages)
        base = np.cumsum(size) - size
        starts = running.extent_starts(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(page)), b["cy"], b["top"], b["bottom"])
        begins = np.zeros(len(page), np.int64)
        begins[starts.flatten().to_numpy() + np.repeat(base, pc.list_value_length(starts).to_numpy())] = 1
        line = np.cumsum(begins) - 1

        # the column that is overlapped most, the left one of equals
        most, name = np.zeros(len(page)), np.full(len(page), -1)
        for k in range(n.max()):
            has = n[page] > k
            col = (begin[page] + k)[has]
            x0, x1, cx = c["x_min"][col], c["x_max"][col], b["cx"][has]
            by = np.fmax(0.0, np.fmin(x1, b["right"][has]) - np.fmax(x0, b["left"][has])) + np.where((cx >= x0) & (cx <= x1), 10.0, 0.0)
            more = by > most[has]
            at = np.flatnonzero(has)[more]
            most[at], name[at] = by[more], c["name"][col[more]]

        # texts of a cell stand from left to right
        order = np.lexsort((b["block"], b["left"], line))
        page, name, sure, text = page[order], name[order], b["confidence"][order], text.take(pa.array(order))
        lines = int(begins.sum())
        digit = (name == _NAMES.index("item_number")) & pc.match_substring_regex(text, "[0-9]").to_numpy(zero_copy_only=False)
        starts_item, described = np.zeros(lines, bool), np.zeros(lines, bool)
        starts_item[line[np.isin(name, _NUMERIC) | digit]] = True
        described[line[name == _NAMES.index("description")]] = True
        # lines above a page's first item are left out
        first = np.flatnonzero(begins)
        line_page = b["page"][first]
        item_of = np.cumsum(starts_item) - 1
        of_page = line_page[starts_item]
        items = len(of_page)
        inside = (item_of >= 0) & (np.append(of_page, -1)[item_of] == line_page)
        item, head_line, kept = item_of[line], starts_item[line], inside[line]
        cell = lambda chosen: _joined(text.filter(pa.array(chosen)), item[chosen], items)
        cells = [cell(kept & head_line & (name == k)) for k, h in enumerate(_NAMES) if h != "description"]
        said = cell(kept & np.where(head_line | described[line], name == _NAMES.index("description"), True))
        known = kept & head_line & (name >= 0) & ~np.isnan(sure)
        count, total = _counts(item[known], items), np.bincount(item[known], sure[known], items)
        per_page = _counts(of_page, pages)
        nth = np.arange(items) - (np.cumsum(per_page) - per_page)[of_page] + 1
        yield pa.RecordBatch.from_arrays([
            *[blocks[p].combine_chunks().take(pa.array(page_rows[of_page])) for p in PAGE], pa.array(nth, pa.int64()), *[pc.if_else(pc.equal(x, ""), None, x) for x in cells], said,
            pa.array(np.where(count > 0, total / np.maximum(count, 1), 1.0))], [*PAGE, "item", *[h for h in _NAMES if h != "description"], "description", "confidence"])


def line_items(blocks: DataFrame) -> DataFrame:
    """L-09, A-19: (document_id, page_number, item, item_number, description, quantity, unit, …, gross_amount, confidence).

    A line with a numeric cell, or a digit in its item number, begins an item; other lines continue the
    description of the item above (by their description cell, else by all their text); those above the first
    item are left out. Texts of a cell stand from left to right; confidence is the mean over the first line's cells.
    """
    up = F.upper("text")
    name = F.when(F.col("box.top") > F.col("page_height") * FLOOR, heading_name(up))
    # a block without text is no heading, no end and in no cell
    b = _sized(blocks).where("text <> ''").withColumn("name", name)
    b = b.select(
        *PAGE, "block", "text", F.col("confidence").cast("double").alias("confidence"), *[F.col(f"box.{c}").cast("double").alias(c) for c in ("cy", "left", "top", "bottom", "right", "cx")],
        F.when(F.col("name").isNotNull(), F.col("page_width")).alias("width"), F.when(F.col("name").isNotNull(), F.col("page_height")).alias("height"), "name", begins_summary(up).alias("summary"))
    # the blocks of a page come one after the other, in one task
    page = b.withColumn("_i", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*PAGE)))
    out = T.StructType().add(page.schema["document_id"]).add(page.schema["page_number"]).add("item", "long")
    for column in [*[h for h in _NAMES if h != "description"], "description"]:
        out = out.add(column, "string")
    return page.mapInArrow(_items, out.add("confidence", "double")).withColumn("confidence", F.round("confidence", 4))
