"""Document text to chunks and rows (C-01 to C-10, W-05)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.text import once

WINDOW, STEP, INTACT = 10, 8, 15
# Fixed value: the line that opens a page.
PAGE_MARK = r"(?m)^=== PAGE (\d+) ===$"
# Words that turn a summary into terms.
TERM_TRIGGERS = ["terms", "conditions", "payment terms", "warranty", "liability", "governing law", "jurisdiction", "penalty", "late fee", "incoterms", "bank details"]
# Column headings of line-item tables.
HEADINGS = {
    "item_number": ["item_number", "item no", "item #", "no.", "no_", "no", "sl no", "sr no", "pos", "pos.", "pos no", "item", "article", "art.", "sr.", "sl.", "#"],
    "description": ["description", "item description", "particulars", "product", "items", "designation", "bezeichnung", "artikel", "details", "product description", "specification", "service"],
    "quantity": ["qty", "quantity", "menge", "anzahl", "qty.", "menge (stk)", "count"],
    "unit": ["unit", "uom", "um", "einheit", "u/m", "measure", "unit of measure"],
    "unit_price": ["unit price", "net price", "price", "rate", "preis", "einzelpreis", "netto-preis", "unit cost", "price/unit", "price (net)", "rate/unit"],
    "net_amount": ["net amount", "net worth", "taxable amount", "taxable value", "betrag", "nettobetrag", "net", "total net", "base amount", "net price total", "amount"],
    "vat_rate": ["vat [%]", "vat[%]", "vat %", "vat%", "tax %", "tax%", "gst %", "gst%", "mwst", "mwst%", "mwst %", "vat rate", "tax rate", "rate %", "mwst. %", "vat", "mwst.", "tax rate %", "gst"],
    "gross_amount": ["gross amount", "gross worth", "total amount", "gross total", "line total", "gesamt", "bruttobetrag", "brutto", "gross", "total"],
}


def _strip(c: Column) -> Column:
    """White space of every kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """C-01: (…, page_number, page_text): a marker fills a line; text before the first one and blank pages go.

    Without a marker, or where every page is blank, the whole text is page 1; a blank text has no page.
    """
    numbers = F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1))
    parts = F.split(text, PAGE_MARK)
    zipped = F.filter(F.transform(numbers, lambda n, i: F.struct(n.cast("int").alias("page_number"), _strip(F.get(parts, i + 1)).alias("page_text"))), lambda p: p["page_text"] != "")
    one = F.array(F.struct(F.lit(1).alias("page_number"), _strip(F.col(text)).alias("page_text")))
    rows = docs.withColumn("_p", F.explode(once(zipped, lambda z: F.when(F.size(z) > 0, z).otherwise(one))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "_p.*").where("page_text <> ''")


def heading(cell: Column) -> Column:
    """F-08: a heading's column: exact, else the longest known heading inside it at word borders."""
    by_size = sorted(((name, column) for column, names in HEADINGS.items() for name in names), key=lambda x: -len(x[0]))
    exact: dict[str, str] = {}
    for name, column in by_size:
        exact.setdefault(name, column)
    names = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair])
    inner = [(f" {name} ", column) for name, column in by_size if len(name) >= 3]
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("column")) for n, c in inner])
    # one pattern tells whether any of them is there at all
    some = "|".join(re.escape(n) for n, _ in inner).replace(r"\ ", " ").replace(r"\%", "%").replace(r"\#", "#").replace(r"\/", "/")

    def found(clean: Column) -> Column:
        padded = F.concat(F.lit(" "), clean, F.lit(" "))
        inside = F.get(F.filter(table, lambda x: F.contains(padded, x["name"])), 0)["column"]
        return F.when(clean != "", F.coalesce(F.try_element_at(names, clean), F.when(padded.rlike(some), inside)))

    return once(F.trim(F.regexp_replace(F.regexp_replace(F.lower(cell), r"[^\w%#]", " "), r"\s+", " ")), found)


def markdown_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """C-07: (…, row_number, cells map<column, value>) of the first pipe table with at least three lines.

    The heading line names the columns; dividers go; cells under unknown headings add to the
    description; a missing item number is the row's number; rows without substance go.
    """
    table = F.regexp_extract(text, r"(?m)((?:^[ \t]*\|.*\|[ \t]*(?:\n|$)){3,})", 1)
    lines = F.filter(F.split(F.trim(table), r"\s*\n\s*"), lambda s: ~s.rlike(r"^[\s|:\-]+$"))
    cells = lambda s: F.transform(F.split(F.regexp_replace(s, r"^\s*\||\|\s*$", ""), r"\|"), _strip)
    d = docs.withColumn("_l", F.when(table != "", lines)).where("size(_l) > 1").withColumn("_h", F.transform(cells(F.col("_l")[0]), heading))
    d = d.select(*[F.col(f"`{c}`") for c in docs.columns], "_h", F.posexplode(F.slice("_l", 2, F.size("_l") - 1)).alias("_i", "_r"))
    pairs = F.arrays_zip(F.col("_h").alias("k"), cells(F.col("_r")).alias("v"))
    named = F.filter(pairs, lambda p: p["k"].isNotNull() & (p["v"] != ""))
    loose = F.array_join(F.transform(F.filter(pairs, lambda p: p["k"].isNull() & (p["v"] != "")), lambda p: p["v"]), " ")
    first = lambda k: F.get(F.filter(named, lambda p: p["k"] == k), 0)["v"]
    columns = {k: first(k) for k in HEADINGS}
    columns["description"] = F.nullif(F.trim(F.concat_ws(" ", first("description"), F.nullif(loose, F.lit("")))), F.lit(""))
    columns["item_number"] = F.coalesce(first("item_number"), (F.col("_i") + 1).cast("string"))
    out = d.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("_i") + 1).alias("row_number"), *[v.alias(k) for k, v in columns.items()])
    return out.where("description IS NOT NULL OR quantity IS NOT NULL OR net_amount IS NOT NULL OR gross_amount IS NOT NULL")


def windows(df: DataFrame, rows: str, window: int = WINDOW, step: int = STEP, intact: int = INTACT) -> DataFrame:
    """C-04, W-05: an array of table rows stays whole up to ``intact``, else windows that overlap; the last ends with the table."""
    n = F.size(rows)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + window < n))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(rows, s + 1, window).alias("part")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col(rows).alias("part")))
    return df.withColumn("_w", F.explode(F.when(n <= intact, whole).otherwise(cut))).select(
        *[F.col(f"`{c}`") for c in df.columns if c != rows], "_w.start", F.col("_w.part").alias(rows))


def sections(lines: DataFrame, keys: list[str], position: str, line: str = "line") -> DataFrame:
    """C-05: SUMMARY until a line has a trigger, TERMS from there on (array of lines per page, no shuffle by line)."""
    trigger = "(?i)" + "|".join(rf"\b{t}\b" for t in TERM_TRIGGERS)
    arr = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(position, line))).alias("_l"))  # the lines of one page
    at = F.array_position(F.transform("_l", lambda x: x[line].rlike(trigger)), True)
    tagged = F.transform("_l", lambda x, i: F.struct(x[position].alias(position), x[line].alias(line), F.when((at > 0) & (i + 1 >= at), "TERMS").otherwise("SUMMARY").alias("section")))
    return arr.select(*keys, F.inline(tagged))


def exploded_fields(results: DataFrame, fields: str = "fields") -> DataFrame:
    """C-08: a row for each field."""
    return results.select(*[c for c in results.columns if c != fields], F.explode(fields).alias("key", "field")).select("*", "field.*").drop("field")


def to_markdown(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """C-10: the ordered rows of a key as a Markdown table."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "|".join(" --- " for _ in columns) + "|\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), row.alias("row")))), lambda x: x["row"]), "\n")
    return df.groupBy(*keys).agg(F.concat(F.lit(head), body).alias("markdown"))
