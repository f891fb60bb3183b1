"""Pages with two heading bands, uneven lines, continued items, and ends with and without a summary."""

import random
import re

import numpy as np
import pyarrow as pa

from ledgerspark.operators import line_tables

BOX = "struct<left:double,top:double,right:double,bottom:double,cx:double,cy:double,height:double>"
SCHEMA = f"document_id bigint, page_number int, page_width double, page_height double, block bigint, text string, confidence double, box {BOX}"


def block(doc, n, text, x0, y0, x1, y1, confidence=0.9, page=(1000.0, 1000.0)):
    x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
    return doc, 1, *page, n, text, confidence, (x0, y0, x1, y1, (x0 + x1) / 2, (y0 + y1) / 2, y1 - y0)


def page(doc=1, **more):
    top = [("Quantity", 10, 10, 80, 20), ("Price", 200, 10, 260, 20), ("Vat", 400, 10, 440, 20), ("Amount", 600, 10, 660, 20)]  # above 5 %: more columns, but no table
    decoy = [("Pos", 10, 100, 40, 110), ("Qty", 500, 100, 530, 110)]
    head = [("No.", 10, 200, 40, 212), ("Item Description", 100, 205, 260, 217), ("Qty", 500, 200, 540, 212), ("Net", 700, 196, 730, 208), ("Worth", 735, 206, 790, 216)]
    body = [
        ("1", 12, 240, 20, 250), ("Steel", 100, 243, 140, 253), ("bolt", 150, 236, 180, 246), ("12", 505, 239, 520, 251), ("100.00", 705, 241, 760, 251),
        ("long version", 102, 262, 200, 272), ("with", 300, 282, 330, 292), ("nuts", 335, 282, 365, 292),
        ("Tall cell", 100, 310, 180, 340), ("3", 505, 312, 512, 320), ("7.50", 705, 329, 740, 339),
        ("", 100, 350, 120, 360), ("Item 9", 20, 370, 60, 380),
    ]
    return [block(doc, i, *b, **more) for i, b in enumerate(top + decoy + head + body)]


def items(spark, rows):
    got = line_tables.line_items(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted((r["document_id"], r["item"], r["item_number"], r["description"], r["quantity"], r["net_amount"], r["confidence"]) for r in got.collect())


def test_items_of_a_page(spark):
    rows = page() + [block(1, 50, "Subtotal", 100, 420, 160, 430), block(1, 51, "2", 505, 440, 515, 450)]
    assert items(spark, rows) == [
        (1, 1, "1", "Steel bolt long version with nuts", "12", "100.00", 0.9), (1, 2, None, "Tall cell", "3", "7.50", 0.9), (1, 3, "Item 9", "", None, None, 0.9)]


def test_without_a_summary_the_table_ends_at_95_percent(spark):
    rows = page() + [block(1, 60, "4", 505, 935, 515, 945), block(1, 61, "5", 505, 945, 515, 960)]
    got = items(spark, rows)
    assert [g[4] for g in got] == ["12", "3", None, "4"]


def test_bands_columns_and_ends(spark):
    df = spark.createDataFrame(page(), SCHEMA)
    bands = line_tables.heading_bands(df)
    assert {r["block"] for r in bands.collect()} == {6, 7, 8, 9}
    columns = {r["name"]: (r["place"], r["x_min"], r["x_max"]) for r in line_tables.column_ranges(bands).collect()}
    # "Worth" alone is no heading; the description stops two short of the next column
    assert columns == {"item_number": (1, 0.0, 70.0), "description": (2, 70.0, 380.0), "quantity": (3, 380.0, 620.0), "net_amount": (4, 620.0, 1000.0)}
    region = line_tables.table_regions(df, line_tables.column_ranges(bands)).first()
    assert region["heading_bottom"] == 232.0 and region["table_end"] == 950.0


def test_pages_without_table_sizes_or_blocks(spark):
    lone = [block(2, 1, "Qty", 10, 200, 40, 210), block(2, 2, "5", 10, 240, 20, 250)]
    far = [block(3, 1, "Qty", 10, 200, 40, 210), block(3, 2, "Amount", 10, 300, 40, 310), block(3, 3, "5", 10, 340, 20, 350)]
    unsized = page(4, page=(None, 0.0))
    null = [block(5, 1, None, 10, 200, 40, 210)]
    got = items(spark, lone + far + unsized + null)
    assert {g[0] for g in got} == {4} and len(got) == 3
    assert items(spark, []) == []


def test_lines_follow_overlap_and_mean(spark):
    # each block is 9 below the one before: near the last, but too far from the line's mean after a while
    rows = [block(1, i, "x", 10.0 * i, 9.0 * i, 10.0 * i + 5, 9.0 * i + 8) for i in range(8)]
    lines = {r["block"]: r["line"] for r in line_tables.row_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    mean, n, want, line = None, 0, {}, 0
    top = bottom = 0.0
    for i in range(8):
        cy, y0, y1 = 9.0 * i + 4, 9.0 * i, 9.0 * i + 8
        high = max(bottom - top, 8, 10.0)
        if n and (min(bottom, y1) - max(top, y0) > 0.3 * high or abs(cy - mean) <= max(14, 0.65 * high)):
            mean, n, top, bottom = (mean * n + cy) / (n + 1), n + 1, min(top, y0), max(bottom, y1)
        else:
            line += n > 0
            mean, n, top, bottom = cy, 1, y0, y1
        want[i] = line
    assert lines == want and len(set(want.values())) > 1


def test_bands_and_columns_of_many_pages_equal_the_expressions(spark):
    rng = random.Random(8)
    names = ["No.", "Item Description", "Qty", "Net Worth", "VAT", "Unit Price", "Total", "Rate"]
    rows = [block(doc, i, rng.choice(names), x := rng.randint(0, 900), y := rng.randint(5, 30) * 10, x + rng.randint(5, 120), y + 10, page=(rng.choice([1000.0, 1000.0, 800.0]), 1000.0)) for doc in range(60) for i in range(rng.randint(0, 14))]
    bands = line_tables.heading_bands(spark.createDataFrame(rows, SCHEMA)).cache()
    want = sorted((r["document_id"], r["place"], r["name"], r["x_min"], r["x_max"], r["heading_bottom"] - 15) for r in line_tables.column_ranges(bands).collect())
    known = {line_tables._NAMES[i]: i for i in range(len(line_tables._NAMES))}
    column = {r["t"]: r["n"] for r in spark.createDataFrame([(n.upper(),) for n in names], "t string").select("t", line_tables.heading_name(line_tables.F.col("t")).alias("n")).collect()}
    heads = [r for r in rows if r[7][1] > 50]
    b = {c: np.array([r[7][i] for r in heads]) for i, c in enumerate(["left", "top", "right", "bottom", "cx", "cy"])}
    b |= {"page": np.array([r[0] for r in heads]), "block": np.array([r[4] for r in heads]), "name": np.array([known[column[r[5].upper()]] for r in heads]), "width": np.array([r[2] for r in heads]), "height": np.array([r[3] for r in heads])}
    banded = line_tables._band(b["page"], b["cy"], b["name"], 60)
    assert {(r[0], r[4]) for r, x in zip(heads, banded) if x} == {(r["document_id"], r["block"]) for r in bands.collect()}
    c = line_tables._ranges(b, np.flatnonzero(banded))
    page, at = c["page"].tolist(), {}
    got = [(p, at.setdefault(p, []).append(i) or len(at[p]), line_tables._NAMES[c["name"][i]], c["x_min"][i], c["x_max"][i], max(c["bottom"][c["page"] == p])) for i, p in enumerate(page)]
    assert sorted(got) == want and len(want) > 100


def test_pages_are_not_cut(monkeypatch):
    sizes = [3, 1, 9, 2, 2, 20, 1]
    rows = [(p, i + 1) for p, n in enumerate(sizes) for i in range(n)]
    batches = [pa.RecordBatch.from_pydict({"p": [r[0] for r in rows[a : a + 4]], "_i": [r[1] for r in rows[a : a + 4]]}) for a in range(0, len(rows), 4)]
    for limit in (1, 5, 12, 1000):
        monkeypatch.setattr(line_tables, "BLOCKS_AT_ONCE", limit)
        tables = [list(zip(t["p"].to_pylist(), t["_i"].to_pylist())) for t in line_tables._whole_pages(batches)]
        assert sum(tables, []) == rows and all(t[0][1] == 1 for t in tables)


def test_line_items_gather_no_lists(spark):
    # every block was a structure in three lists of its page, and every step a function called for each of them
    plan = line_tables.line_items(spark.createDataFrame(page(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_headings_and_ends_are_more_than_numbers():
    assert all(re.search("[^0-9.,]", w) for w in [*line_tables.SUMMARY, *(h for names in line_tables.HEADINGS.values() for h in names)])
