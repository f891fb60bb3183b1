"""Queries over pages of blocks deal their rows out once, whatever their steps."""

import re

from pyspark.sql import functions as F

import __spark_entry__
from ledgerspark.functions.text import some_word
from ledgerspark.operators import line_tables, sections

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_continued_items_shuffles_the_lines_once(spark):
    assert exchanges(__spark_entry__.queries()["continued_items"](spark, SF)) == 1


def test_table_cells_and_labels_shuffle_the_lines_once(spark):
    for name in ("table_cells", "spatial_labels"):
        assert exchanges(__spark_entry__.queries()[name](spark, SF)) == 1, name


def test_some_word_finds_what_all_words_find():
    words = [h for names in line_tables.HEADINGS.values() for h in names]
    every, short = re.compile("|".join(map(re.escape, words))), re.compile(some_word(words))
    for t in [*words, "PART 12", "NOTHING", "9 DAYS NET", "FROM 7", "", "X#", "TOTA", "MW ST", "GST  %"]:
        assert bool(every.search(t)) == bool(short.search(t)), t


def test_rules_of_plain_pages_are_written_once(spark):
    # each rule stood in the expression wherever its result was used: some 20 times over all lines of a page
    text = sections.plain_chunks(F.col("page_text"))._jc.toString()
    assert text.count("---|") == 1 and len(text) < 12_000


def test_plain_pages_with_odd_lines(spark):
    rows = "\n".join(f"| {i} | x |" for i in range(20))
    pages = [f"Head\n|a|b|\n|===|===|\n{rows}\nTotal 5\nBAN\u212a DETAILS", "| lone |", "a\n\n  b\x0b", "Terms"]
    got = sections.chunks(spark.createDataFrame(list(enumerate(pages)), "id int, page_text string")).orderBy("id", "chunk").collect()
    kinds = [(r["id"], r["chunk_type"], r["content"].count("\n") + 1) for r in got]
    assert kinds == [(0, "HEADER", 1), (0, "LINE_ITEMS", 12), (0, "LINE_ITEMS", 12), (0, "LINE_ITEMS", 6), (0, "SUMMARY", 1), (0, "TERMS", 1), (1, "LINE_ITEMS", 1), (2, "SUMMARY", 2), (3, "TERMS", 1)]


def test_reconciled_documents_shuffle_no_rows_of_single_fields(spark):
    plan = __spark_entry__.queries()["reconciled_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(document_id#\w+, key#", plan)
    assert not any("Join [document_id" in x and "key#" in x for x in plan.splitlines())
