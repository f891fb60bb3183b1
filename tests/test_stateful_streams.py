"""Streams end in what the batch forms give: ingestion by outcomes, sessions with pending offers."""

import datetime

from pyspark.sql import functions as F

from ledgerspark.operators.conversation import stands_alone
from ledgerspark.streaming import ingestion, sessions

RESULTS = "id bigint, document_id bigint, created_at timestamp, full_text string"


def day(n):
    return datetime.datetime(2024, 1, n)


def cut(text):
    if "poison" in text:
        raise ValueError("can't read this")
    return [{"page_number": 1, "chunk_type": "GENERAL", "section": "OTHER", "content": line} for line in text.split("\n") if line.strip("- ")]


DATA = [
    (1, 1, day(1), "a\nb\nc"), (2, 1, day(3), "d"), (3, 2, day(1), "a\npoison"), (4, 3, day(1), "gone"), (5, 4, day(1), "unknown"), (6, 5, day(1), "  \n\t"),
    (7, 6, day(1), "---"), (8, 7, day(1), "kept\nlines"), (9, 7, day(2), "poison again"), (10, 8, day(1), "kept too"), (11, 8, day(2), None), (12, 1, day(2), "late\nand\nmany\nlines"),
    (13, 9, day(1), "same"), (14, 9, day(2), "same"), (15, 10, day(4), "x\ny"), (16, 10, day(4), "z"), (17, None, day(1), "nobody's"),
]


def documents(spark):
    return spark.createDataFrame([(i, i == 3) for i in range(1, 11) if i != 4], "id bigint, is_deleted boolean")


def state(ingestor):
    status = {r["document_id"]: (r["result_id"], r["status"], r["reason"], r["held_id"] if r["document_id"] != 9 else None, r["chunk_count"]) for r in ingestor.status.read().collect()}
    chunks = sorted((r["document_id"], r["chunk"], r["content"]) for r in ingestor.chunks.read().collect())
    return status, chunks


def test_a_replayed_and_reordered_stream_ends_like_one_batch(spark, tmp_path):
    whole = ingestion.Ingestor(spark, f"{tmp_path}/whole", documents(spark), ingestion.guarded(cut), 3)
    whole.apply(spark.createDataFrame(DATA, RESULTS))
    status, chunks = state(whole)
    assert status == {
        1: (2, "success", None, 2, 1), 2: (3, "failed", "can't read this", None, 0), 3: (4, "skipped", "soft_deleted", None, 0), 4: (5, "skipped", "not_found", None, 0),
        5: (6, "skipped", "no_ocr_text", None, 0), 6: (7, "skipped", "zero_chunks", None, 0), 7: (9, "failed", "can't read this", 8, 2), 8: (11, "skipped", "no_ocr_text", 10, 1),
        9: (14, "success", None, None, 1), 10: (16, "success", None, 16, 1),
    }
    assert chunks == [(1, 0, "d"), (7, 0, "kept"), (7, 1, "lines"), (8, 0, "kept too"), (9, 0, "same"), (10, 0, "z")]
    assert {(r["status"], r["reason"]): r["documents"] for r in whole.outcomes().collect()}[("failed", "can't read this")] == 2
    spark.createDataFrame(DATA[::-1], RESULTS).repartition(6, "id").write.parquet(f"{tmp_path}/in")
    parts = ingestion.Ingestor(spark, f"{tmp_path}/parts", documents(spark), ingestion.guarded(cut), 3)
    stream = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    for attempt in range(2):  # the second start reads all again under the same numbers
        parts.start(stream, f"{tmp_path}/checkpoint{attempt}").awaitTermination(300)
    assert state(parts) == (status, chunks)
    version = parts.status.version()
    parts.apply(spark.createDataFrame(DATA, RESULTS), ("stream", 0))
    assert parts.status.version() == version


def test_equal_texts_are_not_cut_again_and_pages_are(spark, tmp_path):
    at = ingestion.Ingestor(spark, str(tmp_path), documents(spark), buckets=2)
    page = "--- PAGE 1 ---\nOrder 1\n\n| No | Item |\n|---|---|\n| 1 | a |\n\n--- PAGE 2 ---\nTotal 5"
    at.apply(spark.createDataFrame([(1, 1, day(1), page)], RESULTS))
    first = state(at)
    assert len(first[1]) > 1
    version = at.chunks.version()
    at.apply(spark.createDataFrame([(2, 1, day(2), page)], RESULTS))
    assert at.chunks._current()["holds"] == at.chunks._manifest(version)["holds"] and state(at)[1] == first[1]
    assert at.status.read().first()["result_id"] == 2


TURNS = "session bigint, turn bigint, at timestamp, role string, text string"
ASK = "Would you like me to check for shipping costs?"


def script():
    says = {
        1: [("user", "yes"), ("assistant", ASK), ("user", "Yes please"), ("user", "yes"), ("assistant", "Should I verify the payment terms?"), ("user", "no"), ("user", "ok")],
        2: [("user", "hello"), ("assistant", ASK), ("user", "what is the total amount of this invoice"), ("user", "sure"), ("assistant", "Done."), ("user", "sure")],
        3: [("user", "hi there"), ("assistant", ASK), ("clear", None), ("user", "yes"), ("assistant", "I can look."), ("user", "yes"), ("user", "what about the second one")],
        4: [("user", "a"), ("assistant", ASK), ("user", None), ("user", "  go ahead  "), (None, "?"), ("user", "list all invoices of the vendor")],
    }
    rows = []
    for s, turns in says.items():
        for i, (role, text) in enumerate(turns):
            rows.append((s, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=10 * i), role, text))
    rows += [(5, 0, datetime.datetime(2024, 1, 1), "assistant", ASK), (5, 1, datetime.datetime(2024, 1, 1, 0, 2), "user", "yes")]  # too late
    return rows


def test_offers_are_answered_replaced_cleared_and_expire(spark, monkeypatch):
    want = {}
    for block in (4096, 2):
        monkeypatch.setattr(sessions, "BLOCK_TURNS", block)
        got = {(r["session"], r["turn"]): (r["action"], r["request"]) for r in sessions.resolve_table(sessions.marked(spark.createDataFrame(script(), TURNS)), 60).collect()}
        assert not want or got == want
        want = got
    check = "Check the document for shipping costs."
    assert got[1, 0] == ("none", "yes") and got[1, 2] == ("confirmation_affirmative", check)
    assert got[1, 3][0] == "confirmation_affirmative" and "checking the details" in got[1, 3][1]  # the offer is used up, the answer still speaks of checking
    assert got[1, 5] == ("confirmation_negative", sessions.DECLINED)
    assert got[2, 2] == ("reference", "what is the total amount of this invoice") and got[2, 3] == ("confirmation_affirmative", check) and got[2, 5][0] == "reference"
    assert got[3, 3] == ("none", "yes") and got[3, 5][1].startswith("Proceed with checking") and got[3, 6][0] == "reference"
    assert got[4, 3] == ("confirmation_affirmative", check) and got[4, 5] == ("none", "list all invoices of the vendor")
    assert got[5, 1][1].startswith("Proceed")
    monkeypatch.undo()


def test_the_stream_gives_the_table_in_any_order(spark, tmp_path):
    # a turn of session 6 never comes; a later session moves the watermark on, so that the wait ends
    gap = [(6, 0, datetime.datetime(2024, 1, 1), "assistant", ASK), (6, 2, datetime.datetime(2024, 1, 1, 0, 0, 20), "user", "yes"), (6, 3, datetime.datetime(2024, 1, 1, 0, 0, 30), "user", "no")]
    rows = script() + gap
    for i, part in enumerate([rows[1::3], rows[::3], rows[2::3] + rows[::3], [(9, 0, datetime.datetime(2024, 3, 1), "user", "late")], [(9, 1, datetime.datetime(2024, 3, 2), "user", "later")]]):
        spark.createDataFrame(part, TURNS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")
    out = sessions.resolve_stream(sessions.marked(stream), 60)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    table = sorted(map(tuple, sessions.resolve_table(sessions.marked(spark.createDataFrame(rows, TURNS)), 60).collect()))
    assert [r for r in got if r[0] != 9] == table
    assert len(got) == len(set(got))


def test_words_end_at_letters_beyond_a_to_z(spark):
    """As in the SQL of session_offers, a word is a run of a to z, digits and apostrophes."""
    texts = ["Yesñadoes asque rata invoice.", "en ñdoció osque noñrrezar", "yesterday ñ osque rata"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(stands_alone(F.col("t"))).collect()
    assert [r[0] for r in got] == [False, False, True]
