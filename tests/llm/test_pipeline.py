import pytest

import corpus_pipeline
from ledgerspark.llm import ngram_join, quality_classifier, toxicity

from .conftest import corpus

NAMES = ["quality classifier", "toxicity", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_filter_and_keep_columns(spark, docs, labels, tmp_path):
    sf = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = now.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/{i}")
        after = spark.read.parquet(f"{sf}/{i}")
        stages.append((now, after))
        now = after
        assert i == 4 or now.columns == columns
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    # each stage's decision, taken anew over its own input
    scored = quality_classifier.quality_scores(stages[0][0], labels, ["doc_id"]).collect()
    assert ids(stages[0][1]) == sorted((r["doc_id"] for r in scored if r["score"] >= 0.3), key=str)
    scored = toxicity.toxicity_scores(stages[1][0], labels, ["doc_id"]).collect()
    assert ids(stages[1][1]) == sorted((r["doc_id"] for r in scored if r["score"] < 0.3), key=str)
    joined = ngram_join.ngram_join(stages[2][0]).collect()
    stay = {r["doc_id"] for r in joined if r["doc_id"] in (None, r["component_id"])}
    assert set(ids(stages[2][1])) == stay
    # the clean tokens of the mixture's input stay, and nothing comes in
    assert set(ids(stages[3][1])) <= set(ids(stages[3][0])) and stages[3][1].count() > 0.8 * stages[3][0].count()
    assert set(ids(stages[4][1])) == set(ids(stages[3][1]))
    assert corpus_pipeline.run(spark, sf).count() == stages[4][1].count()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3 + [(1, "", "en", "a", 0), (1, "", "en", "a", 0)]])
def test_empty_null_and_repeated_rows(spark, tmp_path, rows):
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    # without labels nothing is rejected; of the repeated row one stays
    assert sorted((r["doc_id"] for r in got), key=str) == ([] if not rows else [1, None, None, None])


def test_columns_of_any_name_are_handed_on(spark, labels, tmp_path):
    sf = str(tmp_path)
    extra = ["score", "rate", "tokens", "cell", "component_id", "stays", "n"]
    rows = [(i, t, None, "s", 1, *["mine"] * len(extra)) for i, t, *_ in corpus()[:30]]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in extra))
    labels.write.parquet(f"{sf}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        assert {r[c] for r in after.collect() for c in extra} == {"mine"}
