import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, score string, cls string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus() -> list[tuple]:
    """Clean, junk, toxic, copied, near-copied, empty, null and very long texts; nulls in every column; clashing extra columns."""
    rng = random.Random(5)
    rows = []

    def add(text, source="a", lang="en", doc_id="next"):
        rows.append((len(rows) if doc_id == "next" else doc_id, text, lang, source, None if text is None else len(text), 1, "x", None))

    for _ in range(60):
        add(prose(rng, rng.randint(60, 200)), rng.choice("aaab"))
    base = prose(rng, 150).split()
    for k in range(12):
        w = list(base)
        w[5 + 10 * k] = "changed"
        add(" ".join(w))
    for _ in range(5):
        add(rows[3][1])
    for _ in range(20):
        add(" ".join(f"{w}###" for w in prose(rng, 60).split()), "junk")
    for _ in range(20):
        add(prose(rng, 40) + " idiot moron " + prose(rng, 40) + " Trash")
    add("License: All Rights Reserved. Licensed under CC BY-NC 4.0.")
    add("Released under the MIT License. general public license")
    add(None)
    add("")
    add(" \n\t ")
    add("three little words")
    add("THREE little   words")
    add("é" * 40 + " ünï 中文 text")
    add("long " * 60_000)
    add(prose(rng, 80), None, None)
    add(prose(rng, 90), doc_id=None)
    rows.append(rows[0])
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int("###" not in (r[1] or "")), int("idiot" in (r[1] or ""))) for i, r in enumerate(corpus()[:117])]
    return spark.createDataFrame([*rows, (None, 1, 1), (1, None, None), (2, 7, 7)], "doc_id bigint, quality int, toxic int")
