"""Operator 8, licence scan with a positional rare-token index; DataFrame functions only.

The words of licence notices (templates) are indexed with their positions. Of each template the
words of its key phrase with the highest inverse document frequency are looked up first; where all of
them stand in a file at the distances that the template gives them, the file and template meet at one
relative position, and there all indexed words are compared: the words of the template's key phrase
must all be in place, and the share of matched words, weighted by their frequencies, must be high
enough. As the words looked up first are among those that must be in place, no match is missed,
however many notices a file holds. A file's indexed words stay together: around each occurrence of a
template's rarest word, as many of them as the longest template reaches are compared where they are
read, and only what matched is dealt out by file.

Document frequencies are counted over all documents; only a number for each word of the templates
comes to the driver. Defined cases: null texts count as empty and have no words, places or labels;
null ids are scanned like others; repeated rows are rows of their own; other columns are ignored; no
rows give no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Scratch

#: (label, key phrase, notice): fixed wordings of public licences' notices.
TEMPLATES = [
    ("apache-2.0", "apache license", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "apache license", "you may not use this file except in compliance with the License distributed under the Apache License"),
    ("mit", "mit license", "Released under the MIT License"),
    ("mit", "mit license", "Licensed under the MIT License"),
    ("mit", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "general public license version 3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "general public license version 2", "This program is licensed under the GNU General Public License, version 2"),
    ("gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "cc by 4 0", "Licensed under CC BY 4.0"),
    ("cc0", "public domain", "To the extent possible under law the author has dedicated this work to the public domain"),
    ("mpl-2.0", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("lgpl-2.1", "gnu lesser general public license", "you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "gnu affero general public license", "you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("isc", "permission to use copy modify and or distribute this software", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-3-clause", "neither the name of the copyright holder", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("epl-2.0", "eclipse public license", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "free and unencumbered software", "This is free and unencumbered software released into the public domain"),
    ("bsl-1.0", "boost software license", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib", "altered source versions must be plainly marked", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("ofl-1.1", "sil open font license", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("artistic-2.0", "artistic license", "you can redistribute it and or modify it under the terms of the Artistic License 2.0"),
    ("cddl-1.0", "common development and distribution license", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "Licensed under CC BY-ND 4.0"),
]
#: (phrase, label): the base phrases.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
MIN_INDEX_LETTERS = 5
RARE_WORDS = 6
MIN_SHARE = 0.7
#: Indexed words of a file that are compared at a time.
BLOCK_HITS = 256
_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def build_index(templates: list[tuple[str, str, str]]) -> list[tuple[str, int, str, int, bool]]:
    """(word, template, label, position, mandatory): longer words, and those of the key phrase."""
    rows = []
    for t, (label, key, text) in enumerate(templates):
        words, phrase = template_words(text), template_words(key)
        at = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        must = set(range(at[0], at[0] + len(phrase))) if at else set()
        if not must:
            # a key phrase outside the notice's own words: every indexed word must match
            must = {i for i, w in enumerate(words) if len(w) >= MIN_INDEX_LETTERS}
        rows += [(w, t, label, i, i in must) for i, w in enumerate(words) if len(w) >= MIN_INDEX_LETTERS or i in must]
    return rows


def scan_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """documents -> (row, doc_id, n_words, base array<struct<label, at>>, hits array<struct<w, at>>)."""
    any_phrase = "(?i)" + "|".join((_SEP + "+").join(p.split()) for p, _ in PHRASES)
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    tokens = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low = F.filter(
        F.transform(F.col("words"), lambda w, i: F.struct(F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("w"), i.alias("at"))),
        lambda x: x["w"].isin(vocabulary),
    )
    found = tokens.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"), F.col("text").rlike(any_phrase).alias("some"),
    ).select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "some", low.alias("hits"))
    places = [phrase_places(p.split(), label) for p, label in PHRASES]
    none = F.array().cast("array<struct<label:string,at:bigint>>")
    return found.select("row", "doc_id", "n_words", F.when(F.col("some"), F.concat(*places)).otherwise(none).alias("base"), "hits")


def phrase_places(phrase: list[str], label: str):
    """Places of a phrase: its words are all in the vocabulary, so they are neighbours among the hits too."""

    def stands(x, i):
        out = x["w"] == phrase[0]
        for k, w in list(enumerate(phrase))[1:]:
            y = F.get("hits", i + k)
            out = out & (y["w"] == w) & (y["at"] == x["at"] + k)
        return out

    return F.transform(F.filter("hits", stands), lambda x: F.struct(F.lit(label).alias("label"), x["at"].cast("long").alias("at")))


def license_scan(docs: DataFrame, templates=TEMPLATES, rare_words: int = RARE_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """-> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "license-scan")
    index = build_index(templates)
    vocabulary = sorted({w for w, *_ in index} | {w for p, _ in PHRASES for w in p.split()})
    scanned = scratch.keep(scan_words(docs, vocabulary))
    total = scanned.count()
    seen = scanned.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    df = {r["w"]: r["n"] for r in seen.collect()}  # at most a number for each word of the vocabulary
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
    held: dict[int, list[tuple[str, str, int, bool]]] = {}
    for w, t, label, i, m in index:
        held.setdefault(t, []).append((w, label, i, m))
    # fixed by the templates, whatever the corpus: one row for each, broadcast
    rows, reach = [], 0
    for t, words in held.items():
        weight = sum(idf[w] for w, *_ in words)
        # the rarest places that the template needs anyway: a file without them all cannot match it
        first = sorted((-idf[w], w, i) for w, _, i, m in words if m)[:max(rare_words, 1)]
        if not first:
            continue
        _, word, at = first[0]
        reach = max(reach, *(abs(i - at) for _, _, i, _ in words))
        rows.append((word, t, words[0][1], at, [(w, i) for _, w, i in first], [(w, i, m, idf[w] / weight) for w, _, i, m in words]))
    postings = F.broadcast(spark.createDataFrame(
        rows, "w string, template int, label string, place int, rare array<struct<w:string,place:int>>, places array<struct<w:string,place:int,must:boolean,part:double>>"))
    starts = sorted({w for w, *_ in rows})
    # places grow by one at least from hit to hit, so all within reach of a hit are among so many neighbours; a long
    # file's hits are cut into blocks with that much on both sides, so that no row holds the neighbours of all
    size = F.greatest(F.size("hits") - 1, F.lit(0))
    cut = lambda i, n: F.slice("hits", F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach)) + n + reach)
    blocks = scanned.where(F.size("hits") > 0).select("row", F.explode(F.transform(
        F.sequence(F.lit(0), size, F.lit(BLOCK_HITS)), lambda b: F.struct(cut(b, BLOCK_HITS).alias("hits"), F.least(b, F.lit(reach)).alias("lead")))).alias("x")).select("row", "x.*")
    start = lambda x, i: x["w"].isin(starts) & (i >= F.col("lead")) & (i < F.col("lead") + BLOCK_HITS)
    around = F.transform("hits", lambda x, i: F.when(start(x, i), F.struct(x["w"].alias("w"), x["at"].alias("at"), cut(i, 1).alias("near"))))
    met = blocks.select("row", F.explode(F.filter(around, lambda x: x.isNotNull())).alias("x")).select("row", "x.*")
    stands = lambda p: F.array_contains("near", F.struct(p["w"].alias("w"), (F.col("shift") + p["place"]).alias("at")))
    found = met.join(postings, "w").withColumn("shift", F.col("at") - F.col("place")).where(F.forall("rare", stands))
    found = found.select("row", "label", "places", F.filter("places", stands).alias("found"))
    musts = lambda c: F.size(F.filter(c, lambda p: p["must"]))
    share = F.aggregate("found", F.lit(0.0), lambda total, p: total + p["part"])
    judged = found.where(musts("found") == musts("places")).select("row", "label", share.alias("share")).where(F.col("share") >= min_share)
    by_row = judged.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    ends = F.transform("base", lambda x: x["at"])
    none = F.array().cast("array<string>")
    return scanned.select("row", "doc_id", "n_words", "base").join(by_row, "row", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(ends).alias("first_word"), F.array_max(ends).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", none))), ",").alias("labels"),
        F.round(F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)), 9).alias("score"),
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
