"""License notices in documents: phrases found word by word, and an exact join of text blocks with notice templates.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case. A block is a window of ``2 * STRIDE`` words that begins at every ``STRIDE`` th
word, so any passage of up to ``STRIDE`` words, however its lines are broken, lies whole in one block; no template is longer. A block meets a template
when it holds at least ``percent`` of the template's distinct words (its need).

The join is a set-similarity join that loses no such pair:

* Only words of templates can be shared; the others come first in the order and are left out. A block with fewer words than the least need is none.
* Words are ordered by the number of blocks they occur in over the whole corpus, rare ones first, and sets are sorted by that order.
* Prefix: sets that share ``need`` words share one among the first ``size - need + 1`` of each, so only those are joined on.
* Length: a block smaller than the need can't meet it. Position: the words after the first shared one must suffice for the rest.
* What is left is checked with whole sets.

Equal blocks are one row of the join, so a notice in a third of all documents is joined once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from facadelake.llm.common import flat, pieces, written
from facadelake.llm.shingles import word_hashes, word_spans

STRIDE = 32
PERCENT = 90
# Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Sentences by which public licenses are granted or named.
TEMPLATES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "apache-2": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's begin (one more entry than texts)."""
    data, offsets = flat(texts)
    begins, ends = word_spans(data, offsets, _SEPARATOR)
    return word_hashes(data, begins, ends), np.searchsorted(begins, offsets)


def places(words: np.ndarray, owner: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after the other in one text."""
    k = len(phrase)
    at = np.flatnonzero(words[: max(0, len(words) - k + 1)] == phrase[0])
    for j in range(1, k):
        at = at[words[at + j] == phrase[j]]
    return at[owner[at] == owner[at + k - 1]]


def blocks_of(words: np.ndarray, bounds: np.ndarray, owner: np.ndarray, vocabulary: np.ndarray, least: int, stride: int) -> list[list[np.ndarray]]:
    """Per text its blocks with at least ``least`` distinct words of the sorted ``vocabulary``, each a sorted array of places in it."""
    token = np.searchsorted(vocabulary, words)
    token[token == len(vocabulary)] = 0
    hit = np.flatnonzero(vocabulary[token] == words)
    text, token, window = owner[hit], token[hit], (hit - bounds[owner[hit]]) // stride
    # Windows are numbered through: text i's begin after those of the texts before it.
    first = np.concatenate([[0], np.cumsum(np.diff(bounds) // stride + 1)])
    window = first[text] + window
    earlier = window > first[text]
    window, token = np.concatenate([window, window[earlier] - 1]), np.concatenate([token, token[earlier]])
    cells = np.unique(window * len(vocabulary) + token)
    window, token = cells // len(vocabulary), (cells % len(vocabulary)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(window, prepend=-1))
    sizes = np.diff(cuts, append=len(window))
    out: list[list[np.ndarray]] = [[] for _ in range(len(bounds) - 1)]
    for at, n in zip(cuts[sizes >= least], sizes[sizes >= least]):
        out[np.searchsorted(first, window[at], "right") - 1].append(token[at : at + n])
    return out


def scanned(docs: DataFrame, phrases: Mapping[str, str], vocabulary: np.ndarray, least: int, stride: int) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base`` and ``blocks``; one pass over the texts."""
    ddl = "row long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<array<int>>"
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL(ddl)])
    arrow = to_arrow_schema(schema)
    wanted = [(label, words_of(pa.array([phrase]))[0]) for phrase, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, bounds = words_of(batch.column("text"))
            n = batch.num_rows
            owner = np.repeat(np.arange(n), np.diff(bounds))
            base: list[set] = [set() for _ in range(n)]
            counts, first, last = np.zeros(n, np.int64), np.full(n, 1 << 60), np.full(n, -1)
            for label, phrase in wanted:
                at = places(words, owner, phrase)
                np.add.at(counts, owner[at], 1)
                np.minimum.at(first, owner[at], at - bounds[owner[at]])
                np.maximum.at(last, owner[at], at - bounds[owner[at]])
                for i in np.unique(owner[at]):
                    base[i].add(label)
            blocks = blocks_of(words, bounds, owner, vocabulary, least, stride)
            none = counts == 0
            columns = [
                batch.column("doc_id"), batch.column("row"), np.diff(bounds), counts, pa.array(first, mask=none), pa.array(last, mask=none),
                [sorted(x) for x in base], [[b.tolist() for b in x] for x in blocks],
            ]
            yield pa.record_batch([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    # The numbers of rows are only of use once written: a row computed anew could get another one.
    return written(rows.mapInArrow(run, schema), "license-blocks")


def matched(blocks: DataFrame, templates: Sequence[tuple[str, list[int], int]]) -> DataFrame:
    """``(block, label, score)``: every pair of a block and a template that share at least the template's need, by prefix, length and position.

    ``blocks (block, n)`` are distinct sets of word numbers and how often they occur; ``templates`` are label, word numbers and need.
    """
    spark = blocks.sparkSession
    # One number per template word: as many as the templates have, however large the corpus.
    seen = {r["w"]: r["n"] for r in blocks.select(F.explode("block").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    every = sorted({w for _, ws, _ in templates for w in ws}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(every)}
    postings = []
    for t, (label, ws, need) in enumerate(templates):
        ordered = sorted(rank[w] for w in ws)
        postings += [(r, t, label, ordered, i, need) for i, r in enumerate(ordered[: len(ordered) - need + 1])]
    index = F.broadcast(spark.createDataFrame(postings, "word int, t int, label string, words array<int>, i int, need int"))  # templates only
    order = F.array(*[F.lit(rank[w]) for w in range(len(every))])
    least = min(need for *_, need in templates)
    sets = blocks.select("block", F.sort_array(F.transform("block", lambda w: order[w])).alias("set")).withColumn("size", F.size("set"))
    prefixes = sets.select("block", "set", "size", F.posexplode(F.slice("set", F.lit(1), F.greatest(F.col("size") - least + 1, F.lit(0)))).alias("j", "word"))
    near = prefixes.join(index, "word").where("size >= need AND j <= size - need AND 1 + least(size(words) - i - 1, size - j - 1) >= need")
    shared = F.size(F.array_intersect("set", "words"))
    pairs = near.withColumn("shared", shared).where("shared >= need")
    return pairs.groupBy("block", "label").agg(F.max(F.col("shared") / F.size("words")).alias("score"))


def scan_licenses(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, percent: int = PERCENT, stride: int = STRIDE) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are their smallest and largest start (null without one).
    ``labels`` are those of the phrases and of the templates that a block meets; ``score`` is 1 with a phrase, else the largest share of a
    template's words in a block that meets it, else 0. A template has ``stride`` words at most and one at least.

    A null text is empty: no words, no labels. Repeated rows and rows without ``doc_id`` have rows of their own. Very long texts are cut into blocks
    without a bound on their number. Other columns are not read. An empty table gives an empty result.
    """
    texts = [(label, words_of(pa.array([text]))[0]) for label, some in templates.items() for text in some]
    if any(not 0 < len(words) <= stride for _, words in texts):
        raise ValueError(f"a template has between 1 and {stride} words")
    vocabulary = np.unique(np.concatenate([words for _, words in texts]))
    sets = [(label, np.unique(np.searchsorted(vocabulary, words)).tolist()) for label, words in texts]
    known = [(label, ws, -(-percent * len(ws) // 100)) for label, ws in sets]
    rows = scanned(docs, phrases, vocabulary, min(need for *_, need in known), stride)
    held = rows.select("row", F.explode("blocks").alias("block"))
    distinct = written(held.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "license-sets")
    found = matched(distinct, known)
    per_row = held.join(found, "block").groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    out = rows.drop("blocks").join(per_row, "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score")
    )
