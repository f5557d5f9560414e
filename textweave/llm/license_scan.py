"""License scans by diagonal voting.

Words are runs of ``[0-9a-z]`` and all non-ASCII characters after lower-casing A-Z.  The rolling
hashes of all word k-grams of all texts are joined to the positions of the same k-grams in a fixed
set of template texts (a broadcast of a few thousand rows, its size set by the templates alone).
Each hit votes for the diagonal (document position - template position); votes are added up, diagonals
up to ``drift`` apart are merged, and the merged spans (or, where these fail, each diagonal alone) are verified: a second, independent hash of each
k-gram must agree, and the matched words must cover ``cover`` of the template and ``dense`` of the span.

The base scan counts the places where a phrase's words stand consecutively.

Edge cases: null text is empty (no words); rows are keyed by a 64-bit hash of id and text, so rows
with equal ids but different texts (null ids as well) keep their own results, and repeated rows get the
same one each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.llm.common import prepare

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as they are commonly written; lines and headers, with the words that identify them.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Licensed under the BSD 3-Clause License",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "all-rights-reserved": ["All rights reserved"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
K = 3
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_Q = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]
BATCH = 1 << 20


def _scan(texts: list[bytes], k: int) -> dict[str, np.ndarray]:
    """Word hashes and, for each text with k words, its rolling k-gram hashes (two of them)."""
    from textweave.llm.words import join_texts, mix, span_hashes, spans

    raw, at = join_texts([t.lower() for t in texts])
    starts, ends = spans(_WORD[raw])
    w = span_hashes(raw, starts, ends)
    first = np.searchsorted(starts, at)
    out = {"raw": raw, "starts": starts, "ends": ends, "hash": w, "first": first, "words": np.diff(first)}
    m = max(0, len(w) - k + 1)
    row = np.repeat(np.arange(len(texts)), out["words"])
    good = np.flatnonzero(row[:m] == row[k - 1 :]) if m else np.zeros(0, dtype=np.int64)
    for name, q in zip(("gram", "check"), _Q):
        h = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            h = h * q + (w[j : j + m] if name == "gram" else mix(w[j : j + m] + q))
        out[name] = mix(h)[good]
    out["row"], out["pos"] = row[good], good - first[:-1][row[good]]
    return out


def _places(scan: dict[str, np.ndarray], phrase: list[bytes]) -> np.ndarray:
    """Word numbers (over the batch) where the phrase begins; words are compared byte by byte."""
    from textweave.llm.words import span_hashes

    w, m = scan["hash"], len(scan["hash"]) - len(phrase) + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    ok = np.ones(m, dtype=bool)
    for j, x in enumerate(phrase):
        ok &= w[j : j + m] == span_hashes(np.frombuffer(x, dtype=np.uint8), np.array([0]), np.array([len(x)]))[0]
    row = np.repeat(np.arange(len(scan["words"])), scan["words"])
    at = np.flatnonzero(ok)
    at = at[row[at] == row[at + len(phrase) - 1]]
    raw, s, e = scan["raw"], scan["starts"], scan["ends"]
    return np.array([i for i in at.tolist() if all(raw[s[i + j] : e[i + j]].tobytes() == x for j, x in enumerate(phrase))], dtype=np.int64)


def template_grams(k: int = K, templates: dict[str, list[str]] | None = None) -> list[tuple[int, int, int, str, int, int]]:
    """(hash, check, template, label, position, words) of every k-gram of every template."""
    rows, n = [], 0
    for label, texts in (templates or TEMPLATES).items():
        for text in texts:
            s = _scan([text.encode()], k)
            rows += [(int(h), int(c), n, label, int(p), int(s["words"][0])) for h, c, p in zip(s["gram"].view(np.int64), s["check"].view(np.int64), s["pos"])]
            n += 1
    return rows


def _sliced(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= BATCH):
            n += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def base_scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, n_base, first_word, last_word, base) of every row; base lists labels."""
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            n_words, places, labels = [], [[] for _ in texts], [set() for _ in texts]
            for i, part in _sliced(texts):
                s = _scan(part, 1)
                n_words += s["words"].tolist()
                for phrase, label in phrases:
                    for at in _places(s, phrase).tolist():
                        r = int(np.searchsorted(s["first"], at, side="right")) - 1
                        places[i + r].append(at - int(s["first"][r]))
                        labels[i + r].add(label)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))],
                ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"row long, doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>")


def gram_rows(docs: DataFrame, k: int) -> DataFrame:
    """(row, pos, gram, check) of every k-gram of every text."""

    def grams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(0).to_numpy()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            for i, part in _sliced(texts):
                s = _scan(part, k)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + s["row"]]), pa.array(s["pos"]), pa.array(s["gram"].view(np.int64)), pa.array(s["check"].view(np.int64))], ["row", "pos", "gram", "check"])

    return docs.mapInArrow(grams, "row long, pos long, gram long, check long")


def spans_found(docs: DataFrame, k: int = K, drift: int = 3, cover: float = 0.8, dense: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Verified spans (row, template, label, first, last, matched, size, similarity)."""
    spark = docs.sparkSession
    known = spark.createDataFrame(template_grams(k, templates), "gram long, check long, template int, label string, tpos int, size int")
    hits = gram_rows(docs, k).join(F.broadcast(known), ["gram", "check"])
    votes = hits.groupBy("row", "template", "label", "size", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.sort_array(F.collect_set("tpos")).alias("at"))
    before = Window.partitionBy("row", "template").orderBy("diagonal")
    group = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(before) <= drift, 0).otherwise(1)).over(before)
    merged = votes.withColumn("g", group).select("row", "template", "label", "size", "g", "diagonal", F.explode("at").alias("t"))
    word = merged.select("row", "template", "label", "size", "g", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("o"), "t", "diagonal").select("row", "template", "label", "size", "g", "diagonal", (F.col("t") + F.col("o")).alias("tw"), (F.col("t") + F.col("o") + F.col("diagonal")).alias("dw"))
    tried = word.withColumn("d", F.explode(F.array(F.lit(None).cast("long"), "diagonal")))  # merged, and each diagonal alone
    spans = tried.groupBy("row", "template", "label", "size", "g", "d").agg(F.count_distinct("tw").alias("matched"), F.min("dw").alias("first"), F.max("dw").alias("last"))
    good = spans.withColumn("similarity", F.least(F.lit(1.0), F.col("matched") / F.col("size")) * F.least(F.lit(1.0), F.col("matched") / (F.col("last") - F.col("first") + 1)))
    good = good.where((F.col("matched") >= cover * F.col("size")) & (F.col("matched") >= dense * (F.col("last") - F.col("first") + 1)))
    whole = F.max(F.col("d").isNull()).over(Window.partitionBy("row", "template", "g"))
    return good.withColumn("whole", whole).where("d is null or not whole").drop("d", "whole")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base_scan(rows, "doc_id", "text")
    found = spans_found(rows, **how).groupBy(F.col("row").alias("found_row")).agg(F.collect_set("label").alias("more"), F.max("similarity").alias("best"))
    out = base.join(found, base["row"] == found["found_row"], "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
