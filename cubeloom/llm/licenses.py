"""Licence scans: an exact set-similarity join of text blocks with notice templates, beside places of fixed phrases.

A text is cut into half-overlapping windows of words; the set of a window is what it holds of the templates' vocabulary. A
template is met when a window holds at least ``percent`` of its words. The vocabulary is ordered by how many windows hold a word,
rarest first, and three filters choose the pairs that are compared: a template of t words that must share o of them shares
one of its first t - o + 1 (prefix), only windows of o words or more can meet it (length), and what lies behind the first shared
word on both sides must still suffice (position). All of that is an ordinary join of Spark; the templates are its bounded side.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.common import query, table, written

# Phrases whose places the query counts, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening sentences of public licence notices, with their labels.
TEMPLATES = (
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
               "License. You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
            "with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
PERCENT = 85
#: Words of a window; a notice of up to half as many words lies whole in one.
WINDOW = 64
SCAN = ("_sid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "blocks array<struct<block: long, held: array<int>>>")


def _letters() -> bytes:
    """Translation of bytes: A-Z to a-z, ASCII that is no letter or digit to a blank; bytes of other characters stay."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


LETTERS = _letters()


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(LETTERS).split()


def needed(size: int, percent: int) -> int:
    """Words that a set must share with a template of ``size`` words."""
    return -(-size * percent // 100)


def phrase_places(words: list[bytes], phrases: Mapping[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands."""
    found = []
    for phrase, label in phrases.items():
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if tuple(words[at : at + len(phrase)]) == phrase:
                    found.append((at, label))
        except ValueError:
            continue
    return found


def windows_of(held: Sequence[tuple[int, int]], least: int, window: int) -> Iterator[tuple[int, list[int]]]:
    """(block, sorted distinct words) of the windows that hold ``least`` distinct words or more; ``held`` is (place, word) by place.

    Block b covers the words from b * window / 2 on; the window of a text's end starts at a multiple as well.
    """
    half = window // 2
    if len(held) < least:
        return
    lo = 0
    for block in range(max(0, held[0][0] // half - 1), held[-1][0] // half + 1):
        start = block * half
        while lo < len(held) and held[lo][0] < start:
            lo += 1
        if lo + least > len(held):
            return
        if held[lo + least - 1][0] >= start + window:
            continue  # too few words of the vocabulary
        hi = lo
        while hi < len(held) and held[hi][0] < start + window:
            hi += 1
        inside = {word for _, word in held[lo:hi]}
        if len(inside) >= least:
            yield block, sorted(inside)


def scan_texts(docs: DataFrame, sets: Sequence[Sequence[str]], phrases: Mapping[str, str], percent: int, window: int) -> DataFrame:
    """One row per document: its words and phrase places, and the windows long enough for the smallest template (written)."""
    vocabulary = {w: i for i, w in enumerate(sorted({w.encode() for s in sets for w in s}))}
    least = min(needed(len(s), percent) for s in sets)
    known = {tuple(words_of(p.encode())): label for p, label in phrases.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            names, texts = batch.column(0), pc.cast(batch.column(1), pa.binary())
            out = []
            for text in texts:
                words = words_of(text.as_py() or b"")
                present = set(words)
                places = []
                if any(present.issuperset(p) for p in known):
                    places = phrase_places(words, known)
                held = []
                if len(present & vocabulary.keys()) >= least:
                    held = [(i, v) for i, v in enumerate(map(vocabulary.get, words)) if v is not None]
                blocks = [{"block": b, "held": w} for b, w in windows_of(held, least, window)]
                starts = [s for s, _ in places]
                out.append((base + seen, len(words), len(places), min(starts, default=None), max(starts, default=None),
                            ",".join(sorted({label for _, label in places})), blocks))
                seen += 1
            if out:
                sid, words, n, first, last, labels, blocks = zip(*out)
                kind = pa.list_(pa.struct([("block", pa.int64()), ("held", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid, pa.int64()), names, *(pa.array(c, pa.int64()) for c in (words, n, first, last)), pa.array(labels, pa.string()),
                     pa.array(blocks, kind)],
                    names=["_sid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"],
                )

    # written, so that the row numbers stay as they are if an executor is lost
    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCAN), "licence-scan")


def template_matches(scanned: DataFrame, sets: Sequence[Sequence[str]], percent: int) -> DataFrame:
    """Every (_sid, block, template, shared) with the share of the template's words that ``percent`` asks for."""
    spark = scanned.sparkSession
    number = {w: i for i, w in enumerate(sorted({w.encode() for s in sets for w in s}))}
    blocks = scanned.select("_sid", F.explode("blocks").alias("b")).select("_sid", "b.block", "b.held")
    # one row per word of the templates reaches the driver
    counts = blocks.select(F.explode("held").alias("word")).groupBy("word").count().collect()
    often = {r["word"]: r["count"] for r in counts}
    order = sorted(number.values(), key=lambda w: (often.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes = []
    for t, words in enumerate(sets):
        mine = sorted(place[number[w.encode()]] for w in words)
        least = needed(len(mine), percent)
        prefixes += [(t, p, i, len(mine), least, mine) for i, p in enumerate(mine[: len(mine) - least + 1])]
    template = spark.createDataFrame(prefixes, "template int, token int, at int, size int, least int, words array<int>")
    # words become their places in the order; the map has one entry per word of the templates
    places = F.create_map(*[F.lit(x) for w in number.values() for x in (w, place[w])])
    ranked = blocks.withColumn("held", F.array_sort(F.transform("held", lambda w: places[w])))
    smallest = min(needed(len(set(s)), percent) for s in sets)
    # of a window with m words of the vocabulary at most the first m - smallest + 1 can be the first shared one
    head = ranked.select("*", F.posexplode(F.slice("held", 1, F.size("held") - smallest + 1)).alias("spot", "token"))
    pairs = head.join(F.broadcast(template), "token")  # bounded by the templates
    behind = 1 + F.least(F.col("size") - F.col("at") - 1, F.size("held") - F.col("spot") - 1)
    possible = pairs.filter((F.size("held") >= F.col("least")) & (F.col("at") + behind >= F.col("least")))
    shared = F.array_intersect("held", "words")
    # a pair is taken at the first word it shares
    return (
        possible.withColumn("both", shared)
        .filter((F.col("both")[0] == F.col("token")) & (F.size("both") >= F.col("least")))
        .select("_sid", "block", "template", F.size("both").alias("shared"))
    )


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
                 percent: int = PERCENT, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches array<struct<block, template, shared>>.

    Base places are where a phrase's words stand consecutively; first_word and last_word are the smallest and largest start of one.
    ``matches`` holds every window (block b starts at word b * window / 2) that meets a template; ``labels`` joins theirs and the base labels.
    The score is the largest share of a template's words met, a phrase being met whole, and 0 without any. Null and empty texts
    have no words; null ids are kept; repeated rows are answered one by one; an empty table gives no rows; other columns are
    not read. A template without words raises ValueError.
    """
    sets = [sorted({w.decode() for w in words_of(text.encode())}) for _, text in templates]
    if not all(sets):
        raise ValueError("a template has no words")
    scanned = scan_texts(docs, sets, phrases, percent, window)
    found = template_matches(scanned, sets, percent)
    names = F.array(*[F.lit(label) for label, _ in templates])
    sizes = F.array(*[F.lit(len(s)) for s in sets])
    # a window meets each template once at most; a text has as many windows as its length asks for
    per_row = found.groupBy("_sid").agg(
        F.array_sort(F.collect_list(F.struct("block", "template", "shared"))).alias("matches"),
        F.collect_set(names[F.col("template")]).alias("met"),
        F.max(F.col("shared") / sizes[F.col("template")]).alias("share"),
    )
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    both = F.array_sort(F.array_union(base, F.coalesce("met", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    none = F.array().cast("array<struct<block: long, template: int, shared: int>>")
    return scanned.drop("blocks").join(per_row, "_sid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(both, ",").alias("labels"),
        score.alias("score"), F.coalesce("matches", none).alias("matches"),
    )


@query("op12_licenses")
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("matches")
