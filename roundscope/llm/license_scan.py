"""License texts by diagonal voting.

Every rolling k-gram of a document's words is joined, by its hash, to the places of the templates where it stands.  A hit whose words are the template's votes
for a diagonal: place in the document less place in the template.  Votes of a diagonal mark the template's words that they hold.  Neighbouring diagonals of
a text (words put in or left out shift it) are merged into one span, and a span is verified by the share of the template's words that it holds: all words of a
phrase, whose diagonals are not merged, ``least`` of a text.

Phrases of a few words vote with two words, texts with five.  Templates hold 63 words at most, one bit each.  The joined table has a row for each of
their k-grams, so it is broadcast; documents travel in pieces and are not shuffled, only votes are.

Positions count words from 0.  Null and blank texts have no words.  Rows that repeat a doc_id are each scanned.  Other columns are ignored; an empty
table gives no rows.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import importable

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


# Phrases of the base rule, then further phrases and the usual opening words of public license texts.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("all-rights-reserved", "all rights reserved"),
)
TEXTS = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software"""),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at"""),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation"""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met"""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies"""),
    Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at"""),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class ScanRule:
    """``slack``: diagonals of a text that are so many words apart at most are one span.  ``piece``: words of a document that travel together."""
    phrase_words: int = 2
    text_words: int = 5
    slack: int = 8
    least: float = 0.6
    piece: int = 2048


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


def _pieces(rule: ScanRule):
    """Rows (node, doc_id, first, n, words): ``n`` words from ``first`` on, and those after them that their k-grams need."""
    names, over = ["node", "doc_id", "first", "n", "words"], max(rule.phrase_words, rule.text_words) - 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for node, doc, text in zip(batch.column("node").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = words(text.as_py())
                for at in range(0, max(len(found), 1), rule.piece):
                    some = found[at : at + rule.piece + over]
                    rows.append((node, doc, at, min(rule.piece, len(found) - at), some))
                    held += len(some)
                    if held > 1 << 16:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def _grams(k: int) -> Column:
    """Each place i < n of the piece where k words begin, with their hash."""
    last = F.least(F.col("n") - 1, F.size("words") - k).cast("int")
    places = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.lit(k).alias("k"), F.xxhash64(F.slice("words", i + 1, k)).alias("h")))
    return F.when(last >= 0, places).otherwise(F.array().cast("array<struct<i:int,k:int,h:bigint>>"))


def template_places(spark: SparkSession, rule: ScanRule = ScanRule(), phrases: tuple = PHRASES, texts: tuple = TEXTS) -> DataFrame:
    """A row for each k-gram of each template."""
    rows = []
    for template, (t, k, slack) in zip([*phrases, *texts], [*((t, rule.phrase_words, 0) for t in phrases), *((t, rule.text_words, rule.slack) for t in texts)], strict=True):
        parts = [w.decode() for w in words(t.text)]
        if not k <= len(parts) <= 63:
            raise ValueError(f"a template has {k} to 63 words: {t.text}")
        name = len({r[0] for r in rows})
        rows += [(name, template.label, template.base, len(parts), slack, k, j, ((1 << k) - 1) << j, parts[j : j + k]) for j in range(len(parts) - k + 1)]
    kinds = "template int, label string, base boolean, size int, slack int, tk int, place int, mask long, gram array<string>"
    return spark.createDataFrame(rows, kinds).withColumn("th", F.xxhash64("gram"))


def _spans(docs: DataFrame, rule: ScanRule) -> DataFrame:
    """Rows (node, doc_id, n, template columns, start, end, held); one row of each document has no template and counts its words."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(rule), "node long, doc_id long, first long, n long, words array<string>")
    count = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("h")))
    grams = pieces.select("node", "doc_id", "first", "n", "words", F.inline(F.concat(count, _grams(rule.phrase_words), _grams(rule.text_words))))
    places = F.broadcast(template_places(spark, rule))  # a row for each k-gram of the fixed templates
    hits = grams.join(places, (F.col("h") == F.col("th")) & (F.col("k") == F.col("tk")), "left")
    hits = hits.where("i < 0 or gram = slice(words, i + 1, k)")
    diagonal = (F.col("first") + F.col("i") - F.col("place")).alias("diagonal")
    template = ["template", "label", "base", "size", "slack"]
    votes = hits.select("node", "doc_id", *template, diagonal, F.when(F.col("i") < 0, F.col("n")).alias("n"), "mask", "place", "tk")
    lines = votes.groupBy("node", "doc_id", *template, "diagonal").agg(
        F.sum("n").alias("n"), F.bit_or("mask").alias("mask"), F.min("place").alias("low"), F.max(F.col("place") + F.col("tk")).alias("high"))
    # diagonals of a phrase are spans of their own, so that a document full of them is no single group
    near = Window.partitionBy("node", "template", F.when(F.col("slack") == 0, F.col("diagonal"))).orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(near) > F.col("slack")).cast("int")
    lines = lines.withColumn("span", F.sum(F.coalesce(new, F.lit(0))).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("apart", F.when(F.col("slack") == 0, F.col("diagonal")))
    return lines.groupBy("node", "doc_id", *template, "apart", "span").agg(
        F.sum("n").alias("n"), F.min(F.col("diagonal") + F.col("low")).alias("start"), F.max(F.col("diagonal") + F.col("high")).alias("end"),
        F.bit_count(F.bit_or("mask")).alias("held"))


def _verified(rule: ScanRule) -> Column:
    share = F.col("held") / F.col("size")
    return F.when(F.col("slack") == 0, F.col("held") == F.col("size")).otherwise(share >= rule.least)


def license_spans(docs: DataFrame, rule: ScanRule = ScanRule()) -> DataFrame:
    """The verified spans: doc_id, label, base, start and end (words, end exclusive), share of the template's words."""
    return _spans(docs, rule).where(_verified(rule)).select("doc_id", "label", "base", "start", "end", (F.col("held") / F.col("size")).alias("share"))


def license_scan(docs: DataFrame, rule: ScanRule = ScanRule()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): its words, places of the base phrases, labels and the largest share of a verified span (0: none)."""
    good = F.coalesce(_verified(rule), F.lit(False))
    base = good & F.col("base")
    listed = lambda one: F.concat_ws(",", F.array_sort(F.collect_set(F.when(one, F.col("label")))))
    return _spans(docs, rule).groupBy("node", "doc_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(good).alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("held") / F.col("size"))), F.lit(0.0)).alias("score"), F.count(F.when(good, 1)).alias("n_spans")).drop("node")
