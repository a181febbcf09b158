"""License texts by an exact set-similarity join, in DataFrame operations only.

A template is the set of words of a license text. A text block is a line and as many of the words after it as the
template is long but one, so a notice is in one block wherever it begins in a line and however it is wrapped. A block
meets a template if it holds at least ``CONTAINMENT`` of the template's words. The join is exact and filters in three steps:

* Prefix. Template words are ordered by their frequency in the whole corpus, rarest first. A block that lacks the first
  ``size - needed + 1`` of them cannot reach ``needed`` shared words, so only blocks with one of these words go on.
* Length. A block with fewer different words than ``needed`` cannot meet the template.
* Position. If the first shared word is at place ``p`` (from 0) in that order, at most ``size - p`` words are shared.

What passes is verified on the full sets. Templates are a fixed list, so their words are bounded and travel as literals
or by broadcast; blocks never meet blocks.

Null texts count as empty: no words, no labels, score 0. Repeated rows are judged each; the result carries doc_id, and
other columns are left out.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are runs of letters, digits and everything beyond ASCII.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count by themselves, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wordings that licenses prescribe for the notice that names them.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "bsd": "use of this source code is governed by a bsd style license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl": "licensed under the gnu lesser general public license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "permission": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "warranty": "the software is provided as is without warranty of any kind express or implied",
}
CONTAINMENT = 0.90


@dataclass(frozen=True)
class Template:
    label: str
    ordered: tuple[str, ...]  # rarest word first
    needed: int
    length: int  # words, repeated ones as often as they stand

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.ordered[: len(self.ordered) - self.needed + 1]


def normal(text: Column) -> Column:
    """Words of a text, lower-cased and joined by single spaces, with a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK, " ")), F.lit(" "))


def word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """Texts that hold each of a fixed list of words, over the whole corpus; at most one row per listed word comes back."""
    listed = F.array(*(F.lit(w) for w in words))
    held = docs.select(F.explode(F.array_intersect(F.split(F.trim(normal(F.col("text"))), " "), listed)).alias("word"))
    counts = {r.word: r["count"] for r in held.groupBy("word").count().collect()}
    return {w: counts.get(w, 0) for w in words}


def templates(docs: DataFrame, texts: dict[str, str] | None = None, containment: float = CONTAINMENT) -> list[Template]:
    """Templates with their words in order of frequency in ``docs``."""
    listed = {label: t.split() for label, t in (texts or TEMPLATES).items()}
    sets = {label: set(t) for label, t in listed.items()}
    counts = word_counts(docs, sorted(set().union(*sets.values())))
    return [Template(label, tuple(sorted(s, key=lambda w: (counts[w], w))), math.ceil(containment * len(s) - 1e-9), len(listed[label])) for label, s in sets.items()]


def candidates(blocks: DataFrame, wanted: list[Template]) -> DataFrame:
    """Pairs of block and template after the three filters, each pair once, at its first shared word.

    ``blocks`` has ``words``, the set of a block as it is for the longest template. Blocks without any prefix word stay,
    with a null label.
    """
    spark = blocks.sparkSession
    rows = [(w, t.label, list(t.ordered), p, t.needed, t.length) for t in wanted for p, w in enumerate(t.prefix)]
    index = spark.createDataFrame(rows, "word string, label string, ordered array<string>, place int, needed int, length int")
    prefix = F.array(*(F.lit(w) for w in sorted({r[0] for r in rows})))
    passed = (
        (F.size("words") >= F.col("needed"))  # length
        & (F.size("ordered") - F.col("place") >= F.col("needed"))  # position
        & ~F.arrays_overlap("words", F.slice("ordered", 1, F.col("place")))  # an earlier word has this pair already
    )
    met = blocks.withColumn("word", F.explode_outer(F.array_intersect("words", prefix))).join(F.broadcast(index), "word", "left")
    return met.withColumn("label", F.when(passed, F.col("label"))).drop("word", "place")


def scan(docs: DataFrame, texts: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are the least and largest of their
    first words (null without any). ``labels`` holds the base labels and those of templates that a block meets. The score
    is the largest share of a template that one block holds among those met, and 1 where a base phrase stands.
    """
    wanted = templates(docs, texts, containment)
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    read = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_replace(text, BREAK_IN_LINE, " ").alias("lines"))
    trimmed = F.trim(F.regexp_replace(F.translate("lines", "\n", " "), "  +", " "))
    read = read.select("doc_id", "row", "lines", F.concat(F.lit(" "), trimmed, F.lit(" ")).alias("t"))
    n_spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    places, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        key = f" {phrase} "
        there = F.contains("t", F.lit(key))
        start = F.instr("t", key)
        final = F.length("t") - F.instr(F.reverse("t"), key[::-1]) + 2 - len(key)
        places.append(F.when(there, F.regexp_count("t", F.lit(f" {phrase}(?= )"))).otherwise(0))
        first.append(F.when(there, n_spaces(F.substring("t", F.lit(1), start)) - 1))
        last.append(F.when(there, n_spaces(F.substring("t", F.lit(1), final)) - 1))
        labels.append(F.when(there, F.lit(label)))
    prefix = sorted({w for t in wanted for w in t.prefix})
    held = lambda c: functools.reduce(operator.or_, (F.contains(c, F.lit(f" {w} ")) for w in prefix))
    # Most texts hold no prefix word at all and are not cut into blocks.
    filled = F.when(held("t"), F.filter(F.transform(F.split("lines", "\n"), lambda b: F.trim(b)), lambda b: b != ""))
    base = read.select(
        "doc_id", "row", F.transform(filled, lambda b: F.split(b, " +")).alias("cut"),
        F.when(F.trim("t") == "", 0).otherwise(n_spaces(F.col("t")) - 1).cast("long").alias("n_words"),
        functools.reduce(operator.add, places).cast("long").alias("n_base"),
        F.array_min(F.array(*first)).cast("long").alias("first_word"), F.array_max(F.array(*last)).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_labels"),
    )
    # Each line that is left has a word at least, so the next ``more`` lines hold the words that a block can need.
    more = max((t.length for t in wanted), default=1) - 1
    follows = lambda i: F.slice(F.flatten(F.slice("cut", i + 2, F.lit(more))), 1, more)
    runs = F.transform("cut", lambda w, i: F.struct(F.concat(w, follows(i)).alias("run"), F.size(w).alias("own")))
    listed = F.array(*(F.lit(w) for w in prefix))
    base = base.withColumn("blocks", F.filter(runs, lambda b: F.arrays_overlap(b["run"], listed))).drop("cut")
    base = base.withColumn("block", F.explode_outer("blocks")).drop("blocks")
    met = candidates(base.withColumn("words", F.array_distinct("block.run")), wanted)
    inside = F.slice("block.run", F.lit(1), F.col("block.own") + F.col("length") - 1)
    shared = F.when(F.col("label").isNotNull(), F.size(F.array_intersect(inside, "ordered")))
    met = met.withColumn("share", F.when(shared >= F.col("needed"), shared / F.size("ordered")))
    carried = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    judged = met.groupBy("row").agg(
        *(F.any_value(c).alias(c) for c in carried),
        F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("more"),  # at most one per template
        F.max("share").alias("share"),
    )
    return judged.select(
        *carried[:5], F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", "more"))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
