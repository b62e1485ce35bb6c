"""License scans: exact set-similarity join of text blocks and license templates. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

#: Phrases and their labels (fixed values of the contract).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices and their labels: public license texts, one text block each.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-notice": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

#: Everything but digits, ASCII letters and characters beyond ASCII parts words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` is much faster and differs for ASCII letters only where these two characters stand."""
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def spaced(text: Column) -> Column:
    """The lower-cased words of a text with one space before, between and after them (a text without words: one space)."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(text), GAP, " ")), F.lit(" "))


def word_run(text: str) -> list[str]:
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(word_run(text)))


def plan_templates(templates: Mapping[str, str], frequency: Mapping[str, int], threshold: float) -> list[dict]:
    """Each template's distinct words in global order (rare ones first), the least overlap and the prefix.

    A block that holds at least ``need`` of n words holds one of any n - need + 1 of them; the
    rarest make the fewest candidates.
    """
    out = []
    for label in sorted(templates):
        words = sorted(template_words(templates[label]), key=lambda w: (frequency.get(w, 0), w))
        if words:
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            out.append({"label": label, "words": words, "need": need, "prefix": len(words) - need + 1, "span": len(word_run(templates[label]))})
    return out


def word_frequencies(norm: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each of the templates' words, over all documents; at most one number for each such word comes back."""
    held = F.explode(F.array_intersect(F.split(F.col("norm"), " "), F.array(*[F.lit(w) for w in vocabulary])))
    return {r["word"]: r["n"] for r in norm.select(held.alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def find_blocks(docs: DataFrame, plans: list[dict], text: str, keys: list[str]) -> DataFrame:
    """keys, label, containment of every block that holds enough of a template's words.

    Blocks are lines and, for notices wrapped over lines, runs of as many words as the template has,
    at every place of the text. Prefix filter: the block's words that stand in a template's prefix are hash-joined with the
    prefix postings. Position filter: only the first common word, in global order, makes the pair,
    and need - 1 words must be left in the template after it. Length filter: a block has at least
    ``need`` distinct words. Survivors are verified on the whole sets. A text whose words as a whole
    don't pass has no run that does; in the others the runs that start with a template's word are verified.
    """
    spark = docs.sparkSession
    order = {w: i for i, w in enumerate(dict.fromkeys(w for p in plans for w in p["words"]))}
    prefix = sorted({w for p in plans for w in p["words"][: p["prefix"]]}, key=order.get)
    rows = [(w, p["label"], i, p["words"], p["need"], p["span"]) for p in plans for i, w in enumerate(p["words"][: p["prefix"]]) if len(p["words"]) - i >= p["need"]]
    postings = spark.createDataFrame(rows, "word string, label string, position int, words array<string>, need int, span int")
    some = F.array(*[F.lit(w) for w in prefix])
    shortest = min(p["need"] for p in plans)
    first = F.array_position("words", F.element_at(F.array_intersect("words", "block"), 1)) - 1
    common = F.size(F.array_intersect("words", "block"))

    def passed(blocks: DataFrame) -> DataFrame:
        heads = blocks.where(F.size("block") >= shortest).withColumn("word", F.explode(F.array_intersect("block", some)))
        pairs = heads.join(F.broadcast(postings), "word").where(F.size("block") >= F.col("need"))
        return pairs.where(F.col("position") == first).where(common >= F.col("need"))

    held = docs.where(F.arrays_overlap(F.split(spaced(F.col(text)), " "), some))
    lines = held.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("line"))
    lines = passed(lines.select(*keys, F.array_distinct(F.filter(F.split(spaced(F.col("line")), " "), lambda w: w != "")).alias("block")))
    runs = held.where(F.contains(F.col(text), F.lit("\n"))).select(*keys, F.split(F.trim(spaced(F.col(text))), " ").alias("run"))
    runs = passed(runs.withColumn("block", F.array_distinct("run")))
    starts = F.filter(F.sequence(F.lit(1), F.size("run")), lambda i: F.array_contains("words", F.get("run", i - 1)))
    most = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect("words", F.slice("run", i, F.col("span"))))))
    runs = runs.select(*keys, "label", "need", F.size("words").alias("n"), most.alias("common")).where(F.col("common") >= F.col("need"))
    found = lines.select(*keys, "label", (common / F.size("words")).alias("containment")).unionByName(runs.select(*keys, "label", (F.col("common") / F.col("n")).alias("containment")))
    return found.groupBy(*keys, "label").agg(F.max("containment").alias("containment"))


def stands(parts: list[str]) -> Callable[[Column], Column]:
    """Whether the words from place i on are ``parts``."""

    def here(i: Column) -> Column:
        found = F.get("words", i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            found = found & (F.get("words", i + j) == part)
        return F.coalesce(found, F.lit(False))

    return here


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Phrase places are exact; template labels come from the set-similarity join with containment of
    at least ``threshold``. score: 1 with a phrase, else the best containment, else 0. Null and
    empty texts have 0 words, empty label strings and null places. Equal rows get equal results;
    an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    norm = rows.withColumn("norm", spaced(F.col("text")))
    vocabulary = sorted({w for t in templates.values() for w in template_words(t)})
    plans = plan_templates(templates, word_frequencies(norm, vocabulary) if vocabulary else {}, threshold)

    some_phrase = F.lit(False)
    for phrase in phrases:
        some_phrase = some_phrase | F.contains("norm", F.lit(f" {phrase} "))
    words = F.split(F.trim("norm"), " ")
    places, labels = F.array().cast("array<long>"), F.array().cast("array<string>")
    for phrase, label in phrases.items():
        spots = F.filter(F.sequence(F.lit(0), F.size("words") - 1), stands(phrase.split(" "))).cast("array<long>")
        hit = F.contains("norm", F.lit(f" {phrase} "))
        places = F.concat(places, F.when(hit, spots).otherwise(F.array().cast("array<long>")))
        labels = F.when(hit, F.concat(labels, F.array(F.lit(label)))).otherwise(labels)
    based = norm.withColumn("words", F.when(some_phrase, words)).select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.when(F.length(F.trim("norm")) == 0, 0).otherwise(F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
        F.when(some_phrase, places).otherwise(F.array().cast("array<long>")).alias("places"),
        F.when(some_phrase, labels).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    if plans:
        found = find_blocks(rows.withColumn("text_hash", F.xxhash64("text")), plans, "text", ["doc_id", "text_hash"])
        found = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
        based = based.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    else:
        based = based.withColumn("own", F.lit(None).cast("array<string>")).withColumn("best", F.lit(None).cast("double"))
    return based.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
