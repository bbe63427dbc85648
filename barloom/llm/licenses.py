"""License scans: exact containment join of text blocks with license notices.

A block is a run of consecutive words, whatever lines they stand on: ``2 * step``
words from every multiple of ``step``, where ``step`` is the power of two from
1.2 times the template's own words. So every run of ``step`` words lies whole in
some block, and words far apart in a long line do not meet. A block matches a
template when it holds at least ``threshold`` of the template's distinct words,
whatever their order. Some words tell variants of one license apart: numbers and
words such as ShareAlike or Lesser. A block must hold all of these that the template
has and none that it lacks, so that one version's notice is not taken for another's.
A template of at most three words must stand in its order. The join is exact: words stand in one global order, rarest
first, by the number of texts that hold them; a matching block must hold one of
the template's first ``|T| - need + 1`` words (prefix filter), at least ``need``
template words at all (length filter), and enough words after the first shared
one on either side (positional filter). Survivors are verified on the full sets.
Words outside all templates cannot add to a containment, so texts are kept as
the places of template words only, and blocks are cut out around prefix words.

Beside it, base phrases are found at every place where their words stand one
after another in the whole text, over line ends too.

Only DataFrame functions are used. Null texts count as empty, a text without
words has no place and no label. Rows with null or repeated ids stay rows of
their own; other columns of the input are not read.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written

#: Base phrases and their labels. Fixed values of the contract.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices of common licenses and the labels the join adds: several texts for some.
TEMPLATES = {
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "either version 3 of the License, or (at your option) any later version"],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "agpl-3.0": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
    "all-rights-reserved": ["All rights reserved."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}

#: Words that tell the variants of a family of licenses apart, by a part of its labels.
VARIANTS = {"cc-by": ("sa", "sharealike", "alike", "nc", "noncommercial", "nd", "noderivatives", "noderivs"), "gpl": ("lesser", "affero")}
#: Templates of at most as many words must stand in their order.
PHRASE = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


#: Slots of the vocabulary's look-up table.
SLOTS = 1024


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words of a text that is lower-case already."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  # distinct
    step: int  # words between the beginnings of two blocks
    need: int
    must: tuple[str, ...]  # words of it that a block may not lack
    avoid: tuple[str, ...]  # words that a block may not hold
    phrase: tuple[str, ...]  # the words in order, if that matters


def templates_of(texts: dict[str, list[str]], threshold: float) -> list[Template]:
    out = []
    for label, notices in texts.items():
        for notice in notices:
            words = re.findall(WORD, notice.translate(str.maketrans(UPPER, LOWER)))
            telling = {w for part, family in VARIANTS.items() if part in label for w in family}
            must = {w for w in words if w in telling or w.isdigit()}
            phrase = tuple(words) if len(words) <= PHRASE else ()
            out.append(Template(label, tuple(sorted(set(words))), 1 << math.ceil(math.log2(1.2 * len(words))), needed(len(set(words)), threshold), tuple(sorted(must)), tuple(sorted(telling - must)), phrase))
    return out


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    here = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.size(words) - F.lit(1)), here)


def _labelled(places: Column, label: str, size: int) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("word"), F.lit(size).alias("size")))


def scan_documents(documents: DataFrame, base: dict[str, str] = BASE_PHRASES, templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """For each row: doc_id, n_words, places by base phrase, matches.

    ``places`` is array<struct<label, word, size>>, ``matches`` is
    array<struct<word, width, label, containment>>, a block's first word and its
    words; both empty where nothing is found.
    """
    spark = documents.sparkSession
    known = templates_of(templates, threshold)
    vocabulary = sorted({w for t in known for w in t.words + t.avoid})
    least = min(t.need for t in known)
    prefilter = "(?i)(?:" + "|".join(BETWEEN.join(p.split(" ")) for p in base) + ")"
    low = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", lowered(F.col("text")))
    found = F.concat(*[_labelled(_places(F.col("words"), p), label, len(p.split(" "))) for p, label in base.items()])
    nothing = F.array().cast("array<struct<label:string,word:bigint,size:int>>")
    # a word's number in the vocabulary, or null: its hash picks the few it could be
    slots: dict[int, list[str]] = {}
    for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.pmod(F.hash("w"), F.lit(SLOTS)).alias("slot")).collect():
        slots.setdefault(r["slot"], []).append(r["w"])
    held = json.dumps([sorted(slots.get(i, [])) for i in range(SLOTS)])
    table = F.from_json(F.lit(held), "array<array<string>>")  # one literal of fixed size
    hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(F.get(table, F.pmod(F.hash(w), F.lit(SLOTS))), w), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())
    scanned = low.withColumn("words", words_of(F.col("low"))).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.col("text").rlike(prefilter) & (F.size("words") > 0), found).otherwise(nothing).alias("places"),
        hits.alias("hits"),
    )
    scanned = written(scanned, "license-words")  # fixes the row numbers

    counts = scanned.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}  # template words only
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for t in known:
        ranked = sorted(t.words, key=rank.__getitem__)
        index += [(w, t.label, i, len(ranked), t.need, t.step, ranked, t.must, t.avoid, t.phrase) for i, w in enumerate(ranked[: len(ranked) - t.need + 1])]
    prefix = sorted({x[0] for x in index})
    widest = 2 * max(t.step for t in known)
    prefixes = spark.createDataFrame(index, "word string, label string, at int, size int, need int, step int, template array<string>, must array<string>, avoid array<string>, phrase array<string>")
    ranks = F.from_json(F.lit(json.dumps(rank)), "map<string,int>")
    # around each prefix word the template words that any block with it can hold
    near = F.filter(
        F.transform("hits", lambda h, k: F.when(F.array_contains(F.array(*[F.lit(w) for w in prefix]), h["w"]), F.struct(h["i"].alias("i"), h["w"].alias("word"), F.slice("hits", F.greatest(k + 1 - widest, F.lit(1)), F.lit(2 * widest)).alias("around")))),
        lambda x: x.isNotNull(),
    )
    tokens = scanned.where(F.size("hits") >= least).select("row", F.explode(near).alias("x")).select("row", "x.*")
    # the index has a row for each prefix word of each template
    pairs = tokens.join(F.broadcast(prefixes), "word")
    own = F.floor(F.col("i") / F.col("step")).cast("int")
    pairs = pairs.withColumn("block", F.explode(F.when(own > 0, F.array(own - 1, own)).otherwise(F.array(own))))
    begin = F.col("block") * F.col("step")
    within = F.filter("around", lambda h: (h["i"] >= begin) & (h["i"] < begin + 2 * F.col("step")))
    pairs = pairs.withColumn("within", within).withColumn("held", F.array_distinct(F.transform("within", lambda h: h["w"]))).where(F.size("held") >= F.col("need"))
    telling = (F.size(F.array_intersect("held", "must")) == F.size("must")) & ~F.arrays_overlap("held", "avoid")
    size = F.size("phrase")
    runs = F.transform("within", lambda h, k: F.slice("within", k + 1, F.greatest(size, F.lit(1))))
    in_order = F.exists(runs, lambda r: (F.transform(r, lambda h: h["w"]) == F.col("phrase")) & (F.get(r, size - 1)["i"] - F.get(r, F.lit(0))["i"] == size - 1))
    pairs = pairs.where(telling & ((size == 0) | in_order))
    pairs = pairs.withColumn("held", F.transform(F.array_sort(F.transform("held", lambda w: F.struct(F.element_at(ranks, w).alias("r"), w.alias("w")))), lambda x: x["w"]))
    pairs = pairs.withColumn("pos", F.array_position("held", F.col("word")).cast("int") - 1)
    pairs = pairs.where(F.lit(1) + F.least(F.size("held") - F.col("pos") - 1, F.col("size") - F.col("at") - 1) + F.least("pos", "at") >= F.col("need"))
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("held", "template"))).where(F.col("shared") >= F.col("need"))
    matches = pairs.groupBy("row", begin.cast("long").alias("word"), (2 * F.col("step")).alias("width"), "label").agg(F.max(F.col("shared") / F.col("size")).alias("containment"))
    matches = matches.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("word", "width", "label", "containment"))).alias("matches"))
    none = F.array().cast("array<struct<word:bigint,width:int,label:string,containment:double>>")
    return scanned.join(matches.hint("shuffle_hash"), "row", "left").select("doc_id", "n_words", "places", F.coalesce("matches", none).alias("matches"))


def license_rows(documents: DataFrame) -> DataFrame:
    """The scan's digest for each document."""
    found = scan_documents(documents)
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    added = F.array_distinct(F.transform("matches", lambda m: m["label"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, added))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))).alias("score"),
    )
