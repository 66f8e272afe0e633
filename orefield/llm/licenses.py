"""License scans: phrase places, and an exact set-similarity join of text blocks with license notices.

One pass over the documents makes words, and keeps of them what the rest needs: which of the notices' words a text has, its phrase places, and
the text itself where it has enough of some notice's words.

A block is a run of up to 2*step words, one beginning every `step` words, so any run of `step` words lies whole in a
block; step is at least the longest notice of its class (notices of up to STEP words, and longer ones). Block and notice are sets of words. A notice is found in a block that holds at least
`threshold` of its distinct words. A notice of fewer than SHORT distinct words is found only where its words are consecutive, since
most of so small a set turns up by chance. The join is exact: the notices' words are ordered by how many documents hold them, rarest
first; a block's words in that order are the notices' words that it has (others cannot count). Length filter: a block with
fewer such words than the overlap needed is out. Prefix filter: a pair must share a word among the notice's first
|T|-o+1 and the block's first |B|-o+1. Positional filter: from that word on both must have o words left. What remains
is verified on the whole sets. Only built-in functions run; the one broadcast is the notices' own prefix table.

Defined cases: null or empty text has no words, places or blocks; very long texts are read whole; repeated rows get equal results; documents with null or
equal doc_ids are told apart by their text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_words, stage, table

#: A character of a word and one between words, before lower-casing A-Z.
IN, OUT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Phrases whose words, consecutive anywhere, name a license.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
#: Notices by label. The public wording of each license's own notice.
NOTICES = {
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-release": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
THRESHOLD = 0.8
STEP = 64
#: A notice with fewer distinct words must stand in the text word by word.
SHORT = 8


def pattern(phrases: list[str]) -> str:
    """Case is ignored in A-Z only; the words must end where the phrase's do."""
    return f"(?i)(?<!{IN})(?:{'|'.join(f'{OUT}+'.join(p.split()) for p in phrases)})(?!{IN})"


def tokens(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def words(text: Column) -> Column:
    return split_words(F.lower(text), f"{OUT}+")


def strings(xs: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")


def looked_at(docs: DataFrame, phrases: dict[str, str], short: dict[str, str], notices: dict[str, str], threshold: float) -> DataFrame:
    """Staged, from the one pass over all words: doc_id, th (hash of the text), n_words, places of the phrases (number, first, last, labels),
    labels of short notices, present (the vocabulary's words that the text has), and the text where present holds enough of a notice.

    Texts are searched for phrases only if they have a phrase's words. No phrase's end begins another, so places do not overlap and counting left to
    right finds all.
    """
    every = pattern(list(phrases.values()))
    sets = {k: sorted(set(tokens(v))) for k, v in notices.items()}
    vocabulary = sorted({w for v in (*phrases.values(), *short.values(), *notices.values()) for w in tokens(v)})
    count = lambda x: F.size(words(x)).cast("long")
    has_all = lambda v: F.size(F.array_intersect(strings(sorted(set(tokens(v)))), F.col("present"))) == len(set(tokens(v)))
    some = lambda held: F.array_compact(F.array(*(F.when(has_all(v) & F.col("text").rlike(pattern([" ".join(tokens(v))])), k) for k, v in sorted(held.items())))) if held else strings([])
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text")).withColumn("ws", words(F.col("text")))
    rows = rows.select("doc_id", "th", "text", F.size("ws").cast("long").alias("n_words"), F.array_intersect(strings(vocabulary), F.col("ws")).alias("present"))
    may = reduce(Column.__or__, (has_all(v) for v in phrases.values())) if phrases else F.lit(False)
    rows = rows.withColumn("n_base", F.when(may, (F.size(F.split("text", every)) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
    has = F.col("n_base") > 0
    enough = [F.size(F.array_intersect(strings(s), F.col("present"))) >= needed(s, threshold) for s in sets.values()]
    rows = rows.select("doc_id", "th", "n_words", "n_base", "present",
        F.when(has, count(F.regexp_extract("text", f"(?s)^(.*?){every}", 1))).alias("first_word"),
        F.when(has, count(F.regexp_extract("text", f"(?s)^(.*){every}", 1))).alias("last_word"),
        F.when(has, some(phrases)).otherwise(strings([])).alias("base"), some(short).alias("short"),
        F.when(reduce(Column.__or__, enough), F.col("text")).alias("text") if enough else F.lit(None).cast("string").alias("text"))
    return stage(rows, "license-rows")


def needed(words_: list[str], threshold: float) -> int:
    return math.ceil(threshold * len(words_) - 1e-9)


def rarest_first(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents that hold each word; ties by the word. One row a word comes back."""
    held = rows.select(F.explode("present").alias("w")).groupBy("w").count()
    n = {r.w: r["count"] for r in held.collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def block_matches(rows: DataFrame, notices: dict[str, str], order: list[str], threshold: float = THRESHOLD, step: int = STEP) -> DataFrame:
    """rows (of looked_at): doc_id, th, block, label, containment for every block that reaches the threshold. order: the notices' words, rarest first."""
    sets = {k: sorted(set(tokens(v))) for k, v in notices.items()}
    order = [w for w in order if any(w in s for s in sets.values())]
    step = max([step, *(len(tokens(v)) for v in notices.values())])
    rank = {w: i for i, w in enumerate(order)}
    need = {k: needed(s, threshold) for k, s in sets.items()}
    prefix = [(w, k, i, need[k], sorted(s, key=rank.get)) for k, s in sets.items() for i, w in enumerate(sorted(s, key=rank.get)[: len(s) - need[k] + 1])]
    prefixes = rows.sparkSession.createDataFrame(prefix, "w string, label string, i int, need int, notice array<string>")
    least, vocabulary = min(need.values(), default=1), strings(order)
    found = rows.where("text is not null").where(F.arrays_overlap("present", strings(sorted({r[0] for r in prefix})))).select("doc_id", "th", words(F.col("text")).alias("ws"))
    block = lambda k: F.struct(k.alias("block"), F.array_intersect(vocabulary, F.slice("ws", k * step + 1, 2 * step)).alias("b"))
    blocks = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("ws") - 1) / step) - F.when(F.size("ws") > step, 1).otherwise(0)).cast("int")), block), lambda x: F.size(x["b"]) >= least)
    found = found.select("doc_id", "th", F.explode(blocks).alias("x")).select("doc_id", "th", "x.block", "x.b")
    found = found.select("*", F.posexplode(F.slice("b", 1, F.size("b") - least + 1)).alias("j", "w"))
    pairs = found.join(F.broadcast(prefixes), "w")
    left = F.least(F.size("notice") - F.col("i"), F.size("b") - F.col("j"))
    pairs = pairs.where((F.col("j") <= F.size("b") - F.col("need")) & (left >= F.col("need")))
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("b", "notice"))).where("shared >= need")
    return pairs.groupBy("doc_id", "th", "block", "label").agg(F.max(F.col("shared") / F.size("notice")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: phrase places and the labels of phrases and of notices; score 1 for a phrase, else the best containment, else 0."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold is over 0 and at most 1")
    short = {k: v for k, v in notices.items() if len(set(tokens(v))) < SHORT}
    joined_ = {k: v for k, v in notices.items() if k not in short}
    rows = looked_at(docs.select("doc_id", "text"), phrases, short, joined_, threshold)
    order = rarest_first(rows, sorted({w for v in joined_.values() for w in tokens(v)}))
    both = rows.withColumn("more", strings([])).withColumn("best", F.lit(None).cast("double"))
    if joined_:
        found = [block_matches(rows, held, order, threshold) for long in (False, True) if (held := {k: v for k, v in joined_.items() if (len(tokens(v)) > STEP) == long})]
        names = reduce(DataFrame.unionByName, found).groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
        left, right = rows.alias("a"), names.alias("b")
        both = left.join(right, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.th").eqNullSafe(F.col("b.th")), "left").select("a.*", "more", "best")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "short", F.coalesce("more", strings([])))).alias("labels"),
        F.when((F.col("n_base") > 0) | (F.size("short") > 0), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
