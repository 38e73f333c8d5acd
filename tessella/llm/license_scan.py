"""License scans: phrases, and an exact set-similarity join of text blocks with license templates. SQL functions only.

A block is a line, or a run of as many words as a template has and a quarter more, wherever lines end (a shorter text is
one block); a template is a short notice. Blocks and templates are sets of words. The join finds every block that holds
at least the threshold's share of a template's words. Words are ordered by how often they come in the whole corpus, rare
ones first. A template's prefix is as many of its first words as it can't miss entirely: a block that shares none of them
cannot reach the threshold (prefix filter). A block needs as many of all templates' words as the template asks (length
filter), and from a shared word on there must be enough words left in both orders (positional filter). What remains is
counted exactly. Runs are looked for only around places of prefix words, in as many words as a run can reach from there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, text_of

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "apache-2.0": ("licensed under the apache license version 2 0",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "gpl-3": ("this work is licensed under the gnu general public license version 3",),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "cc-by-sa": ("licensed under cc by sa 4 0",),
    "cc-by-4": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc0": ("this work has been dedicated to the public domain under cc0 1 0",),
}

#: Word borders: all of ASCII but digits and lower-case letters; line feeds are left for the blocks.
_BORDER = r"\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F"
#: Every run of borders that is not one space already.
_TIDY = rf"(?: [{_BORDER}]|[\x00-\x09\x0B-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F])[{_BORDER}]*"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    """The text with A-Z in lower case and one space between words; lines stay lines."""
    return F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), _TIDY, " ")


def run_length(n_words: int) -> int:
    """How many words the blocks have that lines do not bound, for a template of ``n_words``."""
    return -(-5 * n_words // 4)


def words_of(lines: Column) -> Column:
    """The whole text as one line of words with single spaces, none at the ends."""
    return F.trim(F.regexp_replace(lines, r" ?\n[ \n]*", " "))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def phrase_columns(words: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base_found over a line of words."""
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        sought = f" {phrase} "
        there = F.contains(padded, F.lit(sought))
        counts.append(F.when(there, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(0))
        first = spaces(F.substring(padded, 1, F.instr(padded, sought))) - 1
        start = F.length(padded) - F.instr(F.reverse(padded), sought[::-1]) - len(sought) + 2
        last = spaces(F.substring(padded, 1, start)) - 1
        firsts.append(F.when(there, first))
        lasts.append(F.when(there, last))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_words": F.when(words == "", 0).otherwise(spaces(words) + 1).cast("long"),
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base_found": F.array_compact(F.array(*labels)),
    }


def scan(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a text: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a template's words in one block, among those that reach ``threshold``; 1 where a phrase
    stands; else 0. Null texts are empty: no words, no labels, score 0. Repeated and null ids keep their rows.
    Ties in share need no order, as all labels that reach the threshold are given. ``templates`` is the driver's list; it
    is broadcast only where Spark finds it small.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    notices = [(label, sorted(set(text.split(" "))), run_length(len(text.split(" ")))) for label, texts in sorted(templates.items()) for text in texts]
    vocabulary = sorted({w for _, words, _ in notices for w in words})

    # the corpus's order of the templates' words: rare ones first
    lines = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_lines", lines_of(F.col("_text")))
    each = lines.select(F.explode(F.split(words_of(F.col("_lines")), " ")).alias("word")).filter(F.col("word").isin(vocabulary))
    times = {r["word"]: r["count"] for r in each.groupBy("word").count().collect()}  # one row a word of the templates at most
    place = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (times.get(w, 0), w)))}

    rows, named = [], []
    for label, words, run in notices:
        order = sorted(place[w] for w in words)
        need = math.ceil(threshold * len(order) - 1e-9)
        prefix = order[: len(order) - need + 1]
        rows += [(word, at, label, order, prefix, need) for at, word in enumerate(prefix)]
        in_order = sorted(words, key=place.__getitem__)
        named += [(word, at, label, in_order, need, run) for at, word in enumerate(in_order[: len(prefix)])]
    reach = max((r[5] for r in named), default=1) - 1
    around = spark.createDataFrame(named, "word string, at int, label string, words array<string>, need int, run int")
    table = spark.createDataFrame(rows, "word int, at int, label string, words array<int>, prefix array<int>, need int")

    # blocks as ordered sets of the templates' words; those without a prefix word or with too few words are no candidates
    known = F.array(*map(F.lit, vocabulary))
    places = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, place[w])])
    starts = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])
    least = min((r[5] for r in rows), default=1)
    shared = F.transform(
        F.filter(F.split("_lines", "\n"), lambda line: F.length(line) > 0), lambda line: F.array_intersect(F.split(line, " "), known)
    )
    blocks = F.transform(F.filter(shared, lambda b: F.size(b) >= least), lambda b: F.array_sort(F.transform(b, lambda w: places[w])))
    blocks = F.array_distinct(F.filter(blocks, lambda b: F.arrays_overlap(b, starts)))
    found = phrase_columns(words_of(F.col("_lines")))
    # around each prefix word, the words that a run which holds it can have
    begins = F.array(*[F.lit(w) for w in sorted({r[0] for r in named})])
    split = F.split(words_of(F.col("_lines")), " ")
    at_begins = F.filter(F.transform("_words", lambda w, i: F.when(F.array_contains(begins, w), F.struct(w.alias("word"), i.alias("i")))), lambda x: x.isNotNull())
    near = F.array_distinct(
        F.transform(at_begins, lambda x: F.struct(x["word"].alias("word"), F.slice("_words", F.greatest(x["i"] - reach, F.lit(0)) + 1, F.least(x["i"], F.lit(reach)) + 1 + reach).alias("near")))
    )
    columns = ["_id", F.xxhash64("_text").alias("_key"), *[c.alias(k) for k, c in found.items()], blocks.alias("_blocks"), F.when(F.arrays_overlap(split, begins), split).alias("_words")]
    base = scratch.keep(lines.select(*columns).withColumn("_near", near).drop("_words"))

    one = base.filter(F.size("_blocks") > 0).select("_id", "_key", F.explode("_blocks").alias("block"))
    one = one.select("*", F.posexplode("block").alias("from", "word"))
    pairs = one.join(table, "word")
    pairs = pairs.filter((F.size("block") >= F.col("need")) & (F.element_at(F.array_intersect("block", "prefix"), 1) == F.col("word")))
    pairs = pairs.filter(1 + F.least(F.size("words") - F.col("at") - 1, F.size("block") - F.col("from") - 1) >= F.col("need"))
    shares = pairs.withColumn("n", F.size(F.array_intersect("block", "words"))).filter(F.col("n") >= F.col("need"))
    runs = base.filter(F.size("_near") > 0).select("_id", "_key", F.inline("_near")).join(around, "word")
    left = F.size("words") - F.col("at") - 1
    shared_left = F.size(F.array_intersect(F.slice("words", F.col("at") + 2, F.greatest(left, F.lit(0))), "near"))
    runs = runs.filter((F.size("near") >= F.col("need")) & (F.col("at") + 1 + shared_left >= F.col("need")))
    most = F.array_max(F.transform(F.sequence(F.lit(1), F.size("near")), lambda i: F.size(F.array_intersect(F.slice("near", i, F.col("run")), "words"))))
    runs = runs.withColumn("n", most).filter(F.col("n") >= F.col("need"))
    shares = shares.select("_id", "_key", "label", "n", F.size("words").alias("of")).unionAll(runs.select("_id", "_key", "label", "n", F.size("words").alias("of")))
    hits = shares.groupBy(F.col("_id").alias("_i"), F.col("_key").alias("_k")).agg(
        F.collect_set("label").alias("more"), F.max(F.col("n") / F.col("of")).alias("share")
    )
    out = base.join(hits, base["_id"].eqNullSafe(hits["_i"]) & (base["_key"] == hits["_k"]), "left")
    nothing = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat("base_found", F.coalesce("more", nothing))))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base_found"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
