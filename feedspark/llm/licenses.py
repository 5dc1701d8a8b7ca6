"""Operator 7: license scans by an exact set-similarity join, in DataFrame expressions alone.

A template is a known license text, a set of words; a text block is a window of WIDTH times as many consecutive
words of a document as the template has. Windows start at every word and take no notice of line breaks, so that a
wrapped wording is met, and words scattered over a long line are not. A block meets a template if it holds at
least THRESHOLD of the template's words. Words are put in one global order, by rising number of occurrences in all
documents. With n template words, a = ceil(THRESHOLD * n) of which are needed:

* prefix filter: a block that meets a template holds one of the template's first n - a + 1 words;
* length filter: the document, and the words within a window's length of that word, hold a template words at least;
* positional filter: a block starts at a word of the template, after the prefix word before, so that each block
  is confirmed once, at the first prefix word in it.

The prefixes of all templates form an index (a parameter of bounded size, so broadcast) that meets the documents'
prefix words in an equi-join. n_blocks counts for each template the blocks that do not overlap, from the first on.

Defined results: a null or empty text has no words, places or labels and score 0; rows that repeat an id or a
text, and null ids, give a row each; other columns are not read; the empty table gives no rows.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .literals import constant_table
from .url_filter import LOWER, UPPER

THRESHOLD = 0.9
#: Words of a block for each word of the template (the rest is room for words in between, such as comment marks).
WIDTH = 2
#: Everything but words (fixed value: words are runs of other characters).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters beyond ASCII whose lower case holds ASCII letters (fixed values).
TO_ASCII = ("\u0130", "\u212a")
#: Phrases looked for as they stand, and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public license wordings and their labels.
TEMPLATES = (
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl"),
)


def normal(text: Column) -> Column:
    """Words in lower case with one space between them.

    Phrases and templates are ASCII, so that lower case beyond A-Z shows in no result, but for the two characters that become
    ASCII letters by it: these are set apart first. (``translate`` of A-Z alone takes five times as long.)
    """
    for c in TO_ASCII:
        text = F.replace(text, F.lit(c), F.lit("÷"))
    return F.trim(F.regexp_replace(F.lower(text), BETWEEN, " "))


def words_of(text: Column) -> Column:
    n = normal(text)
    return F.when(n != "", F.split(n, " ")).otherwise(F.array().cast("array<string>"))


def _words(template: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in template.lower()).split()


def _set(template: str) -> list[str]:
    return sorted(set(_words(template)))


def frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Occurrences of the vocabulary's words in all texts (at most one row a word comes back)."""
    w = texts.select(F.explode(words_of(F.col("__text"))).alias("w")).where(F.col("w").isin(vocabulary))
    return {r["w"]: r["count"] for r in w.groupBy("w").count().collect()}


def template_matches(texts: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(__id, __text_key, label, containment, blocks) of every text of ``texts`` (__id, __text) and template that it meets."""
    sets = [(_set(t), label, len(_words(t))) for t, label in templates]
    vocabulary = sorted({w for s, _, _ in sets for w in s})
    seen = frequencies(texts, vocabulary)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, least = [], 1 << 30
    for t, (s, label, own) in enumerate(sets):
        s = sorted(s, key=rank.__getitem__)
        need = math.ceil(threshold * len(s) - 1e-9)
        least = min(least, need)
        prefix = s[:len(s) - need + 1]
        index += [(w, t, label, s, prefix, len(s), need, own, WIDTH * own) for w in prefix]
    prefixes = constant_table(texts.sparkSession, ["token", "t", "label", "template", "prefix", "n", "need", "own", "width"], index,
                              ["string", "int", "string", "array<string>", "array<string>", "int", "int", "int", "int"])
    widest = max((r[-1] for r in index), default=0)
    known, tokens = F.array(*[F.lit(w) for w in order]), sorted({r[0] for r in index})
    docs = texts.select("__id", F.xxhash64("__text").alias("__text_key"), words_of(F.col("__text")).alias("w"))
    docs = docs.where(F.arrays_overlap("w", F.array(*[F.lit(w) for w in tokens])) & (F.size(F.array_intersect(known, "w")) >= least))
    # the words around each prefix word, as far as a window that holds it reaches
    places = F.filter(F.sequence(F.lit(1), F.size("w")), lambda p: F.get("w", p - 1).isin(tokens))
    around = F.transform(places, lambda p: F.struct(
        F.get("w", p - 1).alias("token"), F.greatest(p - widest, F.lit(0)).alias("before"), F.least(p, F.lit(widest)).alias("at"),
        F.slice("w", F.greatest(p - widest + 1, F.lit(1)), F.least(p, F.lit(widest)) + widest - 1).alias("near")))
    firsts = docs.select("__id", "__text_key", F.inline(around))
    pairs = firsts.join(F.broadcast(prefixes), "token").where(F.size(F.array_intersect("template", "near")) >= F.col("need"))
    starts = F.filter(F.sequence(F.greatest(F.col("at") - F.col("width") + 1, F.lit(1)), F.col("at")), lambda j:
                      F.array_contains("template", F.get("near", j - 1)) & ~F.arrays_overlap(F.slice("near", j, F.col("at") - j), "prefix"))
    pairs = pairs.select("__id", "__text_key", "t", "label", "n", "need", "own", "width", "template", "near", "before", F.explode(starts).alias("j"))
    # places of the template's words in the window that starts at j
    pairs = pairs.withColumn("window", F.slice("near", F.col("j"), F.col("width")))
    pairs = pairs.withColumn("found", F.array_sort(F.filter(F.transform("template", lambda x: F.array_position("window", x)), lambda x: x > 0)))
    pairs = pairs.where(F.size("found") >= F.col("need"))
    end = F.col("before") + F.col("j") + F.get("found", F.col("need") - 1)
    met = pairs.groupBy("__id", "__text_key", "t", "label", "own").agg(
        F.max(F.size("found") / F.col("n")).alias("containment"),
        F.array_sort(F.collect_set(F.struct(end.alias("end"), (-F.col("before") - F.col("j")).alias("back")))).alias("spans"))
    blocks = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("free"), F.lit(0).cast("long").alias("n")), lambda a, x: F.when(
        -x["back"] >= a["free"], F.struct(F.greatest(x["end"], F.col("own") - x["back"]).cast("long").alias("free"), (a["n"] + 1).alias("n"))).otherwise(a))
    return met.select("__id", "__text_key", "label", "containment", blocks["n"].alias("blocks"))


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase among the words."""
    parts = phrase.split(" ")
    at = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for d, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + d) == p)
        return hit

    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= len(parts), F.filter(at, here)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, matched) of every row."""
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    none = F.array().cast("array<int>")
    base = texts.withColumn("__n", normal(F.col("__text"))).withColumn("__text_key", F.xxhash64("__text"))
    base = base.withColumn("n_words", F.when(F.col("__n") == "", 0).otherwise(F.length("__n") - F.length(F.replace("__n", F.lit(" "), F.lit(""))) + 1).cast("long"))
    # only texts that hold the common last word are looked at word by word
    words = F.when(F.contains("__n", F.lit("license")), F.split("__n", " ")).otherwise(F.array().cast("array<string>"))
    base = base.withColumn("__w", words)
    for i, (phrase, _) in enumerate(PHRASES):
        base = base.withColumn(f"__p{i}", F.when(F.size("__w") > 0, _places(F.col("__w"), phrase)).otherwise(none))
    places = F.concat(*[F.col(f"__p{i}") for i in range(len(PHRASES))])
    base = base.withColumn("__all", places).select(
        "__id", "__text_key", "n_words", F.size("__all").cast("long").alias("n_base"),
        F.array_min("__all").cast("long").alias("first_word"), F.array_max("__all").cast("long").alias("last_word"),
        F.array_distinct(F.filter(F.array(*[F.when(F.size(f"__p{i}") > 0, label) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())).alias("__base"))
    hits = template_matches(texts, templates, threshold).groupBy("__id", "__text_key").agg(
        F.collect_set("label").alias("__labels"), F.max("containment").alias("__c"), F.sum("blocks").alias("__m"))
    left, right = base.alias("l"), hits.alias("r")
    joined = left.join(right, F.col("l.__id").eqNullSafe(F.col("r.__id")) & (F.col("l.__text_key") == F.col("r.__text_key")), "left")
    found = F.coalesce(F.col("r.__labels"), F.array().cast("array<string>"))
    return joined.select(
        F.col("l.__id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort("__base")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("__base", found))).alias("labels"),
        F.greatest(F.coalesce(F.col("r.__c"), F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.coalesce(F.col("r.__m"), F.lit(0)).cast("long").alias("n_blocks"))


def op7(spark, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = ", ".join(f"({i}, {quoted(_set(t))}, '{label}', {math.ceil(THRESHOLD * len(_set(t)) - 1e-9)}, {len(_words(t))}::BIGINT)" for i, (t, label) in enumerate(TEMPLATES))
    between = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    norm = lambda x: f"trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '{between}', ' ', 'g'))"
    places = []
    for phrase, label in PHRASES:
        parts = phrase.split(" ")
        cond = " AND ".join(f"w[i + {d + 1}] = '{p}'" for d, p in enumerate(parts))
        places.append(f"list_transform(list_filter(range(0, len(w)), lambda i: {cond}), lambda i: {{'i': i, 'label': '{label}'}})")
    return f"""
WITH t(t, words, label, need, own) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS text, {norm("coalesce(text, '')")} AS n FROM documents),
e AS (SELECT row_number() OVER () AS r, doc_id, text, CASE WHEN n = '' THEN [] ELSE string_split(n, ' ') END AS w FROM d),
p AS (SELECT r, doc_id, text, len(w) AS n_words, list_concat(list_concat({places[0]}, {places[1]}), {places[2]}) AS ps FROM e),
b AS (SELECT r, t.*, w, unnest(list_filter(range(1, len(w) + 1), lambda j: list_contains(words, w[j]))) AS j FROM e JOIN t ON len(list_intersect(t.words, e.w)) >= t.need),
f AS (SELECT r, t, label, need, own, len(words) AS n, j, list_sort(list_filter(list_transform(words, lambda x: list_position(w[j:j + {WIDTH} * own - 1], x)), lambda x: x > 0)) AS found FROM b),
s AS (
  SELECT r, label, own, max(len(found) / n) AS c, list_sort(list(DISTINCT {{'a': (j + found[need])::BIGINT, 'b': (-j)::BIGINT}})) AS spans
  FROM f WHERE len(found) >= need GROUP BY r, t, label, own),
m AS (
  SELECT r, label, c, list_reduce(list_prepend({{'a': 0::BIGINT, 'b': 0::BIGINT}}, spans),
    lambda x, y: CASE WHEN -y.b >= x.a THEN {{'a': greatest(y.a, own - y.b), 'b': x.b + 1}} ELSE x END).b AS blocks FROM s),
g AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c, sum(blocks) AS n_blocks FROM m GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(ps, lambda x: x.i)) AS BIGINT) AS first_word, CAST(list_max(list_transform(ps, lambda x: x.i)) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(ps, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(ps, lambda x: x.label), coalesce(g.labels, [])))), ',') AS labels,
  greatest(coalesce(g.c, 0.0), CASE WHEN len(ps) > 0 THEN 1.0 ELSE 0.0 END) AS score, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM p LEFT JOIN g USING (r)
"""


OP7_SQL = _sql()
