"""License scans by diagonal voting, with DataFrame functions only.

Every run of K words of a document is hashed and joined to the positions of the same run in the templates. A match
votes for the diagonal (position in the document minus position in the template); neighbouring diagonals of one
document and template are merged into a band, so a few inserted or missing words do not split a copy; a band is
verified by the share of the template's words that it covers and by the length of its span.

Places of the base phrases are found besides. Null texts count as empty: no words, no labels, score 0, null places.
Rows that are equal in id and text get equal results. Score: the best verified band's share of the template, at least
PHRASE_SCORE where a base phrase stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 4
MERGE_GAP = 3
"""Diagonals this far apart belong to one band."""
MIN_COVER = 0.7
MAX_STRETCH = 1.5
"""A span may have so many times the template's words."""
PHRASE_SCORE = 0.5
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases of the contract and the labels they stand for.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Widely used license notices, as words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
    ),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc", "this work is licensed under a creative commons attribution"),
)


def words_of(text) -> F.Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def template_grams(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """template, label, t_words, t_pos, gram: every run of k words of every template. A table of fixed size."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    own = spark.createDataFrame(rows, "template int, label string, t string").withColumn("w", F.split("t", " "))
    own = own.withColumn("t_words", F.size("w"))
    return own.select("template", "label", "t_words", F.posexplode(_grams("w", k)).alias("t_pos", "gram"))


def _grams(words: str, k: int) -> F.Column:
    """Hashes of all runs of k words of an array column."""
    parts = ", ".join(f"get({words}, i + {j})" for j in range(1, k))
    return F.expr(f"transform(slice({words}, 1, greatest(size({words}) - {k - 1}, 0)), (g, i) -> xxhash64(g, {parts}))")


def bands(words: DataFrame, keys: list[str], templates: DataFrame, k: int = K) -> DataFrame:
    """Verified bands: keys, template, label, start and stop (words, inclusive), cover, span_words."""
    runs = words.select(*keys, F.posexplode(_grams("words", k)).alias("pos", "gram"))
    hits = runs.join(F.broadcast(templates), "gram").withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    own = [*keys, "template", "label", "t_words"]
    votes = hits.groupBy(*own, "diagonal").agg(F.collect_set("t_pos").alias("t_at"))
    by = Window.partitionBy(*own).orderBy("diagonal")
    votes = votes.withColumn(
        "new", F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= MERGE_GAP, 0).otherwise(1)
    ).withColumn("band", F.sum("new").over(by))
    covered = votes.select(*own, "band", "diagonal", F.explode("t_at").alias("t")).select(
        *own, "band", (F.col("diagonal") + F.col("t")).alias("at"), F.explode(F.expr(f"sequence(t, t + {k - 1})")).alias("t")
    )
    found = covered.groupBy(*own, "band").agg(F.min("at").alias("start"), (F.max("at") + k - 1).alias("stop"), F.count_distinct("t").alias("n"))
    found = found.withColumn("span_words", F.col("stop") - F.col("start") + 1).withColumn("cover", F.col("n") / F.col("t_words"))
    return found.filter((F.col("cover") >= MIN_COVER) & (F.col("span_words") <= MAX_STRETCH * F.col("t_words"))).drop("n", "t_words")


def phrase_places(words: str = "words") -> dict[str, F.Column]:
    """For each label the starts of its phrases in an array column of words."""
    out = {}
    for phrase, label in PHRASES:
        parts = phrase.split()
        same = " and ".join(f"get({words}, i + {j}) = '{p}'" for j, p in enumerate(parts))
        out[label] = F.expr(f"filter(sequence(0, greatest(size({words}) - 1, 0)), i -> coalesce({same}, false))")
    return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), words_of(F.col(text)).alias("words"))
    found = bands(rows, ["doc_id", "h"], template_grams(docs.sparkSession))
    labels = found.groupBy("doc_id", "h").agg(F.collect_set("label").alias("own"), F.max(F.least(F.lit(1.0), "cover")).alias("best"))
    # Most texts lack the last word of every phrase; only the others are searched.
    none = F.expr("array()").cast("array<int>")
    places = {label: F.when(F.array_contains("words", "license"), p).otherwise(none) for label, p in phrase_places().items()}
    base = rows.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), *(p.alias(f"at_{label}") for label, p in places.items()))
    every = F.flatten(F.array(*(F.col(f"at_{label}") for label in places)))
    base = base.select(
        "doc_id", "h", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.filter(F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in sorted(places))), lambda x: x.isNotNull()).alias("base"),
    )
    same = base["doc_id"].eqNullSafe(labels["doc_id"]) & (base["h"] == labels["h"])
    joined = base.join(labels, same, "left").select(base["*"], "own", "best")
    return joined.select(
        F.col("doc_id").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", F.expr("array()").cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


_VALUES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
_GRAM = lambda w, i: "(" + " || ' ' || ".join(f"{w}[{i} + {j}]" for j in range(1, K + 1)) + ")"
_PLACE = lambda phrase: f"[i for i in range(len(w)) if " + " and ".join(f"w[i + {j + 1}] = '{p}'" for j, p in enumerate(phrase.split())) + "]"
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     t AS (SELECT template, label, string_split(words, ' ') AS w FROM (VALUES {_VALUES}) AS v(template, label, words)),
     tg AS (SELECT template, label, len(w) AS t_words, i AS t_pos, {_GRAM("w", "i")} AS gram FROM (SELECT *, unnest(range(len(w) - {K - 1})) AS i FROM t)),
     dg AS (SELECT doc_id, i AS pos, {_GRAM("w", "i")} AS gram FROM (SELECT *, unnest(range(len(w) - {K - 1})) AS i FROM d WHERE len(w) >= {K})),
     v AS (SELECT DISTINCT doc_id, template, label, t_words, pos - t_pos AS diagonal, t_pos FROM dg JOIN tg USING (gram)),
     g AS (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS before FROM (SELECT DISTINCT doc_id, template, diagonal FROM v)),
     b AS (SELECT *, sum(CASE WHEN diagonal - before <= {MERGE_GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS band FROM g),
     c AS (SELECT v.*, band, unnest(range(t_pos, t_pos + {K})) AS t FROM v JOIN b USING (doc_id, template, diagonal)),
     f AS (SELECT doc_id, label, count(DISTINCT t) * 1.0e0 / t_words AS cover, max(diagonal + t_pos) + {K} - min(diagonal + t_pos) AS span_words, t_words
           FROM c GROUP BY doc_id, template, label, t_words, band),
     m AS (SELECT doc_id, list(DISTINCT label) AS own, max(cover) AS best FROM f WHERE cover >= {MIN_COVER} AND span_words <= {MAX_STRETCH} * t_words GROUP BY doc_id),
     p AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{_PLACE(phrase)} AS at_{label}" for phrase, label in PHRASES)} FROM d),
     q AS (SELECT doc_id, n_words, at_mit || at_apache || at_gpl AS every,
                  list_filter([CASE WHEN len(at_apache) > 0 THEN 'apache' END, CASE WHEN len(at_gpl) > 0 THEN 'gpl' END, CASE WHEN len(at_mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS base FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
       array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(own, []))), ',') AS labels,
       greatest(coalesce(best, 0.0e0), CASE WHEN len(every) > 0 THEN {PHRASE_SCORE}e0 ELSE 0.0e0 END) AS score
FROM q LEFT JOIN m USING (doc_id)
"""
