"""License scans by diagonal voting, with DataFrame operations only.

Every run of k words of a document is hashed. Runs whose hash some template has are joined to the template's positions;
each pair votes for a diagonal, the document position less the template position. A diagonal with enough votes is a
sighting of the template at that place. Neighbouring diagonals of the same template, which an inserted or lost word
makes, merge into one sighting. A vote only counts after its words were compared with the template's own, so spans hold
word by word. Two kinds of template exist: a phrase counts only where all its words stand consecutively, a text counts
from ``least_share`` of its runs on.

The rolling hashes of a document are filtered by the hashes of the templates before they leave its row: a pushed-down
semi join; the templates are a constant of a few hundred runs, so that set and the broadcast table of positions have a
fixed size. Only votes are shuffled, spread by document, template and diagonal.

Cases: a null text counts as empty; a text without words has no sightings. Documents of one id are one document: their
sightings are united, and each of the repeated rows is returned with them; a null id is an id of its own. Extra columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 2
LEAST_SHARE = 0.6
NEIGHBOURS = 3
"""Diagonals of one template that lie no further apart belong to one sighting."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels that the scan must count.
BASE_PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Public wording of common license notices.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
            " to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
            " free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, an empty array for fewer."""
    n = F.size(words) - (k - 1)
    out = F.slice(words, 1, F.greatest(n, F.lit(0)))
    if k == 2:
        return F.zip_with(out, F.slice(words, 2, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.transform(out, lambda _, i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def template_runs(spark: SparkSession, phrases=BASE_PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """A row for each run of each template: template, label, phrase, runs, t_pos, t_hash, t_words."""
    all_ = [(label, True, text) for label, text in phrases] + [(label, False, text) for label, text in notices]
    for _, _, text in all_:
        if len(text.split()) < k or not re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", text):
            raise ValueError(f"a template needs {k} words of a-z and 0-9 at least: {text!r}")
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.lit(p).alias("phrase"), F.split(F.lit(t), " ").alias("w")) for i, (a, p, t) in enumerate(all_)))
    t = spark.range(1).select(F.inline(rows)).withColumn("runs", F.size("w") - (k - 1))
    return t.select(
        "template", "label", "phrase", "runs", "w", F.posexplode(_grams(F.col("w"), k)).alias("t_pos", "t_hash")
    ).select("template", "label", "phrase", "runs", "t_pos", "t_hash", F.slice("w", F.col("t_pos") + 1, k).alias("t_words"))


def words_of(text: Column) -> Column:
    """Words of digits, letters and everything beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _PARTING), "")


def scan_sightings(docs: DataFrame, doc_id: str, words: str, phrases=BASE_PHRASES, notices=NOTICES, k: int = K, least_share: float = LEAST_SHARE) -> DataFrame:
    """Sightings of templates: doc_id, label, phrase, first_pos, last_pos (of their words), score."""
    spark = docs.sparkSession
    runs = template_runs(spark, phrases, notices, k)
    known = [r.t_hash for r in runs.select("t_hash").distinct().collect()]  # of the constant templates
    w = F.col(f"`{words}`")
    found = F.filter(F.transform(_grams(w, k), lambda h, i: F.struct(h.alias("hash"), i.alias("pos"))), lambda s: s["hash"].isin(known))
    votes = (
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(F.transform(found, lambda s: F.struct(s["hash"].alias("hash"), s["pos"].alias("pos"), F.slice(w, s["pos"] + 1, k).alias("seen")))).alias("v"))
        .select("doc_id", "v.hash", "v.pos", "v.seen")
        .join(F.broadcast(runs), (F.col("hash") == F.col("t_hash")) & (F.col("seen") == F.col("t_words")))
    )
    diagonals = votes.groupBy("doc_id", "template", "label", "phrase", "runs", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("seen"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    exact = diagonals.filter("phrase AND size(seen) = runs").select(
        "doc_id", "label", "phrase", F.col("low").alias("first_pos"), (F.col("high") + k - 1).alias("last_pos"), F.lit(1.0).alias("score")
    )
    return exact.unionByName(_merged(diagonals.filter("NOT phrase"), k, least_share))


def _merged(diagonals: DataFrame, k: int, least_share: float) -> DataFrame:
    """One sighting from the diagonals of a template that lie next to each other; each place of the template counts once in it."""
    from pyspark.sql import Window

    # Blocks bound what a window holds: diagonals of a template further apart than its length never merge.
    by = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    grouped = diagonals.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOURS).cast("int"), F.lit(1))).withColumn(
        "sighting", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    )
    places = grouped.withColumn("t_pos", F.explode("seen"))
    spans = places.groupBy("doc_id", "template", "label", "phrase", "runs", "sighting").agg(
        (F.count_distinct("t_pos") / F.first("runs")).alias("score"), F.min("low").alias("first_pos"), (F.max("high") + k - 1).alias("last_pos")
    )
    return spans.filter(F.col("score") >= least_share).select("doc_id", "label", "phrase", "first_pos", "last_pos", "score")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), words_of(F.col(f"`{text}`")).alias("words"))
    sightings = scan_sightings(rows, "doc_id", "words", **options)
    per_doc = sightings.groupBy(F.col("doc_id").alias("seen_id")).agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first_pos"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first_pos"))).cast("long").alias("last_word"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.sort_array(F.collect_set("label"))).alias("labels"),
        F.max("score").alias("score"),
    )
    counted = rows.select("doc_id", F.size("words").cast("long").alias("n_words"))
    joined = counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("seen_id")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
