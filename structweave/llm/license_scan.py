"""Licence scan by a positional rare-token index, in DataFrame operations only.

Each licence template is a sequence of words with mandatory key phrases. The index holds, per template, its rarest words
by inverse document frequency over the scanned corpus, with their places in the template. A text's words are looked up in
it; postings that agree on the start of the template (place in the text less place in the template) mark a match, which
counts once a key phrase is verified word for word in the text. The base phrases are templates that must stand as a whole.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

# The phrases of the base scan with their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Opening words of common licences, and the key phrases of which one must stand in a text.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("under the mit license", "released under the mit license")),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    ("gpl", "licensed under the gnu general public license", ("gnu general public license",)),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0", "mozilla public license version 2 0")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("cc-by-nc", "this work is licensed under cc by nc", ("cc by nc",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
)
#: Rare words per template, and per one of fewer than LONG words; the share of their weight that must agree on a start.
RARE, FEW, LONG = 4, 2, 8
AGREE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No template may be longer, so that the words around a hit hold all of its template.
CONTEXT = 32


def word_line(text: Column) -> Column:
    """The lower-cased words with one space before, between and after them; no words: one space."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), _GAP, " ")


def document_frequencies(words: DataFrame, wanted: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those that hold each wanted word; one row per wanted word at most comes back."""
    held = words.select(F.array_intersect("words", F.array(*map(F.lit, wanted))).alias("held"))
    counts = held.select(F.explode(F.array_append("held", "")).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in counts}
    return found.get("", 0), found


def rare_words(phrases: list[str], total: int, df: dict[str, int]) -> list[tuple[int, int, str, float]]:
    """(template, place, word, weight): each template's words of highest inverse document frequency; weights add up to 1.

    Of ties, and of a word that stands twice, the earliest place is taken.
    """
    out = []
    for t, phrase in enumerate(phrases):
        words = phrase.split()
        places = {w: words.index(w) for w in words}
        idf = {w: log((1 + total) / (1 + df.get(w, 0))) + 1 for w in places}
        chosen = sorted(places, key=lambda w: (-idf[w], places[w]))[: RARE if len(words) >= LONG else FEW]
        out += [(t, places[w], w, idf[w] / sum(idf[x] for x in chosen)) for w in chosen]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are their smallest and largest start
    (null without one); label columns are distinct, sorted and comma-joined. ``score``: the greatest share of rare-word
    weight that agrees with a verified match, 1 for a base phrase, 0 without a match. Null and empty texts have no words
    and no match; rows that repeat are judged alike; other columns are not read.
    """
    spark = docs.sparkSession
    phrases = [text for _, text, _ in templates] + [text for text, _ in base]
    assert all(len(p.split()) < CONTEXT for p in phrases)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), word_line(F.col(text_col).cast("string")).alias("line"))
    words = rows.select("_id", "_hash", F.split(F.trim("line"), " ").alias("words"), (F.length("line") - F.length(F.replace("line", F.lit(" "))) - 1).cast("bigint").alias("n_words"))
    wanted = sorted({w for p in phrases for w in p.split()})
    index = rare_words(phrases, *document_frequencies(words, wanted))
    looked_up = F.array(*[F.lit(w) for w in sorted({w for _, _, w, _ in index})])

    # Each place of a rare word with the words around it; texts without such a word stop at the first look.
    places = F.transform("words", lambda w, i: F.when(F.array_contains(looked_up, w), i))
    hits = F.when(
        F.arrays_overlap("words", looked_up),
        F.transform(F.filter(places, lambda i: i.isNotNull()), lambda i: F.struct(
            i.alias("i"), F.slice("words", F.greatest(i - CONTEXT, F.lit(0)) + 1, F.lit(2 * CONTEXT + 1)).alias("around"))),
    )
    looked = saved(words.select("_id", "_hash", "n_words", hits.alias("hits")), "licence-words")

    postings = spark.createDataFrame(index, "t int, place int, w string, weight double")
    label = F.element_at(F.array(*[F.lit(x[0]) for x in templates], *[F.lit(x[1]) for x in base]), F.col("t") + 1)
    phrase = F.element_at(F.array(*map(F.lit, phrases)), F.col("t") + 1)
    keys = F.element_at(F.array(*[F.array(*map(F.lit, x[2])) for x in templates], *[F.array(F.lit(x[0])) for x in base]), F.col("t") + 1)

    hit = looked.where("hits is not null").select("_id", "_hash", F.explode("hits").alias("h"))
    hit = hit.select("_id", "_hash", "h.i", "h.around", F.least("h.i", F.lit(CONTEXT)).alias("back"))
    found = hit.withColumn("w", F.element_at("around", F.col("back") + 1)).join(F.broadcast(postings), "w")  # a few words per template
    # Where the template stands in the text, as its words from there on read; a start before the text cannot be whole.
    found = found.withColumn("start", F.col("i") - F.col("place")).withColumn("from", F.col("back") - F.col("place"))
    size = F.size(F.split(phrase, " "))
    stands = F.slice("around", F.greatest("from", F.lit(0)) + 1, F.greatest(size + F.least("from", F.lit(0)), F.lit(0)))
    line = F.concat(F.lit(" "), F.array_join(stands, " "), F.lit(" "))
    whole = line == F.concat(F.lit(" "), phrase, F.lit(" "))
    keyed = F.exists(keys, lambda k: F.contains(line, F.concat(F.lit(" "), k, F.lit(" "))))
    is_base = F.col("t") >= len(templates)
    found = found.withColumn("verified", F.when(is_base, whole).otherwise(keyed)).where("verified")
    # Rows that repeat give a posting again; each counts once.
    postings_found = found.groupBy("_id", "_hash", "t", "start", "place").agg(F.max("weight").alias("weight"))
    matches = postings_found.groupBy("_id", "_hash", "t", "start").agg(F.sum("weight").alias("share")).where(is_base | (F.col("share") >= AGREE))
    only_base = F.when(is_base, F.col("start"))
    judged = matches.groupBy("_id", "_hash").agg(
        F.count(only_base).alias("n_base"), F.min(only_base).alias("first_word"), F.max(only_base).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.max(F.least("share", F.lit(1.0))).alias("score"),
    )
    same = F.col("a._id").eqNullSafe(F.col("b._id")) & F.col("a._hash").eqNullSafe(F.col("b._hash"))
    out = looked.select("_id", "_hash", "n_words").alias("a").join(judged.alias("b"), same, "left")
    return out.select(
        F.col("a._id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
