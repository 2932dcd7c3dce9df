"""License scans by diagonal voting, in DataFrame functions only.

All rolling word pairs of every text are hashed and joined to the positions they have in license
templates. A match votes for its diagonal, document position minus template position; votes on one
diagonal, and on near ones where a template is long, show a license text with its place. A phrase
stands exactly where its diagonal has every vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyspark.llm.base import query, table

# Phrases whose places are counted, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Further wording: a label is added where enough of its pairs vote for near diagonals. At most 64
# words each, as votes are bits.
WORDINGS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance "
     "with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the "
     "gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without "
     "fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution license", "cc-by"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("dedicated to the public domain", "public-domain"),
)
# Part of a wording's pairs that must vote; wordings under LONG pairs must stand whole.
VOTES, LONG = 0.7, 6
REACH = 2  # diagonals on each side that count as near

# a capital outside ASCII whose small letter is an ASCII one, and a letter without that property
_KELVIN, _OTHER = "K", "ĸ"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null counts as empty."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit(_OTHER)))
    return F.array_remove(F.split(low, _APART), "")


def template_pairs(spark: SparkSession) -> DataFrame:
    """(gram, a, b, template, at, bit, pairs): one row per word pair of each template; a few hundred rows."""
    rows = []
    for k, (text, _) in enumerate((*PHRASES, *WORDINGS)):
        words = text.split()
        rows += [(a, b, k, i, len(words) - 1) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    listed = ", ".join(f"('{a}', '{b}', {k}, {i}, {1 << i}L, {n})" for a, b, k, i, n in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t(a, b, template, at, bit, pairs)").select(
        F.xxhash64("a", "b").alias("gram"), "a", "b", "template", "at", "bit", "pairs"
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`,
    `labels`, `score`.

    `n_base` counts the places of `PHRASES`, first_word and last_word their smallest and largest
    first word (null without one). `labels` adds those of `WORDINGS`; both lists are sorted and
    comma-joined, empty without a label. `score` is the largest part of a labelled template's pairs
    that was found, 0 without one. Null text counts as empty. Rows with equal id and text give equal
    rows.
    """
    spark = docs.sparkSession
    # the templates are constants of this module, so their broadcast has a fixed size
    pairs = F.broadcast(template_pairs(spark))
    split = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("th"),
        license_words(F.col(text_col).cast("string")).alias("words"),
    ).withColumn("n", F.size("words"))
    # index -1 stands for the document itself, so one pass gives the documents and their votes
    walked = split.select(
        "id",
        "th",
        "n",
        "words",
        F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n") - 2, F.lit(-1)))).alias("i"),
    )
    word, following = F.get("words", F.col("i")), F.get("words", F.col("i") + 1)
    hashed = walked.select(
        "id",
        "th",
        "n",
        "i",
        F.when(F.col("i") >= 0, F.xxhash64(word, following)).alias("gram"),
        word.alias("w"),
        following.alias("v"),
    )
    met = hashed.join(pairs, "gram", "left").where(
        (F.col("i") < 0) | ((F.col("w") == F.col("a")) & (F.col("v") == F.col("b")))
    )
    votes = met.groupBy(
        "id", "th", "template", (F.col("i") - F.col("at")).alias("diag")
    ).agg(
        F.bit_or("bit").alias("bits"),
        F.first("pairs").alias("pairs"),
        F.max("n").alias("n"),
        F.sum((F.col("i") < 0).cast("bigint")).alias("copies"),
    )
    near = (
        Window.partitionBy("id", "th", "template")
        .orderBy("diag")
        .rangeBetween(-REACH, REACH)
    )
    label = F.element_at(
        F.array(*[F.lit(name) for _, name in (*PHRASES, *WORDINGS)]), F.col("template") + 1
    )
    base = F.col("template") < len(PHRASES)
    whole = F.bit_count("bits") == F.col("pairs")
    part = F.when(base | (F.col("pairs") < LONG), F.bit_count("bits")).otherwise(
        F.bit_count(F.bit_or("bits").over(near))
    ) / F.col("pairs")
    judged = votes.withColumn("part", part).select(
        "id",
        "th",
        "n",
        "copies",
        F.when(base & whole, F.col("diag")).alias("place"),
        F.when(base & whole, label).alias("base_label"),
        F.when((F.col("part") >= VOTES) & (whole | (~base & (F.col("pairs") >= LONG))), label).alias("label"),
        "part",
    )
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = judged.groupBy("id", "th").agg(
        F.max("n").cast("bigint").alias("n_words"),
        F.count("place").alias("n_base"),
        F.min("place").cast("bigint").alias("first_word"),
        F.max("place").cast("bigint").alias("last_word"),
        joined("base_label").alias("base_labels"),
        joined("label").alias("labels"),
        F.coalesce(F.round(F.max(F.when(F.col("label").isNotNull(), F.col("part"))), 6), F.lit(0.0)).alias("score"),
        F.sum("copies").alias("copies"),
    )
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        "labels", "score",
    )


def _oracle() -> str:
    rows, names = [], []
    for k, (text, label) in enumerate((*PHRASES, *WORDINGS)):
        words = text.split()
        names.append(f"({k}, '{label}')")
        rows += [f"('{a}', '{b}', {k}, {i}, {len(words) - 1})" for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    m = len(PHRASES)
    return f"""
WITH t(a, b, template, pos, pairs) AS (VALUES {", ".join(rows)}),
names(template, label) AS (VALUES {", ".join(names)}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
      FROM documents),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
g AS (SELECT rid, i, w, lead(w) OVER (PARTITION BY rid ORDER BY i) AS v FROM u),
votes AS (SELECT rid, template, i - pos AS diag, bit_or(CAST(1 AS BIGINT) << pos) AS bits,
                 any_value(pairs) AS pairs
          FROM g JOIN t ON g.w = t.a AND g.v = t.b GROUP BY 1, 2, 3),
near AS (SELECT *, bit_or(bits) OVER (PARTITION BY rid, template ORDER BY diag
                RANGE BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING) AS wide FROM votes),
j AS (SELECT rid, label, diag, template < {m} AS base, bit_count(bits) = pairs AS whole, pairs,
             bit_count(CASE WHEN template < {m} OR pairs < {LONG} THEN bits ELSE wide END)
               / CAST(pairs AS DOUBLE) AS part
      FROM near JOIN names USING (template)),
f AS (SELECT *, part >= {VOTES} AND (whole OR (NOT base AND pairs >= {LONG})) AS good FROM j),
a AS (SELECT rid, count(*) FILTER (base AND whole) AS n_base,
             min(diag) FILTER (base AND whole) AS first_word,
             max(diag) FILTER (base AND whole) AS last_word,
             array_to_string(list_sort(list(DISTINCT label) FILTER (base AND whole)), ',') AS base_labels,
             array_to_string(list_sort(list(DISTINCT label) FILTER (good)), ',') AS labels,
             round(max(part) FILTER (good), 6) AS score
      FROM f GROUP BY rid)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (rid)"""


@query(_oracle())
def op7_license_scan(spark, folder):
    return scan_licenses(table(spark, folder, "documents"))
