"""License scans: an exact set-similarity join of text blocks with notice templates.

Texts are cut into blocks of ``BLOCK`` words that overlap by half. A block takes a template's
label if it holds at least ``CONTAINED`` percent of the template's distinct tokens. Tokens are
ordered from the globally rarest to the most frequent; a block that meets the threshold must
hold one of the first |T| - need + 1 tokens of the template (prefix filter), must itself have
``need`` distinct words (length filter), and what may still follow the first common token on
either side must suffice (positional filter). Blocks that pass are counted exactly. Phrases of
``PHRASES`` are found beside that, word by word.

Scale: DataFrame operations only. Texts are read twice, for the tokens' document counts and
for the narrow facts; neither pass shuffles texts. The templates are a fixed table, so that
their tokens (under 200) may stand in the plan as literals. Only blocks with a rare template
token are ever exploded.

Defined results: null is the empty text, which has no words, no labels and score 0; repeated
rows repeat; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 64
CONTAINED = 80

# Phrases whose places are reported, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Opening words of published notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "this project is licensed under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright all rights reserved no part may be reproduced without prior written permission"),
)


def words(column: str = "text") -> Column:
    """Words of a text, A-Z in lower case."""
    lowered = F.translate(whole_text(column), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def need(tokens: set[str]) -> int:
    """Tokens of a template that a block must hold at least."""
    return -(-CONTAINED * len(tokens) // 100)


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template tokens from the rarest to the most frequent, by the documents that hold them."""
    held = docs.select(F.explode(F.array_intersect(words(), literal(vocabulary))).alias("token"))
    counts = {row.token: row["count"] for row in held.groupBy("token").count().collect()}  # vocabulary rows
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def places(phrase: str) -> Column:
    """Starts of a phrase in ``_words``; only texts that hold it are walked."""
    parts = phrase.split()
    stands = lambda i: F.array_contains(F.array(
        *[F.get(F.col("_words"), i + k) == p for k, p in enumerate(parts)]), False)
    walked = F.filter(F.sequence(F.lit(0), F.size("_words") - len(parts)), lambda i: ~stands(i))
    return F.when(F.contains(F.col("_joined"), F.lit(f" {phrase} ")), walked).otherwise(
        F.array().cast("array<int>")
    )


def find_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Per document: words, phrase places, labels of both kinds and the best containment."""
    docs = docs.select("doc_id", "text")
    sets = [(label, set(text.split())) for label, text in templates]
    order = token_order(docs, sorted(set().union(*[tokens for _, tokens in sets])))
    postings = []
    for number, (_, tokens) in enumerate(sets):
        ordered = [t for t in order if t in tokens]
        postings += [
            (token, number, place, len(tokens), need(tokens))
            for place, token in enumerate(ordered[: len(tokens) - need(tokens) + 1])
        ]
    rare = literal(sorted({p[0] for p in postings}))
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words().alias("_words"))
    split = split.withColumn("_joined", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    starts = [places(phrase) for phrase, _ in PHRASES]
    half = BLOCK // 2

    def block(i: Column) -> Column:
        part = F.slice("_words", i * half + 1, BLOCK)
        return F.struct(
            i.alias("block"),
            F.array_intersect(literal(order), part).alias("tokens"),
            F.size(F.array_distinct(part)).alias("distinct"),
        )

    # A last block of half length or less lies inside the one before it.
    last = F.greatest(F.lit(0), F.ceil(F.size("_words") / half).cast("int") - 2)
    blocks = F.filter(F.transform(F.sequence(F.lit(0), last), block), lambda b: F.arrays_overlap(b["tokens"], rare))
    none = F.array().cast("array<struct<block:int,tokens:array<string>,distinct:int>>")
    facts = split.select(
        "doc_id",
        "text_hash",
        F.size("_words").cast("bigint").alias("n_words"),
        F.array(*starts).alias("starts"),
        F.when(F.arrays_overlap("_words", rare), blocks).otherwise(none).alias("blocks"),
    )
    facts = settle(facts)
    index = docs.sparkSession.createDataFrame(
        postings, "token string, template int, place int, size int, need int"
    )
    tokens = (
        facts.select("doc_id", "text_hash", F.inline("blocks"))
        .select("doc_id", "text_hash", "block", "tokens", "distinct", F.posexplode("tokens").alias("at", "token"))
    )
    first = (
        tokens.join(index, "token")
        .where(F.col("distinct") >= F.col("need"))
        .groupBy("doc_id", "text_hash", "block", "template")
        .agg(F.min("at").alias("at"), F.min("place").alias("place"), F.first("size").alias("size"),
             F.first("need").alias("need"), F.first("tokens").alias("tokens"))
        .where(F.least(F.col("size") - F.col("place"), F.size("tokens") - F.col("at")) >= F.col("need"))
    )
    members = F.create_map(*[
        x for number, (_, tokens) in enumerate(sets) for x in (F.lit(number), literal(sorted(tokens)))
    ])
    label = F.element_at(literal([name for name, _ in sets]), F.col("template") + 1)
    met = (
        first.withColumn("both", F.size(F.array_intersect("tokens", F.element_at(members, F.col("template")))))
        .where(F.col("both") >= F.col("need"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(label).alias("more"), F.max(F.col("both") / F.col("size")).alias("best"))
        .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "more", "best")
    )
    every = F.flatten("starts")
    base = F.array_compact(F.array(*[
        F.when(F.size(F.col("starts")[i]) > 0, F.lit(name)) for i, (_, name) in enumerate(PHRASES)
    ]))
    named = F.array_sort(F.array_distinct(base))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("text_hash").eqNullSafe(F.col("_hash"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return facts.drop("blocks").join(met, same, "left").select(
        "doc_id",
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        F.array_join(named, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, more)), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
