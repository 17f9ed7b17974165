"""Licence scans by a positional rare-token index, in DataFrame functions only.

A first pass counts in how many documents each licence word stands.  A second pass takes each document's licence words; of
every template whose key phrase they can make up, it looks up the document's highest-IDF words, turns each posting into
the start that the template would have, keeps starts on which a template's postings agree, and verifies the mandatory key
phrase there.  The base phrases are templates too; every place of theirs is reported.

Defined results: null or empty text has no words and no labels, first and last word null, score 0; labels are distinct,
sorted and comma-joined; repeated rows are scanned alike; an empty table gives no rows.  The score is the largest share of
a found template's words that stand at their places (1 for a base phrase).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Index words of a template, at most.
RAREST = 3
# The base phrases with their labels.
BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
# Label, first place of the key phrase, words of its notice, number of words of the key phrase.
TEMPLATES = [
    ("gpl-3", 3, "licensed under the gnu general public license version 3", 6),
    ("gpl", 10, "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 4),
    ("lgpl", 0, "gnu lesser general public license", 5),
    ("agpl", 0, "gnu affero general public license", 5),
    ("apache-2", 3, "licensed under the apache license version 2 0", 5),
    ("mit", 0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 12),
    ("bsd", 0, "redistribution and use in source and binary forms with or without modification are permitted", 8),
    ("isc", 0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 9),
    ("mpl", 11, "this source code form is subject to the terms of the mozilla public license", 3),
    ("epl", 14, "this program and the accompanying materials are made available under the terms of the eclipse public license", 3),
    ("cc-by-nc", 2, "licensed under cc by nc", 3),
    ("cc-by-sa", 2, "licensed under cc by sa", 3),
    ("cc-by-nd", 2, "licensed under cc by nd", 3),
    ("unlicense", 3, "this is free and unencumbered software released into the public domain", 9),
]


def templates() -> list[tuple[str, int, list[str], list[str]]]:
    """(label, place of the key phrase, template words, key phrase words), base phrases first."""
    out = [(label, 0, p.split(), p.split()) for label, p in BASE]
    return out + [(label, at, w, w[at : at + n]) for label, at, text, n in TEMPLATES for w in [text.split()]]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text after lower-casing.  Lower-casing beyond A-Z moves no word border and makes no template word."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def document_frequencies(docs: DataFrame) -> dict[str, int]:
    """In how many documents each word of the key phrases stands; at most one row per such word reaches the driver."""
    vocabulary = sorted({w for _, _, _, key in templates() for w in key})
    found = F.array_intersect(words(F.col("text")), strings(vocabulary))
    rows = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {w: 0 for w in vocabulary} | {r.word: r.n for r in rows}


def rarest(frequency: dict[str, int]) -> list[list[tuple[str, int]]]:
    """Per template: the rarest words of its key phrase with their places in the template, the highest IDF first."""
    out = []
    for _, at, _, key in templates():
        order = sorted(range(len(key)), key=lambda i: (frequency[key[i]], i))
        out.append([(key[i], at + i) for i in order[:RAREST]])
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    known = templates()
    rare = rarest(document_frequencies(docs))
    by_word: dict[str, list[tuple[int, int]]] = {}
    for t, posts in enumerate(rare):
        for word, r in posts:
            by_word.setdefault(word, []).append((t, r))
    postings = F.create_map(*[x for w, p in sorted(by_word.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(r).alias("r")) for t, r in p]))])
    vocabulary = strings(sorted({w for _, _, _, key in known for w in key}))
    need = strings([len(posts) for posts in rare])
    looked_up = F.array(*[strings(sorted({w for w, _ in posts})) for posts in rare])
    wanted_keys = F.array(*[strings(sorted(set(key))) for _, _, _, key in known])
    keys = F.array(*[strings(key) for _, _, _, key in known])
    full = F.array(*[strings(w) for _, _, w, _ in known])
    at = strings([a for _, a, _, _ in known])
    names = strings([label for label, _, _, _ in known])

    def possible(w: Column) -> Column:
        """Templates whose key phrase the document's licence words can make up."""
        every = F.sequence(F.lit(0), F.lit(len(known) - 1))
        return let(F.array_intersect(w, vocabulary), lambda own: F.filter(every, lambda t: F.size(F.array_except(F.get(wanted_keys, t), own)) == 0))

    def started(w: Column) -> Column:
        """(t, s): template t would start at word s, by the posting of each word that the document looks up."""

        def of(z: Column) -> Column:
            at_words = F.filter(F.sequence(F.lit(0), F.size(z["w"]) - 1), lambda i: F.array_contains(z["own"], F.get(z["w"], i)))
            posted = lambda i: F.filter(F.element_at(postings, F.get(z["w"], i)), lambda p: F.array_contains(z["ts"], p["t"]))
            found = F.flatten(F.transform(at_words, lambda i: F.transform(posted(i), lambda p: F.struct(p["t"].alias("t"), (i - p["r"]).alias("s")))))
            return F.when(F.size(z["ts"]) > 0, found).otherwise(F.array().cast("array<struct<t:int,s:int>>"))

        own = lambda ts: F.array_distinct(F.flatten(F.transform(ts, lambda t: F.get(looked_up, t))))
        return let(possible(w), lambda ts: let(F.struct(w.alias("w"), ts.alias("ts"), own(ts).alias("own")), of))

    def agreed(starts: Column) -> Column:
        """Starts that all looked-up words of their template give, once each; equal ones stand together after sorting."""
        first = lambda c, x, i: F.when(i > 0, F.get(c, i - 1) != x).otherwise(True)
        return let(F.array_sort(starts), lambda c: F.filter(c, lambda x, i: first(c, x, i) & (F.get(c, i + F.get(need, x["t"]) - 1) == x)))

    def verified(w: Column, starts: Column) -> Column:
        return F.filter(starts, lambda x: let(F.get(keys, x["t"]), lambda key: (x["s"] + F.get(at, x["t"]) >= 0) & (F.slice(w, x["s"] + F.get(at, x["t"]) + 1, F.size(key)) == key)))

    def share(w: Column, x: Column) -> Column:
        def of(t: Column) -> Column:
            there = F.size(F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.when(x["s"] + i >= 0, F.get(w, x["s"] + i) == F.get(t, i)).otherwise(False)))
            return there.cast("double") / F.size(t)

        return let(F.get(full, x["t"]), of)

    def summary(w: Column) -> Column:
        def of(hits: Column) -> Column:
            base = F.filter(hits, lambda x: x["t"] < len(BASE))
            label = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.get(names, x["t"])))), ",")
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.size(base).cast("long").alias("n_base"),
                F.array_min(F.transform(base, lambda x: x["s"])).cast("long").alias("first_word"),
                F.array_max(F.transform(base, lambda x: x["s"])).cast("long").alias("last_word"),
                label(base).alias("base_labels"),
                label(hits).alias("labels"),
                F.coalesce(F.array_max(F.transform(hits, lambda x: share(w, x))), F.lit(0.0)).alias("score"),
            )

        return let(verified(w, agreed(started(w))), of)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(words(F.col("text")), summary).alias("found"))
    return out.select("doc_id", "found.*")


def oracle() -> str:
    """DuckDB SQL for the same rows, by plain phrase search."""

    def words_of(w):
        return "[" + ", ".join(f"'{x}'" for x in w) + "]"

    parts = []
    for t, (label, at, w, key) in enumerate(templates()):
        same = " + ".join(f"(CASE WHEN s + {i} >= 0 AND w[s + {i + 1}] = '{x}' THEN 1 ELSE 0 END)" for i, x in enumerate(w))
        parts.append(f"SELECT doc_id, {t} AS t, '{label}' AS label, s, ({same})::DOUBLE / {len(w)} AS share FROM (SELECT doc_id, w, unnest(list_filter(range(len(w)), lambda i: w[i + 1] = '{key[0]}' AND w[i + 1 : i + {len(key)}] = {words_of(key)})) - {at} AS s FROM words)")
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), hits AS ({" UNION ALL ".join(parts)})
SELECT words.doc_id, any_value(len(w))::BIGINT AS n_words, count(s) FILTER (t < {len(BASE)})::BIGINT AS n_base,
       min(s) FILTER (t < {len(BASE)})::BIGINT AS first_word, max(s) FILTER (t < {len(BASE)})::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (t < {len(BASE)}))), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))), ','), '') AS labels,
       coalesce(max(share), 0.0)::DOUBLE AS score
FROM words LEFT JOIN hits USING (doc_id) GROUP BY words.doc_id
"""
