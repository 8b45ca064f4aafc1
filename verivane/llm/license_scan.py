"""License scan: exact containment join of text blocks with license templates. DataFrame operations only.

A block is a line, or a run of words that line ends don't break (below). A line's token set and each template's are ordered by how many blocks of the whole corpus hold a
token, rarest first. A block B holds a template T if |B & T| >= a, a = ceil(THRESHOLD * |T|). Then
- length: |B & V| >= a, with V all templates' tokens (tokens outside V can't match and count for nothing),
- prefix: B's first |B & V| - a + 1 tokens and T's first |T| - a + 1 share one,
- position: 1 + min(what follows that token in T, what follows it in B) >= a at the first shared one,
are necessary, so that no pair is lost; survivors are verified on the full sets. Templates are a parameter of a
few short texts: only they are broadcast.

Notices are often wrapped: a text of several lines also holds T if ceil(words of T / THRESHOLD) words in a row do, wherever
its lines end. Only texts whose whole token set holds T are looked through. Inside one line such a run adds nothing to the line.

Each text is read once: its places and its lines' tokens of the vocabulary are written, and all else starts from there; texts that
may hold a wrapped notice are read again. Equal texts are searched once.

Null texts count as empty. Texts and lines are read whole, whatever their length. Tokens held by equally many blocks are
ordered by themselves. Repeated rows get equal results. Documents without a match have score 0. An empty table gives no
rows. Only doc_id and text are read, other columns may have any names.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.llm.common import ascii_lower, materialize, small_side, table, text_hashes

#: Fixed phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Label and wording of well-known license notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
THRESHOLD = 0.8

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text):
    """Lower-cased words; an empty one may stand at either end."""
    return F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text, n_words, phrases):
    """Columns of the phrases' places in a text: n_base, first_word, last_word, base_set."""
    words = lambda c: F.regexp_count(c, F.lit(f"{WORD}+"))
    either = "|".join(GAP.join(p.split()) for p, _ in phrases)
    pattern = rf"(?i)(?<!{WORD})(?:{either})(?!{WORD})"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    some = F.size(found) > 0
    label = lambda m: reduce(lambda e, p: F.when(m.rlike("(?i)^" + GAP.join(p[0].split()) + "$"), p[1]).otherwise(e), phrases, F.lit(None))
    return {
        "n_base": F.size(found).cast("long"),
        "first_word": F.when(some, words(F.element_at(between, 1)).cast("long")),
        "last_word": F.when(some, n_words - words(F.element_at(between, -1)) - words(F.element_at(found, -1))),
        "base_set": F.array_distinct(F.transform(found, label)),
    }


def read(docs: DataFrame, vocabulary: list[str], phrases) -> DataFrame:
    """doc_id, h and g (hash of the text), n_words, places(), lines (tokens of the vocabulary, in its order, of each line that has some), wrapped
    (whether there are several lines), written."""
    text = F.col("text")
    known = F.array(*[F.lit(v) for v in vocabulary])
    lines = F.transform(F.transform(F.split(text, "\n"), tokens), lambda w: F.struct(F.size(F.array_remove(w, "")).alias("n"), F.array_intersect(known, w).alias("b")))
    once = docs.select("doc_id", *text_hashes(), "text", lines.alias("each"))
    n_words = F.aggregate("each", F.lit(0).cast("long"), lambda sum, x: sum + x["n"])
    once = once.select("doc_id", "h", "g", "text", "each", n_words.alias("n_words"))
    held = F.filter(F.transform("each", lambda x: x["b"]), lambda b: F.size(b) > 0)
    columns = {**places(text, F.col("n_words"), phrases), "lines": held, "wrapped": F.size("each") > 1}
    return materialize(once.select("doc_id", "h", "g", "n_words", *[v.alias(k) for k, v in columns.items()]), "license-lines")


def wrapped(docs: DataFrame, lines: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """h, g, label, share of each template that a text of several lines holds: the most of its tokens in a run of words."""
    known = []
    for label, text in templates:
        words = re.findall(r"[0-9a-z]+", text)
        t = sorted(set(words))
        least, width = math.ceil(threshold * len(t) - 1e-9), math.ceil(len(words) / threshold - 1e-9)
        known.append(F.struct(F.lit(label).alias("label"), F.lit(least).alias("least"), F.lit(width).alias("width"), F.array(*map(F.lit, t)).alias("t")))
    several = lines.where(F.col("wrapped") & (F.size("lines") > 0)).select("h", "g", F.array_distinct(F.flatten("lines")).alias("own"))
    maybe = several.select("h", "g", F.filter(F.array(*known), lambda t: F.size(F.array_intersect("own", t["t"])) >= t["least"]).alias("maybe")).where(F.size("maybe") > 0)
    maybe = materialize(maybe.dropDuplicates(["h", "g"]), "license-wrapped")
    texts = docs.select(*text_hashes(), "text").join(small_side(maybe), ["h", "g"]).select("h", "g", tokens(F.col("text")).alias("w"), "maybe").dropDuplicates(["h", "g"])
    each = texts.select("h", "g", "w", F.inline("maybe"))
    starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_contains("t", F.element_at("w", i)))
    most = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("w", i, F.col("width")), "t"))))
    each = each.select("h", "g", "label", "least", most.alias("most"), F.size("t").alias("size"))
    return each.where("most >= least").select("h", "g", "label", (F.col("most") / F.col("size")).alias("share"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = [(label, sorted(set(re.findall(r"[0-9a-z]+", t)))) for label, t in templates]
    everything = sorted({w for _, s in sets for w in s})
    lines = read(docs, everything, phrases)
    counted = {x["w"]: x["n"] for x in lines.select(F.explode(F.flatten("lines")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(everything, key=lambda w: (counted.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, s in sets:
        s = sorted(s, key=rank.get)
        least = math.ceil(threshold * len(s) - 1e-9)
        rows += [(w, i, label, least, s) for i, w in enumerate(s[: len(s) - least + 1])]
    index = spark.createDataFrame(rows, "w string, i int, label string, least int, t array<string>")
    b = lines.select("h", "g", F.explode("lines").alias("b")).where(F.size("b") >= min(r[3] for r in rows)).distinct()
    b = b.withColumn("b", F.array_intersect(F.array(*map(F.lit, order)), "b"))
    hits = b.select("h", "g", "b", F.posexplode("b").alias("j", "w")).join(F.broadcast(index), "w")
    after_b, after_t = F.size("b") - F.col("j"), F.size("t") - F.col("i")  # the shared token and what follows it
    hits = hits.where((F.col("j") <= F.size("b") - F.col("least")) & (F.least(after_b, after_t) >= F.col("least")))
    overlap = F.size(F.array_intersect("b", "t"))
    found = hits.where(overlap >= F.col("least")).select("h", "g", "label", (overlap / F.size("t")).alias("share"))
    found = found.unionByName(wrapped(docs, lines, templates, threshold)).groupBy("h", "g").agg(F.collect_set("label").alias("found"), F.max("share").alias("best"))
    out = lines.join(small_side(materialize(found, "license-found")), ["h", "g"], "left")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base_set")).alias("base_labels"),
        joined(F.array_union("base_set", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same by comparing each line, and each run of words of texts of several lines, with each template, and each place with each phrase."""
    values = ", ".join(f"('{label}', {sorted(set(t.split()))}, {math.ceil(len(t.split()) / THRESHOLD - 1e-9)})" for label, t in TEMPLATES)
    words = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    at = lambda p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
    case = "CASE " + " ".join(f"WHEN {at(p)} THEN '{label}'" for p, label in PHRASES) + " END"
    return rf"""
WITH templates(label, t, width) AS (VALUES {values}),
docs AS (SELECT doc_id, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents),
runs AS (
  SELECT doc_id, label, t, list_max(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(t, w[i])), lambda i: len(list_intersect(list_distinct(w[i : i + width - 1]), t)))) AS most
  FROM (SELECT doc_id, w, list_distinct(w) AS b FROM docs WHERE contains(text, chr(10))), templates
  WHERE len(list_intersect(b, t)) >= ceil({THRESHOLD} * len(t) - 1e-9)
),
base AS (
  SELECT doc_id, len(w) AS n_words, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'i': i - 1, 'label': {case}}}), lambda x: x.label IS NOT NULL) AS p FROM docs
),
lines AS (SELECT doc_id, list_distinct({words.format("line")}) AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM (
    SELECT doc_id, label, len(list_intersect(b, t)) / len(t) AS share FROM lines, templates WHERE len(list_intersect(b, t)) >= ceil({THRESHOLD} * len(t) - 1e-9)
    UNION ALL SELECT doc_id, label, most / len(t) FROM runs WHERE most >= ceil({THRESHOLD} * len(t) - 1e-9)
  ) GROUP BY doc_id
)
SELECT doc_id, n_words, len(p) AS n_base, list_min(list_transform(p, lambda x: x.i)) AS first_word, list_max(list_transform(p, lambda x: x.i)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM base LEFT JOIN found USING (doc_id)
"""


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLE_SQL = {"op9_license_scan": _oracle()}
