"""License scans: an exact set-similarity join of text blocks with license templates.

DataFrame operations only. A template's blocks are all runs of a text's words that
are as long as the template and a quarter, wherever they start, so line breaks and
words put in between don't matter. A block's set are its distinct words. It matches
if it holds at least ``percent`` hundredths of the template's distinct words, or all
of them where they are fewer than ``WHOLE``.

Template words are ordered by how many texts of the corpus have them, the rarest
first. To reach ``need`` of a template's n words, a block must have one of its
first n - need + 1 (prefix), and ``need`` words at all (length), and from the first
word they share on there must be enough left of both (position). So texts without
enough words of any template go first; then only the surroundings of prefix words
are looked at, and what passes is counted on full sets, block by block.

Beside it stand the base phrases: places where a phrase's words follow one another.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
after A-Z are lower-cased.

Defined results: a null text is empty (no words, no labels, score 0); a null
doc_id is carried; repeated rows are scanned each for itself; other columns are
ignored; an empty table gives an empty result. A text of any length is split into
words at once; its template words are then searched in parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, saved

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label and text of each template; words in order, lower case. They are sentences and paragraphs of public licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("all-rights-reserved", "all rights reserved"),
)
#: Templates of fewer distinct words must be there whole.
WHOLE = 10
#: Template words of a text that are searched as one part.
PART = 1024


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters stay, unless none of them could turn into ASCII."""
    # lower() is many times faster than translate(); these two alone have ASCII letters among their small letters
    odd = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K"))
    return F.when(odd, F.translate(text, CAPITALS, SMALL)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """The words in order: between first and last, no piece is empty."""
    pieces = F.split(text, NOT_WORD)
    head = F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size(pieces) > 1) & (F.get(pieces, F.size(pieces) - 1) == ""), 1).otherwise(0)
    return F.slice(pieces, head + 1, F.size(pieces) - head - tail)


def need(n: int, percent: int) -> int:
    """The fewest of n words that reach the threshold."""
    return n if n < WHOLE else -(-n * percent // 100)


def window(length: int) -> int:
    """Words in a block for a template of so many."""
    return length + length // 4


def known_templates(templates: tuple, percent: int) -> list[dict]:
    out = []
    for k, (label, text) in enumerate(templates):
        own = sorted(set(text.split()))
        if own:
            out.append({"template": k, "label": label, "n": len(own), "need": need(len(own), percent), "window": window(len(text.split())), "words": own})
    return out


def _rows(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A table of a few fixed rows, made where it is used."""
    cell = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    structs = [F.struct(*[cell(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def matches(table: DataFrame, templates: list[dict]) -> DataFrame:
    """row, template, label and containment of the best block of every text and template at or above the threshold.

    ``table`` has row, held (a text's distinct template words) and spots (i, w: all
    of them with their places). What the driver reads and what is broadcast has a
    row for each word of the templates at most.
    """
    spark = table.sparkSession
    vocabulary = sorted({w for t in templates for w in t["words"]})
    counted = table.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()
    df = {r["word"]: r["df"] for r in counted}
    place = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (df.get(w, 0), w)))}
    prefix, whole = [], []
    for t in templates:
        own = sorted(t["words"], key=place.__getitem__)
        whole.append((t["template"], t["label"], t["n"], t["need"], t["window"], own))
        prefix += [(t["template"], w, place[w]) for w in own[: len(own) - t["need"] + 1]]
    prefixes, sets = _rows(spark, prefix, "template", "word", "place"), _rows(spark, whole, "template", "label", "n", "need", "window", "words")
    places = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    around = max(t["window"] for t in templates) - 1
    # parts of a text's spots, with what surrounds them
    at = F.explode(F.sequence(F.lit(0), F.expr(f"(size(spots) - 1) div {PART}")))
    start = F.greatest(F.col("part") * PART - around, F.lit(0))
    parts = table.where("spots is not null and size(spots) > 0").select("row", "spots", at.alias("part")).select(
        "row", (F.col("part") * PART - start).alias("first"), F.slice("spots", start + 1, F.lit(PART + 2 * around)).alias("spots"))
    rare = sorted({w for _, w, _ in prefix})

    def anchor(s: Column, k: Column) -> Column:
        mine = (k >= F.col("first")) & (k < F.col("first") + PART) & s["w"].isin(rare)
        near = F.slice(F.col("spots"), F.greatest(k - around, F.lit(0)) + 1, F.lit(2 * around + 1))
        return F.when(mine, F.struct(s["i"].alias("a"), s["w"].alias("word"), near.alias("near")))

    anchors = parts.select("row", F.explode(F.array_compact(F.transform("spots", anchor))).alias("x")).select("row", "x.*")
    met = anchors.join(F.broadcast(prefixes), "word").join(F.broadcast(sets), "template")
    mine = F.filter("near", lambda s: (s["i"] > F.col("a") - F.col("window")) & (s["i"] < F.col("a") + F.col("window")) & F.array_contains("words", s["w"]))
    # the words that are left to be shared from this one on, in global order
    left = F.size(F.filter(F.array_distinct(F.col("near")["w"]), lambda w: F.element_at(places, w) >= F.col("place")))
    near = met.withColumn("near", mine).where(F.size("near") >= F.col("need")).where(left >= F.col("need"))

    def shared(s: Column) -> Column:
        block = F.filter("near", lambda x: (x["i"] >= s["i"]) & (x["i"] < s["i"] + F.col("window")))
        return F.size(F.array_distinct(F.transform(block, lambda x: x["w"])))

    best = F.array_max(F.transform(F.filter("near", lambda s: s["i"] <= F.col("a")), shared))
    passed = near.withColumn("both", best).where("both >= need")
    return passed.groupBy("row", "template", "label").agg(F.max(F.col("both") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, percent: int = 80) -> DataFrame:
    """doc_id, n_words, base places and labels, all labels, score (the highest containment, 1 where a phrase stands)."""
    known = known_templates(templates, percent)
    phrases = {p: p.split() for p in PHRASES}
    vocabulary = sorted({w for t in known for w in t["words"]} | {w for words in phrases.values() for w in words})
    text = lowered(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(text).alias("words"))
    held = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    scanned = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), held.alias("held"))

    def places(words: list[str]) -> Column:
        w = F.col("words")

        def whole(i: Column) -> Column:
            here = F.get(w, i) == words[0]
            for k, word in enumerate(words[1:], 1):
                here = here & F.coalesce(F.get(w, i + k) == word, F.lit(False))
            return here

        # no text without a phrase's last word has it
        found = F.filter(F.transform(w, lambda x, i: i), whole)
        return F.when(F.array_contains("held", words[-1]), found).otherwise(F.array().cast("array<int>"))

    starts = [places(words).alias(f"at_{k}") for k, words in enumerate(phrases.values())]
    could = F.lit(False)
    for t in sorted(known, key=lambda t: t["need"]):
        could = could | (F.size("held") >= t["need"]) & (F.size(F.array_intersect("held", F.array(*map(F.lit, t["words"])))) >= t["need"])
    every = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: s["w"].isin(vocabulary))
    told = scanned.select("doc_id", "n_words", "words", "held", *starts, could.alias("could"))
    spotted = told.select("doc_id", "n_words", *[f"at_{k}" for k in range(len(phrases))], F.when(F.col("could"), F.col("held")).alias("held"), F.when(F.col("could"), every).alias("every"))
    # inside a run of one word, its first and last place stand for all: a block with another word has one of them
    edge = lambda s, k: (k == 0) | (k == F.size("every") - 1) | (F.get("every", k - 1)["w"] != s["w"]) | (F.get("every", k + 1)["w"] != s["w"])
    # the row's own name: rows of one doc_id stay apart
    table = saved(spotted.withColumn("spots", F.filter("every", edge)).drop("every").withColumn("row", F.monotonically_increasing_id()), "license-rows")
    some = saved(matches(table.where("held is not null").select("row", "held", "spots"), known), "license-matches")
    found = some.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    every_place = F.concat(*[F.col(f"at_{k}") for k in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(PHRASES[p])) for k, p in enumerate(phrases)]))
    none = F.array().cast("array<string>")
    joined = table.drop("held", "spots").join(found, "row", "left")
    return joined.select(
        "doc_id", "n_words", F.size(every_place).cast("long").alias("n_base"), F.array_min(every_place).cast("long").alias("first_word"), F.array_max(every_place).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", none)))), ",").alias("labels"),
        F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.size(base) > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle(templates: tuple = TEMPLATES, percent: int = 80) -> str:
    """The same by brute force: every block that starts with a template's word."""
    texts = ", ".join(f"({t['template']}, '{t['label']}', {t['n']}, {t['need']}, {t['window']}, string_split('{' '.join(t['words'])}', ' '))" for t in known_templates(templates, percent))
    phrases = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES.items())
    return rf"""
with docs as (select doc_id, translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}') t from documents),
words as (select doc_id, regexp_extract_all(t, '{WORD}') w, t from docs),
phrases(label, p) as (values {phrases}),
spots as (
  select doc_id, label, i - 1 as spot from (select doc_id, w, unnest(range(1, len(w) + 1)) i from words where t like '%license%'), phrases
  where list_slice(w, i, i + len(p) - 1) = p),
base as (select doc_id, count(*) n_base, min(spot) first_word, max(spot) last_word, list_sort(list(distinct label)) ls from spots group by 1),
templates(k, label, n, need, span, s) as (values {texts}),
own as (select k, n, need, span, unnest(s) x from templates),
each as (select doc_id, unnest(w) x, unnest(range(0, len(w))) i from words),
places as (select doc_id, k, n, need, span, x, i from each join own using (x)),
could as (select doc_id, k from places group by doc_id, k, need having count(distinct x) >= need),
likely as (select * from places semi join could on places.doc_id = could.doc_id and places.k = could.k),
blocks as (
  select a.doc_id, a.k, a.n, a.need, count(distinct b.x) c
  from likely a join likely b on a.doc_id = b.doc_id and a.k = b.k and b.i >= a.i and b.i < a.i + a.span
  group by a.doc_id, a.k, a.n, a.need, a.i having count(distinct b.x) >= a.need),
method as (select doc_id, list(distinct label) ls, max(c / blocks.n) score from blocks join templates using (k) group by 1)
select words.doc_id, cast(len(w) as bigint) n_words, coalesce(n_base, 0) n_base, first_word, last_word,
  coalesce(array_to_string(base.ls, ','), '') base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(method.ls, [])))), ','), '') labels,
  greatest(coalesce(method.score, 0.0), case when n_base > 0 then 1.0 else 0.0 end)::double score
from words left join base using (doc_id) left join method using (doc_id)
"""


ORACLE_SQL = oracle()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
