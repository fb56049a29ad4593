"""Quality, PII, license scan, language ID, top-k and the pipeline."""

import math
import os
import random
import re
import unicodedata
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import language_id, license_scan, near_dedup, pii, quality, queries, topk
from quillon.llm.common import WordHashes, read_table

SMALL = "/root/testdata/sf0.001"


# quality -----------------------------------------------------------------------------------------


def slow_measures(text):
    text = text or ""
    words = [m.group() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def odd_texts():
    r = random.Random(9)
    cycle = " ".join("one two three four five six seven eight nine".split() * 3)
    return [None, "", " \n\t", "é\x85ü x", cycle, cycle + " end\n" + cycle, "a\na\n a\n\n\na", "#*$%&|<> " * 9, "w " * 40_000, *("".join(r.choice("ab \n#é") for _ in range(r.randint(0, 200))) for _ in range(60))]


def test_measures():
    words = WordHashes()
    for text in odd_texts():
        if text and len(text) > 10_000:
            continue
        assert quality.measure(text, words)[:5] == slow_measures(text), repr(text)


def test_quality_query(spark, tmp_path):
    texts = odd_texts()
    rows = [(k, t, True, 1, 2) for k, t in enumerate(texts)] + [(None, "x y", False, 1, 2), (0, None, False, 1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, kept boolean, n_words int, quality int").write.parquet(str(tmp_path / "documents.parquet"))
    found = quality.query(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept) and 0 <= r.quality <= 1
    assert next(r for r in found if r.n_words == 40_000).n_repeat_words == 40_000
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(frame).count() == 0


def test_estimate_finds_accuracies():
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.75
    rights = np.array([0.95, 0.9, 0.85, 0.8, 0.7, 0.5])
    right = r.random((20_000, 6)) < rights
    votes = np.where(right == truth[:, None], 1, -1) * (r.random((20_000, 6)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert abs(model.prior - 0.75) < 0.03
    assert np.abs(np.array([model.accuracy(k) for k in range(6)]) - rights).max() < 0.05


def test_quality_keeps_good_and_drops_bad(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    labels = read_table(spark, "/root/testdata/sf0.01", "labels")
    judged = quality.judge(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id")
    good = judged.where("label = 1 and not base_failed")
    assert good.where("not kept").count() <= 0.01 * good.count()
    assert judged.where("label = 0 and not kept").count() > 0.7 * judged.where("label = 0").count()


def test_letters_are_counted_in_characters():
    words = WordHashes()
    of = lambda text: dict(zip(quality.MEASURES, quality.measure(text, words), strict=True))
    assert of("\U0001f600" * 90)["n_letters"] == 0 and of("\U0001f600" * 90)["word_chars"] == 90
    assert (of("слово12345")["n_letters"], of("слово12345")["word_chars"], of("СЛОво é")["n_upper"]) == (5, 10, 3)
    r = random.Random(4)
    for _ in range(200):
        text = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x600), r.randrange(0x900, 0x980), r.randrange(0x4E00, 0x4F00), r.randrange(0x1F600, 0x1F640)])) for _ in range(30))
        letters = [c for c in text if c.isascii() and c.isalpha() or not c.isascii() and unicodedata.category(c)[0] in "LM"]
        assert of(text)["n_letters"] == len(letters) and of(text)["n_upper"] == sum(c.isupper() for c in text if c.isascii() and c.isalpha() or not c.isascii()), text


def test_rules_of_languages_beyond_the_first(spark):
    texts = {"sv": "det är en bok och jag har den på ett bord " * 6, "ru": "это не книга и он на столе как в доме " * 6, "hi": "यह एक किताब है और वह मेज पर है " * 8, "th": "คำ " * 60, "ar": "هذا كتاب على الطاولة في البيت " * 10, "junk": "xqz vvb kkw zzt " * 12, "digits": "слово12345 " * 60, "emoji": "\U0001f600 " * 60}
    judged = quality.judge(spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id long, text string")).collect()
    by = {name: row for name, row in zip(texts, sorted(judged, key=lambda r: r.doc_id), strict=True)}
    assert [by[k].vote_common_words for k in ("sv", "ru", "hi", "ar", "junk")] == [1, 1, 0, 0, -1]
    assert [by[k].vote_letters for k in ("sv", "ru", "hi", "digits", "emoji")] == [1, 1, 1, -1, -1]


def slow_quality(rows, rounds=200):
    """The posterior of each row of votes by EM, a document at a time."""
    rules, prior = len(rows[0]), 0.8
    chance = [{g: {-1: (0.2, 0.8)[not g], 0: 0.0, 1: (0.2, 0.8)[g]} for g in (0, 1)} for _ in range(rules)]

    def good(votes):
        odds = [1 - prior, prior]
        for g in (0, 1):
            for k, v in enumerate(votes):
                odds[g] *= chance[k][g][v] if v else 1
        return odds[1] / sum(odds)

    for _ in range(rounds):
        each = [good(votes) for votes in rows]
        mass = [len(rows) - sum(each), sum(each)]
        for k in range(rules):
            for g in (0, 1):
                start = {-1: (0.2, 0.8)[not g], 1: (0.2, 0.8)[g]}
                n = {v: sum(e if g else 1 - e for e, votes in zip(each, rows, strict=True) if votes[k] == v) + max(1, 0.01 * mass[g]) * start[v] for v in (-1, 1)}
                chance[k][g] = {v: n[v] / (n[-1] + n[1]) for v in n} | {0: 0.0}
        prior = min(0.99, max(0.01, mass[1] / len(rows)))
    return [good(votes) for votes in rows]


def test_posterior_is_brute_force(spark):
    r = random.Random(2)
    words = "the of and house garden river in light stone to is".split()
    texts = [" ".join(r.choices(words if k % 4 else ["zq", "#x", "QQQ", "vvv"], k=r.randint(15, 90))) + ("\nsame line" * 9 if k % 7 == 0 else "") for k in range(120)]
    judged = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    votes = {x.doc_id: [x[f"vote_{rule.name}"] for rule in quality.RULES] for x in judged}
    learned = [x.doc_id for x in judged if not x.base_failed]
    posterior = dict(zip(learned, slow_quality([votes[d] for d in learned]), strict=True))
    assert 20 < len(learned) < 120 and {x.kept for x in judged} == {True, False}
    for x in judged:
        if not x.base_failed:
            assert abs(x.quality - posterior[x.doc_id]) < 1e-6 and x.kept == (x.quality >= 0.5)


# PII ---------------------------------------------------------------------------------------------

LETTER = (
    "Mr. Schmidt wrote to Anna Schmidt and Maria Lopez at maria.lopez9@mail.example.com; call +1 (366) 555-9807 or 555-123-4567. "
    'Card 4111 1111 1111 1111, host 10.2.3.4, SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00, token = "0641917ea4e9feb9cda83477b57ac2654884f485", Анна Петрова.'
)


def test_find():
    kinds = [s[2].split(":")[0] for s in pii.find(LETTER)]
    assert kinds == ["surname", "given", "surname", "given", "surname", "email", "phone", "phone", "card", "ipv4", "ssn", "iban", "secret", "given", "surname"]
    clean = "On 3.4.2020 version 1.2.3 of 1234 5678 9012 3456 units cost 5,000; pages 100-200 at 12:30. The Mr sat. 9807915762804490 999.1.1.1"
    assert pii.find(clean) == []


def test_surrogates_keep_type_and_form():
    s = pii.Surrogates(b"key")
    new, spans = pii.replaced(LETTER, s, {})
    assert [k for _, _, k, _ in pii.find(new)] == [k for _, _, k, _ in pii.find(LETTER)] and len(spans) == 15
    old, now = ([x[3] for x in pii.find(t)] for t in (LETTER, new))
    assert all(a != b for a, b in zip(old, now, strict=True))
    assert now[0] == now[2] and len(set(now)) == len(set(old))  # coreference and distinctness
    assert pii.GENDER_OF[now[1]] == ("latin", "f") and pii.script_of(now[-1]) == "cyrillic"
    assert re.sub(r"\d", "0", now[6]) == "+0 (000) 000-0000" and now[12] == now[12].lower()
    assert pii.replaced(LETTER, pii.Surrogates(b"other"), {})[0] != new
    for span in spans:
        assert new[span["start"] : span["end"]] in now


@pytest.mark.parametrize("size", [1, 2, 3, 10, 26, 100, 223, 1000])
def test_numbers_are_permuted(size):
    s = pii.Surrogates(b"k")
    assert sorted(s.number("x", v, size) for v in range(size)) == list(range(size))
    assert all(s.number("x", s.number("x", v, size), size, back=True) == v for v in range(size))
    other = [s.another("x", v, size) for v in range(size)]
    assert sorted(other) == list(range(size)) and (size == 1 or all(v != w for v, w in enumerate(other)))


def test_long_secret_and_case():
    s = pii.Surrogates(b"k")
    value = "a1" * 900
    assert len(s.of("secret", value)) == 1800 and s.of("secret", value) != value
    new, _ = pii.replaced("To A.B@Mail.com or a.b@mail.com", s, {})
    upper, lower = (x[3] for x in pii.find(new))
    assert upper.lower() == lower and upper[0].isupper()


def test_collisions_get_another_try(spark):
    values = [f"name{k}" for k in range(3000)]
    s = pii.Surrogates(b"k")
    first = [s.of("surname:greek", v).lower() for v in values]
    taken = first[7]  # a surrogate that is itself an entity of the corpus
    rows = [("surname:greek", v) for v in [*values, taken]] + [("ssn", f"{k:03d}-00-0000") for k in range(200)]
    found = {(r.kind, r.value): r.attempt for r in pii.collisions(spark.createDataFrame(rows, "kind string, value string"), b"k").collect()}
    assert len(set(first)) < len(first) and found
    final = {(k, v): pii.entity(s.of(k, v, found.get((k, v), 0)), k) for k, v in rows}
    assert len({(k, x) for (k, _), x in final.items()}) == len(rows)
    assert not {(k, x) for (k, _), x in final.items()} & set(rows)


def test_pseudonymise(spark):
    rows = [(1, LETTER), (2, "plain text"), (3, None), (4, ""), (None, LETTER), (1, LETTER), (5, "x" * 50_000 + " 10.2.3.4")]
    frame = spark.createDataFrame([(*r, "a", 2, 3, 4) for r in rows], "doc_id long, text string, kind string, row int, value int, entities int")
    found = pii.pseudonymise(frame, b"k").collect()
    assert pii.pseudonymise(frame, b"k").columns == ["doc_id", "text", "kind", "row", "value", "n_entities", "entities"]
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add(r.text)
    assert by[1] == by[None] and len(by[1]) == 1 and LETTER not in by[1]
    assert by[2] == {"plain text"} and by[3] == {None} and by[4] == {""}
    host = [x[3] for x in pii.find(next(iter(by[1]))) if x[2] == "ipv4"][0]
    assert next(iter(by[5])).endswith(" " + host)
    assert pii.pseudonymise(frame.limit(0), b"k").count() == 0


def test_more_surnames_than_short_surrogates(spark):
    assert len(pii.SYLLABLES["latin"]) ** 3 * len(pii.SURNAME_END["latin"]) < 300_000
    values = spark.range(300_000).select(F.lit("surname:latin").alias("kind"), F.concat(F.lit("n"), F.col("id")).alias("value"))
    tries = {r.value: r.attempt for r in pii.collisions(values, b"k").collect()}
    s = pii.Surrogates(b"k")
    assert len({s.of("surname:latin", f"n{k}", tries.get(f"n{k}", 0)).lower() for k in range(300_000)}) == 300_000


def test_full_forms_widen(spark):
    """Every value of a form is an entity, so no surrogate of that form is free."""
    rows = [("email", f"{c}@{h}.com") for c in "abcdefghijklmnopqrstuvwxyz0" for h in "xyz"] + [("ssn", str(c)) for c in range(10)]
    found = {(r.kind, r.value): r.attempt for r in pii.collisions(spark.createDataFrame(rows, "kind string, value string"), b"k").collect()}
    s = pii.Surrogates(b"k")
    final = [pii.entity(s.of(k, v, found.get((k, v), 0)), k) for k, v in rows]
    assert len(set(final)) == len(rows) and max(found.values()) > pii.WIDEN
    values = {"email": "a.b@x.com", "ipv4": "1.2.3.4", "ipv6": "fe80::12", "card": "4111 1111 1111 1111", "ssn": "123-45-6789", "phone": "+1 (366) 555-9807", "iban": "DE89 3704 0044 0532 0130 00", "secret": "ab12cd34ef=="}
    for kind, value in values.items():
        assert len(s.of(kind, value, pii.WIDEN)) == len(value) or kind == "ipv4"
        longer = {s.of(kind, value, t) for t in range(pii.WIDEN + 1, pii.WIDEN + 6)}
        assert len(longer) == 5 and all(len(x) > len(value) or kind == "ipv4" for x in longer)


ODD = [
    "call +٩٦٦ ٥٠ ١٢٣ ٤٥٦٧ now", "تماس +۹۸ ۹۱۲ ۱۲۳ ۴۵۶۷", "card ４１１１ １１１１ １１１１ １１１１", "aİb@x.com and ßA@ǅ.com", "иван.Петров@почта.рф", "邮箱 张三@例子.com", "mail a@b.com你好",
    "DB_PASSWORD=hunter2hunter", "client_secret: 'a1b2c3d4e5'", "AWS_SECRET_ACCESS_KEY = abcDEF/123456", "auth_token=correcthorsebattery", "pwd: P@ssw0rd!x9",
    "555 123 4567", "020 7946 0958", "fe80::1ff:fe23:4567:890a", "2001:DB8:0:0:8:800:200C:417A", "+1 (366) 555-9807", "10.2.3.4", "123-45-6789",
    "Dr. Strange met Priya Sharma and Hiroshi Tanaka", "My name is Zebulon Quux", "From: Iker Etxeberria", "Dear Siobhan O'Neil", "меня зовут Пётр Иванов",
]


def test_no_entity_stays_and_none_meet(spark):
    texts = [*ODD, *(f"{a}; {b}" for a, b in zip(ODD, ODD[1:], strict=False)), LETTER]
    found = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"k").collect()}
    became = {}
    for k, text in enumerate(texts):
        own = pii.find(text)
        assert own and len(own) == found[k].n_entities, text
        for (_, _, kind, value), span in zip(own, found[k].entities, strict=True):
            new = found[k].text[span["start"] : span["end"]]
            assert new != value and became.setdefault((kind, pii.entity(value, kind)), pii.entity(new, kind)) == pii.entity(new, kind)
            # of the same form: digits, capitals and small letters of one script stay so
            if kind in ("phone", "card", "ssn"):
                assert [pii.alphabet_of(c) for c in new] == [pii.alphabet_of(c) for c in value]
    listed = {x for x in became if not x[0].startswith("given")}
    assert not {(kind, new) for (kind, _), new in became.items() if not kind.startswith("given")} & listed
    for kind in {k for k, _ in became}:
        new = [v for (k, _), v in became.items() if k == kind]
        assert len(set(new)) == len(new), kind


@pytest.mark.parametrize("key", [b"k", b"corpus pipeline", b"public test key", b"x"])
def test_no_given_name_stands_for_itself(key):
    s = pii.Surrogates(key)
    for (script, gender), names in pii.GIVEN.items():
        assert len(set(names)) == len(names)
        new = [s.of(f"given:{script}:{gender}", n) for n in names]
        assert sorted(new) == sorted(names) and all(a != b for a, b in zip(names, new, strict=True))


@pytest.mark.parametrize("clean", ["Karen National Union and Paul Street", "at 12:30:45, std::vector a::b, 10:20", "the secret: everything is fine; token: optional", "Dear Customer Service, from New York", "100 200 3000 4000", "he said: dear Sir Madam", "½ ² ① 12 345"])
def test_what_is_no_entity(clean):
    assert pii.find(clean) == []


def test_columns_of_any_name_are_carried(spark):
    frame = spark.createDataFrame([(1, "mail a1@x.com", 2, 3)], "doc_id long, text string, `a.b` int, `c``d` int")
    assert pii.pseudonymise(frame, b"k").columns == ["doc_id", "text", "a.b", "c`d", "n_entities", "entities"]
    assert pii.pseudonymise(frame, b"k").first()["a.b"] == 2


# license scan and other queries with SQL ----------------------------------------------------------


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            path = f"{folder}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{folder}/{t}.parquet") else "")
            con.execute(f"create view {t} as select * from '{path}'")
    frame = queries.queries()[name](spark, str(folder))
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    theirs = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in frame.collect()), key=repr) == theirs
    return theirs


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, SMALL, name)


LICENSES = [
    "MIT License and Apache License\nGNU General Public License", "mit\nlicense", "Summit license mit-LICENSE mit license", "ALL RIGHTS RESERVED", "rights reserved all over", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and files",
    "Licensed under the Apache License, Version 2.0", "under the apache licence version 2 0 licensed", "Éé mit é license", "mİt license, Kind", "", None, " \n ", "license " * 30_000 + "mit license", "this work is licensed under gnu public license version 3",
]


def test_license_edge_cases(spark, tmp_path):
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(LICENSES)]
    schema = "doc_id long, text string, label string, row int, held int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert len(compare(spark, tmp_path, "op4_license_scan")) == len(rows)
    again = license_scan.scan(spark.createDataFrame([(None, *rows[0][1:]), rows[0], rows[0], (0, None, "x", 1, 2)], schema)).collect()
    assert sorted((r.doc_id is None, r.n_words, r.labels) for r in again) == [(False, 0, ""), (False, 9, "apache,gpl,mit"), (False, 9, "apache,gpl,mit"), (True, 9, "apache,gpl,mit")]
    by = {r.doc_id: r for r in license_scan.query(spark, str(tmp_path)).collect()}
    assert (by[0].base_labels, by[0].n_base, by[0].first_word, by[0].last_word) == ("apache,gpl,mit", 3, 0, 6)
    assert (by[1].n_base, by[2].n_base, by[3].labels, by[3].n_base) == (1, 2, "all-rights-reserved", 0)
    assert by[5].labels == "mit" and by[5].n_base == 0 and 0.8 <= by[5].score < 1
    assert by[9].n_base == 0 and by[11].n_words == 0 and by[11].labels == "" and by[11].first_word is None and by[11].score == 0
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert license_scan.query(spark, str(tmp_path / "none")).count() == 0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:",
    "gpl": "// This program is free software; you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted",
}


def test_wrapped_notices_match_and_scattered_words_do_not(spark, tmp_path):
    scattered = ["All of these have the rights that were reserved", "released to the public under a license that MIT wrote", "redistribution\n" + "word " * 20 + "and use in source\n" + "word " * 20 + "and binary forms with or without modification are permitted"]
    alternating = "license general " * 20_000 + "all rights reserved"
    texts = [*WRAPPED.values(), *("filler words here " * 300 + t + " more filler " * 300 for t in WRAPPED.values()), *scattered, alternating]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    by = {r.doc_id: r for r in license_scan.query(spark, str(tmp_path)).collect()}
    for k, label in enumerate([*WRAPPED, *WRAPPED]):
        assert label in by[k].labels.split(",") and by[k].score >= 0.9, (k, by[k])
    assert [by[len(WRAPPED) * 2 + k].labels for k in range(4)] == ["", "", "", "all-rights-reserved"]


def test_random_texts_equal_the_license_sql(spark, tmp_path):
    r = random.Random(12)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    rows = []
    for k in range(150):
        words = []
        for _ in range(r.randint(1, 6)):
            template = r.choice(license_scan.TEMPLATES)[1].split()
            words += [w for w in template if r.random() < r.choice([0.75, 0.9, 1.0])] + r.choices(vocabulary + ["x", "y", "Z"], k=r.randint(0, 30))
        rows.append((k, "".join(w + r.choice([" ", "\n", ", ", "  "]) for w in words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sum(x[3] != "" for x in compare(spark, tmp_path, "op4_license_scan")) > 50


def test_license_scan_has_no_python(spark, monkeypatch):
    """Neither the last plan nor those of the tables written before it."""
    plans = []
    write = license_scan.saved
    monkeypatch.setattr(license_scan, "saved", lambda df, *rest: plans.append(df) or write(df, *rest))
    plans.append(license_scan.query(spark, SMALL))
    assert len(plans) == 3
    for frame in plans:
        assert not re.search("Python|Pandas|Arrow|ExternalRDD|MapPartitions", frame._jdf.queryExecution().executedPlan().toString())


# language ID ---------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = language_id.query(spark, folder).join(read_table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    total, right = found.count(), found.where("lang = lang_pred").count()
    assert total > 100 and right >= 0.97 * total
    assert found.where("score < 0 or score > 1").count() == 0


def test_held_out(spark):
    import zlib

    frame = spark.createDataFrame([(k,) for k in [*range(50), None]], "doc_id long")
    for r in frame.select("doc_id", language_id.held_out().alias("h")).collect():
        assert r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_edge_cases(spark, tmp_path):
    words = {"en": "the house and the garden with a river", "de": "das haus und der garten mit dem fluss", "fr": "la maison et le jardin avec une rivière", "xx": "zqzq qzzq zzqq qqzz"}
    r = random.Random(1)
    rows = [(k, " ".join(r.choices(words[lang].split(), k=30)), lang, 1.0, "y") for k in range(200) for lang in [list(words)[k % 4]]]
    rows += [(1000, None, "en", 1.0, "y"), (1001, "123 !?", "en", 1.0, "y"), (1002, "", None, 1.0, "y"), (1003, "das haus " * 20_000, None, 1.0, "y"), (None, "la maison et le jardin", "en", 1.0, "y"), (5, rows[5][1], "de", 1.0, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string").write.parquet(str(tmp_path / "documents.parquet"))
    found = language_id.query(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    by = {x.doc_id: x for x in found}
    assert [by[k].lang_pred for k in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "de", "fr"] and by[1000].score == 0
    assert sum(by[k].lang_pred == rows[k][2] for k in range(200)) >= 196
    spark.createDataFrame([(2, "abc", None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "u/documents.parquet"))
    assert language_id.query(spark, str(tmp_path / "u")).first().lang_pred == "und"
    assert language_id.predict(spark.createDataFrame([], "doc_id long, text string"), None).count() == 0


def test_numerals_are_no_letters(spark, tmp_path):
    rows = [(k, "the house and the garden", "en") for k in range(8)] + [(20, "½ ²", None), (21, "①②③ Ⅷ", None), (22, "½ a", None), (23, "北", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = {x.doc_id: x.lang_pred for x in language_id.query(spark, str(tmp_path)).collect()}
    assert [found[k] for k in (20, 21, 22, 23)] == ["und", "und", "en", "en"]
    odd = frame.select("doc_id", "text", F.lit(1).alias("a.b"), F.lit(2).alias("score"))
    assert language_id.predict(odd, None).columns == ["doc_id", "text", "a.b", "lang_pred", "score"]
    assert {x.doc_id for x in frame.where(language_id.has_letter(F.col("text"))).collect()} == {*range(8), 22, 23}


def slow_language(text, model):
    """Votes of all duels, trigram by trigram."""
    raw = f" {text.lower()} ".encode()
    count = {}
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        at = ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32) * 0x27D4EB2F % 2**32 >> 20
        count[at] = count.get(at, 0) + 1
    total = sum(count.values())

    def level(names, pairs, weights):
        if len(names) == 1:
            return names[0]
        votes, margins = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (a, b), w in zip(pairs, weights, strict=True):
            m = sum((n / total) ** 0.5 * w[at] for at, n in count.items()) + w[-1]
            votes[names[a if m >= 0 else b]] += 1
            margins[names[a]] += m
            margins[names[b]] -= m
        return max(sorted(names), key=lambda x: (votes[x], margins[x]))

    inside = model.within[level(model.families.names, model.families.pairs, model.families.weights)]
    return level(inside.names, inside.pairs, inside.weights)


def test_predictions_are_brute_force(spark):
    docs = read_table(spark, SMALL, "documents")
    model = language_id.fit(docs)
    rows = language_id.predict(docs, model).where("lang_pred <> 'und'").collect()
    assert len(rows) > 50 and all(x.lang_pred == slow_language(x.text, model) for x in rows)


# top-k ---------------------------------------------------------------------------------------------


def slow_top_k(rows, k=10, single=True):
    """Python's integers; of two lengths the components that both have count, and scores beyond 64 bits are cut in the end."""
    good = [(i, [math.floor(1024 * Fraction(float(np.float32(x)) if single else x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in good:
        asked.setdefault(i, v) if i % 100 == 0 else None
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:k]
        out += [(q, rank, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e4, 3e4])
def test_top_k_is_brute_force(spark, tmp_path, scale):
    r = np.random.default_rng(4)
    rows = [(k, (r.normal(size=8) * scale * r.choice([0.1, 1, 5])).tolist()) for k in range(700)]
    rows += [(1000 + k, rows[3][1]) for k in range(60)] + [(2000, None), (2001, []), (2100, [1.0] * 7 + [None]), (2200, [float("nan")] * 8), (2300, [float("inf")] + [1.0] * 7), (None, [9.0] * 8), (2400, [0.0] * 8), (3, rows[9][1])]
    spark.createDataFrame([(*row, 1, 2, 3) for row in rows], "vec_id long, embedding array<float>, pivot int, part int, score int").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = sorted(map(tuple, topk.query(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))
    assert found == slow_top_k(rows)


def test_top_k_of_huge_components_and_mixed_lengths(spark, tmp_path):
    r = np.random.default_rng(9)
    rows = [(k, (r.normal(size=r.choice([1, 3, 8, 8, 8, 40])) * r.choice([1.0, 1e3, 1e6, 1e9, 1e15, 1e30, 1e200], p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])).tolist()) for k in range(500)]
    rows += [(600, []), (700, [4e6] * 8), (701, [1e300] * 8), (800, [-1e300] * 8), (900, [float("inf")]), (901, [9e18, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = sorted(map(tuple, topk.query(spark, str(tmp_path)).collect()))
    assert found == slow_top_k(rows, single=False)
    assert {x[3] for x in found} >= {2**63 - 1, 0}


def test_exact_keys_sort_as_numbers():
    r = random.Random(1)
    values = [s * r.getrandbits(r.randint(60, 900)) for _ in range(300) for s in (1, -1)]
    assert sorted(values) == sorted(values, key=topk.exact_key)


def test_queries_skip_parts_and_annuli():
    """Clustered vectors: most annuli are never multiplied."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16)) * 1000
    rows = np.floor(centres[r.integers(0, 20, 20_000)] + r.normal(size=(20_000, 16)) * 30)
    pivots = topk.choose_pivots(rows[:500])
    near = ((rows[:, None] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)
    distance = np.linalg.norm(rows - pivots[near], axis=1)
    order = np.lexsort((distance, near))
    part = topk.Part(np.arange(20_000)[order], rows[order], near[order], distance[order], pivots)
    scores = rows[:50] @ rows.T
    np.fill_diagonal(scores, -np.inf)
    floors = np.sort(scores, axis=1)[:, -10]
    reach = topk.bounds(rows[:50], pivots, *part.rings) >= floors[:, None]
    assert reach.mean() < 0.5
    for n, (query, ids, found) in enumerate(part.search(np.arange(50), rows[:50], np.full(50, topk.LOWEST), 10)):
        assert query == n and sorted(found.tolist()) == sorted(np.sort(scores[n])[-10:].astype(int).tolist())


def test_top_k_of_few_and_none(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "a/embeddings.parquet"))
    assert [tuple(r) for r in topk.query(spark, str(tmp_path / "a")).collect()] == [(0, 1, 7, 1024 * 1024)]
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "b/embeddings.parquet"))
    assert topk.query(spark, str(tmp_path / "b")).count() == 0


# pipeline ------------------------------------------------------------------------------------------


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = read_table(spark, SMALL, "documents")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert near_dedup.near_duplicates(docs).where("not kept").count() == 0
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    packed = pipeline.run(spark, SMALL)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert [name for name, _ in pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "PII", "packing"]


def test_pipeline_edge_cases(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(6)
    words = {"en": "the house and garden with river stone light".split(), "de": "das haus und der garten mit dem fluss".split()}
    rows = [(k, " ".join(r.choices(words[lang], k=60)) + f"\n{k} mail me at person{k}@mail.example.com please now", lang, "s", 0) for k in range(60) for lang in [("en", "de")[k % 2]]]
    rows += [(100, rows[0][1], "en", None, None), (0, rows[0][1], "en", "s", 0), (101, None, None, None, None), (102, "", "en", "s", 0), (103, "!!! 123", "en", "s", 0), (None, "the house and the garden alone", "en", "s", 0), (104, "the river " * 30_000, None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = read_table(spark, str(tmp_path), "documents")
    found = pipeline.run(spark, str(tmp_path))
    ids = {x.doc_id for x in found.select("doc_id").distinct().collect()}
    assert ids == {*range(60), None, 104}
    assert found.where("doc_id = 104").agg(F.sum("length")).first()[0] > 50_000
    once = pipeline.language(spark, docs, str(tmp_path))
    assert once.columns == docs.columns and once.where("doc_id in (101, 102, 103)").count() == 0
    texts = pipeline.personal_data(spark, once, str(tmp_path)).select("text").collect()
    assert not any("person7@mail.example.com" in x.text for x in texts)
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_keeps_text_of_any_script(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    shared = "one line that stands in front of every document"
    own = ["Москва стоит на берегу реки", "Η Αθήνα είναι μεγάλη πόλη", "القاهرة مدينة كبيرة جدا", "दिल्ली एक बड़ा शहर है", "北京是一座古老的城市", "--- !!! ---"]
    rows = [(0, shared, "x", "s", 1), *((k, f"{shared}\n{line}", "x", "s", 1) for k, line in enumerate(own, 1))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in pipeline.lines(spark, frame, SMALL).collect()} == {0: shared, **dict(enumerate(own[:-1], 1))}


def test_pipeline_without_labels(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(4)
    texts = [" ".join(r.choices("the house and garden with river stone light".split(), k=40)) for _ in range(6)]
    rows = [(k, t, None, "s", 1) for k, t in enumerate([*texts, "Москва стоит", "²", None, "", "12 !?"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, schema)
    assert sorted(x.doc_id for x in pipeline.language(spark, frame, SMALL).collect()) == [*range(7)]
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id for x in pipeline.run(spark, str(tmp_path)).collect()} == {*range(7)}
    held = frame.withColumn("lang", F.lit("en")).where(language_id.held_out())
    assert held.count() and pipeline.language(spark, held, SMALL).count() == held.where("doc_id < 7").count()


def test_every_language_is_learned(spark, tmp_path):
    r = random.Random(8)
    words = {f"x{k:02d}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(60)}
    # the last ones are the rarest
    rows = [(n, " ".join(r.choices(words[lang], k=25)), lang) for n, lang in enumerate(lang for k, lang in enumerate(words) for _ in range(30 - k // 5))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {x.doc_id: x.lang_pred for x in language_id.query(spark, str(tmp_path)).collect()}
    assert {found[n] for n, _, _ in rows} == set(words)
    assert sum(found[n] == lang for n, _, lang in rows) >= 0.97 * len(rows)
