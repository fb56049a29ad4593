"""Components, runs, near-dedup and line dedup against brute force."""

import random
import re
import unicodedata
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import line_dedup, linkage, near_dedup
from quillon.llm.common import read_table, scratch_root
from quillon.llm.graph import connected_components


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)], [(9, 9), (5, 4), (4, 5), (7, 4)], [(random.Random(k).randint(0, 60), random.Random(k + 99).randint(0, 60)) for k in range(45)]])
@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, edges, one_task):
    frame = spark.createDataFrame(edges, "u long, v long")
    rows = connected_components(frame, one_task=one_task).collect()
    found = {r.node: r.component for r in rows}
    assert len(rows) == len(found)
    assert found == components([e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components_of_names_and_nulls(spark, one_task):
    frame = spark.createDataFrame([("b", "a"), ("c", "b"), (None, "a"), ("d", None)], "u string, v string")
    assert {r.node: r.component for r in connected_components(frame, one_task=one_task).collect()} == {"a": "a", "b": "a", "c": "a"}


@pytest.mark.parametrize("block", [3, 1000])
def test_runs_lose_no_link(spark, block):
    r = random.Random(block)
    rows = [(r.randint(0, 4), k, r.randint(0, 30)) for k in range(120)] + [(99, 500, 1)]
    frame = spark.createDataFrame(rows, "g long, node long, x long")

    def matcher(batch):
        x = batch.column(1).to_numpy()
        return np.arange(len(x)), lambda k, others: abs(x[others] - x[k]) <= 1

    found = linkage.linked(frame, "g", "node", ["node", "x"], matcher, block=block).collect()
    expected = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 1]
    assert components(map(tuple, found)) == components(expected)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def near_model(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    edges = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[k + 1 :] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    name = components(edges)
    return sorted(((d, len(shingles(t, width)), None if d is None else name.get(d, d), d is not None and name.get(d, d) == d) for d, t in rows), key=repr)


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [r.choice(words) for _ in range(r.choice([4, 25, 80, 200]))]
        for copy in range(r.randint(1, 9)):
            own = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((1000 - base * 20 - copy, ("The " if copy % 2 else "the ") + " ".join(own)))
    rows += [(2, "the common opening line of all " + " ".join(r.choice(words) for _ in range(40))), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "ONE"), (8, "two words"), (None, "one"), (None, None), (9, "É é"), (10, "é é")]
    return rows


@pytest.mark.parametrize(("width", "percent", "matches"), [(3, 85, 28), (5, 80, 24), (1, 50, 8)])
def test_near_duplicates_are_brute_force(spark, width, percent, matches):
    rows = corpus()
    frame = spark.createDataFrame([(*row, 1, "x", 2, 3) for row in rows], "doc_id long, text string, class int, set_md5 string, component int, signature int").repartition(3)
    found = sorted(map(tuple, near_dedup.near_duplicates(frame, width, percent, 48, matches).collect()), key=repr)
    assert found == near_model(rows, width, percent)


def test_near_duplicates_of_repeated_rows(spark):
    a, b = "x y z " * 20 + "one", "p q r s t u v " * 9
    rows = [(5, a), (5, a), (3, b), (3, a), (8, b)]
    found = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {5: (3, False), 3: (3, True), 8: (3, False)}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_shares_estimate_the_similarity():
    functions = near_dedup.hash_functions(2000)
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 1200, dtype=np.uint64)
    a, b = near_dedup.signature(np.sort(pool[:1000]), *functions), near_dedup.signature(np.sort(pool[200:]), *functions)
    assert abs((a == b).mean() - 800 / 1200) < 0.04


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(8)
    for _ in range(4000):
        a = "".join(r.choice("abc ") for _ in range(r.randint(0, 15)))
        b = "".join(r.choice("abc ") for _ in range(r.randint(0, 15))) if r.random() < 0.5 else a[: r.randint(0, 15)] + "x" + a[3:]
        most = r.randint(0, 9)
        assert line_dedup.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1), (a, b, most)


def test_distance_by_parts_is_no_less():
    r = random.Random(4)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 6))) for _ in range(40)]
    close = []
    for _ in range(400):
        a = r.choices(words, k=r.randint(0, 40))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.choice([0, 1, 1, 3])] = r.choices(words, k=r.choice([0, 1, 1, 2]))
        a, b = " ".join(a), " ".join(b)
        true, most = levenshtein(a, b), max(len(a), len(b)) * 15 // 100
        found = line_dedup.distance_by_parts(a, b, most + most // 4)
        assert found >= true or found > most + most // 4
        if true <= most:
            close.append(found <= most + most // 4)
    assert len(close) > 100 and np.mean(close) > 0.98


def plain(line):
    """The normalised line, character by character."""
    kept = ["0" if c.isdecimal() else c if c.isalnum() or unicodedata.category(c)[0] == "M" else " " for c in line.lower()]
    return " ".join("".join(kept).split())


def within(a, b, most):
    """Whether the edit distance is ``most`` or less, by the plain table near its diagonal."""
    if abs(len(a) - len(b)) > most or max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total()) > most:
        return False  # each edit changes one character of the bag
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, c in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, most) + 1, new.get(j - 1, most) + 1, row.get(j - 1, most) + (j == 0 or c != b[j - 1])) if j else i
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), most + 1) <= most


def line_model(rows, percent=85):
    """Places (doc, line) to remove by plain edit similarity of all pairs, and the linked pairs."""
    places = [(doc, k, name) for doc, text in rows for k, line in enumerate(text.split("\n")) if (name := plain(line))]
    names = sorted({p[2] for p in places}, key=len)
    edges = []
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            if within(a, b, len(b) * (100 - percent) // 100):
                edges.append((a, b))
    group = components(edges)
    firsts = {}
    for doc, k, name in places:
        name = group.get(name, name)
        firsts[name] = min(firsts.get(name, (doc, k)), (doc, k))
    return {(doc, k) for doc, k, name in places if firsts[group.get(name, name)] != (doc, k)}, edges


def near_lines(seed=2):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(300)]
    rows = []
    base = [" ".join(r.choice(words) for _ in range(r.choice([2, 5, 12, 60, 90]))) for _ in range(25)]
    for doc in range(40):
        lines = []
        for _ in range(r.randint(1, 5)):
            line = r.choice(base).split(" ")
            if r.random() < 0.5:
                line[r.randrange(len(line))] = r.choice(words)
            lines.append(" ".join(line).capitalize() + r.choice(["", ".", " 12", " 34"]))
        rows.append((doc, "\n".join(lines)))
    return rows


def removed(rows, found):
    """Places of the lines that are gone, from whole texts."""
    gone = set()
    for doc, text in rows:
        lines = text.split("\n")
        left = found[doc][0].split("\n") if found[doc][1] < len(lines) else []
        at = 0
        for k, line in enumerate(lines):
            if at < len(left) and left[at] == line:
                at += 1
            else:
                gone.add((doc, k))
        assert at == len(left)
    return gone


def test_line_dedup_is_brute_force(spark):
    rows = near_lines()
    expected, edges = line_model(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup.dedup_lines(frame).collect()
    found = removed(rows, {r.doc_id: (r.text, r.n_lines_removed) for r in out})
    assert len(edges) > 50 and found <= expected
    assert len(found) >= 0.9 * len(expected)
    assert sum(r.n_lines_removed for r in out) == len(found)


def test_line_dedup_recall_on_the_small_tables(spark):
    """Against plain edit similarity of all pairs of lines of up to 150 characters."""
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").where("text is not null").select("doc_id", F.expr("array_join(filter(split(text, '\\n'), x -> length(x) < 150), '\\n')").alias("text"))
    rows = [tuple(r) for r in docs.collect()]
    expected, edges = line_model(rows)
    found = removed(rows, {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup.dedup_lines(docs).collect()})
    assert expected and found <= expected and len(found) >= 0.9 * len(expected)


def test_lines_with_changed_words_meet():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))).encode() for _ in range(5000)]
    share = {}
    for n, changes in ((6, 1), (9, 1), (14, 1), (20, 2), (30, 2), (60, 4), (200, 12)):
        met = []
        for _ in range(150):
            a = r.choices(words, k=n)
            b = list(a)
            for _ in range(changes):
                at = r.randrange(len(b))
                kind = r.random()
                b[at : at + 1] = [r.choice(words)] if kind < 0.6 else [] if kind < 0.8 else [b[at], r.choice(words)]
            a, b = b" ".join(a), b" ".join(b)
            if line_dedup.similar(a.decode(), b.decode(), 85):
                keys, ends, need = line_dedup.line_keys([a, b])
                met.append(len(np.intersect1d(keys[: ends[0]], keys[ends[0] :])) >= max(need))
        share[n] = np.mean(met)
    # short lines meet under three blocks of four, so a word put in or left out near a block's edge hides some
    assert min(share[6], share[9]) > 0.6 and min(share[n] for n in (14, 20, 30, 60, 200)) > 0.85, share


def test_many_removed_lines_take_linear_time(spark):
    import time

    line_dedup.dedup_lines(spark.createDataFrame([(1, "a\na\nb")], "doc_id long, text string")).collect()
    text = "\n".join(f"first line number {'x' * (k % 3)}" for k in range(200_000))
    began = time.perf_counter()
    out = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out.n_lines_removed > 199_990 and time.perf_counter() - began < 60
    cut = line_dedup.dedup_lines
    gone = spark.createDataFrame([(1, text, list(range(1, 200_000)))], "doc_id long, text string, lines array<int>")
    assert cut(gone).count() == 1


def test_line_dedup_edge_cases(spark):
    same = "this very line has more than eight words in it"
    rows = [(1, same + "\n\n" + same.upper() + "!\nshort one"), (2, same + "\nshort one"), (3, None), (4, ""), (None, same), (2, same + "\nshort one"), (5, "--- --- --- ---\n--- --- --- ---"), (6, same.replace("more", "moer") + " " + "w" * 50_000)]
    frame = spark.createDataFrame([(*row, 1, "x", "y") for row in rows], "doc_id long, text string, line int, name string, simhash string")
    found = line_dedup.dedup_lines(frame)
    assert found.columns == ["doc_id", "line", "name", "simhash", "text", "n_lines_removed"]
    out = sorted(((r.doc_id, r.text, r.n_lines_removed) for r in found.collect()), key=repr)
    assert out == sorted([(1, same + "\n\nshort one", 1), (2, "", 2), (2, "", 2), (3, None, 0), (4, "", 0), (None, same, 0), (5, rows[6][1], 0), (6, rows[7][1], 0)], key=repr)
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_simhash_is_the_weighted_majority():
    import xxhash

    r = random.Random(5)
    words = [bytes(r.choices(b"abcd", k=r.randint(1, 6))) for _ in range(400)]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    weights = np.array([1 if len(w) < 4 else 3 for w in words], np.uint8)
    blocks = [(0, 1), (3, 19), (10, 26), (399, 400), (368, 400), (5, 7)]
    for (a, b), found in zip(blocks, line_dedup.simhashes(hashes, weights, *np.array(blocks).T), strict=True):
        expected = 0
        for bit in range(64):
            total = sum((1 if int(h) >> bit & 1 else -1) * int(w) for h, w in zip(hashes[a:b], weights[a:b], strict=True))
            expected |= (total > 0) << bit
        assert int(found) == expected


def test_blocks_of_lines():
    r = random.Random(7)
    starts, stops = [0, 30, 36, 100], [30, 36, 100, 103]
    ends = sorted(r.sample(range(103), 25))
    lines, begin, end = line_dedup.long_blocks(starts, stops, ends, 6, 16)
    assert set(lines) == {0, 1, 2}
    for k in range(3):
        own = [(a, b) for x, a, b in zip(lines, begin, end, strict=True) if x == k]
        assert own[0][0] == starts[k] and stops[k] - own[-1][1] < 6 and all(b == c for (_, b), (c, _) in zip(own, own[1:], strict=False))
        for a, b in own:
            first = next((e for e in ends if e >= a + 5), 10**9)
            assert 6 <= b - a <= 16 and b == min(first + 1, a + 16, stops[k])
    for n in range(1, 130):
        line = [b"%dw" % k for k in range(n)]
        for words in (b" ".join(line), b"".join(line)):
            keys, last, need = line_dedup.line_keys([words, b"z", words])
            assert (keys[: last[0]] == keys[last[1] :]).all() and last[0] == last[1] and (1 <= need[0] <= max(1, last[0]))
            assert last[0] or n < 4


def test_near_dedup_on_the_small_tables(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = sorted(map(tuple, near_dedup.near_duplicates(docs, 3, 85, 48, 28).collect()), key=repr)
    assert found == near_model(rows, 3, 85)


def test_equal_lines_of_any_script_are_one(spark):
    lines = ["a,b,c,d,e", "x/y/z/w", "https://www.example.com/some/long/path", "state-of-the-art", "北京是一座历史悠久的城市", "これは長い日本語の文章です", "กรุงเทพมหานครเป็นเมืองหลวง", "“He said” – yes, it’s so…", "Donaudampfschifffahrtsgesellschaft", "Introduction", "关于我们", "one two"]
    short = ["★ ★ ★ ★ ★", "--", ""]
    rows = [(1, "\n".join(lines + short)), (2, "\n".join(lines + short)), (3, '"He said" - yes, it\'s so...'), (4, "की कि का के को"), (5, "क क क क क")]
    found = {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (rows[0][1], 0), 2: ("\n".join(short), len(lines)), 3: ("", 1), 4: (rows[3][1], 0), 5: (rows[4][1], 0)}


def test_words_are_cut_alike_with_and_without_other_scripts():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(chr(r.randrange(128)) for _ in range(60))
        assert line_dedup.plain_lines(text + "\né") == [*line_dedup.plain_lines(text), ["é".encode()]]


def test_short_lines_with_one_changed_word_always_meet():
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(500)]
    for blank, counts in ((" ", range(5, 12)), ("", range(7, 14))):
        units = words if blank else "abcdefgh"
        for n in counts:
            for _ in range(60):
                a = r.choices(units, k=n)
                b = list(a)
                at = r.randrange(n)
                b[at : at + 1] = r.choice([[r.choice(units)], [], [b[at], r.choice(units)]])
                if blank or len(b) >= 7:
                    keys, ends, need = line_dedup.line_keys([blank.join(x).encode() for x in (a, b)])
                    assert max(need) == 1 and len(np.intersect1d(keys[: ends[0]], keys[ends[0] :])), (a, b)


def test_many_distances_at_once():
    r = random.Random(22)
    for _ in range(300):
        lines = ["".join(r.choice("abé ") for _ in range(r.randint(1, 70))) for _ in range(r.randint(2, 6))]
        base = r.choice(lines)
        lines += [base + "x" * k for k in range(4)] + [base[:9] + "zz" + base[11:]]
        true = [levenshtein(base, x) for x in lines]
        assert line_dedup.edit_distances(base, [line_dedup.Letters(x) for x in lines]) == true
        near = [d <= max(len(base), len(x)) * 15 // 100 for d, x in zip(true, lines, strict=True)]
        assert line_dedup.similar_lines([base, *lines], 85)(0, list(range(1, len(lines) + 1))) == near
        assert [line_dedup.similar(base, x, 85) for x in lines] == near
        assert all(d <= most for d, x in zip(true, lines, strict=True) for most in (0, 2, 8) if line_dedup.within_ends(base, x, most))


def test_long_lines_that_differ_everywhere_are_compared_whole():
    """No run of four words is the same, yet the lines are similar."""
    r = random.Random(23)
    a = ["".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(40)]
    b = ["x" + w[1:] if k % 4 == 3 else w for k, w in enumerate(a)]
    a, b = " ".join(a), " ".join(b)
    assert levenshtein(a, b) <= 10 and line_dedup.similar(a, b, 85)
    assert line_dedup.distance_by_parts(a, b, 75) > 75


def test_line_dedup_leaves_one_scratch_table(spark):
    folder = Path(scratch_root(spark).removeprefix("file://"))
    before = set(folder.glob("*"))
    found = line_dedup.dedup_lines(spark.createDataFrame(near_lines(), "doc_id long, text string"))
    assert [x.name.rsplit("-", 1)[0] for x in set(folder.glob("*")) - before] == ["removed-lines"]
    assert found.agg(F.sum("n_lines_removed")).first()[0] > 0


def test_lines_within_so_many_edits():
    r = random.Random(12)
    words = ["".join(r.choices("abcdeéж漢", k=r.randint(1, 6))) for _ in range(30)]
    for _ in range(60):
        base = " ".join(r.choices(words, k=r.choice([1, 3, 10, 60])))
        others = []
        for _ in range(r.randint(1, 5)):
            line = list(base)
            for _ in range(int(len(base) * r.choice([0.02, 0.1, 0.15, 0.2, 0.6])) + 1):
                at = r.randrange(len(line) + 1)
                line[at : at + r.randint(0, 1)] = r.choices("abcé z", k=r.randint(0, 1))
            others.append("".join(line) or "a")
        true = [levenshtein(base, x) for x in others]
        for share in (5, 15, 40):
            most = [max(len(base), len(x)) * share // 100 for x in others]
            assert line_dedup.all_within(base, others, most) == [d <= m for d, m in zip(true, most, strict=True)]
            assert line_dedup.all_within(base, others, true) == [True] * len(others)
        assert all(abs(line_dedup.letter_pairs(base) - line_dedup.letter_pairs(x)).sum() <= 4 * d for d, x in zip(true, others, strict=True))


def test_lines_of_other_letters_are_not_compared(monkeypatch):
    def fail(*_):
        raise AssertionError("compared")

    for name in ("edit_distance", "edit_distances", "all_within", "distance_by_parts"):
        monkeypatch.setattr(line_dedup, name, fail, raising=False)
    lines = ["was " * 100, "the " * 100, "der " * 100]
    assert line_dedup.similar_lines(lines, 85)(0, [1, 2]) == [False, False]


def test_second_search_compares_no_pair_again():
    seen = []

    def matcher(rows):
        return np.arange(rows.num_rows), lambda k, others: seen.extend((k, int(x)) for x in others) or np.zeros(len(others), bool)

    # nodes 0 and 1 are open, and of chunks 0 and 1; 2 and 3 aren't, and are of chunks 0 and 1
    rows = [(0, "a", 0, True, True), (1, "b", 1, True, True), (0, "a", 0, True, False), (1, "b", 1, True, False), (2, "c", 0, False, False), (3, "c", 1, False, False)]
    types = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
    run = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["node", "_label", "_chunk", "_open", "_left"])
    linkage._joined(run, matcher)
    assert seen == [(0, 3), (0, 5), (1, 4)]


def test_places_of_lines_carry_no_names(spark, monkeypatch):
    made = {}
    write = line_dedup.Scratch.__init__

    def init(self, df, name, *like):
        write(self, df, name, *like)
        made[name] = df.schema.simpleString()

    monkeypatch.setattr(line_dedup.Scratch, "__init__", init)
    line_dedup.dedup_lines(spark.createDataFrame(near_lines(), "doc_id long, text string")).collect()
    assert made["line-places"] == "struct<doc_id:bigint,wanted:array<int>>"
