"""Duplicate operators against brute force, and their defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from weft.llm.jaccard import jaccard_components
from weft.llm.rlz import dedup_substrings, factor
from weft.llm.words import Words, flat

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["é", "ß", "漢", "a b", "x\x0by"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(13, 60))] for _ in range(6)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 12, 13, 14, 40, 90]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        if out and rng.random() < 0.3:
            words = WORD.findall(rng.choice(out) or "")
            for _ in range(rng.choice([0, 0, 1, 3])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(rng.choice([" ", "  ", "\n", "\t "]).join(words))
    return out


def brute_substrings(rows, k=13):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i, ws in words.items():
        for s in range(len(ws) - k + 1):
            key = tuple(ws[s : s + k])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, ws in words.items():
        gone = {j for s in range(len(ws) - k + 1) if first[tuple(ws[s : s + k])] < i for j in range(s, s + k)}
        kept = [w for j, w in enumerate(ws) if j not in gone]
        out[i] = (len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_bytes", [300, 1 << 20])
def test_substrings_equal_brute_force(spark, part_bytes):
    rows = list(enumerate(corpus(1)))
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup_substrings(df, part_bytes=part_bytes).collect()}
    assert got == brute_substrings(rows)
    assert any(v[1] for v in got.values())


def test_substring_cases(spark):
    long = " ".join(f"q{i}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage + " end", "x"), (2, "start  " + passage + "\ntail", "y"), (3, None, None), (None, passage, "z"), (4, "", "x"), (5, long, "x"), (6, long, "y"), (2, "start  " + passage + "\ntail", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp string")
    got = dedup_substrings(df, with_text=True, carry=("grp",)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["kept_text"] == "start  tail" and by[2]["n_removed"] == 20 and by[2]["rest"]["grp"] == "y"
    assert by[2]["factors"][0].asDict() == {"start": 1, "length": 20, "ref_doc": 1, "ref_start": 0}
    assert by[3]["n_words"] == 0 and by[None]["n_removed"] == 0 and by[5]["n_removed"] == 0 and by[6]["n_removed"] == 30_000
    assert by[1]["kept_text"] == passage + " end"
    assert dedup_substrings(df.limit(0)).count() == 0


def test_factors_cover_every_indexed_block():
    """A parse by jumps and boundaries covers the words of all indexed blocks, and each factor is a piece of its reference."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n, k = int(rng.integers(1, 60)), int(rng.integers(2, 14))
        ref, place, found = np.zeros(n, np.int64), np.zeros(n, np.int64), rng.random(n) < rng.choice([0.1, 0.6, 0.95])
        for i in range(n):
            goes_on = i and rng.random() < 0.8
            ref[i], place[i] = (ref[i - 1], place[i - 1] + 1) if goes_on else (rng.integers(5), rng.integers(50))
        covered = np.zeros(n + k, bool)
        for i in np.flatnonzero(found):
            covered[i : i + k] = True
        parts, parsed, end = factor(ref, place, found, k), np.zeros(n + k, bool), 0
        for start, length, r, p in parts:
            parsed[start : start + length] = True
            blocks = np.arange(start, start + length - k + 1)
            assert length >= k and found[blocks].all() and (ref[blocks] == r).all() and (place[blocks] == p + blocks - start).all()
        assert (parsed == covered).all()
        # Greedy: a factor that starts behind the last jump is as long as its reference goes on.
        for start, length, r, p in parts:
            if start >= end:
                after = start + length - k + 1
                assert after >= n or not found[after] or ref[after] != r or place[after] != p + after - start
                end = start + length


def test_greedy_factors():
    ref, place = np.array([1, 1, 2, 2, 0]), np.array([4, 5, 9, 10, 0])
    assert factor(ref, place, np.array([True, True, True, True, False]), 13) == [(0, 14, 1, 4), (2, 14, 2, 9)]


def test_words_do_not_depend_on_batches():
    import pyarrow as pa

    texts = ["a b  c", None, "", "\tc b", "Ünï código", "b c"]
    words = Words(*flat(pa.array(texts)))
    found = [words.data[s:e].tobytes().decode() for s, e in zip(words.start, words.end, strict=True)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    alone = Words(*flat(pa.array(["zz c"])))
    assert alone.hash[1] == words.hash[found.index("c")] == words.hash[found.index("c", 3)]


def shingles(text, k):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    low = {i: i for i, _ in rows}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            inter = len(sets[a][1] & sets[b][1])
            if inter and 100 * inter >= percent * len(sets[a][1] | sets[b][1]):
                x, y = sorted((root(sets[a][0]), root(sets[b][0])))
                low[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "percent", "part_bytes"), [(4, 85, 1 << 20), (5, 80, 400)])
def test_jaccard_equals_brute_force(spark, k, percent, part_bytes):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(120)]
    texts = corpus(3, 40)
    for n in (0, 1, 2, 3, 4, 5, 6, 8, 2, 1):
        for _ in range(4):
            ws = list(base)
            for _ in range(n):
                ws[rng.randrange(len(ws))] = "e%d" % rng.randint(0, 9999)
            texts.append(" ".join(ws))
    chain = list(base)
    for _ in range(12):
        chain = [*chain[8:], *("c%d" % rng.randint(0, 9999) for _ in range(8))]
        texts.append(" ".join(chain).upper())
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, words=k, percent=percent, part_bytes=part_bytes).collect()}
    assert got == brute_components(rows, k, percent)


def test_jaccard_cases(spark):
    rows = [(1, None, 0), (2, "", 1), (3, "One two", 2), (4, "one TWO", 3), (None, "one two", 4), (5, "three", 5), (5, "three", 5), (6, " \n\t", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(jaccard_components(df).collect(), key=str)
    assert len(got) == 8
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), None: (1, None), 5: (1, 5), 6: (0, 6)}
    assert jaccard_components(df.limit(0)).count() == 0


def test_joins_with_hot_keys_agree(spark, monkeypatch):
    from weft.llm import graph

    rows = spark.createDataFrame([(i, i % 3 if i > 50 else 7) for i in range(200)] + [(900, None)], "id long, k long")
    of = spark.createDataFrame([(7, "a"), (0, "b"), (1, "c")], "k long, x string")
    counts = rows.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n")
    for how in ("inner", "left"):
        got = []
        for most in (10, 10_000):
            monkeypatch.setattr(graph, "ROWS_A_KEY", most)
            got.append(sorted(repr(tuple(r)) for r in graph.join_hot(rows, of, ["k"], counts, "id", 201, how).select("id", "k", "x").collect()))
        assert got[0] == got[1] and len(got[0]) == (rows.join(of, "k", how).count())


def test_many_copies_in_one_class(spark, monkeypatch):
    from weft.llm import graph

    monkeypatch.setattr(graph, "ROWS_A_KEY", 20)
    texts = ["the same text of a few words again"] * 150 + ["the same text of a few words again and more words"] * 5 + ["something else that is not alike at all"] * 3
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(df).collect()}
    assert all(got[i] == 1 for i in range(1, 151)) and {got[i] for i in range(156, 159)} == {156} and len(got) == 158
