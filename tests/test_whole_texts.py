"""Operators over whole texts, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft import catalog
from weft.functions import documents
from weft.operators import ngrams as operator
from weft.operators.aggregates import frequent_ngrams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def messages(spark):
    return [(r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]


def hit_rate(t):
    size = min(300, max(60, len(t) // 10))
    mid = max(0, len(t) // 2 - size // 2)
    parts = [t] if len(t) <= 600 else [t[:size], t[mid : mid + size], t[-size:]]
    marks = sum(c in '{}[]":,<>/=' for p in parts for c in p)
    words = sum(any(w in p.lower() for p in parts) for w in documents.COMMON)
    return 0.0 if len(t) < 10 else min(1.0, marks / sum(map(len, parts)) * 0.7 + words * 0.05 * 0.3)


def test_hit_rate_of_every_message(spark, messages):
    got = {(r["conv_id"], r["turn"]): r["rate"] for r in catalog.QUERIES["fn_hit_rate_sampled"](spark, SF).collect()}
    assert len(got) == len(messages) and any(len(t) > 600 for _, _, t in messages)
    assert all(abs(got[c, k] - hit_rate(t)) < 2e-6 for c, k, t in messages)


def test_hit_rate_samples(spark):
    texts = ["", "short", "x" * 599 + "{", "x" * 600 + "{", "{" * 100 + "x" * 5000 + " error", "é" * 400 + "<a=b>" * 80 + "data" * 99, "y" * 300 + "status" + "y" * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", documents.hit_rate(F.col("t")).alias("x")).collect()}
    assert all(abs(got[i] - hit_rate(t)) < 1e-9 for i, t in enumerate(texts))


def ngrams(texts, least):
    n = Counter(t[i : i + k] for t in texts for k in range(10, min(100, len(t))) for i in range(len(t) - k + 1))
    return {g: c for g, c in n.items() if c >= least and len(g.strip()) >= 10}


def test_frequent_ngrams(spark, messages):
    long = " ".join(f"word{i}" for i in range(60))
    texts = [t for _, _, t in messages[:12]] + [long, "ab " + long + "\u2003\u00e9 tail", long[150:] + "  \t  end"] + ["repeated message text"] * 3 + ["abc" * 40, "short", "", "exactly 10"]
    for least in (2, 3):
        got = {r["gram"]: r["n"] for r in frequent_ngrams(spark.createDataFrame([(t,) for t in texts], "t string"), "t", least).collect()}
        want = ngrams(texts, least)
        assert got == want
    assert max(map(len, want)) == 99 and want["repeated message tex"] == 3 and "repeated message text" not in want


@pytest.mark.parametrize("alphabet", ["ab", "a", "ab \t ", "abcdefgh \u00e9\U0001f600\x00\n", "a\x1f\x85 b"])
def test_frequent_ngrams_over_chunks_and_pieces(spark, monkeypatch, alphabet):
    for name, size in (("PIECE", 200), ("PART", 1500), ("LEAST", 1500)):
        monkeypatch.setattr(operator, name, size)
    draw = random.Random(7)
    base = "".join(draw.choice(alphabet) for _ in range(420))
    texts = ["".join(draw.choice(alphabet) for _ in range(n)) for n in (0, 1, 9, 10, 11, 15, 16, 17, 31, 32, 33, 98, 99, 100, 101, 199, 298, 299, 300, 301, 420)]
    texts += [base[draw.randrange(200) :][: draw.randrange(420)] for _ in range(12)] + [base[:99]] * 4 + [base[:100]] * 3 + [base]
    for least in (1, 3):
        got = [(r["gram"], r["n"]) for r in frequent_ngrams(spark.createDataFrame([(t,) for t in [*texts, None]], "t string"), "t", least).collect()]
        assert len(got) == len(dict(got)) and dict(got) == ngrams(texts, least)


def test_frequent_ngrams_exchange_a_few_bytes_a_place(spark):
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        each = sc.statusStore().executorList(True)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    texts = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    places = texts.agg(F.sum(F.length("text"))).first()[0]
    before = written()
    assert frequent_ngrams(texts, "text").count() == 22677
    assert written() - before < 20 * places
