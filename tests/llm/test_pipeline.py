"""The pipeline's stages against their brute-force versions, over the smallest tables."""

import re
from collections import Counter

import corpus_pipeline

from tests.llm.test_text_operators import brute_components, brute_substrings

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard", "substring_dedup", "source_mixing", "length_packing"]
    kept = stage["quality_classifier"](spark, docs, SF).cache()
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    good = {i for i, q in labels.items() if q == 1}
    assert len(ids & good) >= 0.97 * len(good)
    assert kept.columns == docs.columns
    single = stage["ngram_jaccard"](spark, kept, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == docs.columns
    clean = stage["substring_dedup"](spark, single, SF).cache()
    brute = brute_substrings([(r["doc_id"], r["text"]) for r in single.collect()])
    assert {r["doc_id"]: len(WORD.findall(r["text"])) for r in clean.collect()} == {i: n - g for i, (n, g, _) in brute.items() if g == 0 or g < n}
    assert clean.columns == docs.columns and clean.where("n_chars <> length(text)").count() == 0
    mixed = stage["source_mixing"](spark, clean, SF).cache()
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= {r["doc_id"] for r in clean.collect()} and max(copies.values()) <= 3
    packed = stage["length_packing"](spark, mixed, SF)
    assert Counter(r["doc_id"] for r in packed.collect()) == copies
    assert corpus_pipeline.run(spark, SF).count() == sum(copies.values())


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", None, None, "x"), (None, "a b c", None, "s", 5, "y"), (2, "", "en", "s", 0, "z"), (3, "A b c d e f g.", "en", "s", 9, "w")], "doc_id long, text string, lang string, source string, n_chars long, rest string")
    for name, f in corpus_pipeline.STAGES[1:]:
        assert f(spark, docs, SF).count() >= 1, name
        assert f(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), SF).count() == 0


def test_clashing_columns_stay(spark):
    names = ("__score", "__id", "__key", "__copies", "__copy", "__size", "score", "size", "grp", "rest", "key", "u")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k % 9}" for k in range(5 + i)), "en", "ab"[i % 2], 9, *[f"{n} {i}" for n in names]) for i in range(12)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, f in corpus_pipeline.STAGES[:-1]:
        got = f(spark, docs, SF)
        assert got.columns == docs.columns, name
        for r in got.collect():
            assert all(r[n] == f"{n} {r['doc_id']}" for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 12
