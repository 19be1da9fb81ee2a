"""From raw documents to packed training batches, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  Near duplicates are taken at five words and a similarity of 0.8 here.

Defined cases: documents of null id pass the duplicate stages unchanged; null texts are scored like empty
ones; a document all of whose words an earlier one holds leaves the corpus; a document that the mix takes
several times is as many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import mixing, packing, quality, rlz
from weft.llm.exchange import checkpoint
from weft.llm.jaccard import jaccard_components

THRESHOLD = 0.3


def free(docs: DataFrame, name: str) -> str:
    """name, or a longer one if docs has a column of that name."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free(docs, "__score")
    return quality.score(docs, model, out=score).where(F.col(score) >= THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    of = jaccard_components(docs, words=5, percent=80)
    gone = of.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of smaller id holds."""
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = rlz.dedup_substrings(docs, with_text=True, carry=carried).where("n_removed = 0 OR n_removed < n_words")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return left.select(*[columns.get(c, F.col(f"rest.{c}")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    copies, name, source, size, one = (free(docs, c) for c in ("__copies", "__id", "__key", "__size", "__copy"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    of = mixing.mix(docs).groupBy(key.alias(name), mixing.source_key().alias(source), F.col("size").alias(size)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    taken = docs.withColumns({name: key, source: mixing.source_key(), size: mixing.word_count("text")}).join(of, [name, source, size])
    return taken.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of every row."""
    return packing.pack(docs)


STAGES = [("quality_classifier", classify), ("ngram_jaccard", near_duplicates), ("substring_dedup", substrings), ("source_mixing", mix_sources), ("length_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
