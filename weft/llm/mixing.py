"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words.  Its documents' expected copies are in proportion to a weight of their
own, the number of binary digits of their size (longer texts are worth more repeats), as far as no document
exceeds most copies: longer ones reach it first, and the rest shares what is left of the target.  The whole
part of the expected copies is allocated for certain.  The fraction p, which so differs from document to
document, is the inclusion probability of one copy more: documents are ranked by random odds over inclusion
odds, u / (1 - u) : p / (1 - p), and the source takes the ranks up to the words that are missing.  u is a hash
of the id, so reruns agree.  Then one document per source changes sides, if that brings the source nearer to
its target.

Ranks are never computed over a whole source: words are summed by source and rank bin, the bin in which the
target falls is found from those sums, and only that bin's documents are put in order.

Defined cases: null texts have no words and are taken as others are; null is a source of its own, the last;
sources without words have target 0; rows of one id, source and size are decided by one hash; a null id hashes
as the text 'null'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.exchange import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1 << 14
# Up to so many bytes of source names and figures are shipped to every task; beyond, sources are joined by salted keys.
SHIPPED_BYTES, SALTS = 8 << 20, 64


def word_count(column: str):  # noqa: ANN201
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """key, source_size and target, one row per source.

    Sources weigh weights in turn, by code point and null last, and share all sizes; none gets over most
    times its size, and what is over goes to the others by weight.  Of all sources ordered by
    most * size / weight some first ones are full, and the level of the rest is what the full ones leave,
    per weight.
    """
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    of = of.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")))
    full = F.lit(most) * F.col("source_size") / F.col("weight")
    order = Window.orderBy("full", "source")
    of = of.withColumn("full", full)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    of = of.withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    of = of.withColumn("left", F.col("all") - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    of = of.withColumn("heavy", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("left") / F.col("heavy") <= F.col("full"), F.struct(F.col("full").alias("f"), (F.col("left") / F.col("heavy")).alias("level")))).over(Window.partitionBy())
    of = of.withColumn("level", level["level"])
    target = F.least(F.lit(most) * F.col("source_size").cast("double"), F.col("weight") * F.col("level"))
    return of.select(source_key().alias("key"), "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def source_key():  # noqa: ANN201
    """A join key under which null is a value."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def with_source(rows: DataFrame, of: DataFrame, how: str = "inner", shipped_bytes: int = SHIPPED_BYTES, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """rows with the columns that of holds for their key, without gathering the rows of a hot source in one task."""
    size = of.agg(F.sum(F.octet_length("key").cast("long") + 128)).first()[0] or 0
    if size <= shipped_bytes:
        return rows.join(F.broadcast(of), list(on), how)
    salted = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in ("doc_id", "u", "size") if c in rows.columns]), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"], how).drop("salt")


def shares(sizes: DataFrame, goal: DataFrame, most: int = 3) -> DataFrame:
    """key, weight, source_size, target, whole, p and missing, one row per source and weight (64 weights at most).

    In a source, of all weights from the greatest down some first ones are full (at most copies); the level of
    the rest is what those leave of the target, per weighted word.  missing is what whole copies leave.
    """
    of = sizes.groupBy(source_key().alias("key"), "weight").agg(F.sum("size").alias("words")).join(goal, "key")
    of = of.withColumn("heavy", F.col("words") * F.col("weight"))
    down = Window.partitionBy("key").orderBy(F.desc("weight"))
    over = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("heavy").over(down.rowsBetween(0, Window.unboundedFollowing))
    of = of.withColumn("level", F.when(rest > 0, (F.col("target") - most * over) / rest))
    of = of.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= most, F.struct("weight", "level"))).over(Window.partitionBy("key"))["level"])
    of = of.withColumn("r", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.coalesce(F.col("weight") * F.col("level"), F.lit(float(most))))).otherwise(0.0))
    of = of.withColumn("whole", F.floor("r")).withColumn("p", F.col("r") - F.floor("r"))
    missing = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("key"))
    return of.withColumn("missing", missing).select("key", "weight", "source_size", "target", "whole", "p", "missing")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (= copies * size), per row of docs."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), u.alias("u")).withColumn("weight", F.length(F.bin("size"))))
    goal = checkpoint(targets(rows.select("source", "size"), weights, most))
    share = checkpoint(shares(rows, goal, most))
    rows = with_source(rows.withColumn("key", source_key()), share, on=("key", "weight"))
    rank = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))).otherwise(F.lit(float("inf")))
    ranked = rows.withColumn("rank", rank).withColumn("bin", F.when(F.col("p") > 0, F.floor(F.col("rank") / (1 + F.col("rank")) * BINS)).otherwise(-1))
    sums = ranked.where("p > 0").groupBy("key", "bin").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    run = Window.partitionBy("key").orderBy("bin")
    sums = sums.withColumn("upto", F.sum("words").over(run)).where("upto >= missing")
    edge = sums.groupBy("key").agg(F.min(F.struct("bin", "upto", "words")).alias("e")).select("key", F.col("e.bin").alias("edge"), (F.col("e.upto") - F.col("e.words")).alias("before"))
    edge = checkpoint(edge)
    at = with_source(ranked, edge, "left")
    inside = F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("rank", "name", "size"))
    at = at.where("bin = edge").withColumn("upto", inside).unionByName(at.where("NOT coalesce(bin = edge, false)").withColumn("upto", F.lit(None).cast("double")))
    picked = F.when(F.col("p") <= 0, False).when(F.col("edge").isNull(), True).when(F.col("bin") < F.col("edge"), True).when(F.col("bin") > F.col("edge"), False)
    at = at.withColumn("picked", picked.otherwise(F.coalesce(2 * F.col("upto") - F.col("size") <= 2 * F.col("missing"), F.lit(False))))
    at = checkpoint(at.select("doc_id", "name", "source", "key", "size", "source_size", "target", "whole", "p", "rank", "missing", "picked"))
    gap = at.where("p > 0").groupBy("key").agg((F.first("missing") - F.sum(F.when(F.col("picked"), F.col("size")).otherwise(0))).alias("gap"))
    could = with_source(at.where("p > 0 AND size > 0"), checkpoint(gap)).withColumn("change", F.when(F.col("picked"), -F.col("size")).otherwise(F.col("size")))
    swap = could.where("abs(gap - change) < abs(gap)").groupBy("key").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("change")).alias("off"), "rank", "name", "size")).alias("s")).select("key", F.col("s.name").alias("name"), F.col("s.size").alias("size"), F.lit(True).alias("flip"))
    done = with_source(at, swap, "left", on=("key", "name", "size"))
    copies = (F.col("whole") + (F.col("picked") != F.coalesce("flip", F.lit(False))).cast("int")).cast("int")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
