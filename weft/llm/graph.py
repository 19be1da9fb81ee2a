"""Connected components of a links table, by alternating large and small stars, and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.exchange import checkpoint


ROWS_A_KEY, HOT_KEYS = 1024, 100_000


def join_hot(rows: DataFrame, of: DataFrame, keys: list[str], counts: DataFrame, spread: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with of (one row a key), where counts(keys, n) tells how many rows a key may have.

    Keys of over ROWS_A_KEY rows, or over total / HOT_KEYS if that is more, are hot: their rows are dealt over as
    many salts by the hash of the column spread, and of has a copy for each.  There are HOT_KEYS of them at most,
    which is why they may be shipped.
    """
    most = max(ROWS_A_KEY, -(-total // HOT_KEYS))
    hot = checkpoint(counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_salts")))
    if not hot.take(1):
        return rows.join(of, keys, how)
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    right = of.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of links(a, b); component is the least node reachable.

    Each round rewrites the edges towards smaller ends and writes them to the checkpoint folder; only a count
    and a checksum reach the driver.  Null ends and loops are no links.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = checkpoint(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    ends = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return ends.join(low, ends["node"] == low["u"], "left").select("node", F.coalesce("m", "node").alias("component"))
