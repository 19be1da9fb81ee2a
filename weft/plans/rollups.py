"""Composed plans: profile grids, sustained-session models and end-to-end discovery reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, read


@query("agg_sustained_model", "SELECT codec, round((sum(request_bytes + response_bytes) + 500.0 * count(DISTINCT target)) / count(*), 6) AS bytes_per_exchange, round(500.0 * count(DISTINCT target) / (sum(request_bytes + response_bytes) + 500.0 * count(DISTINCT target)), 9) AS setup_share FROM runs GROUP BY codec")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "runs").groupBy("codec").agg(F.sum(F.col("request_bytes") + F.col("response_bytes")).alias("b"), F.count_distinct("target").alias("t"), F.count("*").alias("n"))
    setup = F.lit(500.0) * F.col("t")
    return g.select("codec", F.round((F.col("b") + setup) / F.col("n"), 6).alias("bytes_per_exchange"), F.round(setup / (F.col("b") + setup), 9).alias("setup_share"))


@query("agg_dictionary_matrix")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of every scope's messages, deflated as one session, under no dictionary, a fixed one and the scope's best terms."""
    from weft.functions.mining import dictionary_matrix

    return dictionary_matrix(read(spark, d, "msgs"), "conv_id", "turn", "role", "text")


@query("sup_profile_suite", "SELECT profile, codec, mbps, count(*) AS n, round(sum(request_bytes) * 8.0 / (mbps * 1000.0), 3) AS wire_ms FROM runs JOIN (VALUES ('lan', 940.0), ('wifi', 90.0), ('lte', 25.0), ('mesh', 8.0)) p(profile, mbps) USING (profile) GROUP BY profile, codec, mbps")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([("lan", 940.0), ("wifi", 90.0), ("lte", 25.0), ("mesh", 8.0)], "profile string, mbps double")
    g = read(spark, d, "runs").join(F.broadcast(p), "profile").groupBy("profile", "codec", "mbps").agg(F.count("*").alias("n"), F.sum("request_bytes").alias("b"))
    return g.withColumn("wire_ms", F.round(F.col("b") * 8.0 / (F.col("mbps") * 1000.0), 3)).drop("b")


@query("sup_batch_messages", "SELECT conv_id, turn // 4 AS batch, string_agg(text, chr(10) ORDER BY turn) AS payload FROM msgs GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "msgs").groupBy("conv_id", F.expr("turn div 4").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    return g.select("conv_id", "batch", F.array_join("rows.text", "\n").alias("payload"))


@query("sup_profiler_rows", "SELECT run, round(p95_ms::DOUBLE / nullif(exchanges, 0), 6) AS per_call FROM runs ORDER BY p95_ms DESC, run LIMIT 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").orderBy(F.desc("p95_ms"), "run").limit(25).select("run", F.round(F.try_divide(F.col("p95_ms").cast("double"), F.col("exchanges").cast("double")), 6).alias("per_call"))


@query("sup_partial_merge", "SELECT target, count(*) AS runs, CAST(sum(exchanges) AS BIGINT) AS exchanges, quantile_cont(p95_ms::DOUBLE, 0.95) AS p95 FROM runs GROUP BY target")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").groupBy("target").agg(F.count("*").alias("runs"), F.sum("exchanges").alias("exchanges"), F.percentile(F.col("p95_ms").cast("double"), 0.95).alias("p95"))
