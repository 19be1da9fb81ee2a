"""Method choice from message features: scores, ladders, routing prediction and capacity arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, read


def potential(size: Column, entropy: Column, hit_rate: Column, repetition: Column) -> Column:
    """Score of a borderline payload: size, entropy, dictionary hits and repetition, blended in turn."""
    by_size = F.when(size.between(400, 2048), 0.7).when((size > 2048) & (size <= 4096), 0.4).when(size > 4096, 0.2).otherwise(0.8)
    by_entropy = F.when(entropy < 4.0, 0.9).when(entropy < 5.5, 0.7).when(entropy < 6.5, 0.5).otherwise(0.2)
    by_hits = F.when(hit_rate > 0.25, 0.9).when(hit_rate > 0.15, 0.7).when(hit_rate > 0.05, 0.5).otherwise(0.3)
    score = F.lit(0.5)
    for part, weight in ((by_size, 0.3), (by_entropy, 0.25), (by_hits, 0.25), (repetition, 0.2)):
        score = score * (1 - weight) + part * weight
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


@query("fn_potential", """SELECT id, round(0.2 * r + 0.8 * (0.25 * h + 0.75 * (0.25 * e + 0.75 * (0.3 * s + 0.7 * 0.5))), 6) AS score FROM (SELECT id, (id % 10) / 10.0 AS r,
 CASE WHEN original_size * 6 BETWEEN 400 AND 2048 THEN 0.7 WHEN original_size * 6 > 4096 THEN 0.2 WHEN original_size * 6 > 2048 THEN 0.4 ELSE 0.8 END AS s,
 CASE WHEN compressed_size < 200 THEN 0.9 WHEN compressed_size < 275 THEN 0.7 WHEN compressed_size < 325 THEN 0.5 ELSE 0.2 END AS e, CASE WHEN id % 40 > 25 THEN 0.9 WHEN id % 40 > 15 THEN 0.7 WHEN id % 40 > 5 THEN 0.5 ELSE 0.3 END AS h FROM audit)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").select("id", F.round(potential(F.col("original_size") * 6, F.col("compressed_size") / 50, (F.col("id") % 40) / 100, (F.col("id") % 10) / 10), 6).alias("score"))


@query("fn_method_scores", """WITH f AS (SELECT id, unnest(['size', 'ratio', 'latency']) AS feature, unnest([original_size / 1000, compressed_size / 1000, latency_ms / 100]) AS x FROM audit),
w(method, feature, weight) AS (VALUES ('raw', 'size', -0.5), ('raw', 'latency', 0.9), ('zlib', 'size', 0.4), ('zlib', 'ratio', 0.3), ('token', 'ratio', 0.7), ('token', 'latency', -0.2))
SELECT id, max_by(method, (score, method)) AS best FROM (SELECT id, method, round(sum(x * weight), 9) AS score FROM f JOIN w USING (feature) GROUP BY id, method) GROUP BY id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = spark.createDataFrame([("raw", "size", -0.5), ("raw", "latency", 0.9), ("zlib", "size", 0.4), ("zlib", "ratio", 0.3), ("token", "ratio", 0.7), ("token", "latency", -0.2)], "method string, feature string, weight double")
    x = F.explode(F.create_map(F.lit("size"), F.col("original_size") / 1000, F.lit("ratio"), F.col("compressed_size") / 1000, F.lit("latency"), F.col("latency_ms") / 100)).alias("feature", "x")
    s = read(spark, d, "audit").select("id", x).join(F.broadcast(w), "feature").groupBy("id", "method").agg(F.round(F.sum(F.col("x") * F.col("weight")), 9).alias("score"))
    return s.groupBy("id").agg(F.max_by("method", F.struct("score", "method")).alias("best"))


@query("fn_routing_prediction", "SELECT id, CASE WHEN original_size < 150 THEN 'uncompressed' WHEN length(entry_id || session_id) > 6 THEN 'cache' WHEN (CASE WHEN latency_ms < 20 THEN 0.4 ELSE 0 END + CASE WHEN method IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN compressed_size < 300 THEN 0.2 ELSE 0 END + CASE WHEN original_size < 1000 THEN 0.1 ELSE 0 END) > 0.5 THEN 'fast' ELSE 'full' END AS route FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    viable = sum((F.when(c, x).otherwise(0.0) for c, x in ((F.col("latency_ms") < 20, 0.4), (F.col("method").isNotNull(), 0.3), (F.col("compressed_size") < 300, 0.2), (F.col("original_size") < 1000, 0.1))), F.lit(0.0))
    return read(spark, d, "audit").select("id", F.when(F.col("original_size") < 150, "uncompressed").when(F.length(F.concat("entry_id", "session_id")) > 6, "cache").when(F.round(viable, 6) > 0.5, "fast").otherwise("full").alias("route"))


def serialization_ms(size: Column, mbps: Column) -> Column:
    return F.when((size <= 0) | (mbps <= 0), 0.0).otherwise(size * 8.0 / (mbps * 1000.0))


@query("fn_projected_p95", """SELECT run, round(20 + greatest(0, p95_ms::DOUBLE - 20 - request_bytes * 8.0 / 10000 - response_bytes * 8.0 / 10000) + request_bytes * 8.0 / 50000 + response_bytes * 8.0 / 50000, 6) AS p95,
 CAST(ceil(100 * (20 + greatest(0, p95_ms::DOUBLE - 20 - request_bytes * 8.0 / 10000 - response_bytes * 8.0 / 10000)) / 1000) AS BIGINT) AS inflight FROM runs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    at = lambda mbps: serialization_ms(F.col("request_bytes"), F.lit(mbps)) + serialization_ms(F.col("response_bytes"), F.lit(mbps))
    rest = F.greatest(F.lit(0.0), F.col("p95_ms").cast("double") - 20 - serialization_ms(F.col("request_bytes"), F.lit(10.0)) - serialization_ms(F.col("response_bytes"), F.lit(10.0)))
    return read(spark, d, "runs").select("run", F.round(20 + rest + at(50.0), 6).alias("p95"), F.ceil(100 * (20 + rest) / 1000).alias("inflight"))
