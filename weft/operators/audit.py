"""Audit logs: filtered scans, grouped metrics, levels, compact metadata and hash chains."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.registry import query, read


def audit_filter(df: DataFrame, since: str | None = None, until: str | None = None, **equal: object) -> DataFrame:
    """Rows that satisfy every predicate given; none given keeps all rows."""
    conds = [F.col(k) == v for k, v in equal.items() if v is not None]
    conds += [F.col("ts") >= F.lit(since).cast("timestamp_ntz")] if since else []
    conds += [F.col("ts") <= F.lit(until).cast("timestamp_ntz")] if until else []
    return df.where(reduce(lambda a, b: a & b, conds, F.lit(True)))


def latest(df: DataFrame, limit: int = 100) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def metrics_by_method(df: DataFrame) -> DataFrame:
    """Per method (null and empty are 'unknown'), over successful entries."""
    method = F.when(F.coalesce("method", F.lit("")) == "", "unknown").otherwise(F.col("method"))
    ratio = F.col("original_size") / F.col("compressed_size")
    return (
        df.where(F.col("kind").isin("compression_success", "decompression_success")).groupBy(method.alias("method"))
        .agg(F.count("*").alias("n"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed"), F.round(F.avg(ratio), 6).alias("avg_ratio"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))
    )


def entry_hash(prev: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(prev, F.lit("GENESIS")), "entry_id", F.coalesce("props", F.lit(""))), 256)


def verify_chain(df: DataFrame, log: str, order: str, hash_col: str = "entry_hash") -> DataFrame:
    """Per row, whether its hash follows from the row before; the first row of a log starts it."""
    prev = F.lag(hash_col).over(Window.partitionBy(log).orderBy(order))
    return df.withColumn("ok", F.col(hash_col) == entry_hash(prev))


def build_chain(df: DataFrame, log: str, order: str) -> DataFrame:
    """entry_hash over each log in order: every hash covers the one before it, so a log is one pass."""
    cols = df.select(log, order, "entry_id", "props")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, prev, out = pdf.sort_values(order), "GENESIS", []
        for e, p in zip(pdf["entry_id"], pdf["props"], strict=True):
            prev = hashlib.sha256(f"{prev}{e}{p if isinstance(p, str) else ''}".encode()).hexdigest()
            out.append(prev)
        return pdf.assign(entry_hash=out)

    return cols.groupBy(log).applyInPandas(run, cols.select("*").schema.add("entry_hash", "string"))


@query("flt_audit_predicates", "SELECT id, session_id, latency_ms FROM audit WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND session_id = 's7'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit_filter(read(spark, d, "audit"), "2024-01-05", "2024-01-20", event_type="click", session_id="s7").select("id", "session_id", "latency_ms")


@query("srt_latest_entries", "SELECT id, session_id, kind FROM audit ORDER BY ts DESC, id DESC LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return latest(read(spark, d, "audit")).select("id", "session_id", "kind")


@query("agg_audit_by_method", "SELECT CASE WHEN coalesce(method, '') = '' THEN 'unknown' ELSE method END AS method, count(*) AS n, CAST(sum(original_size) AS BIGINT) AS original, CAST(sum(compressed_size) AS BIGINT) AS compressed, round(avg(original_size / compressed_size), 6) AS avg_ratio, round(avg(latency_ms), 6) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms FROM audit WHERE kind IN ('compression_success', 'decompression_success') GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics_by_method(read(spark, d, "audit"))


@query("agg_audit_trailing_hours", "SELECT count(*) AS n, round(avg(latency_ms), 6) AS avg_ms FROM audit WHERE ts >= (SELECT max(ts) FROM audit) - INTERVAL 48 HOUR")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "audit")
    return a.join(a.agg(F.max("ts").alias("last")), F.expr("ts >= last - INTERVAL 48 HOURS")).agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"))


@query("flt_audit_level", "SELECT id, CASE WHEN kind = 'compression_failure' THEN 'ERROR' WHEN compressed_size > original_size THEN 'WARNING' ELSE 'INFO' END AS level FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").select("id", F.when(F.col("kind") == "compression_failure", "ERROR").when(F.col("compressed_size") > F.col("original_size"), "WARNING").otherwise("INFO").alias("level"))


ALIASES = {"original_size": "os", "compressed_size": "cs", "method": "m"}


def compact(metadata: Column) -> Column:
    """Metadata without empty values, under short names, marked as version 1."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    short = F.transform_keys(F.map_filter(metadata, lambda _, v: v.isNotNull() & (v != "")), lambda k, _: F.coalesce(names[k], k))
    return F.map_concat(short, F.create_map(F.lit("mv"), F.lit("1")))


@query("flt_compact_metadata", "SELECT id, CAST(original_size AS VARCHAR) AS os, CAST(compressed_size AS VARCHAR) AS cs, nullif(method, '') AS m, CASE WHEN coalesce(method, '') = '' THEN 3 ELSE 4 END AS n_keys, '1' AS mv FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = compact(F.create_map(F.lit("original_size"), F.col("original_size").cast("string"), F.lit("compressed_size"), F.col("compressed_size").cast("string"), F.lit("method"), F.col("method")))
    return read(spark, d, "audit").select("id", m.alias("z")).select("id", *[F.col("z")[k].alias(k) for k in ("os", "cs", "m", "mv")], F.size("z").alias("n_keys"))


@query("win_chain_build", """
WITH RECURSIVE r AS (SELECT session_id, id, entry_id, props, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM audit),
c AS (SELECT session_id, id, rn, sha256('GENESIS' || entry_id || coalesce(props, '')) AS entry_hash FROM r WHERE rn = 1
 UNION ALL SELECT r.session_id, r.id, r.rn, sha256(c.entry_hash || r.entry_id || coalesce(r.props, '')) FROM c JOIN r ON r.session_id = c.session_id AND r.rn = c.rn + 1)
SELECT session_id, id, entry_hash FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return build_chain(read(spark, d, "audit"), "session_id", "id").select("session_id", "id", "entry_hash")


@query("win_chain_verify", "SELECT session_id, count(*) AS n, CASE WHEN bool_or(id % 1000 = 17) THEN false ELSE true END AS valid FROM audit GROUP BY session_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    chain = build_chain(read(spark, d, "audit"), "session_id", "id")
    forged = chain.withColumn("props", F.when(F.col("id") % 1000 == 17, "forged").otherwise(F.col("props")))
    return verify_chain(forged, "session_id", "id").groupBy("session_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("valid"))


@query("win_sequence_check", "SELECT session_id, bool_and(rn - 1 = seq) AS continuous FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn, CASE WHEN session_id = 's3' THEN -1 ELSE row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 END AS seq FROM audit) GROUP BY session_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("id")
    a = read(spark, d, "audit").withColumn("rn", F.row_number().over(w)).withColumn("seq", F.when(F.col("session_id") == "s3", -1).otherwise(F.row_number().over(w) - 1))
    return a.groupBy("session_id").agg(F.bool_and(F.col("rn") - 1 == F.col("seq")).alias("continuous"))


@query("flt_recent_unprocessed", "SELECT id FROM audit WHERE ts >= (SELECT max(ts) FROM audit) - INTERVAL 24 HOUR AND props <> '' AND event_type <> 'click'")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "audit")
    seen = a.where("event_type = 'click'").select("id")
    return a.join(a.agg(F.max("ts").alias("last")), F.expr("ts >= last - INTERVAL 24 HOURS")).where("props <> ''").join(seen, "id", "left_anti").select("id")


@query("flt_cache_eligible", "SELECT id, length(coalesce(method, entry_id || '-' || session_id)) > 10 AS eligible FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").select("id", (F.length(F.coalesce("method", F.concat_ws("-", "entry_id", "session_id"))) > 10).alias("eligible"))


@query("flt_expired", "SELECT count(*) AS n_expired, CAST(coalesce(sum(compressed_size), 0) AS BIGINT) AS freed FROM audit WHERE TIMESTAMP '2024-01-20' > ts + INTERVAL 7 DAY")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").where("TIMESTAMP_NTZ '2024-01-20' > ts + INTERVAL 7 DAYS").agg(F.count("*").alias("n_expired"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("freed"))


@query("fn_signature_key", "SELECT id, session_id || ':' || CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END || ':' || coalesce(method, 'None') AS signature FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").select("id", F.concat_ws(":", "session_id", F.when(F.col("user_id") % 2 == 0, "True").otherwise("False"), F.coalesce("method", F.lit("None"))).alias("signature"))
