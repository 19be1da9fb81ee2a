"""Query registry: name -> (Spark callable, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# How the audit log, the run metrics and the message log derive from the tables at hand.
AUDIT = [
    "event_id AS id", "ts", "'e' || event_id AS entry_id", "user_id", "'s' || (user_id % 40) AS session_id", "event_type",
    "CASE event_type WHEN 'click' THEN 'raw' WHEN 'view' THEN 'zlib' WHEN 'purchase' THEN 'deflate' WHEN 'signup' THEN '' ELSE NULL END AS method",
    "CASE WHEN event_type = 'error' THEN 'compression_failure' ELSE 'compression_success' END AS kind",
    "100 + event_id % 977 AS original_size", "40 + (event_id * 31) % 611 AS compressed_size", "value AS latency_ms", "props",
]
RUNS = [
    "o_orderkey AS run", "o_custkey % 20 AS target", "CASE o_orderkey % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'zlib' WHEN 2 THEN 'token' ELSE 'deflate' END AS codec",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'lan' WHEN '2-HIGH' THEN 'wifi' WHEN '3-MEDIUM' THEN 'lte' ELSE 'mesh' END AS profile",
    "1 + o_orderkey % 97 AS exchanges", "1000 + o_orderkey % 5003 AS request_bytes", "500 + o_orderkey % 7001 AS response_bytes",
    "5.0 + (o_orderkey % 211) AS p95_ms", "o_orderkey % 50 <> 0 AS verified", "1 + o_custkey % 8 AS shards",
]
MESSAGES = ["conv_id", "turn", "role", "text"]
_TABLES = {"audit": (AUDIT, "events"), "runs": (RUNS, "orders"), "msgs": (MESSAGES, "conversations")}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or one of the derived views audit, runs and msgs."""
    if name in _TABLES:
        columns, table = _TABLES[name]
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; its SQL may use the derived views."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            used = [v for v in _TABLES if v in sql]
            head = ", ".join(f"{v} AS (SELECT {', '.join(_TABLES[v][0])} FROM {_TABLES[v][1]})" for v in used)
            body = sql.strip()
            if head:
                recursive = body.upper().startswith("WITH RECURSIVE")
                body = f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body.split(None, 2 if recursive else 1)[-1]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
            SQL[name] = body
        return f

    return add
