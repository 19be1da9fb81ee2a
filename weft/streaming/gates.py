"""Per-session state machines: conversations with a response cache, the scorer gate and interrupted streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.windows import numbered
from weft.registry import query, read


def conversations(stream: DataFrame, size: int = 1000) -> DataFrame:
    """session, id, response, hit, n and observable for rows (session, id, signature, response, latency_ms).

    A signature met before is answered from the session's cache (least recently used goes beyond size), with the response
    of its first miss; otherwise the row's own response is the answer and is cached.  observable: from ten messages on,
    the mean latency of the first five is more than twice that of the last five.  Null signatures are never cached."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n, first, last = json.loads(state.get[0]) if state.exists else [{}, 0, [], []]
        out = []
        for f in frames:
            for r in f.sort_values("id").itertuples(index=False):
                sig = None if pd.isna(r.signature) else str(r.signature)
                hit = sig is not None and sig in held
                answer = held.pop(sig) if hit else None if pd.isna(r.response) else r.response
                if sig is not None:
                    held[sig] = answer
                    if len(held) > size:
                        held.pop(next(iter(held)))
                ms = 0.0 if pd.isna(r.latency_ms) else float(r.latency_ms)
                n, first, last = n + 1, (first + [ms])[:5], (last + [ms])[-5:]
                out.append((key[0], int(r.id), answer, hit, n, n >= 10 and sum(last) > 0 and sum(first) / sum(last) > 2))
        state.update((json.dumps([held, n, first, last]),))
        yield pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(["session", "id", "response", "hit", "n", "observable"])})

    kind = stream.schema["session"].dataType.simpleString()
    return stream.groupBy("session").applyInPandasWithState(run, f"session {kind}, id long, response string, hit boolean, n long, observable boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def scorer_gate(stream: DataFrame, window: int = 50, least: float = 0.6) -> DataFrame:
    """key, id, block and enabled for rows (key, id, borderline): a full window with a share of borderline rows below
    least closes the gate of its key for good, from the row that completes it on."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, hits, enabled = state.get if state.exists else (0, 0, True)
        out = []
        for f in frames:
            for r in f.sort_values("id").itertuples(index=False):
                hits += int(bool(r.borderline) and not pd.isna(r.borderline))
                seen += 1
                if seen % window == 0:
                    enabled, hits = enabled and hits / window >= least, 0
                out.append((key[0], int(r.id), (seen - 1) // window, enabled))
        state.update((seen, hits, enabled))
        yield pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(["key", "id", "block", "enabled"])})

    return stream.groupBy("key").applyInPandasWithState(run, "key string, id long, block long, enabled boolean", "seen long, hits long, enabled boolean", "append", GroupStateTimeout.NoTimeout)


def interrupted(df: DataFrame, key: str, order: str, hello: str, broken: str) -> DataFrame:
    """df with failed: a stream that broke fails, from that frame on, until its next hello.

    Hellos are counted first; between two of them a frame fails if one before it, or itself, is broken."""
    sofar = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("epoch_", F.count_if(F.col(hello)).over(sofar))
    since = Window.partitionBy(key, "epoch_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("failed", F.coalesce(F.bool_or(F.col(broken)).over(since), F.lit(False))).drop("epoch_")


@query("str_interrupted", """WITH b AS (SELECT session_id, id, max(CASE WHEN event_type = 'signup' THEN id END) OVER w AS hello, max(CASE WHEN event_type = 'error' AND latency_ms > 60 THEN id END) OVER w AS broken FROM audit WINDOW w AS (PARTITION BY session_id ORDER BY id))
SELECT session_id, id, coalesce(broken >= coalesce(hello, -1), false) AS failed FROM b""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "audit").withColumns({"hello": F.col("event_type") == "signup", "broken": (F.col("event_type") == "error") & (F.col("latency_ms") > 60)})
    return interrupted(a, "session_id", "id", "hello", "broken").select("session_id", "id", "failed")


@query("str_gate_states", """WITH b AS (SELECT event_type, id, original_size BETWEEN 400 AND 2048 AS hit, row_number() OVER (PARTITION BY event_type ORDER BY id) AS n FROM audit), g AS (SELECT event_type, (n - 1) // 50 AS block, count(*) FILTER (hit) AS hits, count(*) AS n FROM b GROUP BY ALL)
SELECT b.event_type, b.id, (b.n - 1) // 50 AS block, NOT EXISTS (SELECT 1 FROM g WHERE g.event_type = b.event_type AND g.n = 50 AND g.hits < 30 AND (g.block + 1) * 50 <= b.n) AS enabled FROM b""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The gate's state at every row: windows are counted first, and the first bad one closes the gate."""
    a = read(spark, d, "audit").withColumn("bin", F.expr("id div 65536"))
    a = numbered(a, ["bin"], ["id"], "rn", ("event_type",)).withColumn("block", F.expr("rn div 50"))
    bad = a.groupBy("event_type", "block").agg(F.count("*").alias("n"), F.count_if(F.col("original_size").between(400, 2048)).alias("hits")).where("n = 50 AND hits < 30")
    closed = bad.groupBy("event_type").agg(F.min("block").alias("closed"))
    at = a.join(closed, "event_type", "left")
    return at.select("event_type", "id", "block", F.coalesce(F.col("rn") + 1 < (F.col("closed") + 1) * 50, F.lit(True)).alias("enabled"))
