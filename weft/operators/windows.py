"""Window-shaped operators: positions, running values, count windows with a latch, hit tests and link queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.registry import query, read


def running(df: DataFrame, within: list[str], bins: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums within a key, in the order of bins, then order.  Rows are ordered within their bin only; bins
    are summed first and take their offsets from a running sum over those, so a hot key is not one task."""
    keys, before, here = [*within, *bins], Window.partitionBy(*within).orderBy(*bins), Window.partitionBy(*within, *bins).orderBy(*order)
    before, here = before.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    part = df.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    part = part.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], *[F.sum(n).over(before).alias(f"__{n}") for n in sums])
    rows = df.withColumns({n: F.sum(e).over(here) for n, e in sums.items()})
    same = [rows[k].eqNullSafe(part[f"__key{i}"]) for i, k in enumerate(keys)]
    both = {n: F.when(F.col(n).isNull(), F.col(f"__{n}")).otherwise(F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0))) for n in sums}
    return rows.join(part, same).withColumns(both).drop(*[c for c in part.columns])


def numbered(df: DataFrame, bins: list[str], order: list[str], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Positions from 0 (within a key) in the order of bins, then order."""
    return running(df, list(within), bins, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


@query("win_epoch_direction", "SELECT conv_id, turn, rn // 2 AS exchange, CASE WHEN rn % 2 = 0 THEN 'client_to_server' ELSE 'server_to_client' END AS direction, CASE WHEN rn // 2 < 2 THEN 0 ELSE 1 END AS epoch FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM msgs)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return read(spark, d, "msgs").withColumn("rn", rn).select("conv_id", "turn", F.expr("rn div 2").alias("exchange"), F.when(F.col("rn") % 2 == 0, "client_to_server").otherwise("server_to_client").alias("direction"), F.when(F.expr("rn div 2") < 2, 0).otherwise(1).alias("epoch"))


@query("win_progressive_latency", """SELECT session_id, n >= 10 AND coalesce(a / nullif(b, 0), 0) > 2 AS observable FROM (SELECT session_id, max(n) AS n, avg(latency_ms) FILTER (up <= 5) AS a, avg(latency_ms) FILTER (down <= 5) AS b
 FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS up, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS down, count(*) OVER (PARTITION BY session_id) AS n FROM audit) GROUP BY session_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id")
    a = read(spark, d, "audit").withColumns({"up": F.row_number().over(w.orderBy("id")), "down": F.row_number().over(w.orderBy(F.desc("id")))})
    g = a.groupBy("session_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("up") <= 5, F.col("latency_ms"))).alias("a"), F.avg(F.when(F.col("down") <= 5, F.col("latency_ms"))).alias("b"))
    return g.select("session_id", ((F.col("n") >= 10) & (F.coalesce(F.try_divide("a", "b"), F.lit(0.0)) > 2)).alias("observable"))


@query("win_scorer_gate", """WITH b AS (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY id) - 1) // 50 AS block, original_size FROM audit), g AS (SELECT event_type, block, count(*) AS n, avg(CASE WHEN original_size BETWEEN 400 AND 2048 THEN 1.0 ELSE 0.0 END) AS share FROM b GROUP BY ALL)
SELECT event_type, block, round(share, 6) AS share, min(CASE WHEN n = 50 AND share < 0.6 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY block) AS enabled FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "audit").withColumn("bin", F.expr("id div 65536"))
    b = numbered(a, ["bin"], ["id"], "rn", ("event_type",)).withColumn("block", F.expr("rn div 50"))
    g = b.groupBy("event_type", "block").agg(F.count("*").alias("n"), F.avg(F.col("original_size").between(400, 2048).cast("int")).alias("share"))
    latch = F.min(F.when((F.col("n") == 50) & (F.col("share") < 0.6), 0).otherwise(1)).over(Window.partitionBy("event_type").orderBy("block"))
    return g.select("event_type", "block", F.round("share", 6).alias("share"), latch.alias("enabled"))


@query("win_running_mean", "SELECT id, CAST(sum(CAST(latency_ms AS DECIMAL(18, 2))) OVER w AS DOUBLE) / count(*) OVER w AS mean FROM audit WINDOW w AS (PARTITION BY event_type ORDER BY id ROWS UNBOUNDED PRECEDING)")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "audit").withColumn("bin", F.expr("id div 65536"))
    r = running(a, ["event_type"], ["bin"], ["id"], {"total": F.col("latency_ms").cast("decimal(18,2)"), "n": F.lit(1)})
    return r.select("id", (F.col("total").cast("double") / F.col("n")).alias("mean"))


@query("win_cache_hits", "SELECT session_id, count(*) AS n, count(*) FILTER (k > 1) AS hits, round(count(*) FILTER (k > 1) / count(*), 9) AS hit_rate FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id, event_type, user_id ORDER BY id) AS k FROM audit) GROUP BY session_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("session_id", "event_type", "user_id").orderBy("id"))
    hit = F.count_if(F.col("k") > 1)
    return read(spark, d, "audit").withColumn("k", k).groupBy("session_id").agg(F.count("*").alias("n"), hit.alias("hits"), F.round(hit / F.count("*"), 9).alias("hit_rate"))


@query("win_relative_to_first", "SELECT run, round(p95_ms / first_value(p95_ms) OVER (PARTITION BY target, codec ORDER BY run), 6) AS scaling FROM runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    first = F.first("p95_ms", ignorenulls=True).over(Window.partitionBy("target", "codec").orderBy("run"))
    return read(spark, d, "runs").select("run", F.round((F.col("p95_ms") / first).cast("double"), 6).alias("scaling"))


@query("win_last_n", "SELECT session_id, id FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS k FROM audit) WHERE k <= 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))
    return read(spark, d, "audit").withColumn("k", k).where("k <= 20").select("session_id", "id")


def link_queue(df: DataFrame, key: str | list[str], order: str, arrival: str, service: str) -> DataFrame:
    """Finish of each frame on a shared link: max(arrival, finish before) + service, in closed form."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("sum_", F.sum(service).over(w))
    return df.withColumn("finish", F.col("sum_") + F.max(F.col(arrival) - (F.col("sum_") - F.col(service))).over(w)).drop("sum_")


@query("str_link_queue", """WITH RECURSIVE q AS (SELECT session_id, id, (epoch_us(ts) // 60000000) AS arrival, original_size AS service, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM audit),
f AS (SELECT session_id, id, rn, arrival + service AS finish FROM q WHERE rn = 1 UNION ALL SELECT q.session_id, q.id, q.rn, greatest(q.arrival, f.finish) + q.service FROM f JOIN q ON q.session_id = f.session_id AND q.rn = f.rn + 1) SELECT session_id, id, finish FROM f""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "audit").withColumn("arrival", F.expr("unix_micros(cast(ts AS timestamp)) div 60000000"))
    return link_queue(a, "session_id", "id", "arrival", "original_size").select("session_id", "id", "finish")


@query("win_trigram_share", "WITH g AS (SELECT conv_id, turn, length(s) AS n, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS g FROM (SELECT conv_id, turn, substr(text, 1, 500) AS s FROM msgs WHERE length(text) >= 20)), c AS (SELECT conv_id, turn, n, g, count(*) AS k FROM g GROUP BY ALL) SELECT conv_id, turn, round(least(1.0, max(k) / (max(n) - 2) * 3), 6) AS repetition FROM c GROUP BY conv_id, turn")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "msgs").where("length(text) >= 20").select("conv_id", "turn", F.substring("text", 1, 500).alias("s"))
    g = s.select("conv_id", "turn", F.length("s").alias("n"), F.explode(F.expr("transform(sequence(1, length(s) - 2), i -> substring(s, i, 3))")).alias("g"))
    return g.groupBy("conv_id", "turn", "n", "g").count().groupBy("conv_id", "turn").agg(F.round(F.least(F.lit(1.0), F.max("count") / (F.max("n") - 2) * 3), 6).alias("repetition"))


_BYTE = "CAST('0x' || substr(hex(encode(text)), 2 * (i + {k}) + 1, 2) AS BIGINT)"
_STEP = "((xor({h}, {b}) * 16777619) & 4294967295)"
_HASH = _STEP.format(h=_STEP.format(h=_STEP.format(h="2166136261", b=_BYTE.format(k=0)), b=_BYTE.format(k=1)), b=_BYTE.format(k=2))


@query("win_rolling_hash3", f"SELECT item_id, CASE WHEN strlen(text) >= 3 THEN array_to_string(list_transform(range(0, strlen(text) - 2), lambda i: {_HASH}), ',') ELSE '' END AS hashes FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    from weft.functions.text import rolling_hash3

    return read(spark, d, "benchmark").select("item_id", F.array_join(rolling_hash3("text").cast("array<string>"), ",").alias("hashes"))


@query("agg_least_loaded_workers", None)
def _(spark: SparkSession, d: str) -> DataFrame:
    return least_loaded(read(spark, d, "audit"), "session_id", "id", "original_size", 4)


def least_loaded(df: DataFrame, key: str, order: str, size: str, workers: int) -> DataFrame:
    """Each message, in order, to the worker with the least load; ties to the lowest. One pass per key."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, loads, out = pdf.sort_values(order), [0] * workers, []
        for s in pdf[size]:
            k = min(range(workers), key=loads.__getitem__)
            loads[k] += int(s)
            out.append(k)
        return pdf[[key, order]].assign(worker=out)

    cols = df.select(key, order, size)
    return cols.groupBy(key).applyInPandas(run, cols.select(key, order).schema.add("worker", "integer"))
