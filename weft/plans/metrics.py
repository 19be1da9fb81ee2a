"""Run, cluster and session reports over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.registry import query, read


@query("agg_cluster_rollup", "SELECT count(*) AS runs, CAST(sum(exchanges) AS BIGINT) AS exchanges, round(sum(p95_ms::DOUBLE * exchanges) / sum(exchanges), 6) AS weighted_p95, max(p95_ms)::DOUBLE AS p95_max, count(*) FILTER (verified) AS verified FROM runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p95_ms").cast("double")
    return read(spark, d, "runs").agg(F.count("*").alias("runs"), F.sum("exchanges").alias("exchanges"), F.round(F.sum(p * F.col("exchanges")) / F.sum("exchanges"), 6).alias("weighted_p95"), F.max(p).alias("p95_max"), F.count_if("verified").alias("verified"))


@query("agg_rate_by_codec", "SELECT codec, round(sum(1000.0 * exchanges / p95_ms::DOUBLE), 4) AS rate FROM runs GROUP BY codec")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").groupBy("codec").agg(F.round(F.sum(1000.0 * F.col("exchanges") / F.col("p95_ms").cast("double")), 4).alias("rate"))


@query("agg_bandwidth_efficiency", "SELECT round(avg(request_bytes / response_bytes * CASE profile WHEN 'lan' THEN 940.0 WHEN 'wifi' THEN 90.0 WHEN 'lte' THEN 25.0 ELSE 8.0 END / 1000), 6) AS efficiency FROM runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    mbps = F.create_map(*[F.lit(x) for kv in (("lan", 940.0), ("wifi", 90.0), ("lte", 25.0), ("mesh", 8.0)) for x in kv])
    return read(spark, d, "runs").agg(F.round(F.avg(F.col("request_bytes") / F.col("response_bytes") * mbps[F.col("profile")] / 1000), 6).alias("efficiency"))


@query("agg_harness_metrics", "SELECT count(*) AS messages, count(*) FILTER (event_type IN ('view', 'click')) AS between_agents, round(count(*) FILTER (event_type IN ('view', 'click')) / count(*), 9) AS share, count(*) FILTER (event_type IN ('view', 'click')) / count(*) >= 0.6 AS on_target FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if(F.col("event_type").isin("view", "click"))
    return read(spark, d, "audit").agg(F.count("*").alias("messages"), n.alias("between_agents"), F.round(n / F.count("*"), 9).alias("share"), (n / F.count("*") >= 0.6).alias("on_target"))


@query("agg_method_running_stats", "SELECT event_type, count(*) AS n, round(avg(original_size / compressed_size), 6) AS mean_ratio, round(avg(latency_ms), 6) AS mean_ms FROM audit GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("original_size") / F.col("compressed_size")), 6).alias("mean_ratio"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"))


@query("agg_template_cache", "SELECT count(*) AS size, round(count(*) FILTER (regexp_matches(p_name, '^red .+$') OR regexp_matches(p_name, '^.+ ring$')) / count(*), 9) AS hit_rate, 2 AS library FROM (SELECT DISTINCT p_name FROM part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A match cache holds one outcome per text, a match or none; its hit rate is the share of matches."""
    from weft.operators.templates import match_templates

    library = [(1, "red {0}"), (2, "{0} ring")]
    cache = match_templates(read(spark, d, "part").select("p_name").distinct(), "p_name", library)
    return cache.agg(F.count("*").alias("size"), F.round(F.count("match") / F.count("*"), 9).alias("hit_rate"), F.lit(len(library)).alias("library"))


@query("agg_char_entropy", "WITH s AS (SELECT item_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 333) || substr(text, length(text) // 2 - 165, 332) || right(text, 333) END AS t FROM benchmark), c AS (SELECT item_id, ch, count(*) AS n FROM (SELECT item_id, unnest(string_split(t, '')) AS ch FROM s) GROUP BY ALL) SELECT item_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY item_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the characters, of three samples where a text is long."""
    t, n = F.col("text"), F.length("text")
    sample = F.when(n <= 1000, t).otherwise(F.concat(F.left(t, F.lit(333)), F.substring(t, F.expr("length(text) div 2 - 165"), F.lit(332)), F.right(t, F.lit(333))))
    c = read(spark, d, "benchmark").select("item_id", F.explode(F.split(sample, "")).alias("ch")).groupBy("item_id", "ch").agg(F.count("*").alias("n"))
    return c.groupBy("item_id").agg(F.round(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n"), 6).alias("entropy"))


@query("agg_smoothed_frequencies", "SELECT d, 1 + count(*) AS smoothed, greatest(1, (1 + count(*)) * 4096 // sum(1 + count(*)) OVER ()) AS scaled FROM (SELECT original_size % 10 AS d FROM audit) GROUP BY d")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "audit").groupBy((F.col("original_size") % 10).alias("d")).agg((F.count("*") + 1).alias("smoothed"))
    return g.join(g.agg(F.sum("smoothed").alias("total"))).select("d", "smoothed", F.greatest(F.lit(1), F.expr("smoothed * 4096 div total")).alias("scaled"))


@query("agg_scorer_status", "SELECT count(*) AS seen, count(*) FILTER (original_size BETWEEN 400 AND 2048) AS borderline, count(*) FILTER (original_size BETWEEN 400 AND 2048 AND latency_ms < 10) AS cheap FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("original_size").between(400, 2048)
    return read(spark, d, "audit").agg(F.count("*").alias("seen"), F.count_if(b).alias("borderline"), F.count_if(b & (F.col("latency_ms") < 10)).alias("cheap"))


@query("agg_template_usage", "SELECT id, CASE WHEN original_size % 3 = 0 THEN [original_size % 50] ELSE [] END AS templates FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Template ids in a stream of tagged tokens."""
    tokens = F.array(F.struct(F.when(F.col("original_size") % 3 == 0, "template").otherwise("literal").alias("tag"), (F.col("original_size") % 50).alias("value")), F.struct(F.lit("literal").alias("tag"), F.lit(0).cast("bigint").alias("value")))
    return read(spark, d, "audit").select("id", F.transform(F.filter(tokens, lambda t: t["tag"] == "template"), lambda t: t["value"]).alias("templates"))


@query("srt_longest_match", """SELECT p_partkey, max_by(id, (b - a, -a, -id)) AS template_id, max(b - a) AS length FROM (SELECT p_partkey, 1 AS id, 0 AS a, length(p_name) AS b FROM part WHERE regexp_full_match(p_name, '(?i)red .+')
 UNION ALL SELECT p_partkey, 2, strpos(p_name, ' ') , length(p_name) FROM part WHERE p_name LIKE '% ring' UNION ALL SELECT p_partkey, 3, 0, strpos(p_name, ' ') - 1 FROM part WHERE p_name LIKE 'small %') GROUP BY p_partkey""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Of the templates found inside a text, the one that covers most; of equal ones the first, then the smaller id."""
    from weft.operators.templates import longest_span

    return longest_span(read(spark, d, "part"), ["p_partkey"], "p_name", [(1, "red {0}"), (2, "ring"), (3, "small")]).select("p_partkey", "template_id", (F.col("end_at") - F.col("start_at")).alias("length"))


@query("srt_first_errors", "SELECT session_id, list_slice(list(id ORDER BY id), 1, 5) AS first_errors FROM audit WHERE kind = 'compression_failure' GROUP BY session_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("id")
    e = read(spark, d, "audit").where("kind = 'compression_failure'").withColumn("k", F.row_number().over(w)).where("k <= 5")
    return e.groupBy("session_id").agg(F.sort_array(F.collect_list("id")).alias("first_errors"))


@query("flt_resume_entry", "SELECT user_id, max(event_id) AS state FROM events WHERE event_type = 'view' GROUP BY user_id HAVING count(*) = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Lookups that name exactly one entry; ambiguous ones are no answer."""
    return read(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("state")).where("n = 1").drop("n")


@query("str_conversation_sessions", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, max(turn) AS last_turn FROM msgs GROUP BY conv_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "msgs").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max("turn").alias("last_turn"))


@query("udf_routing_hints", "SELECT id, CASE id % 3 WHEN 0 THEN 'scheduler' WHEN 1 THEN 'validator' ELSE 'custom_service' END AS service FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The function registry is a dimension; new names are appended rows."""
    from weft.functions.text import FUNCTIONS

    known = spark.createDataFrame([(k, h) for k, (_, h) in FUNCTIONS.items()], "name string, service string")
    registry = known.unionByName(spark.createDataFrame([("custom", "custom_service")], "name string, service string"))
    name = F.when(F.col("id") % 3 == 0, "schedule_job").when(F.col("id") % 3 == 1, "validate_input").otherwise("custom")
    return read(spark, d, "audit").select("id", name.alias("name")).join(F.broadcast(registry), "name").select("id", "service")


@query("sup_result_rows", "SELECT run, codec, request_bytes + response_bytes AS bytes, round((request_bytes + response_bytes) / greatest(1, exchanges), 6) AS bytes_per_exchange FROM runs WHERE verified")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("request_bytes") + F.col("response_bytes")
    return read(spark, d, "runs").where("verified").select("run", "codec", b.alias("bytes"), F.round(b / F.greatest(F.lit(1), F.col("exchanges")), 6).alias("bytes_per_exchange"))


@query("sup_client_latency", "SELECT target, count(*) AS n, min(p95_ms)::DOUBLE AS least, quantile_cont(p95_ms::DOUBLE, 0.5) AS p50, round(avg(p95_ms::DOUBLE), 6) AS mean, round(1000.0 * sum(exchanges) / sum(p95_ms::DOUBLE), 6) AS rate FROM runs GROUP BY target")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p95_ms").cast("double")
    return read(spark, d, "runs").groupBy("target").agg(F.count("*").alias("n"), F.min(p).alias("least"), F.percentile(p, 0.5).alias("p50"), F.round(F.avg(p), 6).alias("mean"), F.round(1000.0 * F.sum("exchanges") / F.sum(p), 6).alias("rate"))
