"""Join-shaped operators: pairing, baselines, grids, diffs, ordered lookups, negotiation, band and match joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, read


def pair_exchanges(df: DataFrame, session: str, exchange: str, side: str, sequence: str, message: str) -> DataFrame:
    """Requests with responses by (session, exchange); of duplicates the last by sequence counts."""
    last = df.groupBy(session, exchange, side).agg(F.max_by(message, sequence).alias("message"))
    ask, reply = (last.where(F.col(side) == s).select(session, exchange, F.col("message").alias(n)) for s, n in (("user", "request"), ("assistant", "response")))
    return ask.join(reply, [session, exchange])


@query("join_request_response", "SELECT q.conv_id, q.turn // 2 AS exchange, q.text AS request, r.text AS response FROM msgs q JOIN msgs r ON q.conv_id = r.conv_id AND q.turn // 2 = r.turn // 2 WHERE q.role = 'user' AND r.role = 'assistant'")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "msgs").withColumn("exchange", F.expr("turn div 2"))
    return pair_exchanges(m, "conv_id", "exchange", "role", "turn", "text")


@query("join_raw_baseline", "SELECT r.run, r.codec, coalesce(b.raw_bytes, 0.0) AS raw_bytes FROM runs r LEFT JOIN (SELECT profile, max(request_bytes + response_bytes)::DOUBLE AS raw_bytes FROM runs WHERE codec = 'raw' AND profile <> 'mesh' GROUP BY profile) b USING (profile)")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "runs")
    b = r.where("codec = 'raw' AND profile <> 'mesh'").groupBy("profile").agg(F.max(F.col("request_bytes") + F.col("response_bytes")).cast("double").alias("raw_bytes"))
    return r.join(b, "profile", "left").select("run", "codec", F.coalesce("raw_bytes", F.lit(0.0)).alias("raw_bytes"))


@query("join_capacity_grid", """SELECT profile, codec, mbps, window_size, least(up, down) AS capacity, CASE WHEN up <= down THEN 'uplink' ELSE 'downlink' END AS bottleneck,
 least(least(up, down), window_size / (p95 / 1000.0)) AS effective FROM (SELECT profile, codec, mbps, window_size, p95, mbps * 1000000.0 / 8.0 / req AS up, mbps * 1000000.0 / 8.0 / resp AS down
 FROM (SELECT profile, codec, avg(request_bytes) AS req, avg(response_bytes) AS resp, max(p95_ms) AS p95 FROM runs GROUP BY profile, codec) CROSS JOIN (SELECT unnest([1.0, 10.0, 100.0]) AS mbps) CROSS JOIN (SELECT unnest([8, 64]) AS window_size))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "runs").groupBy("profile", "codec").agg(F.avg("request_bytes").alias("req"), F.avg("response_bytes").alias("resp"), F.max("p95_ms").cast("double").alias("p95"))
    r = r.withColumn("mbps", F.explode(F.array(F.lit(1.0), F.lit(10.0), F.lit(100.0)))).withColumn("window_size", F.explode(F.array(F.lit(8), F.lit(64))))
    up, down = (F.col("mbps") * 1000000.0 / 8.0 / F.col(c) for c in ("req", "resp"))
    cap = F.least(up, down)
    return r.select("profile", "codec", "mbps", "window_size", cap.alias("capacity"), F.when(up <= down, "uplink").otherwise("downlink").alias("bottleneck"), F.least(cap, F.col("window_size") / (F.col("p95") / 1000.0)).alias("effective"))


def map_diff(current: DataFrame, desired: DataFrame, key: str, value: str) -> DataFrame:
    """What turns the current mapping into the desired one: add, update or remove per key."""
    j = current.select(key, F.col(value).alias("old")).join(desired.select(key, F.col(value).alias("new")), key, "full_outer")
    action = F.when(F.col("new").isNull(), "remove").when(F.col("old").isNull(), "add").otherwise("update")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, action.alias("action"), "new")


@query("join_map_diff", "SELECT p_partkey, CASE WHEN n.v IS NULL THEN 'remove' WHEN o.v IS NULL THEN 'add' ELSE 'update' END AS action, n.v AS new FROM (SELECT p_partkey, p_brand AS v FROM part WHERE p_size > 15) o FULL JOIN (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS v FROM part WHERE p_size < 40) n USING (p_partkey) WHERE o.v IS DISTINCT FROM n.v")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return map_diff(p.where("p_size > 15").selectExpr("p_partkey", "p_brand AS v"), p.where("p_size < 40").selectExpr("p_partkey", "CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS v"), "p_partkey", "v")


@query("join_append_only", "SELECT n.p_partkey, n.p_name FROM part n WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_partkey = n.p_partkey AND o.p_size > 15)")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    have = p.where("p_size > 15").select("p_partkey", F.col("p_name").alias("have"))
    j = p.join(have, "p_partkey", "left")
    return j.where(F.col("have").isNull() | F.when(F.col("have") != F.col("p_name"), F.raise_error(F.lit("one id, two patterns"))).otherwise(F.lit(False)).cast("boolean")).select("p_partkey", "p_name")


@query("join_first_offered", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'token' ELSE 'zlib' END END AS codec FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    offered = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("brotli"), F.lit("token"), F.lit("zlib"))).otherwise(F.array(F.lit("zlib"), F.lit("token")))
    able = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("token"), F.lit("zlib"))).otherwise(F.array(F.lit("none")))
    return read(spark, d, "orders").select("o_orderkey", F.get(F.array_intersect(offered, able), F.lit(0)).alias("codec"))


@query("join_route_overlap", """WITH r(ord, handler, ids) AS (VALUES (1, 'greet', [1, 2]), (2, 'task', [2, 3, 4]), (3, 'report', [5]))
SELECT id, min_by(handler, ord) AS handler FROM (SELECT id, [user_id % 7, original_size % 7] AS t FROM audit) a LEFT JOIN r ON list_has_any(a.t, r.ids) GROUP BY id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The first route that handles one of a message's templates.  Routes are turned round once (template to first
    route), so each row asks a map of them and nothing is joined or shuffled."""
    routes = [("greet", [1, 2]), ("task", [2, 3, 4]), ("report", [5])]
    first = {i: n for n, (_, ids) in reversed(list(enumerate(routes))) for i in ids}
    lut = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    place = F.array_min(F.transform(F.array("user_id", "original_size"), lambda x: lut[(x % 7).cast("int")]))
    return read(spark, d, "audit").select("id", F.get(F.array(*[F.lit(h) for h, _ in routes]), place).alias("handler"))


@query("join_sidechannel_route", "SELECT id, CASE WHEN user_id % 10 = 0 THEN 'security_block_handler' WHEN user_id % 10 = 1 THEN 'human_review_handler' WHEN latency_ms > 50 AND event_type = 'view' THEN 'code_interpreter_handler' WHEN latency_ms > 30 THEN 'web_fetch_handler' WHEN method IS NOT NULL AND method <> '' THEN 'template_response_handler' WHEN event_type = 'error' THEN 'clarification_handler' WHEN event_type = 'signup' THEN 'instruction_handler' ELSE 'general_nlp_handler' END AS handler FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").select("id", route_message(F.col("user_id") % 10, (F.col("latency_ms") > 50), F.when(F.col("event_type") == "view", "question"), F.col("latency_ms") > 30, F.nullif("method", F.lit("")), F.when(F.col("event_type") == "error", "clarification").when(F.col("event_type") == "signup", "instruction")).alias("handler"))


def route_message(level, code, intent, urls, template, category):  # noqa: ANN001, ANN201
    """Handler by ordered rules: security, code questions, links, templates, category."""
    return (
        F.when(level == 0, "security_block_handler").when(level == 1, "human_review_handler").when(code & (intent == "question"), "code_interpreter_handler").when(urls, "web_fetch_handler")
        .when(template.isNotNull(), "template_response_handler").when(category == "clarification", "clarification_handler").when(category == "instruction", "instruction_handler").otherwise("general_nlp_handler")
    )


# Intents by template id.
INTENTS = {0: "limitation", 1: "limitation", 2: "limitation", 10: "fact", 11: "fact", 12: "fact", 20: "definition", 21: "definition", 22: "definition", 30: "code_example", 31: "code_example", 32: "code_example", 40: "instruction", 41: "instruction", 42: "instruction", 60: "comparison", 61: "comparison", 70: "explanation", 71: "explanation", 80: "enumeration", 81: "enumeration", 90: "recommendation", 91: "recommendation", 100: "clarification", 101: "clarification", 120: "feature"}


@query("join_template_intent", "WITH i(template_id, intent) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in INTENTS.items()) + ") SELECT id, coalesce(intent, 'unknown') AS intent FROM audit LEFT JOIN i ON template_id = original_size % 130")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = spark.createDataFrame(list(INTENTS.items()), "template_id bigint, intent string")
    return read(spark, d, "audit").withColumn("template_id", F.col("original_size") % 130).join(F.broadcast(i), "template_id", "left").select("id", F.coalesce("intent", F.lit("unknown")).alias("intent"))


@query("join_band_buckets", "SELECT p.p_partkey, count(*) AS n FROM part p JOIN supplier s ON abs(length(p.p_name) // 4 - length(s.s_name) // 4) <= 1 GROUP BY p.p_partkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.explode(F.expr("sequence(length(p_name) div 4 - 1, length(p_name) div 4 + 1)")).alias("bucket"))
    s = read(spark, d, "supplier").groupBy(F.expr("length(s_name) div 4").alias("bucket")).count()
    return p.join(s, "bucket").groupBy("p_partkey").agg(F.sum("count").alias("n"))


@query("join_fuzzy_levenshtein", "SELECT s.s_suppkey, b.p_brand, levenshtein(s.s_name, b.p_brand) AS distance FROM supplier s JOIN (SELECT DISTINCT p_brand FROM part) b ON levenshtein(s.s_name, b.p_brand) <= 15 AND abs(length(s.s_name) - length(b.p_brand)) <= 15")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Texts meet in bands of their length: those within 15 edits are in the same band or the next one."""
    b = read(spark, d, "part").select("p_brand").distinct().withColumn("band", F.explode(F.expr("sequence(length(p_brand) div 15 - 1, length(p_brand) div 15 + 1)")))
    j = read(spark, d, "supplier").withColumn("band", F.expr("length(s_name) div 15")).join(b, "band").where(F.abs(F.length("s_name") - F.length("p_brand")) <= 15)
    return j.withColumn("distance", F.levenshtein("s_name", "p_brand", 15)).where("distance >= 0").select("s_suppkey", "p_brand", "distance")


@query("join_backend_deltas", """WITH a AS (SELECT codec, avg(p95_ms::DOUBLE) AS base FROM runs WHERE target < 10 GROUP BY codec), b AS (SELECT codec, avg(p95_ms::DOUBLE) AS cand FROM runs WHERE target >= 10 GROUP BY codec)
SELECT codec, round(100 * (cand - base) / nullif(base, 0), 6) AS delta_percent, round(base / nullif(cand, 0), 6) AS speedup FROM a JOIN b USING (codec)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "runs")
    a, b = (r.where(w).groupBy("codec").agg(F.avg(F.col("p95_ms").cast("double")).alias(n)) for w, n in (("target < 10", "base"), ("target >= 10", "cand")))
    return a.join(b, "codec").select("codec", F.round(F.try_divide(100 * (F.col("cand") - F.col("base")), F.col("base")), 6).alias("delta_percent"), F.round(F.try_divide("base", "cand"), 6).alias("speedup"))


@query("join_group_agreement", "SELECT target, bool_and(verified) AS all_accepted, count(DISTINCT codec) = 1 AS one_codec, max(shards) AS version FROM runs GROUP BY target")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").groupBy("target").agg(F.bool_and("verified").alias("all_accepted"), (F.count_distinct("codec") == 1).alias("one_codec"), F.max("shards").alias("version"))


@query("join_manifest_rules", "SELECT run, CASE WHEN NOT verified THEN 'schema_mismatch' WHEN shards > 6 THEN 'version_unsupported' WHEN codec = 'raw' THEN 'codec_unavailable' ELSE 'accepted' END AS reason FROM runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = [(~F.col("verified"), "schema_mismatch"), (F.col("shards") > 6, "version_unsupported"), (F.col("codec") == "raw", "codec_unavailable")]
    return read(spark, d, "runs").select("run", F.coalesce(*[F.when(c, r) for c, r in rules], F.lit("accepted")).alias("reason"))
