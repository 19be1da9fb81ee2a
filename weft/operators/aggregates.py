"""Grouped aggregates: corpus profiles, histograms, percentiles, mining and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.ngrams import frequent_ngrams
from weft.registry import query, read


def percentile_nearest(x: str, p: float) -> Column:
    """Nearest rank: element round((n - 1) p), half to even, of the sorted values."""
    xs = F.sort_array(F.collect_list(x))
    return F.element_at(xs, F.bround((F.size(xs) - 1) * F.lit(p)).cast("int") + 1)


def percentile_exclusive(x: str) -> Column:
    """19th of the exclusive 20-quantiles; the maximum of fewer than 20 values."""
    xs = F.sort_array(F.collect_list(x))
    m = 19 * (F.size(xs) + 1)
    j, w = F.floor(m / 20).cast("int"), (m % 20) / 20.0
    return F.when(F.size(xs) < 20, F.max(x)).otherwise(F.element_at(xs, j) * (1 - w) + F.element_at(xs, j + 1) * w)


@query("agg_corpus_summary", "SELECT count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(strlen(text)) AS least, max(strlen(text)) AS most, round(avg(strlen(text)), 6) AS mean FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = F.octet_length("text")
    return read(spark, d, "msgs").agg(F.count("*").alias("n"), F.sum(b).alias("bytes"), F.min(b).alias("least"), F.max(b).alias("most"), F.round(F.avg(b), 6).alias("mean"))


@query("agg_value_mixes", "SELECT 'role' AS field, role AS value, count(*) AS n FROM msgs GROUP BY role UNION ALL SELECT 'turn', CAST(turn AS VARCHAR), count(*) FROM msgs GROUP BY turn")
def _(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.explode(F.array(F.struct(F.lit("role").alias("field"), F.col("role").alias("value")), F.struct(F.lit("turn").alias("field"), F.col("turn").cast("string").alias("value"))))
    return read(spark, d, "msgs").select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


@query("agg_json_keys", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("agg_codec_rollup", """WITH g AS (SELECT codec, count(DISTINCT target) AS targets, max(shards) AS shards, CAST(sum(exchanges) AS BIGINT) AS exchanges, avg(p95_ms)::DOUBLE AS p95_avg, max(p95_ms)::DOUBLE AS p95_max, bool_and(verified) AS verified FROM runs GROUP BY codec)
SELECT g.codec, g.targets, g.shards, g.exchanges, round(g.p95_avg, 6) AS p95_avg, g.p95_max, g.verified, round(g.exchanges / r.exchanges, 6) AS to_raw FROM g CROSS JOIN (SELECT exchanges FROM g WHERE codec = 'raw') r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "runs").groupBy("codec").agg(F.count_distinct("target").alias("targets"), F.max("shards").alias("shards"), F.sum("exchanges").alias("exchanges"), F.round(F.avg("p95_ms").cast("double"), 6).alias("p95_avg"), F.max("p95_ms").cast("double").alias("p95_max"), F.bool_and("verified").alias("verified"))
    raw = g.where("codec = 'raw'").select(F.col("exchanges").alias("raw"))
    return g.join(F.broadcast(raw)).withColumn("to_raw", F.round(F.col("exchanges") / F.col("raw"), 6)).drop("raw")


@query("agg_percentile_linear", "SELECT event_type, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.percentile("value", 0.95).alias("p95"), F.percentile("value", 0.5).alias("p50"))


@query("agg_percentile_nearest", "SELECT user_id, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INTEGER) + 1] AS p95 FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(percentile_nearest("value", 0.95).alias("p95"))


@query("agg_percentile_exclusive", "WITH s AS (SELECT user_id, list_sort(list(value)) AS xs, 19 * (count(*) + 1) AS m FROM events GROUP BY user_id) SELECT user_id, CASE WHEN len(xs) < 20 THEN xs[-1] ELSE xs[m // 20] * (1 - (m % 20) / 20.0::DOUBLE) + xs[m // 20 + 1] * ((m % 20) / 20.0::DOUBLE) END AS p95 FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(percentile_exclusive("value").alias("p95"))


@query("agg_descriptive", "SELECT event_type, round(avg(value), 6) AS mean, median(value) AS median, min(value) AS least, max(value) AS most, round(coalesce(stddev_samp(value), 0), 6) AS stdev FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.median("value").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("stdev"))


@query("agg_method_usage", "SELECT codec, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, round(avg(CASE WHEN verified THEN 1 ELSE 0 END), 9) AS match_rate, round(avg(CASE WHEN request_bytes / response_bytes > 1.1 THEN 1 ELSE 0 END), 9) AS effective FROM runs GROUP BY codec")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "runs")
    g = r.groupBy("codec").agg(F.count("*").alias("n"), F.round(F.avg(F.col("verified").cast("int")), 9).alias("match_rate"), F.round(F.avg((F.col("request_bytes") / F.col("response_bytes") > 1.1).cast("int")), 9).alias("effective"))
    return g.join(g.agg(F.sum("n").alias("total"))).withColumn("share", F.round(F.col("n") / F.col("total"), 9)).drop("total")


@query("agg_method_effectiveness", "SELECT codec, max(request_bytes / response_bytes) AS best, min(request_bytes / response_bytes) AS worst, round(avg(request_bytes / response_bytes), 6) AS mean, round(coalesce(stddev_samp(request_bytes / response_bytes), 0), 6) AS spread, round(avg(CASE WHEN request_bytes / response_bytes > 1.1 THEN 1 ELSE 0 END), 9) AS effective FROM runs GROUP BY codec")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("request_bytes") / F.col("response_bytes")
    return read(spark, d, "runs").groupBy("codec").agg(F.max(r).alias("best"), F.min(r).alias("worst"), F.round(F.avg(r), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(r), F.lit(0.0)), 6).alias("spread"), F.round(F.avg((r > 1.1).cast("int")), 9).alias("effective"))


@query("agg_chunk_ratios", "SELECT coalesce(method, 'none') AS method, round(avg(original_size / compressed_size), 6) AS mean, round(median(original_size / compressed_size), 6) AS median, round(coalesce(stddev_samp(original_size / compressed_size), 0), 6) AS spread FROM audit GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("original_size") / F.col("compressed_size")
    return read(spark, d, "audit").groupBy(F.coalesce("method", F.lit("none")).alias("method")).agg(F.round(F.avg(r), 6).alias("mean"), F.round(F.median(r), 6).alias("median"), F.round(F.coalesce(F.stddev_samp(r), F.lit(0.0)), 6).alias("spread"))


@query("agg_tradeoff", "WITH m AS (SELECT min(request_bytes) a, max(request_bytes) b, min(p95_ms) c, max(p95_ms) e FROM runs) SELECT round(avg(0.6 * CASE WHEN b = a THEN 0.5 ELSE (request_bytes - a) / (b - a) END + 0.4 * CASE WHEN e = c THEN 0.5 ELSE 1 - (p95_ms - c) / (e - c) END), 6) AS score FROM runs, m")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "runs")
    m = r.agg(F.min("request_bytes").alias("a"), F.max("request_bytes").alias("b"), F.min("p95_ms").alias("c"), F.max("p95_ms").alias("e"))
    x = F.coalesce(F.try_divide(F.col("request_bytes") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.5))
    y = F.coalesce(1 - F.try_divide((F.col("p95_ms") - F.col("c")).cast("double"), (F.col("e") - F.col("c")).cast("double")), F.lit(0.5))
    return r.join(m).agg(F.round(F.avg(0.6 * x + 0.4 * y), 6).alias("score"))


@query("agg_routing_metrics", "SELECT count(*) AS total, count(*) FILTER (latency_ms < 5) AS fast, round(count(*) FILTER (latency_ms < 5) / count(*), 9) AS fast_share, round(coalesce(avg(latency_ms) FILTER (latency_ms >= 5) / avg(latency_ms) FILTER (latency_ms < 5), 1.0), 6) AS speedup FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    fast, slow = F.when(F.col("latency_ms") < 5, F.col("latency_ms")), F.when(F.col("latency_ms") >= 5, F.col("latency_ms"))
    return read(spark, d, "audit").agg(F.count("*").alias("total"), F.count(fast).alias("fast"), F.round(F.count(fast) / F.count("*"), 9).alias("fast_share"), F.round(F.coalesce(F.avg(slow) / F.avg(fast), F.lit(1.0)), 6).alias("speedup"))


@query("agg_utilisation", "WITH w AS (SELECT id % 8 AS worker, sum(original_size)::DOUBLE AS load FROM audit GROUP BY 1) SELECT sum(load) AS total, avg(load) AS mean, round(var_pop(load), 3) AS variance, round(CASE WHEN var_pop(load) > 0 THEN 1 / (1 + var_pop(load)) ELSE 1.0 END, 12) AS uniformity FROM w")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "audit").groupBy(F.col("id") % 8).agg(F.sum("original_size").cast("double").alias("load"))
    return w.agg(F.sum("load").alias("total"), F.avg("load").alias("mean"), F.round(F.var_pop("load"), 3).alias("variance"), F.round(F.when(F.var_pop("load") > 0, 1 / (1 + F.var_pop("load"))).otherwise(1.0), 12).alias("uniformity"))


@query("agg_stage_profile", "SELECT codec, stage, count(*) AS calls, CAST(sum(v) AS BIGINT) AS bytes FROM (SELECT codec, unnest(['request', 'response']) AS stage, unnest([request_bytes, response_bytes]) AS v FROM runs) GROUP BY codec, stage")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("request"), F.col("request_bytes"), F.lit("response"), F.col("response_bytes"))
    return read(spark, d, "runs").select("codec", F.explode(m).alias("stage", "v")).groupBy("codec", "stage").agg(F.count("*").alias("calls"), F.sum("v").alias("bytes"))


@query("agg_sweep_vs_raw", "SELECT profile, codec, round(avg(request_bytes + response_bytes) / max(avg(CASE WHEN codec = 'raw' THEN request_bytes + response_bytes END)) OVER (PARTITION BY profile), 6) AS to_raw FROM runs GROUP BY profile, codec")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "runs").groupBy("profile", "codec").agg(F.avg(F.col("request_bytes") + F.col("response_bytes")).alias("bytes"))
    raw = g.where("codec = 'raw'").select("profile", F.col("bytes").alias("raw"))
    return g.join(raw, "profile", "left").select("profile", "codec", F.round(F.col("bytes") / F.col("raw"), 6).alias("to_raw"))


@query("agg_byte_histogram", "WITH b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM msgs) SELECT CAST('0x' || x AS INTEGER) AS byte, count(*) AS n FROM b GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = F.explode(F.regexp_extract_all(F.hex(F.encode("text", "utf-8")), F.lit("(..)")))
    return read(spark, d, "msgs").select(x.alias("x")).groupBy("x").agg(F.count("*").alias("n")).select(F.conv("x", 16, 10).cast("int").alias("byte"), "n")


@query("agg_byte_entropy", "WITH b AS (SELECT conv_id, turn, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM msgs), c AS (SELECT conv_id, turn, x, count(*) AS n FROM b GROUP BY ALL) SELECT conv_id, turn, round(sum(-(n / t) * log2(n / t)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS t FROM c) GROUP BY conv_id, turn")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "msgs").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.hex(F.encode("text", "utf-8")), F.lit("(..)"))).alias("x"))
    c = x.groupBy("conv_id", "turn", "x").agg(F.count("*").alias("n"))
    # -sum p log2 p = log2 t - (sum n log2 n) / t
    return c.groupBy("conv_id", "turn").agg(F.round(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n"), 6).alias("entropy"))


@query("agg_char_ngrams", "SELECT gram, count(*) AS n FROM (SELECT substr(t, s, 12) AS gram FROM (SELECT t, unnest(range(1, length(t) - 10)) AS s FROM (SELECT DISTINCT substr(trim(text), 1, 80) AS t FROM msgs) WHERE length(t) >= 12)) GROUP BY gram HAVING count(*) >= 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "msgs").select(F.substring(F.trim("text"), 1, 80).alias("t")).distinct().where("length(t) >= 12")
    return t.select(F.explode(F.expr("transform(sequence(1, length(t) - 11), s -> substring(t, s, 12))")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 3")


@query("agg_frequent_ngrams")
def _(spark: SparkSession, d: str) -> DataFrame:
    return frequent_ngrams(read(spark, d, "msgs"), "text")


@query("agg_prefixes", "SELECT prefix, count(*) AS n FROM (SELECT rtrim(substr(text, 1, k)) AS prefix FROM (SELECT text, unnest(range(5, least(50, length(text)))) AS k FROM msgs) WHERE substr(text, k, 1) = ' ') GROUP BY prefix HAVING count(*) >= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "msgs").where("length(text) > 5").select("text", F.explode(F.expr("sequence(5, least(49, length(text) - 1))")).alias("k"))
    return k.where("substring(text, k, 1) = ' '").groupBy(F.expr("rtrim(substring(text, 1, k))").alias("prefix")).agg(F.count("*").alias("n")).where("n >= 2")


@query("agg_suffixes", "SELECT suffix, count(*) AS n FROM (SELECT ltrim(right(text, k)) AS suffix FROM (SELECT text, unnest(range(5, least(50, length(text)))) AS k FROM msgs) WHERE substr(text, length(text) - k + 1, 1) = ' ') GROUP BY suffix HAVING count(*) >= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "msgs").where("length(text) > 5").select("text", F.explode(F.expr("sequence(5, least(49, length(text) - 1))")).alias("k"))
    return k.where("substring(text, length(text) - k + 1, 1) = ' '").groupBy(F.expr("ltrim(right(text, k))").alias("suffix")).agg(F.count("*").alias("n")).where("n >= 2")


@query("agg_dictionary_terms", """WITH t AS (SELECT term, count(*) AS frames, CAST(sum(k) AS BIGINT) AS occurrences FROM (SELECT conv_id, turn, w AS term, count(*) AS k FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM msgs) WHERE length(w) >= 4 GROUP BY ALL) GROUP BY term)
SELECT term, frames, occurrences, strlen(term) AS bytes, (strlen(term) - 2) * (occurrences - 1) AS saved FROM t WHERE occurrences >= 2 ORDER BY saved DESC, occurrences DESC, bytes DESC, term DESC LIMIT 200""")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "msgs").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("term")).where("length(term) >= 4")
    t = w.groupBy("term", "conv_id", "turn").count().groupBy("term").agg(F.count("*").alias("frames"), F.sum("count").alias("occurrences")).where("occurrences >= 2")
    t = t.withColumn("bytes", F.octet_length("term")).withColumn("saved", (F.col("bytes") - 2) * (F.col("occurrences") - 1))
    return t.orderBy(F.desc("saved"), F.desc("occurrences"), F.desc("bytes"), F.desc("term")).limit(200)


@query("agg_source_sets", "SELECT l_partkey, list_sort(list(DISTINCT l_returnflag)) AS sources FROM lineitem GROUP BY l_partkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("sources"))


@query("agg_impairment_by_role", "SELECT codec, CAST(sum(greatest(0, request_bytes - response_bytes)) AS BIGINT) AS waited FROM runs GROUP BY codec HAVING sum(greatest(0, request_bytes - response_bytes)) > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").groupBy("codec").agg(F.sum(F.greatest(F.lit(0), F.col("request_bytes") - F.col("response_bytes"))).alias("waited")).where("waited > 0")


@query("agg_storage_stats", "SELECT count(*) AS n, CAST(sum(compressed_size) AS BIGINT) AS stored, round(avg(original_size / compressed_size), 6) AS mean_ratio, round(sum(original_size) / sum(compressed_size), 6) AS total_ratio FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("original_size") / F.col("compressed_size")
    return read(spark, d, "audit").agg(F.count("*").alias("n"), F.sum("compressed_size").alias("stored"), F.round(F.avg(r), 6).alias("mean_ratio"), F.round(F.sum("original_size") / F.sum("compressed_size"), 6).alias("total_ratio"))


@query("agg_latency_summary", "SELECT session_id, count(*) AS n, min(latency_ms) AS least, round(quantile_cont(latency_ms, 0.99), 6) AS p99, round(1000 * count(*) / sum(latency_ms), 6) AS per_second FROM audit GROUP BY session_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").groupBy("session_id").agg(F.count("*").alias("n"), F.min("latency_ms").alias("least"), F.round(F.percentile("latency_ms", 0.99), 6).alias("p99"), F.round(1000 * F.count("*") / F.sum("latency_ms"), 6).alias("per_second"))
