"""Set operations and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.registry import query, read


@query("set_intersection", "SELECT target, codec FROM runs WHERE verified INTERSECT SELECT target, codec FROM runs WHERE NOT verified")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "runs")
    return r.where("verified").select("target", "codec").intersect(r.where("NOT verified").select("target", "codec"))


@query("set_difference", "SELECT target, codec FROM runs WHERE verified EXCEPT SELECT target, codec FROM runs WHERE NOT verified")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "runs")
    return r.where("verified").select("target", "codec").subtract(r.where("NOT verified").select("target", "codec"))


@query("set_version_max", "SELECT run, CASE WHEN shards % 2 = 0 THEN 2 WHEN shards % 3 = 0 THEN 3 END AS version FROM runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    mine = F.array(F.lit(1), F.lit(2), F.lit(3))
    theirs = F.when(F.col("shards") % 2 == 0, F.array(F.lit(2), F.lit(5))).when(F.col("shards") % 3 == 0, F.array(F.lit(3), F.lit(7))).otherwise(F.array(F.lit(9)))
    return read(spark, d, "runs").select("run", F.array_max(F.array_intersect(mine, theirs)).alias("version"))


@query("set_union_no_conflict", """WITH a AS (SELECT DISTINCT p_size AS session, p_partkey % 400 AS id, CASE WHEN p_size % 2 = 0 OR p_partkey % 400 < 300 THEN 'template ' || p_partkey % 400 ELSE p_type END AS pattern FROM part)
SELECT id, CASE WHEN count(DISTINCT pattern) = 1 THEN min(pattern) END AS pattern, count(DISTINCT pattern) > 1 AS conflict, count(DISTINCT session) AS sessions FROM a GROUP BY id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Sessions' template maps united; an id for which they have different patterns is a conflict and has none."""
    p = read(spark, d, "part").withColumn("id", F.col("p_partkey") % 400)
    same = F.concat(F.lit("template "), F.col("id").cast("string"))
    even, odd = p.where("p_size % 2 = 0").select("p_size", "id", same.alias("pattern")), p.where("p_size % 2 <> 0").select("p_size", "id", F.when(F.col("id") < 300, same).otherwise(F.col("p_type")).alias("pattern"))
    of = even.unionByName(odd).groupBy("id").agg(F.min("pattern").alias("a"), F.max("pattern").alias("b"), F.count_distinct("p_size").alias("sessions"))
    return of.select("id", F.when(F.col("a") == F.col("b"), F.col("a")).alias("pattern"), (F.col("a") != F.col("b")).alias("conflict"), "sessions")


@query("set_dedup_terms", "SELECT DISTINCT role, text FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "msgs").select("role", "text").distinct()


@query("srt_argmax_score", "SELECT run, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS best FROM (SELECT run, request_bytes % 7 AS a, response_bytes % 5 AS b, exchanges % 6 AS c FROM runs)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = F.array(*[F.struct(x.alias("score"), F.lit(-k).alias("o"), F.lit(n).alias("name")) for k, (n, x) in enumerate((("a", F.col("request_bytes") % 7), ("b", F.col("response_bytes") % 5), ("c", F.col("exchanges") % 6)))])
    return read(spark, d, "runs").select("run", F.array_max(s)["name"].alias("best"))


@query("srt_limiting_factor", "SELECT run, CASE WHEN a <= b AND a <= c THEN 'bandwidth' WHEN b <= c THEN 'latency' ELSE 'cpu' END AS limit_by FROM (SELECT run, request_bytes AS a, response_bytes AS b, exchanges * 40 AS c FROM runs)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = F.array(*[F.struct(x.alias("v"), F.lit(k).alias("o"), F.lit(n).alias("name")) for k, (n, x) in enumerate((("bandwidth", F.col("request_bytes")), ("latency", F.col("response_bytes")), ("cpu", F.col("exchanges") * 40)))])
    return read(spark, d, "runs").select("run", F.array_min(s)["name"].alias("limit_by"))


@query("srt_best_readout", "SELECT min_by(codec, (p95_ms, run)) AS fastest, max_by(codec, (request_bytes, run)) AS heaviest FROM runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").agg(F.min_by("codec", F.struct("p95_ms", "run")).alias("fastest"), F.max_by("codec", F.struct("request_bytes", "run")).alias("heaviest"))


@query("srt_rank_templates", "SELECT rank, ps, n FROM (SELECT row_number() OVER (ORDER BY n DESC, ps) AS rank, ps, n FROM (SELECT p_type AS ps, count(*) AS n FROM part GROUP BY p_type)) WHERE rank <= 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    top = read(spark, d, "part").groupBy(F.col("p_type").alias("ps")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ps").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "ps")))


@query("srt_retire", "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey) - 1 AS place FROM part WHERE p_size < 10 OR p_retailprice > 1500")
def _(spark: SparkSession, d: str) -> DataFrame:
    from weft.operators.windows import numbered

    return numbered(read(spark, d, "part").where("p_size < 10 OR p_retailprice > 1500"), ["p_size"], ["p_retailprice", "p_partkey"], "place").select("p_partkey", "p_size", "place")


@query("srt_cold_cap", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k <= 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    return read(spark, d, "part").withColumn("k", k).where("k <= 10").select("p_brand", "p_partkey")
