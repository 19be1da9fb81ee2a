"""Stores behind the logs: typed logs, audit ids, scoped template stores, legacy imports, corpora, telemetry, models and resume caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.windows import numbered


def append_by_type(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per log_type."""
    df.write.mode("append").partitionBy("log_type").json(path)


def append_audit(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """rows (ts, event_id, ...) with the next ids, in the order of ts and event_id, appended as Parquet.

    Rows are numbered within their hour, so no task orders all of them.
    """
    try:
        last = spark.read.parquet(path).agg(F.max("id")).first()[0] or 0
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = 0
    new = numbered(rows.withColumn("_hour", F.date_trunc("hour", "ts")), ["_hour"], ["ts", "event_id"], "id")
    new.withColumn("id", F.col("id") + F.lit(last + 1)).drop("_hour").write.mode("append").parquet(path)


def rewrite_scopes(df: DataFrame, path: str) -> None:
    """Replace the whole store of every scope that df has; other scopes stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").parquet(path)


def import_legacy(spark: SparkSession, path: str, scope: str) -> DataFrame:
    """(scope, template_id, pattern, usage_count) of a JSON file {"templates": {id: pattern or {"pattern", "usage_count"}}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.templates"), "map<string,string>").alias("m"))
    t = raw.select(F.explode("m").alias("id", "body")).where(F.col("id").rlike(r"^\d+$"))
    of = F.when(F.col("body").startswith("{"), F.get_json_object("body", "$.pattern")).otherwise(F.col("body"))
    uses = F.coalesce(F.when(F.col("body").startswith("{"), F.get_json_object("body", "$.usage_count")).cast("long"), F.lit(0))
    return t.select(F.lit(scope).alias("scope"), F.col("id").cast("long").alias("template_id"), of.alias("pattern"), uses.alias("usage_count")).where("pattern IS NOT NULL")


def write_corpus(sessions: DataFrame, path: str) -> None:
    """sessions(session, events array) as JSON lines with keys and sessions in a fixed order."""
    sessions.select(*sorted(sessions.columns)).repartitionByRange("session").sortWithinPartitions("session").write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(session, idx, event as JSON) of corpora written as {"sessions": [{"session", "events": [...]}]} or as JSON lines."""
    whole = spark.read.text(path, wholetext=True)
    kind = "struct<session:string,events:array<variant>>"
    nested = whole.select(F.from_json("value", f"struct<sessions:array<{kind}>>").alias("j")).where("j.sessions IS NOT NULL").select(F.explode("j.sessions").alias("s"))
    lines = spark.read.text(path).select(F.from_json("value", kind).alias("s")).where("s.session IS NOT NULL AND s.events IS NOT NULL")
    return nested.unionByName(lines).select("s.session", F.posexplode("s.events").alias("idx", "e")).select("session", "idx", F.to_json("e").alias("event"))


def read_benchmark(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows under "results" of benchmark reports, with their file."""
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    rows = raw.select("file", F.from_json(F.get_json_object("value", "$.results"), f"array<struct<{schema}>>").alias("rows"))
    return rows.select("file", F.explode("rows").alias("r")).select("file", "r.*")


TELEMETRY = "scorer string, seen long, borderline long, accepted long"


def append_telemetry(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def hydrate(spark: SparkSession, path: str) -> DataFrame:
    """Counters to go on from: the greatest of each running column; malformed lines are skipped."""
    t = spark.read.schema(TELEMETRY).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return t.groupBy("scorer").agg(*[F.max(c).alias(c) for c in ("seen", "borderline", "accepted")])


def save_model(weights: DataFrame, samples: DataFrame, path: str, keep: int = 1000) -> None:
    """weights(method, feature, weight) and the keep latest samples(at, ...), as JSON lines in two folders."""
    weights.orderBy("method", "feature").coalesce(1).write.mode("overwrite").json(f"{path}/weights")
    samples.orderBy(F.desc("at")).limit(keep).write.mode("overwrite").json(f"{path}/samples")


def load_model(spark: SparkSession, path: str, samples: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("method string, feature string, weight double").json(f"{path}/weights"), spark.read.schema(samples).json(f"{path}/samples")


RESUME = "namespace string, peer string, state_hash string, templates_hash string, at double"


def save_resume(cache: DataFrame, changes: DataFrame, path: str) -> None:
    """The later entry of each (namespace, peer, state_hash), in a new folder: a reader sees the old or the new one, never half."""
    cache.unionByName(changes).groupBy("namespace", "peer", "state_hash").agg(F.max_by("templates_hash", "at").alias("templates_hash"), F.max("at").alias("at")).write.mode("errorifexists").json(path)


def load_resume(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESUME).json(path).where("state_hash IS NOT NULL")


def resume_entries(cache: DataFrame, asked: DataFrame, strict: bool = False) -> DataFrame:
    """asked(namespace, state_hash, peer or null) with n entries, answer (found, missing, ambiguous) and templates_hash if found.

    With strict, an ambiguous row is an error of the query that reads it.
    """
    same = (cache["namespace"] == asked["namespace"]) & (cache["state_hash"] == asked["state_hash"]) & (asked["peer"].isNull() | (cache["peer"] == asked["peer"]))
    g = asked.join(cache.drop("at"), same, "left").groupBy(asked["namespace"], asked["state_hash"], asked["peer"]).agg(F.count(cache["peer"]).alias("n"), F.min(cache["templates_hash"]).alias("one"))
    answer: Column = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "found")
    answer = answer.otherwise(F.raise_error(F.lit("several resume entries match")) if strict else F.lit("ambiguous"))
    return g.select("namespace", "state_hash", "peer", "n", answer.alias("answer"), F.when(F.col("n") == 1, F.col("one")).alias("templates_hash"))


def forget(cache: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The match cache without the given keys."""
    return cache.join(keys.select(key), key, "left_anti")


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON line per row, nulls written too."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def latest(df: DataFrame, keys: list[str], at: str, n: int) -> DataFrame:
    """The n latest rows of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))).where(F.col("_k") <= n).drop("_k")
