"""Sources and sinks: JSON-lines logs, key-value stores, corpora, telemetry, chunked files and containers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.registry import query, read

LOG_SCHEMA = "seq long, log_type string, session_id string, user_id string, plaintext string, _corrupt string"


def read_log(spark: SparkSession, path: str, log_type: str | None = None, session_id: str | None = None, user_id: str | None = None, limit: int = 100) -> DataFrame:
    """First limit entries in file order that satisfy the filters; corrupt lines are skipped."""
    df = spark.read.schema(LOG_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt IS NULL").drop("_corrupt")
    for c, v in (("log_type", log_type), ("session_id", session_id), ("user_id", user_id)):
        df = df.where(F.col(c) == v) if v is not None else df
    return df.orderBy("seq").limit(limit)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert(current: DataFrame, changes: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Per key the value written last; of equal times the greater value."""
    return current.unionByName(changes).groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value))


def chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, idx, chunk) of binary files, cut every size bytes."""
    f = spark.read.format("binaryFile").load(path).select("path", "content")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size).cast("int"))
    return f.select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")).select("path", "idx", F.expr(f"substring(content, idx * {size} + 1, {size})").alias("chunk"))


MAGIC = b"WFT1"


def write_container(rows: list[tuple[str, bytes]]) -> bytes:
    """Header, then per chunk its length-prefixed metadata and payload."""
    out = MAGIC + struct.pack(">I", len(rows))
    for meta, payload in rows:
        m = meta.encode()
        out += struct.pack(">II", len(m), len(payload)) + m + payload
    return out


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, meta, payload_bytes) of containers; payloads are skipped, not decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                if content[:4] != MAGIC:
                    raise ValueError(f"no container: {p}")
                at = 8
                for k in range(struct.unpack(">I", content[4:8])[0]):
                    m, n = struct.unpack(">II", content[at : at + 8])
                    rows.append((p, k, content[at + 8 : at + 8 + m].decode(), n))
                    at += 8 + m + n
            yield pd.DataFrame(rows, columns=["path", "idx", "meta", "payload_bytes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, idx int, meta string, payload_bytes long")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, meta, payload) of containers. Fewer chunks than the header says, a cut chunk or bytes after the
    last one are errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                if content[:4] != MAGIC:
                    raise ValueError(f"no container: {p}")
                at, count = 8, struct.unpack(">I", content[4:8])[0]
                for k in range(count):
                    if at + 8 > len(content):
                        raise ValueError(f"container is cut: {p}")
                    m, n = struct.unpack(">II", content[at : at + 8])
                    if at + 8 + m + n > len(content):
                        raise ValueError(f"container is cut: {p}")
                    body = at + 8 + m
                    yield pd.DataFrame([(p, k, content[at + 8 : body].decode(), content[body : body + n])], columns=["path", "idx", "meta", "payload"])
                    at = body + n
                if at != len(content):
                    raise ValueError(f"container is longer than its chunks: {p}")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, idx int, meta string, payload binary")


@query("src_upsert", "SELECT user_id, max_by(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_type", "ts")
    return upsert(e.where("event_type <> 'click'"), e.where("event_type = 'click'"), "user_id", "event_type", "ts")


@query("src_cache_load", "SELECT id, session_id FROM audit ORDER BY latency_ms DESC, id LIMIT 64")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").orderBy(F.desc("latency_ms"), "id").limit(64).select("id", "session_id")


@query("src_store_scan", "SELECT p_brand AS scope, p_partkey AS template_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("template_id"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("rank"))


@query("src_bursty", "SELECT range AS idx, CASE WHEN range % 16 = 0 THEN 'large' WHEN range % 4 = 0 THEN 'medium' ELSE 'small' END AS size_class FROM range(1024)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1024).select(F.col("id").alias("idx"), F.when(F.col("id") % 16 == 0, "large").when(F.col("id") % 4 == 0, "medium").otherwise("small").alias("size_class"))


@query("src_conversation_mix", "SELECT s.range AS session, m.range AS seq, ['greeting', 'query', 'result', 'status'][m.range % 4 + 1] AS kind FROM range(20) s CROSS JOIN range(12) m")
def _(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("greeting", "query", "result", "status")])
    return spark.range(20).select(F.col("id").alias("session"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("seq")).withColumn("kind", F.element_at(kinds, (F.col("seq") % 4 + 1).cast("int")))


@query("src_flat_corpus", "SELECT conv_id, turn, role FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    nested = read(spark, d, "msgs").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("events"))
    return nested.select("conv_id", F.explode("events").alias("e")).select("conv_id", "e.*")


@query("src_telemetry_hydrate", "SELECT event_type, count(*) AS n, max(original_size) AS most FROM audit GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Counters that resume after a restart: the greatest of each running column; see stores.hydrate for the files."""
    return read(spark, d, "audit").groupBy("event_type").agg(F.count("*").alias("n"), F.max("original_size").alias("most"))


@query("src_blob_tiers", "SELECT sha256(entry_id) AS key, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'cold' ELSE 'hot' END AS tier FROM audit WHERE ts + INTERVAL 20 DAY > TIMESTAMP '2024-01-25'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").where("ts + INTERVAL 20 DAYS > TIMESTAMP_NTZ '2024-01-25'").select(F.sha2("entry_id", 256).alias("key"), F.when(F.expr("ts < TIMESTAMP_NTZ '2024-01-15'"), "cold").otherwise("hot").alias("tier"))


def put_blobs(store: DataFrame, new: DataFrame) -> DataFrame:
    """store(key, data, stored_at, ttl_seconds, tier) with new(name, data, stored_at, ttl_seconds): a blob's key is the
    SHA-256 of its name, it goes to the hot tier, and the latest of a key stays."""
    hot = new.select(F.sha2(F.col("name"), 256).alias("key"), "data", "stored_at", "ttl_seconds", F.lit("hot").alias("tier"))
    order = F.struct("stored_at", (F.col("tier") == "hot").alias("fresh"), "data")
    return store.unionByName(hot).groupBy("key").agg(F.max_by(F.struct("data", "stored_at", "ttl_seconds", "tier"), order).alias("b")).select("key", "b.*")


def alive(store: DataFrame, now: Column) -> DataFrame:
    """What has not expired; without a time to live (null or 0) a blob stays."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col("stored_at"))
    return store.where(F.coalesce(F.col("ttl_seconds"), F.lit(0)) == 0).unionByName(store.where((F.col("ttl_seconds") != 0) & (age <= F.col("ttl_seconds"))))


def get_blobs(store: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """name, data and tier of the blobs asked for that are there and alive."""
    asked = names.select("name").distinct().withColumn("key", F.sha2(F.col("name"), 256))
    return asked.join(alive(store, now), "key").select("name", "data", "tier")


def to_cold(store: DataFrame, names: DataFrame) -> DataFrame:
    gone = names.select(F.sha2(F.col("name"), 256).alias("key")).distinct().withColumn("moved", F.lit(True))
    return store.join(gone, "key", "left").withColumn("tier", F.when(F.col("moved"), "cold").otherwise(F.col("tier"))).drop("moved")


@query("src_blob_store", """WITH p AS (SELECT user_id, max_by(entry_id, (ts, entry_id)) AS data, max(ts) AS put_at, max_by(id % 30, (ts, entry_id)) AS days FROM audit GROUP BY user_id)
SELECT 'u' || user_id AS name, data, CASE WHEN user_id % 3 = 0 THEN 'cold' ELSE 'hot' END AS tier FROM p WHERE user_id % 2 = 0 AND (days = 0 OR epoch(TIMESTAMP '2024-02-10')::BIGINT - floor(epoch(put_at))::BIGINT <= days * 86400)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every user's last entry is put, a third is moved to the cold tier, and even users are asked for later."""
    a = read(spark, d, "audit").select(F.concat(F.lit("u"), "user_id").alias("name"), "user_id", F.col("entry_id").alias("data"), F.col("ts").cast("timestamp").alias("stored_at"), (F.col("id") % 30 * 86400).alias("ttl_seconds"))
    empty = spark.createDataFrame([], "key string, data string, stored_at timestamp, ttl_seconds long, tier string")
    store = to_cold(put_blobs(empty, a), a.where("user_id % 3 = 0"))
    return get_blobs(store, a.where("user_id % 2 = 0"), F.lit("2024-02-10 00:00:00").cast("timestamp"))


@query("src_bursty_messages", """SELECT range AS idx, '{"index":' || range || CASE WHEN range % 16 = 0 THEN ',"burst":{"kind":"large","chunks":[' || array_to_string(list_transform(range(0, 8), lambda c: '{"index":' || c || ',"text":"segment ' || c || ' of message ' || range.range || '"}'), ',') || ']}'
 WHEN range % 4 = 0 THEN ',"burst":{"kind":"medium","summary":"message ' || range || '"}' ELSE '' END || ',"profile":{"name":"bursty","size_class":"' || CASE WHEN range % 16 = 0 THEN 'large' WHEN range % 4 = 0 THEN 'medium' ELSE 'small' END || '"}}' AS body FROM range(1024)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bursty(spark, 1024)


def bursty(spark: SparkSession, count: int) -> DataFrame:
    """idx and JSON body: every sixteenth message carries eight segments, every fourth a summary."""
    i = F.col("id")
    text = lambda c: F.concat(F.lit("segment "), c, F.lit(" of message "), i)
    chunks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.struct(c.alias("index"), text(c).alias("text")))
    kind = F.when(i % 16 == 0, "large").when(i % 4 == 0, "medium").otherwise("small")
    burst = F.when(kind != "small", F.struct(kind.alias("kind"), F.when(kind == "large", chunks).alias("chunks"), F.when(kind == "medium", F.concat(F.lit("message "), i)).alias("summary")))
    return spark.range(count).select(i.alias("idx"), F.to_json(F.struct(i.alias("index"), burst.alias("burst"), F.struct(F.lit("bursty").alias("name"), kind.alias("size_class")).alias("profile"))).alias("body"))
