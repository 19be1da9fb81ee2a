"""Session state machines as streams against plain versions, and the blob store."""

import random

from pyspark.sql import functions as F

from weft.functions.frames import fast_path
from weft.sources import tables
from weft.streaming import gates


def streamed(spark, tmp_path, batches, schema, operator, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    query = operator(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_conversations_answer_from_their_cache(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i % 2, i, rng.choice(["a", "b", "c", None]), f"r{i}", 100.0 if i < 12 else 1.0) for i in range(40)]
    got = streamed(spark, tmp_path, [rows[:25], rows[25:]], "session long, id long, signature string, response string, latency_ms double", lambda s: gates.conversations(s, 2), "talks")
    want, held, times = {}, {0: {}, 1: {}}, {0: [], 1: []}
    for s, i, sig, response, ms in rows:
        hit = sig is not None and sig in held[s]
        answer = held[s].pop(sig) if hit else response
        if sig is not None:
            held[s][sig] = answer
            while len(held[s]) > 2:
                held[s].pop(next(iter(held[s])))
        times[s].append(ms)
        t = times[s]
        want[i] = (s, answer, hit, len(t), len(t) >= 10 and sum(t[:5]) / sum(t[-5:]) > 2)
    assert {r["id"]: (r["session"], r["response"], r["hit"], r["n"], r["observable"]) for r in got} == want
    assert any(x[2] for x in want.values()) and any(x[4] for x in want.values())


def test_gate_closes_for_good(spark, tmp_path):
    rows = [("k", i, True) for i in range(10)] + [("k", i, None if i % 2 else False) for i in range(10, 17)] + [("k", i, True) for i in range(17, 30)] + [("q", 0, False)]
    got = streamed(spark, tmp_path, [rows[:13], rows[13:]], "key string, id long, borderline boolean", lambda s: gates.scorer_gate(s, 10, 0.6), "gate")
    state = {(r["key"], r["id"]): (r["block"], r["enabled"]) for r in got}
    assert state == {("k", i): (i // 10, i < 19) for i in range(30)} | {("q", 0): (0, True)}


def test_interrupted_streams_against_a_walk(spark):
    rng = random.Random(9)
    rows = [(i % 3, i, rng.random() < 0.1, rng.choice([True, False, False, False, None])) for i in range(200)]
    failed, want = {}, {}
    for k, i, hello, broken in rows:
        failed[k] = bool(broken) if hello else failed.get(k, False) or bool(broken)
        want[i] = failed[k]
    got = gates.interrupted(spark.createDataFrame(rows, "k long, id long, hello boolean, broken boolean"), "k", "id", "hello", "broken").collect()
    assert {r["id"]: r["failed"] for r in got} == want


def test_blobs_expire_move_and_are_replaced(spark):
    now = F.timestamp_seconds(F.lit(1000))
    put = lambda rows: spark.createDataFrame(rows, "name string, data string, at long, ttl_seconds long").withColumn("stored_at", F.timestamp_seconds("at")).drop("at")
    empty = spark.createDataFrame([], "key string, data string, stored_at timestamp, ttl_seconds long, tier string")
    store = tables.put_blobs(empty, put([("a", "1", 900, 100), ("b", "1", 899, 100), ("c", "1", 1, None), ("d", "1", 1, 0), ("e", "1", 5, None)]))
    store = tables.put_blobs(tables.to_cold(store, spark.createDataFrame([("c",), ("e",), ("none",)], "name string")), put([("e", "2", 6, None), ("a", "0", 800, 1)]))
    names = spark.createDataFrame([(x,) for x in ["a", "a", "b", "c", "d", "e", "x", None]], "name string")
    got = sorted(map(tuple, tables.get_blobs(store, names, now).collect()))
    assert got == [("a", "1", "hot"), ("c", "1", "cold"), ("d", "1", "hot"), ("e", "2", "hot")]


def test_short_headers_have_no_record(spark):
    df = spark.createDataFrame([(bytearray(11),), (None,)], "b binary").select(fast_path(F.col("b")).alias("r"))
    assert [r["r"] for r in df.collect()] == [None, None]
