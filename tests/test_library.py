"""Every query with oracle SQL against DuckDB, codecs by round trip, sources and streams end to end."""

import glob
import json
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weft import catalog
from weft.functions import codecs, phrases
from weft.operators.audit import build_chain, verify_chain
from weft.operators import supplement
from weft.operators.windows import least_loaded, numbered
from weft.sources import tables
from weft.streaming import sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, (int, str)) or v is None:
        return v
    try:
        return "nan" if math.isnan(v) else f"{float(v):.8g}"
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    rows = found.fetchall()
    assert sorted(names) == cols
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def payloads():
    rng = random.Random(1)
    return [b"", b"a", b"abababababababab" * 9, bytes(rng.randrange(256) for _ in range(700)), ("the quick brown fox é " * 40).encode()]


@pytest.mark.parametrize("data", payloads())
def test_lz_and_ans_round_trip(data):
    assert codecs.lz_bytes(codecs.lz_tokens(data)) == data
    freq = codecs.ans_frequencies(data)
    assert sum(freq) == codecs.SCALE and min(freq) >= 1
    assert codecs.ans_decode(codecs.ans_encode(data, freq), len(data), freq) == data


def test_token_round_trip():
    texts = ["session resume accepted", "session resume refused again", "", "again session é  double"]
    frames = codecs.tokens_encode(texts)
    assert codecs.tokens_decode(frames) == texts
    assert len(frames[1]) < len(texts[1])


def test_varint():
    for n in (0, 1, 127, 128, 300, 2**62):
        assert codecs.read_varint(codecs.varint(n), 0) == (n, len(codecs.varint(n)))
    with pytest.raises(ValueError):
        codecs.read_varint(b"\xff" * 12, 0)


def test_canonical_json():
    assert codecs.canonical({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'
    with pytest.raises(ValueError):
        codecs.canonical(float("nan"))


def test_broken_session_stays_broken(spark):
    df = spark.createDataFrame([("s", k, f"frame {k}") for k in range(5)] + [("t", 0, "fine")], "session string, seq int, text string")
    wire = codecs.session_deflate(df, "session", "seq", "text")
    cut = wire.withColumn("wire", F.when((F.col("session") == "s") & (F.col("seq") == 2), F.expr("substring(wire, 1, 3)")).otherwise(F.col("wire")))
    got = {(r["session"], r["seq"]): r["text"] for r in codecs.session_inflate(cut, "session", "seq").collect()}
    assert [got["s", k] for k in range(5)] == ["frame 0", "frame 1", None, None, None] and got["t", 0] == "fine"


def test_chain_shows_tampering(spark):
    df = spark.createDataFrame([("a", k, f"e{k}", "x" if k else None) for k in range(6)], "log string, id int, entry_id string, props string")
    chain = build_chain(df, "log", "id")
    assert verify_chain(chain, "log", "id").where("NOT ok").count() == 0
    forged = chain.withColumn("props", F.when(F.col("id") == 3, "y").otherwise(F.col("props")))
    assert [r["id"] for r in verify_chain(forged, "log", "id").where("NOT ok").collect()] == [3]


def test_workers_are_levelled(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 1, 1, 4, 2])], "key string, i int, size int")
    assert [r["worker"] for r in least_loaded(df, "key", "i", "size", 2).orderBy("i").collect()] == [0, 1, 1, 1, 0]


def test_numbered_spans_bins(spark):
    df = spark.createDataFrame([(k,) for k in range(300)], "id long").withColumn("b", F.expr("id div 7"))
    assert [r["k"] for r in numbered(df, ["b"], ["id"], "k").orderBy("id").collect()] == list(range(300))
    assert numbered(df.limit(0), ["b"], ["id"], "k").collect() == []


@pytest.mark.parametrize("text", ["", "a", "session resume accepted again", "ééé session é", "abababababab session abababababab", "x" * 700])
def test_phrase_frames_round_trip(text):
    book = phrases.PhraseBook(["session", "session resume", "again", "é"])
    assert phrases.runs_decode(phrases.runs_encode(text, book), book, {}) == text
    assert phrases.references_decode(phrases.references_encode(text, book), book) == text
    assert phrases.one_shot_text(phrases.one_shot(text)) == text


def test_phrases_are_longest_and_spans_are_templates():
    book = phrases.PhraseBook(["session", "session resume", "again"])
    assert book.longest("a session resume", 2) == "session resume" and book.longest("a session") is None
    text = "hello Ann, session again"
    frame = phrases.runs_encode(text, book, [(0, 10, 3, ["Ann"]), (6, 12, 4, ["over"])])
    assert phrases.runs_walk(frame)[0] == (phrases.TEMPLATE, 3, ["Ann"])
    assert phrases.runs_decode(frame, book, {3: "hello {0},"}) == text
    with pytest.raises(ValueError):
        phrases.runs_walk(frame[:-2] + b"\x09")


def test_fuzzy_record(spark):
    df = spark.createDataFrame([("status of job 17",), ("zzz",), (None,)], "t string")
    got = [r["match"] for r in phrases.fuzzy_record(df, "t", ["weather in rome", "status of job 11"]).collect()]
    assert got[0]["pattern"] == "status of job 11" and got[0]["distance"] == 1 and got[0]["differences"] == 1
    assert got[1] is None and got[2] is None


def test_id_range_can_be_exhausted(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    used = spark.createDataFrame([(10,), (12,)], "template_id long")
    assert {r["key"]: r["template_id"] for r in supplement.allocate(wanted, used, "key", 10, 15).collect()} == {"a": 11, "b": 13, "c": 14}
    with pytest.raises(Exception, match="no free id"):
        supplement.allocate(wanted, used, "key", 10, 14).collect()


@pytest.mark.parametrize(("text", "is_object"), [("{}", True), ('{"a": [1]}', True), ("{}}", False), ("{},{}", False), ("[{}]", False), ("1", False), ("", False), (None, False)])
def test_json_objects(spark, text, is_object):
    df = spark.createDataFrame([(text,)], "t string")
    assert bool(df.select(supplement.is_json_object(F.col("t"))).first()[0]) is is_object


def test_replay_log(spark, tmp_path):
    path = str(tmp_path / "replay")
    rows = [(k, "result", json.dumps({"b": k, "a": "é"})) for k in range(6)]
    supplement.write_replay(spark.createDataFrame(rows, "sequence long, record_type string, payload string"), path)
    got = supplement.read_replay(spark, path).orderBy("sequence").collect()
    assert [(r["sequence"], json.loads(r["payload"])) for r in got] == [(k, json.loads(p)) for k, _, p in rows]
    (tmp_path / "forged").write_text('\n{"payload":{"a":1},"payload_sha256":"00","record_type":"result","sequence":0}\n')
    with pytest.raises(Exception, match="bad replay record"):
        supplement.read_replay(spark, str(tmp_path / "forged")).collect()


def test_log_source_skips_corrupt_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_log(spark.createDataFrame([(k, "ai_output", f"s{k % 2}", None, f"t{k}") for k in range(10)], "seq long, log_type string, session_id string, user_id string, plaintext string"), path)
    (tmp_path / "log" / "bad.json").write_text('{"seq": \nnot json\n' + json.dumps({"seq": 10, "log_type": "ai_output", "session_id": "s0"}) + "\n")
    got = tables.read_log(spark, path, session_id="s0", limit=4)
    assert [r["seq"] for r in got.collect()] == [0, 2, 4, 6]
    assert tables.read_log(spark, path, session_id="s0").count() == 6


def test_container_and_chunks(spark, tmp_path):
    (tmp_path / "c.bin").write_bytes(tables.write_container([("{}", b"abc"), ('{"m":1}', b"")]))
    assert [(r["idx"], r["meta"], r["payload_bytes"]) for r in tables.inspect(spark, str(tmp_path / "c.bin")).collect()] == [(0, "{}", 3), (1, '{"m":1}', 0)]
    restored = tables.restore(spark, str(tmp_path / "c.bin")).orderBy("idx").collect()
    assert [bytes(r["payload"]) for r in restored] == [b"abc", b""]
    (tmp_path / "cut.bin").write_bytes(tables.write_container([("{}", b"abc")])[:-1])
    with pytest.raises(Exception, match="container is cut"):
        tables.restore(spark, str(tmp_path / "cut.bin")).collect()
    parts = tables.chunks(spark, str(tmp_path / "c.bin"), 7).orderBy("idx").collect()
    assert b"".join(bytes(r["chunk"]) for r in parts) == (tmp_path / "c.bin").read_bytes()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("s", 1, "a", "1"), ("s", 2, "b", "2"), ("s", 2, "c", "3"), ("s", 3, "a", "9"), ("s", 3, "c", "3"), ("t", 1, "a", "1")]
    df = spark.createDataFrame(rows, "session string, epoch long, key string, value string").coalesce(1)
    df.write.parquet(src)
    q = sessions.apply_diffs(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("diffs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["session"], r["epoch"], r["answer"]) for r in spark.table("diffs").collect())
    assert got == [("s", 1, "accepted"), ("s", 2, "accepted"), ("s", 2, "wrong epoch"), ("s", 3, "accepted"), ("s", 3, "conflict"), ("t", 1, "accepted")]
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "id long, t string").selectExpr("id", "CAST(t AS timestamp) AS ts").coalesce(1)
    events.write.parquet(src + "2")
    q = sessions.once(spark.readStream.schema(events.schema).parquet(src + "2"), "id", "ts").writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.table("once").collect()) == [1, 2]


def test_store_sync_and_learning(spark, tmp_path):
    src, store, learnt, sink = (str(tmp_path / x) for x in ("in", "store", "learnt", "sink"))
    spark.createDataFrame([(1, "a"), (2, "b")], "template_id long, pattern string").write.parquet(store)
    schema = "id long, template_id long, method string, ratio double"
    for k, rows in enumerate(([(1, 1, "zlib", 2.0), (2, 3, "zlib", 4.0)], [(3, 3, "zlib", 6.0), (4, 2, "raw", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = sessions.with_store(stream, store, sink, str(tmp_path / "cp1")).start()
        q.processAllAvailable()
        q.stop()
        q = sessions.learn(stream, learnt, str(tmp_path / "cp2")).start()
        q.processAllAvailable()
        q.stop()
        if k == 0:
            spark.createDataFrame([(3, "c")], "template_id long, pattern string").write.mode("append").parquet(store)
    assert sorted((r["id"], r["pattern"]) for r in spark.read.parquet(sink).collect()) == [(1, "a"), (2, None), (3, "c"), (4, "b")]
    assert sorted((r["method"], r["n"], r["mean_ratio"]) for r in sessions.learnt(spark, learnt).collect()) == [("raw", 1, 1.0), ("zlib", 3, 4.0)]


def test_concurrent_sessions(spark, tmp_path):
    """Sessions whose messages arrive mixed keep a state each."""
    rows = [(f"s{i % 5}", i // 5 + 1, f"k{i}", str(i)) for i in range(40)]
    src = str(tmp_path / "in")
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "session string, epoch long, key string, value string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("session string, epoch long, key string, value string").parquet(src)
    q = sessions.apply_diffs(stream).writeStream.format("memory").queryName("mixed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("mixed").collect()
    assert len(got) == 40 and {r["answer"] for r in got} == {"accepted"}
