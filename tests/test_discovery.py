"""Discovery, the life of templates, stores and oracle-less queries against plain versions."""

import difflib
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weft import catalog
from weft.functions import codecs
from weft.functions.documents import best_method, compressed, decode_any
from weft.functions.mining import dictionary_matrix
from weft.functions.text import parse_call
from weft.operators import discovery
from weft.operators.protocol import lru, lz_candidates
from weft.sources import stores

SF = "/root/testdata/sf0.001"


def plain_structure(texts):
    if len(texts) < 2:
        return None
    first = texts[0]
    n = next((i for i in range(min(map(len, texts)) + 1) if len({t[: i + 1] for t in texts}) > 1 or i == min(map(len, texts))), 0)
    m = next((i for i in range(min(map(len, texts)) + 1) if len({t[::-1][: i + 1] for t in texts}) > 1 or i == min(map(len, texts))), 0)
    prefix, suffix = first[:n], first[len(first) - m :]
    suffix = "" if n + m >= len(first) else suffix
    escape = lambda x: x.replace("{", "{{").replace("}", "}}")
    head, tail = escape(prefix), escape(suffix)
    return head + "{0}" + tail if len(head) + len(tail) >= 10 else None


def test_common_structure_against_a_plain_version(spark):
    rng, rows = random.Random(1), []
    for g in range(60):
        head, tail = ("".join(rng.choice("ab{}é ") for _ in range(rng.choice([0, 3, 12]))) for _ in range(2))
        rows += [(g, k, head + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 4))) + tail) for k in range(rng.randint(1, 6))]
    want = {}
    for g in range(60):
        texts = [t for x, _, t in rows if x == g]
        p = plain_structure(texts)
        if p:
            want[g] = (len(texts), p)
    df = spark.createDataFrame([*rows, (99, 0, None), (99, 1, None)], "g int, k int, t string")
    assert {r["g"]: (r["frequency"], r["pattern"]) for r in discovery.common_structure(df, ["g"], "k", "t").collect()} == want and len(want) > 10


def test_structure_examples(spark):
    cases = [["Status is ready for user 1 now", "Status is ready for user 22 now"], ['{"a": 1, "name": "x"}', '{"a": 1, "name": "yy"}'], ["abc", "abd"], ["only one text in the group"], ["same text here", "same text here"]]
    df = spark.createDataFrame([(g, k, t) for g, c in enumerate(cases) for k, t in enumerate(c)], "g int, k int, t string")
    got = {r["g"]: r["pattern"] for r in discovery.common_structure(df, ["g"], "k", "t").collect()}
    assert got == {0: "Status is ready for user {0} now", 1: '{{"a": 1, "name": "{0}"}}', 4: "same text here{0}"}


def test_clusters_are_greedy(spark):
    rng = random.Random(2)
    base = ["the server is up and well", "please reset my account now", "zzz"]
    rows = [(b, k, "".join(c if rng.random() > 0.12 else rng.choice("abc") for c in rng.choice(base))) for b in range(3) for k in range(25)]
    want = {}
    for b in range(3):
        left = [(k, t) for x, k, t in rows if x == b]
        while left:
            at, seed = left[0]
            inside = [k for k, t in left if k == at or difflib.SequenceMatcher(None, seed, t).ratio() >= 0.6]
            want |= {(b, k): at for k in inside}
            left = [(k, t) for k, t in left if k not in inside]
    got = discovery.clusters(spark.createDataFrame(rows, "b int, k int, t string"), "b", "k", "t").collect()
    assert {(r["b"], r["k"]): r["seed"] for r in got} == want and len(set(want.values())) > 3


def test_life_of_templates():
    t = discovery.Templates([], 10, 12)
    assert [t.promote(p) for p in ("a", "b", "c")] == [10, 11, 12]
    for k, uses, days in ((10, 50, 0), (11, 3, 1), (12, 20, 40)):
        t.hot[k] |= {"usage_count": uses, "days": days}
    assert t.promote("d") == 11 and sorted(t.cold) == [12] and sorted(t.hot) == [10, 11]
    assert t.promote("e") == 12 and not t.cold
    with pytest.raises(ValueError):
        t.promote("e")
    t.hot[11]["usage_count"] = t.hot[12]["usage_count"] = 99
    with pytest.raises(RuntimeError):
        t.promote("f")
    t.hot[10]["days"] = 31
    assert t.retire() == [10] and t.restore(10) and not t.restore(10)
    t.hot[12]["usage_count"] = 5
    t.retire()
    assert not t.restore(12)
    again = discovery.Templates(t.rows(), 10, 12)
    assert again.rows() == t.rows()


def test_discovery_loop(spark, tmp_path):
    rows = [(f"e{i}", "status", f"Status of job {i} is fine, thank you") for i in range(60)] + [(f"x{i}", "harm", f"the secret password of {i} is here") for i in range(60)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "entry_id string, kind string, text string").coalesce(1).write.json(source)
    stream = spark.readStream.schema("entry_id string, kind string, text string").json(source)
    q = discovery.discovery_loop(stream, str(tmp_path / "store"), str(tmp_path / "cp"), every="1 second").start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.schema(discovery.STORE).parquet(str(tmp_path / "store/batch=0")).collect()
    assert [(r["template_id"], r["pattern"], r["tier"]) for r in got] == [(128, "Status of job {0} is fine, thank you", "hot")]


def test_call_forms(spark):
    cases = [
        ('{"function": "call_api", "args": {"url": "x", "n": 3}}', ("call_api", 3, "api_gateway", {"url": "x", "n": "3"})),
        ('Do this: {"function": "other", "arguments": {}} ok', ("other", None, None, {})),
        ("get_status(id=5, mode='a b')", ("get_status", 10, "status_service", {"id": "5", "mode": "a b"})),
        ('Please EXECUTE TASK "clean" with speed: fast', ("execute_task", 1, "task_executor", {"param_0": "clean", "speed": "fast"})),
        ("print(a=1)", None), ("nothing to do", None), ('{"a": 1}', None), ("", None), (None, None), ('{"function": broken', None),
        ("get_status()", ("get_status", 10, "status_service", {})),
    ]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", parse_call(F.col("t")).alias("c")).orderBy("k").collect()
    assert [None if r["c"] is None else (r["c"]["function"], r["c"]["id"], r["c"]["hint"], r["c"]["args"]) for r in got] == [w for _, w in cases]


def test_stores(spark, tmp_path):
    d = str(tmp_path)
    logs = spark.createDataFrame([("audit", "a", 1), ("security", "b", 2)], "log_type string, text string, n int")
    stores.append_by_type(logs, f"{d}/typed")
    stores.append_by_type(logs, f"{d}/typed")
    assert spark.read.json(f"{d}/typed/log_type=audit").count() == 2
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:00:00", f"e{h}{k}") for h in range(3) for k in range(3)], "ts string, event_id string").withColumn("ts", F.to_timestamp("ts"))
    stores.append_audit(spark, rows, f"{d}/audit")
    stores.append_audit(spark, rows.limit(2), f"{d}/audit")
    ids = spark.read.parquet(f"{d}/audit").orderBy("id").collect()
    assert [r["id"] for r in ids] == list(range(1, 12)) and [r["event_id"] for r in ids[:9]] == sorted(r["event_id"] for r in ids[:9])
    scoped = spark.createDataFrame([("a", 1), ("b", 2)], "scope string, template_id int")
    stores.rewrite_scopes(scoped, f"{d}/scoped")
    stores.rewrite_scopes(spark.createDataFrame([("a", 9)], "scope string, template_id int"), f"{d}/scoped")
    assert sorted((r["scope"], r["template_id"]) for r in spark.read.parquet(f"{d}/scoped").collect()) == [("a", 9), ("b", 2)]
    (tmp_path / "old.json").write_text(json.dumps({"templates": {"7": "x {0}", "8": {"pattern": "y {0}", "usage_count": 4}, "bad": "z", "9": {"no": 1}}}))
    assert sorted(tuple(r) for r in stores.import_legacy(spark, f"{d}/old.json", "s").collect()) == [("s", 7, "x {0}", 0), ("s", 8, "y {0}", 4)]
    (tmp_path / "corpus.json").write_text(json.dumps({"sessions": [{"session": "s1", "events": [{"a": 1}, {"b": [2]}]}]}, indent=1))
    assert [tuple(r) for r in stores.read_corpus(spark, f"{d}/corpus.json").orderBy("idx").collect()] == [("s1", 0, '{"a":1}'), ("s1", 1, '{"b":[2]}')]
    stores.write_corpus(spark.createDataFrame([("s2", [1, 2]), ("s1", [3])], "session string, events array<int>"), f"{d}/corpus")
    assert [tuple(r) for r in stores.read_corpus(spark, f"{d}/corpus").orderBy("session", "idx").collect()] == [("s1", 0, "3"), ("s2", 0, "1"), ("s2", 1, "2")]
    (tmp_path / "bench.json").write_text(json.dumps({"results": [{"codec": "raw", "rate": 1.5}, {"codec": "zlib"}]}))
    assert [tuple(r)[1:] for r in stores.read_benchmark(spark, f"{d}/bench.json", "codec string, rate double").orderBy("codec").collect()] == [("raw", 1.5), ("zlib", None)]
    for n in (1, 2):
        stores.append_telemetry(spark.createDataFrame([("s", 10 * n, n, 0)], stores.TELEMETRY), f"{d}/csv")
    assert [tuple(r) for r in stores.hydrate(spark, f"{d}/csv").collect()] == [("s", 20, 2, 0)]
    weights = spark.createDataFrame([("raw", "size", 0.1)], "method string, feature string, weight double")
    stores.save_model(weights, spark.range(1500).select(F.col("id").alias("at")), f"{d}/model")
    w, s = stores.load_model(spark, f"{d}/model", "at long")
    assert w.collect() == weights.collect() and (s.count(), s.agg(F.min("at")).first()[0]) == (1000, 500)
    empty = spark.createDataFrame([], stores.RESUME)
    stores.save_resume(empty, spark.createDataFrame([("n", "p", "h", "t1", 1.0), ("n", "p", "h", "t2", 2.0), ("n", "q", "h", "t3", 1.0), ("n", "q", "g", "t4", 1.0)], stores.RESUME), f"{d}/resume")
    cache = stores.load_resume(spark, f"{d}/resume")
    asked = spark.createDataFrame([("n", "h", None), ("n", "h", "p"), ("n", "g", None), ("n", "z", None)], "namespace string, state_hash string, peer string")
    got = {(r["state_hash"], r["peer"]): (r["answer"], r["templates_hash"]) for r in stores.resume_entries(cache, asked).collect()}
    assert got == {("h", None): ("ambiguous", None), ("h", "p"): ("found", "t2"), ("g", None): ("found", "t4"), ("z", None): ("missing", None)}
    with pytest.raises(Exception, match="several resume entries"):
        stores.resume_entries(cache, asked, strict=True).collect()
    assert stores.forget(cache, spark.createDataFrame([("h",)], "state_hash string"), "state_hash").count() == 1
    stores.write_metrics(spark.createDataFrame([("a", None)], "name string, value double"), f"{d}/metrics")
    assert json.loads(next(p for p in (tmp_path / "metrics").glob("*.json") if p.stat().st_size).read_text()) == {"name": "a", "value": None}


def test_token_session_deflate(spark):
    rows = [(s, k, f"session {s} sends request number {k} to the server") for s in range(3) for k in range(30)]
    df = spark.createDataFrame(rows, "s int, k int, t string")
    wire = codecs.token_session_deflate(df, "s", "k", "t")
    assert sorted((r["s"], r["k"], r["text"]) for r in codecs.token_session_inflate(wire, "s", "k").collect()) == rows
    plain = sum(len(t) for _, _, t in rows)
    assert 3 * wire.agg(F.sum(F.octet_length("wire"))).first()[0] < plain
    cut = wire.withColumn("wire", F.when((F.col("s") == 1) & (F.col("k") == 4), F.lit(b"x")).otherwise(F.col("wire")))
    broken = {(r["s"], r["k"]): (r["text"], r["failed"]) for r in codecs.token_session_inflate(cut, "s", "k").collect()}
    assert broken[1, 3][0] == rows[33][2] and broken[1, 4] == broken[1, 29] == (None, "frame is not flushed") and broken[2, 29][0] == rows[-1][2]


def test_explicit_methods(spark):
    df = spark.createDataFrame([("some text text text text", m) for m in ("raw", "deflate", "token", "best")], "t string, m string")
    for r in df.select("t", "m", compressed(F.col("t"), F.col("m")).alias("f")).collect():
        assert decode_any(r["f"]) == r["t"] and (r["m"] == "best" or r["f"][0] == ("raw", "deflate", "token").index(r["m"]))
    with pytest.raises(Exception, match="no method"):
        df.select(compressed(F.col("t"), F.lit("unheard")).alias("f")).collect()


def test_dictionary_matrix(spark):
    rows = [(s, k, "ab"[s % 2], f"request number {k} of the session, status okay") for s in range(4) for k in range(5)]
    got = {(r["role"], r["dictionary"]): r for r in dictionary_matrix(spark.createDataFrame(rows, "s int, k int, role string, t string"), "s", "k", "role", "t").collect()}
    for role in "ab":
        frames = [[t.encode() for x, _, y, t in rows if x == s] for s in range(4) if "ab"[s % 2] == role]
        z = [zlib.compressobj(3, zlib.DEFLATED, -15) for _ in frames]
        assert got[role, "none"]["wire"] == sum(len(c.compress(f) + c.flush(zlib.Z_SYNC_FLUSH)) for c, fs in zip(z, frames, strict=True) for f in fs)
        assert got[role, "own"]["wire"] < got[role, "none"]["wire"] and got[role, "own"]["frames"] == 10


def test_lru_against_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(s, k, rng.randrange(6)) for s in range(3) for k in range(80)]
    got = {(r["s"], r["k"]): (r["hit"], r["evicted"], r["held"]) for r in lru(spark.createDataFrame(rows, "s int, k int, x int"), "s", "k", "x", 3).collect()}
    for s in range(3):
        held = []
        for _, k, x in (r for r in rows if r[0] == s):
            hit = x in held
            held = [y for y in held if y != x] + [x]
            evicted, held = len(held) > 3, held[-3:]
            assert got[s, k] == (hit, evicted, len(held))


def test_lz_candidates_against_a_plain_version(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(60)), "abcabcabcabc", "", "é" * 9]
    want = set()
    for i, t in enumerate(texts):
        raw = t.encode()
        for p in range(len(raw) - 2):
            best = (0, 0)
            for q in range(p - 3, -1, -1):
                n = 0
                while n < p - q and p + n < len(raw) and raw[q + n] == raw[p + n]:
                    n += 1
                if n >= 3 and n > best[1]:
                    best = (p - q, n)
            if best[1]:
                want.add((i, p, *best))
    got = lz_candidates(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t")
    assert {tuple(r) for r in got.collect()} == want


def test_similarity_and_best_method_queries(spark):
    for r in catalog.QUERIES["srt_best_method"](spark, SF).join(spark.read.parquet(f"{SF}/conversations.parquet"), ["conv_id", "turn"]).limit(40).collect():
        raw = r["text"].encode()
        sizes = {"raw": len(raw), "deflate": len(zlib.compress(raw, 6)), "token": len(codecs.tokens_encode([r["text"]])[0])}
        assert sizes[r["method"]] == min(sizes.values()) == len(best_method(r["text"])[0]) - 1
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "x")], "a string, b string").select("a", "b", codecs.similarity("a", "b").alias("s"))
    assert [r["s"] for r in df.collect()] == [0.75, 1.0, 0.0]
