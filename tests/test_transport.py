"""Connections against plain versions: frames, in-flight windows, running sums, keys, refusals and reports."""

import json
import random

from pyspark.sql import functions as F

from weft.operators import transport
from weft.operators.protocol import nested_keys
from weft.operators.windows import numbered, running


def test_frames_come_back_and_errors_end_a_stream(spark):
    made = lambda *xs: b"".join(len(x).to_bytes(4, "big") + x for x in xs)
    rows = [(1, made(b"", b"a" * 300, "é".encode())), (2, made(b"x", b"yy")[:-1]), (3, made(b"x" * 9, b"y")), (4, None), (5, b""), (6, b"\0\0")]
    df = spark.createDataFrame(rows, "k int, raw binary")
    got = {(r["k"], r["place"]): (None if r["payload"] is None else bytes(r["payload"]), r["error"]) for r in transport.read_frames(df, ["k"], "raw", most=512).collect()}
    assert got == {
        (1, 0): (b"", None), (1, 1): (b"a" * 300, None), (1, 2): ("é".encode(), None), (2, 0): (b"x", None), (2, 1): (None, "closed"),
        (3, 0): (b"x" * 9, None), (3, 1): (b"y", None), (6, 0): (None, "closed"),
    }
    short = transport.read_frames(df.where("k = 3"), ["k"], "raw", most=8).collect()
    assert [(r["place"], r["payload"], r["error"]) for r in short] == [(0, None, "too_long")]
    one = spark.sql("SELECT encode('hé', 'utf-8') AS p, cast(null AS binary) AS q").select(transport.framed(F.col("p")).alias("p"), transport.framed(F.col("q")).alias("q")).first()
    assert bytes(one["p"]) == b"\0\0\0\x03h\xc3\xa9" and one["q"] is None


def test_in_flight_windows_against_a_queue(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(6):
        at, ends = 0, []
        for i in range(60):
            at, cost = at + rng.randrange(4), rng.randrange(1, 30)
            start = max(at, ends[i - 3]) if i >= 3 else at
            ends.append(start + cost)
            rows.append((k, i, at, cost))
            want[k, i] = (start, start + cost)
    df = spark.createDataFrame(rows, "k int, place long, at long, cost long").repartition(3)
    assert {(r["k"], r["place"]): (r["started"], r["finish"]) for r in transport.in_flight(df, "k", "place", "at", "cost", 3).collect()} == want


def test_running_sums_cross_bins_and_keep_null_keys(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), i // 7 if i % 50 else None, rng.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, bin long, x long").repartition(4)
    sums, counts, want = {}, {}, {}
    for i, k, _, x in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        counts[k] = counts.get(k, 0) + 1
        if x is not None:
            sums[k] = sums.get(k, 0) + x
        want[i] = (sums.get(k), counts[k] - 1)
    got = running(df, ["k"], ["bin"], ["id"], {"total": F.col("x")})
    place = numbered(df, ["bin"], ["id"], "place", ("k",))
    assert {r["id"]: r["total"] for r in got.collect()} == {i: s for i, (s, _) in want.items()}
    assert {r["id"]: r["place"] for r in place.collect()} == {i: n for i, (_, n) in want.items()}
    assert running(df.where("id < 0"), ["k"], ["bin"], ["id"], {"total": F.col("x")}).count() == 0


def test_nested_keys_against_a_walk(spark):
    def walk(x):
        if isinstance(x, dict):
            return [k for key, v in x.items() for k in (key, *walk(v))]
        return [k for v in x for k in walk(v)] if isinstance(x, list) else []

    bodies = [{"a": {"b\"c": [1, {"d": "x: \"y\": z"}]}, "e\\": ":", "": None}, [{"é\n": "\\"}, "a: b", {"k": {"k": {"k": "\\\":"}}}], {"s": 'long "quoted" ' * 4000, "t": "\\" * 9000}, "text", 7, {}]
    texts = [json.dumps(b) for b in bodies] + [json.dumps(bodies[0], indent=2, ensure_ascii=False), None, ""]
    want = sorted(k for b in [*bodies, bodies[0]] for k in walk(b))
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    assert sorted(r["key"] for r in nested_keys(df, "body").collect()) == want


def test_responder_refuses_other_requests(spark):
    pairs = spark.createDataFrame([(0, "q0", "r0"), (1, "q1", None)], "place long, request string, response string")
    asked = spark.createDataFrame([(0, "q0"), (1, "q1"), (2, "q1"), (5, None), (3, "q1")], "i long, sent string")
    got = {r["i"]: (r["expected"], r["response"], r["error"]) for r in transport.respond(asked, pairs, "i", "sent").collect()}
    assert got == {0: ("q0", "r0", None), 1: ("q1", None, None), 2: ("q0", None, "request_mismatch"), 5: ("q1", None, "request_mismatch"), 3: ("q1", None, None)}
    assert transport.respond(asked, pairs.where("place < 0"), "i", "sent").count() == 0


def test_transport_controls_of_odd_roles_and_broken_frames(spark):
    m = '{"codec":"session","shards":3}'
    df = spark.createDataFrame([("say \"hi\"",), ("server",)], "role string").withColumn("f", transport.transport_control(F.col("role"), F.lit(m)))
    for r in df.collect():
        assert json.loads(r["f"])["role"] == r["role"] and json.loads(r["f"])["manifest"] == json.loads(m)
    errors = df.select(transport.transport_error(F.col("f"), F.col("role"), F.lit(m)).alias("e")).collect()
    assert [r["e"] for r in errors] == [None, None]
    broken = spark.createDataFrame([("{",), ("",), (None,), ("7",)], "f string")
    assert {r["e"] for r in broken.select(transport.transport_error(F.col("f"), F.lit("server"), F.lit(m)).alias("e")).collect()} == {"not_an_object"}


def test_markdown_reports(spark, tmp_path):
    df = spark.createDataFrame([("b|c", 2), (None, 1), ("a", 3)], "name string, n long")
    assert [r["line"] for r in transport.markdown(df, ["n"]).orderBy("place").collect()] == ["| name | n |", "|-|-|", "|  | 1 |", "| b\\|c | 2 |", "| a | 3 |"]
    transport.write_markdown(df, ["n"], str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()][:2] == ["| name | n |", "|-|-|"]


def test_simulation_does_not_depend_on_partitions(spark):
    a = transport.simulated(spark, 500)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, a.repartition(7).collect()))
    assert transport.simulated(spark, 0).count() == 0


def test_measured_directions_are_verified_and_add_up(spark):
    rows = [(c, t, f"turn {t} of {c} " * (t + 1)) for c in range(3) for t in range(9)]
    got = transport.measured_by_direction(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert len(got) == 16 and all(r["verified"] and r["framed_bytes"] == r["wire_bytes"] + 4 * r["frames"] for r in got)
    for codec in ("raw", "zlib", "stream", "token"):
        assert sum(r["raw_bytes"] for r in got if r["codec"] == codec) == sum(len(t.encode()) for _, _, t in rows)
