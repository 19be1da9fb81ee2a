"""Signed dictionary proposals over two batches of a stream: every rule once, and state across batches."""

import json

from weft.streaming import dictionaries as dicts

KEY = b"a shared key"


def test_proposals(spark, tmp_path):
    one = {1: "a {0}"}
    first = dicts.propose("s", {}, one, 0, "n1", KEY)
    second = dicts.propose("s", one, {2: "b {0}", 3: "c"}, 1, "n2", KEY)
    three = one | {2: "b {0}", 3: "c"}
    forged = json.dumps({"session": "s"})
    skewed = json.loads(dicts.propose("s", three, {4: "d"}, 2, "n9", KEY)[0]) | {"after": "x"}
    body = dicts._json(skewed)
    batches = [
        [("s", 1, *first), ("s", 2, *first), ("s", 3, first[0], "bad"), ("s", 4, forged, dicts._sign(forged, KEY)), ("t", 1, *first), ("u", 1, *dicts.propose("u", {}, {}, 0, "m", KEY)), ("v", 1, None, None)],
        [
            ("s", 5, *second), ("s", 6, *dicts.propose("s", three, {5: "e"}, 2, "n2", KEY)), ("s", 7, *dicts.propose("s", one, {9: "x"}, 1, "n3", KEY)), ("s", 8, *dicts.propose("s", three, {3: "c"}, 2, "n4", KEY)),
            ("s", 9, *dicts.propose("s", three, {3: "other"}, 2, "n5", KEY)), ("s", 10, body, dicts._sign(body, KEY)), ("s", 11, *dicts.propose("s", three, {k: "t" for k in range(100, 200)}, 2, "n6", KEY)), ("s", 12, *dicts.propose("s", three, {7: "y" * 2000}, 2, "n7", KEY)),
        ],
    ]
    schema, got = "session string, seq long, body string, tag string", []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = dicts.apply_proposals(stream, KEY).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    got = [r.asDict() for r in spark.read.schema(dicts.ANSWERS).parquet(str(tmp_path / "out")).collect()]
    reasons = sorted((r["session"], r["reason"] or "accepted") for r in got)
    assert reasons == sorted(
        [("s", x) for x in ("accepted", "replay", "not authentic", "malformed", "accepted", "replay", "previous state mismatch", "template repeated", "template overwritten", "next state mismatch", "too many additions", "out of bounds")]
        + [("t", "session mismatch"), ("u", "no additions"), ("v", "not authentic")]
    )
    accepted = sorted((r for r in got if r["accepted"]), key=lambda r: r["epoch"])
    assert [r["epoch"] for r in accepted] == [1, 2] and accepted[1]["state_hash"] == dicts.state_hash(three, 2)
    assert dicts.answer_verified(accepted[0], first[0], KEY) and dicts.answer_verified(accepted[1], second[0], KEY)
    assert not dicts.answer_verified(accepted[0], second[0], KEY) and not dicts.answer_verified(accepted[0] | {"epoch": 5}, first[0], KEY)
