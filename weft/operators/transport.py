"""What happens on a connection: frames, control frames, handshakes, resumption, replays, in-flight windows and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.codecs import canonical_json
from weft.operators.joins import pair_exchanges
from weft.operators.supplement import manifest, measure
from weft.operators.windows import link_queue, numbered
from weft.registry import query, read


def framed(payload: Column) -> Column:
    """A payload behind its length as four bytes, highest first; null stays null."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(payload)), 8, "0")), payload)


def read_frames(df: DataFrame, keys: list[str], stream: str, most: int = 16 << 20) -> DataFrame:
    """keys, place, payload and error: the frames of each row's stream, in order.

    A frame over most bytes ('too_long') or one that the stream does not hold whole ('closed') is a last row
    without payload.  Null and empty streams hold no frame.  A frame's place is known only from the lengths before
    it, so a stream is read by one task; its rows should hold bounded pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, place, payload, error = [], [], [], []
            for i, raw in enumerate(b[stream]):
                raw, at, n, bad = raw or b"", 0, 0, None
                while at < len(raw) and bad is None:
                    size = int.from_bytes(raw[at : at + 4], "big")
                    bad = "closed" if at + 4 > len(raw) else "too_long" if size > most else "closed" if at + 4 + size > len(raw) else None
                    row.append(i)
                    place.append(n)
                    payload.append(None if bad else bytes(raw[at + 4 : at + 4 + size]))
                    error.append(bad)
                    at, n = at + 4 + size, n + 1
            yield b[keys].iloc[row].reset_index(drop=True).assign(place=place, payload=pd.Series(payload, dtype=object), error=pd.Series(error, dtype=object))

    cols = df.select(*keys, stream)
    return cols.mapInPandas(run, cols.select(*keys).schema.add("place", "long").add("payload", "binary").add("error", "string"))


@query("src_length_frames", """WITH s AS (SELECT conv_id, turn // 64 AS piece, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY conv_id, turn // 64) AS n, text FROM msgs WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id, turn // 64 ORDER BY turn))
SELECT conv_id, piece, place, CASE WHEN conv_id % 5 <> 0 OR place < n - 1 THEN text END AS text, CASE WHEN conv_id % 5 = 0 AND place = n - 1 THEN 'closed' END AS error FROM s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Messages written as streams of up to 64 turns and read back; every fifth conversation loses its last byte."""
    m = read(spark, d, "msgs").select("conv_id", F.expr("turn div 64").alias("piece"), "turn", F.hex(framed(F.encode("text", "utf-8"))).alias("frame"))
    s = m.groupBy("conv_id", "piece").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", "frame")))["frame"], "").alias("raw"))
    cut = F.when(F.col("conv_id") % 5 == 0, F.expr("substring(raw, 1, length(raw) - 2)")).otherwise(F.col("raw"))
    frames = read_frames(s.select("conv_id", "piece", F.unhex(cut).alias("raw")), ["conv_id", "piece"], "raw")
    return frames.select("conv_id", "piece", "place", F.decode("payload", "utf-8").alias("text"), "error")


# Routine control codes by meaning; those that change what a session agrees on are never sent as bare codes.
ROUTINE, CRITICAL = {"hello": 0x1001, "ready": 0x1002, "ack": 0x2002, "resume": 0x3001}, {"diff": 0x2001}


def control_frame(meaning: Column, payload: Column) -> Column:
    """frame (two-byte code and canonical JSON, if there is any) and error of a control by its meaning."""
    lut = F.create_map(*[F.lit(x) for k, v in ROUTINE.items() for x in (k, f"{v:04X}")])
    body = F.when(payload.isNull() | (payload == "{}"), F.unhex(F.lit(""))).otherwise(F.encode(payload, "utf-8"))
    error = F.when(meaning.isin(list(CRITICAL)), "critical").when(F.coalesce(lut[meaning], F.lit("")) == "", "unknown")
    return F.struct(F.concat(F.unhex(lut[meaning]), body).alias("frame"), error.alias("error"))


@query("fn_control_frames", """SELECT id, CASE m WHEN 'hello' THEN '1001' WHEN 'ready' THEN '1002' WHEN 'ack' THEN '2002' WHEN 'resume' THEN '3001' END || CASE WHEN id % 3 = 0 THEN hex(encode(replace(props, ' ', ''))) ELSE '' END AS frame,
 CASE m WHEN 'diff' THEN 'critical' WHEN 'other' THEN 'unknown' END AS error FROM (SELECT id, props, ['hello', 'ready', 'ack', 'resume', 'diff', 'other'][CAST(id % 6 AS INTEGER) + 1] AS m FROM audit)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    meaning = F.element_at(F.array(*[F.lit(x) for x in (*ROUTINE, *CRITICAL, "other")]), (F.col("id") % 6 + 1).cast("int"))
    payload = F.when(F.col("id") % 3 == 0, F.col("props"))
    a = read(spark, d, "audit").select("id", meaning.alias("meaning"), payload.alias("payload")).withColumn("payload", canonical_json("payload"))
    return a.select("id", control_frame(F.col("meaning"), F.col("payload")).alias("r")).select("id", F.hex("r.frame").alias("frame"), "r.error")


def dictionary_state(epoch: Column, templates: Column, static_sha256: Column) -> Column:
    """SHA-256 of canonical JSON of a session dictionary: templates is an array of (template_id, pattern)."""
    one = lambda t: F.struct(t["pattern"].alias("pattern"), F.sha2(t["pattern"], 256).alias("pattern_sha256"), t["template_id"].alias("template_id"))
    text = F.to_json(F.struct(epoch.alias("epoch"), F.lit("weft.dictionary_state.1").alias("schema"), static_sha256.alias("static_sha256"), F.transform(F.array_sort(templates), one).alias("templates")))
    return F.when(epoch >= 0, F.sha2(text, 256))


@query("fn_dictionary_state", """SELECT p_brand, p_size, sha256('{"epoch":' || p_size % 4 || ',"schema":"weft.dictionary_state.1","static_sha256":"' || sha256('static') || '","templates":[' || string_agg('{"pattern":' || to_json(p_name) || ',"pattern_sha256":"' || sha256(p_name) || '","template_id":' || p_partkey || '}', ',' ORDER BY p_partkey) || ']}') AS state
 FROM part GROUP BY p_brand, p_size""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """One dictionary per brand and size; a dictionary is bounded, as its ids are."""
    g = read(spark, d, "part").groupBy("p_brand", "p_size").agg(F.collect_list(F.struct(F.col("p_partkey").alias("template_id"), F.col("p_name").alias("pattern"))).alias("t"))
    return g.select("p_brand", "p_size", dictionary_state(F.col("p_size") % 4, F.col("t"), F.sha2(F.lit("static"), 256)).alias("state"))


def fixture(pairs: DataFrame, block: str, order: list[str]) -> DataFrame:
    """place (from 0), request and response: what a client cycles through and a responder knows."""
    return numbered(pairs.withColumn("block", F.expr(block)), ["block"], order, "place").select("place", "request", "response")


def respond(asked: DataFrame, pairs: DataFrame, exchange: str, sent: str) -> DataFrame:
    """asked with expected, response and error: exchange i is answered by pair i mod n, if its request is that pair's.

    The number of pairs is one row, whatever they hold; exchanges meet their pairs by place."""
    n = pairs.agg(F.count("*").alias("pairs"))
    at = asked.join(F.broadcast(n)).where("pairs > 0").withColumn("place", F.expr(f"pmod({exchange}, pairs)")).drop("pairs")
    j = at.join(pairs.withColumnsRenamed({"request": "expected", "response": "known"}), "place").drop("place")
    same = F.col(sent).eqNullSafe(F.col("expected"))
    return j.withColumns({"response": F.when(same, F.col("known")), "error": F.when(~same, "request_mismatch")}).drop("known")


@query("sup_replay_verified", """WITH q AS (SELECT conv_id, turn // 2 AS x, max_by(text, turn) AS request FROM msgs WHERE role = 'user' GROUP BY ALL), r AS (SELECT conv_id, turn // 2 AS x, max_by(text, turn) AS response FROM msgs WHERE role = 'assistant' GROUP BY ALL),
p AS (SELECT row_number() OVER (ORDER BY conv_id, x) - 1 AS place, request, response FROM q JOIN r USING (conv_id, x)), e AS (SELECT session_id, id, request, response FROM audit JOIN p ON place = id % (SELECT count(*) FROM p))
SELECT session_id, count(*) FILTER (id % 97 <> 0) AS exchanges, count(*) FILTER (id % 97 = 0) AS refused, count(*) FILTER (id % 97 <> 0 AND id % 89 = 0) AS tampered, CAST(coalesce(sum(8 + strlen(request) + strlen(response) + CASE WHEN id % 89 = 0 THEN 1 ELSE 0 END) FILTER (id % 97 <> 0), 0) AS BIGINT) AS framed_bytes FROM e GROUP BY session_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A client replays the fixture; some requests are spoilt and refused, some answers change on the way and are found out."""
    m = read(spark, d, "msgs").withColumn("exchange", F.expr("turn div 2"))
    pairs = fixture(pair_exchanges(m, "conv_id", "exchange", "role", "turn", "text"), "conv_id div 1024", ["conv_id", "exchange"])
    mine = pairs.select("place", F.col("request").alias("sent"), F.col("response").alias("wanted"))
    n = pairs.agg(F.count("*").alias("pairs"))
    asked = read(spark, d, "audit").select("session_id", "id").join(F.broadcast(n)).where("pairs > 0").withColumn("place", F.expr("pmod(id, pairs)")).join(mine, "place").drop("place", "pairs")
    asked = asked.withColumn("sent", F.when(F.col("id") % 97 == 0, F.concat("sent", F.lit("!"))).otherwise(F.col("sent")))
    got = respond(asked, pairs, "id", "sent").withColumn("got", F.when(F.col("id") % 89 == 0, F.concat("response", F.lit("?"))).otherwise(F.col("response")))
    done = F.col("error").isNull()
    size = F.lit(8) + F.octet_length("sent") + F.octet_length("got")
    return got.groupBy("session_id").agg(F.count_if(done).alias("exchanges"), F.count_if(~done).alias("refused"), F.count_if(done & ~F.col("got").eqNullSafe(F.col("wanted"))).alias("tampered"), F.coalesce(F.sum(F.when(done, size)), F.lit(0)).alias("framed_bytes"))


def resume_answer(hello: Column, response: Column, required: Column) -> Column:
    """state (the epoch's hash, where a session goes on) and error of a resumption.

    hello(nonce, static_sha256, offered) is null if nothing was asked; response(nonce, static_sha256, accepted, state)
    if nothing was answered.  Without an error and a state, the session starts afresh."""
    named = F.array_contains(hello["offered"], response["state"])
    error = (
        F.when(hello.isNull(), F.when(response.isNotNull(), "unexpected_response"))
        .when(response.isNull(), F.when(required, "response_missing")).when(~response["nonce"].eqNullSafe(hello["nonce"]), "nonce_mismatch")
        .when(~response["static_sha256"].eqNullSafe(hello["static_sha256"]), "dictionary_mismatch").when(~F.coalesce(response["accepted"], F.lit(False)), F.when(required, "rejected"))
        .when(~F.coalesce(named, F.lit(False)), "state_not_offered")
    )
    goes_on = error.isNull() & hello.isNotNull() & response.isNotNull() & F.coalesce(response["accepted"], F.lit(False))
    return F.struct(F.when(goes_on, response["state"]).alias("state"), error.alias("error"))


@query("sup_resume_verified", """SELECT id, CASE WHEN error IS NULL AND h AND r AND id % 2 = 0 THEN id % 5 END AS state, error FROM (SELECT *, CASE WHEN NOT h THEN CASE WHEN r THEN 'unexpected_response' END WHEN NOT r THEN CASE WHEN q THEN 'response_missing' END
 WHEN id % 13 = 0 THEN 'nonce_mismatch' WHEN id % 17 = 0 THEN 'dictionary_mismatch' WHEN id % 2 = 1 THEN CASE WHEN q THEN 'rejected' END WHEN id % 5 NOT IN (1, 2, 3) THEN 'state_not_offered' END AS error
 FROM (SELECT id, id % 7 <> 0 AS h, id % 11 <> 0 AS r, id % 3 = 0 AS q FROM audit))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    hello = F.when(i % 7 != 0, F.struct(i.alias("nonce"), F.lit("d").alias("static_sha256"), F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]).alias("offered")))
    response = F.when(i % 11 != 0, F.struct(F.when(i % 13 != 0, i).alias("nonce"), F.when(i % 17 == 0, "other").otherwise("d").alias("static_sha256"), (i % 2 == 0).alias("accepted"), (i % 5).alias("state")))
    a = read(spark, d, "audit").select("id", hello.alias("hello"), response.alias("response"))
    return a.select("id", resume_answer(F.col("hello"), F.col("response"), i % 3 == 0).alias("r")).select("id", "r.*")


def ack_error(ack: Column, codec: Column, local: Column) -> Column:
    """Why a handshake's acknowledgement is refused, or null.

    ack(role, accepted, reason, codec, manifest, seen_sha256): manifest is the peer's, seen_sha256 what the peer holds
    for ours.  Manifests count for the session codec only; they must agree in every field."""
    ours = F.sha2(local, 256)
    return (
        F.when(~ack["role"].eqNullSafe("egress"), "unexpected_role").when(~F.coalesce(ack["accepted"], F.lit(False)), F.concat(F.lit("rejected: "), F.coalesce(ack["reason"], F.lit("no reason"))))
        .when(~ack["codec"].eqNullSafe(codec), "codec_mismatch").when(codec != "session", F.lit(None).cast("string")).when(ack["manifest"].isNull(), "manifest_missing")
        .when(F.sha2(ack["manifest"], 256) != ours, "manifest_mismatch").when(ack["seen_sha256"] != ours, "seen_hash_mismatch")
    )


@query("sup_proxy_handshake", """SELECT run, CASE WHEN run % 19 = 0 THEN 'unexpected_role' WHEN NOT verified THEN 'rejected: ' || CASE WHEN run % 4 = 0 THEN 'busy' ELSE 'no reason' END WHEN run % 23 = 0 THEN 'codec_mismatch' WHEN run % 2 = 1 THEN NULL WHEN run % 29 = 0 THEN 'manifest_missing' WHEN shards <> 3 THEN 'manifest_mismatch'
 WHEN run % 5 = 0 THEN 'seen_hash_mismatch' END AS error FROM runs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    run = F.col("run")
    ours = manifest({"codec": F.lit("session"), "shards": F.lit(3), "version": F.lit(2)})
    theirs = manifest({"version": F.lit(2), "codec": F.lit("session"), "shards": F.col("shards")})
    codec = F.when(run % 2 == 1, "deflate").otherwise("session")
    ack = F.struct(
        F.when(run % 19 == 0, "ingress").otherwise("egress").alias("role"), F.col("verified").alias("accepted"), F.when(run % 4 == 0, "busy").alias("reason"), F.when(run % 23 == 0, "raw").otherwise(codec).alias("codec"),
        F.when(run % 29 != 0, theirs).alias("manifest"), F.when(run % 5 == 0, "stale").otherwise(F.sha2(ours, 256)).alias("seen_sha256"),
    )
    return read(spark, d, "runs").select("run", codec.alias("codec"), ours.alias("ours"), ack.alias("ack")).select("run", ack_error(F.col("ack"), F.col("codec"), F.col("ours")).alias("error"))


TRANSPORT = "weft.transport.1"


def transport_control(role: Column, text: Column) -> Column:
    """The control frame that shows a peer one's manifest (canonical JSON) before the first message."""
    name = F.regexp_extract(F.to_json(F.array(role)), r"^\[(.*)\]$", 1)
    return F.concat(F.lit('{"manifest":'), text, F.lit(',"manifest_sha256":"'), F.sha2(text, 256), F.lit('","role":'), name, F.lit(f',"schema":"{TRANSPORT}"}}'))


def transport_error(frame: Column, role: Column, local: Column) -> Column:
    """Why a transport control is refused, or null."""
    at = lambda k: F.get_json_object(frame, f"$.{k}")
    return (
        F.when(F.json_object_keys(frame).isNull(), "not_an_object").when(~at("schema").eqNullSafe(TRANSPORT), "schema").when(~at("role").eqNullSafe(role), "role")
        .when(F.json_object_keys(at("manifest")).isNull(), "manifest_missing").when(~at("manifest_sha256").eqNullSafe(F.sha2(at("manifest"), 256)), "hash_mismatch").when(at("manifest") != local, "incompatible")
    )


@query("sup_transport_control", """SELECT run, CASE WHEN run % 7 = 0 THEN 'not_an_object' WHEN run % 11 = 0 THEN 'schema' WHEN run % 3 = 0 THEN 'role' WHEN run % 13 = 0 THEN 'manifest_missing' WHEN run % 17 = 0 THEN 'hash_mismatch' WHEN shards <> 3 THEN 'incompatible' END AS error FROM runs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Frames of peers with manifests of their own, some spoilt on the way."""
    run = F.col("run")
    ours, theirs = (manifest({"codec": F.lit("session"), "shards": s}) for s in (F.lit(3), F.col("shards")))
    f = read(spark, d, "runs").select("run", ours.alias("ours"), transport_control(F.when(run % 3 == 0, "client").otherwise("server"), theirs).alias("f"))
    for by, old, new in ((17, '_sha256":"', '_sha256":"0'), (13, '"manifest":', '"other":'), (11, TRANSPORT, "weft.transport.0")):
        f = f.withColumn("f", F.when(run % by == 0, F.replace("f", F.lit(old), F.lit(new))).otherwise(F.col("f")))
    f = f.withColumn("f", F.when(run % 7 == 0, F.concat(F.lit("["), "f", F.lit("]"))).otherwise(F.col("f")))
    return f.select("run", transport_error(F.col("f"), F.lit("server"), F.col("ours")).alias("error"))


def in_flight(df: DataFrame, key: str, place: str, arrival: str, service: str, window: int) -> DataFrame:
    """started and finish of requests of which up to window are on their way: one starts when it has arrived and the
    request window places before it has been answered.  So each place modulo window is a queue of its own."""
    lanes = link_queue(df.withColumn("lane", F.col(place) % window), [key, "lane"], place, arrival, service)
    return lanes.withColumn("started", F.col("finish") - F.col(service)).drop("lane")


@query("str_in_flight", """WITH RECURSIVE q AS (SELECT session_id, id, (epoch_us(ts) // 60000000) AS arrival, original_size AS service, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM audit),
f AS (SELECT session_id, id, rn, arrival AS started, arrival + service AS finish FROM q WHERE rn <= 8 UNION ALL SELECT q.session_id, q.id, q.rn, greatest(q.arrival, f.finish), greatest(q.arrival, f.finish) + q.service FROM f JOIN q ON q.session_id = f.session_id AND q.rn = f.rn + 8) SELECT session_id, id, started, finish FROM f""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "audit").withColumns({"arrival": F.expr("unix_micros(cast(ts AS timestamp)) div 60000000"), "bin": F.expr("id div 65536")})
    a = numbered(a, ["bin"], ["id"], "place", ("session_id",))
    return in_flight(a, "session_id", "place", "arrival", "original_size", 8).select("session_id", "id", "started", "finish")


# Shares of message types in a simulated network.
TYPES = {"api_request": 0.3, "log_message": 0.25, "chat_message": 0.15, "binary_data": 0.1, "structured_data": 0.15, "repetitive_text": 0.05}


def simulated(spark: SparkSession, messages: int, seed: int = 1729) -> DataFrame:
    """id, type and size of messages drawn by the shares of their types; reruns and partitionings agree."""
    draw = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(what), F.lit(seed), "id").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    kind, upto = None, 0.0
    for name, share in TYPES.items():
        upto += share
        kind = F.when(F.col("u") < upto, name) if kind is None else kind.when(F.col("u") < upto, name)
    drawn = spark.range(messages).select("id", draw("type").alias("u"), draw("size").alias("v"))
    return drawn.select("id", kind.otherwise(list(TYPES)[-1]).alias("type"), F.floor(10 + 990 * F.col("v") * F.col("v")).cast("long").alias("size"))


@query("str_simulation", """WITH d AS (SELECT range AS id, ('0x' || left(md5('type:1729:' || range), 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || left(md5('size:1729:' || range), 8))::BIGINT / 4294967296.0::DOUBLE AS v FROM range(20000))
SELECT type, CASE WHEN size < 100 THEN 'small' WHEN size < 500 THEN 'medium' ELSE 'large' END AS class, count(*) AS messages, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT CASE WHEN u < 0.3::DOUBLE THEN 'api_request' WHEN u < 0.55::DOUBLE THEN 'log_message' WHEN u < 0.7::DOUBLE THEN 'chat_message' WHEN u < 0.8::DOUBLE THEN 'binary_data' WHEN u < 0.95::DOUBLE THEN 'structured_data' ELSE 'repetitive_text' END AS type,
 CAST(floor(10 + 990 * v * v) AS BIGINT) AS size FROM d) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = simulated(spark, 20_000)
    size = F.when(F.col("size") < 100, "small").when(F.col("size") < 500, "medium").otherwise("large")
    return m.groupBy("type", size.alias("class")).agg(F.count("*").alias("messages"), F.sum("size").alias("bytes"))


@query("agg_stage_means", """SELECT session_id, event_type AS stage, count(*) AS calls, round(avg(latency_ms), 6) AS mean_ms FROM audit GROUP BY session_id, event_type""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Mean time of each stage of a session: its total over its calls, as counters keep them."""
    total = F.sum("latency_ms")
    return read(spark, d, "audit").groupBy("session_id", F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.coalesce(F.try_divide(total, F.count("latency_ms")), F.lit(0.0)), 6).alias("mean_ms"))


def measured_by_direction(msgs: DataFrame, epoch_after: int = 2) -> DataFrame:
    """codec, direction and epoch with frames, bytes and derived rates; each direction and epoch of a conversation is a stream."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    m = msgs.withColumn("rn", rn)
    direction = F.when(F.col("rn") % 2 == 0, "client_to_server").otherwise("server_to_client")
    m = m.select("turn", "text", F.concat_ws("|", "conv_id", direction, F.when(F.expr("rn div 2") < epoch_after, 0).otherwise(1)).alias("stream"))
    part = lambda i: F.element_at(F.split("stream", r"\|"), i)
    g = measure(m, "stream", "turn", "text").groupBy("codec", part(-2).alias("direction"), part(-1).cast("int").alias("epoch"))
    g = g.agg(F.sum("frames").alias("frames"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("wire_bytes").alias("wire_bytes"), F.bool_and("verified").alias("verified"))
    framed_ = F.col("wire_bytes") + 4 * F.col("frames")
    return g.withColumns({"framed_bytes": framed_, "bytes_per_frame": F.try_divide(framed_, F.col("frames")), "saved_percent": F.coalesce(100 * (1 - F.try_divide(framed_, F.col("raw_bytes") + 4 * F.col("frames"))), F.lit(0.0))})


@query("agg_measured_directions", """SELECT codec, direction, epoch, count(*) AS frames, CAST(sum(strlen(text)) AS BIGINT) AS raw_bytes, true AS verified FROM (SELECT text, CASE WHEN rn % 2 = 0 THEN 'client_to_server' ELSE 'server_to_client' END AS direction, CASE WHEN rn // 2 < 2 THEN 0 ELSE 1 END AS epoch, unnest(['raw', 'zlib', 'stream', 'token']) AS codec
 FROM (SELECT text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM msgs)) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return measured_by_direction(read(spark, d, "msgs")).select("codec", "direction", "epoch", "frames", "raw_bytes", "verified")


@query("sup_coordinator_comparison", """WITH s AS (SELECT ['threads', 'tasks', 'native'][CAST(target % 3 AS INTEGER) + 1] AS coordinator, codec, bool_and(verified) AS verified, CAST(sum(exchanges) AS BIGINT) AS exchanges, sum(request_bytes + response_bytes) / sum(exchanges) AS per_exchange, 1000.0 * sum(exchanges) / sum(p95_ms::DOUBLE) AS rate FROM runs GROUP BY ALL)
SELECT s.coordinator, s.codec, s.verified, s.exchanges, round(s.per_exchange, 6) AS per_exchange, round(s.rate, 6) AS rate, round(100 * (s.rate / b.rate - 1), 6) AS rate_delta_percent, bool_and(s.verified) OVER () AS ok FROM s LEFT JOIN s b ON b.coordinator = 'threads' AND b.codec = s.codec""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """One summary per coordinator and codec, against the first coordinator's of the same codec."""
    name = F.element_at(F.array(F.lit("threads"), F.lit("tasks"), F.lit("native")), (F.col("target") % 3 + 1).cast("int"))
    n = F.sum("exchanges")
    s = read(spark, d, "runs").groupBy(name.alias("coordinator"), "codec").agg(F.bool_and("verified").alias("verified"), n.alias("exchanges"), (F.sum(F.col("request_bytes") + F.col("response_bytes")) / n).alias("per_exchange"), (1000.0 * n / F.sum(F.col("p95_ms").cast("double"))).alias("rate"))
    base = s.where("coordinator = 'threads'").select("codec", F.col("rate").alias("base"))
    ok = s.agg(F.bool_and("verified").alias("ok"))
    j = s.join(base, "codec", "left").join(F.broadcast(ok))
    return j.select("coordinator", "codec", "verified", "exchanges", F.round("per_exchange", 6).alias("per_exchange"), F.round("rate", 6).alias("rate"), F.round(100 * (F.col("rate") / F.col("base") - 1), 6).alias("rate_delta_percent"), "ok")


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """place and line of df as a Markdown table: names, a rule, then rows in order.  A report is for reading, so df is
    small: rows are put in order in one task."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("long").alias("place"), line.alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "-|" * len(df.columns))], "place long, line string")
    return head.unionByName(body)


def write_markdown(df: DataFrame, order: list[str], path: str) -> None:
    markdown(df, order).repartition(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


@query("src_markdown_report", """WITH g AS (SELECT codec, profile, count(*) AS runs, CAST(sum(exchanges) AS BIGINT) AS exchanges FROM runs GROUP BY ALL) SELECT 0::BIGINT AS place, '| codec | profile | runs | exchanges |' AS line UNION ALL SELECT 1, '|-|-|-|-|'
 UNION ALL SELECT 1 + row_number() OVER (ORDER BY codec, profile), '| ' || codec || ' | ' || profile || ' | ' || runs || ' | ' || exchanges || ' |' FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return markdown(read(spark, d, "runs").groupBy("codec", "profile").agg(F.count("*").alias("runs"), F.sum("exchanges").alias("exchanges")), ["codec", "profile"])
