"""Id allocation, template stores, manifests, control messages, limits, summaries and codec measurement."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import codecs
from weft.operators.windows import numbered
from weft.registry import query, read

# Control messages that are understood.
CONTROL_TYPES = ["hello", "ready", "dictionary_diff", "dictionary_ack", "resume", "close"]


def allocate(wanted: DataFrame, used: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """(key, template_id): the free ids of [start, stop) in order, to the keys in order.  A range without enough
    free ids is an error.  The range bounds both sides: what is numbered never holds more rows than it has ids."""
    spark = wanted.sparkSession
    free = spark.range(start, stop).join(used.select(F.col("template_id").alias("id")), "id", "left_anti")
    free = numbered(free.withColumn("block", F.expr("id div 65536")), ["block"], ["id"], "k").select("k", F.col("id").alias("template_id"))
    asked = numbered(wanted.select(key).distinct().withColumn("block", F.left(F.col(key).cast("string"), F.lit(8))), ["block"], [key], "k").select("k", key)
    full = F.raise_error(F.lit(f"no free id left in [{start}, {stop})"))
    return asked.join(free, "k", "left").select(key, F.coalesce("template_id", full.cast("long")).alias("template_id"))


@query("sup_allocate_ids", """WITH w AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS k FROM (SELECT DISTINCT p_type FROM part)), u AS (SELECT 100 + p_size AS id FROM part GROUP BY p_size), f AS (SELECT range AS id, row_number() OVER (ORDER BY range) AS k FROM range(100, 2000) WHERE range NOT IN (SELECT id FROM u))
SELECT p_type, id AS template_id FROM w JOIN f USING (k)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return allocate(p, p.select((F.col("p_size") + 100).cast("long").alias("template_id")).distinct(), "p_type", 100, 2000)


def merged_by_priority(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """Union of maps; of equal keys the later part wins, and within a part the greater value."""
    every = None
    for k, p in enumerate(parts):
        one = p.select(key, value, F.lit(k).alias("priority"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.max_by(value, F.struct("priority", value)).alias(value))


@query("sup_client_templates", "SELECT p_size, coalesce(max(p_type) FILTER (p_retailprice > 1500), max(p_name) FILTER (p_brand < 'Brand#3'), max(p_brand)) AS pattern FROM part GROUP BY p_size")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    parts = [p.selectExpr("p_size", "p_brand AS pattern"), p.where("p_brand < 'Brand#3'").selectExpr("p_size", "p_name AS pattern"), p.where("p_retailprice > 1500").selectExpr("p_size", "p_type AS pattern")]
    return merged_by_priority(parts, "p_size", "pattern")


@query("sup_register_from_chunks", "SELECT user_id AS template_id, max_by(coalesce(method, 'none'), (ts, id)) AS pattern, count(*) AS chunks FROM audit GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Templates that chunk metadata names; the chunk seen last decides."""
    return read(spark, d, "audit").groupBy(F.col("user_id").alias("template_id")).agg(F.max_by(F.coalesce("method", F.lit("none")), F.struct("ts", "id")).alias("pattern"), F.count("*").alias("chunks"))


@query("sup_store_lookup", "SELECT l_orderkey, l_linenumber, p_type AS pattern FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").join(read(spark, d, "part").selectExpr("p_partkey AS l_partkey", "p_type AS pattern"), "l_partkey", "left").select("l_orderkey", "l_linenumber", "pattern")


@query("sup_dictionary_bounds", "SELECT p_brand, count(*) AS n, CAST(max(strlen(p_name)) AS BIGINT) AS longest, CAST(sum(strlen(p_name)) AS BIGINT) AS bytes, count(*) <= 64 AND max(strlen(p_name)) <= 40 AND sum(strlen(p_name)) <= 1024 AS within FROM part GROUP BY p_brand")
def _(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("p_name").cast("long")
    g = read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max(size).alias("longest"), F.sum(size).alias("bytes"))
    return g.withColumn("within", F.expr("n <= 64 AND longest <= 40 AND bytes <= 1024"))


@query("sup_ordered_distinct", "SELECT session_id, list(user_id ORDER BY first) AS users FROM (SELECT session_id, user_id, min(id) AS first FROM audit GROUP BY ALL) GROUP BY session_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each user once, where first seen; combined before the shuffle, so a hot session sends its distinct users."""
    first = read(spark, d, "audit").groupBy("session_id", "user_id").agg(F.min("id").alias("first"))
    return first.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("first", "user_id"))).alias("xs")).select("session_id", F.col("xs.user_id").alias("users"))


@query("sup_semantic_sketch", "SELECT conv_id, turn, 'templates=' || (turn % 5) || ',' || (turn % 3) || '|' || substr(text, 1, 160) AS sketch FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.array((F.col("turn") % 5).cast("string"), (F.col("turn") % 3).cast("string")), ",")
    return read(spark, d, "msgs").select("conv_id", "turn", F.concat(F.lit("templates="), ids, F.lit("|"), F.left("text", F.lit(160))).alias("sketch"))


@query("sup_template_terms", "SELECT term, count(*) AS n, count(DISTINCT p_brand) AS stores FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS term FROM part) GROUP BY term")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select("p_brand", F.explode(F.split("p_type", " ")).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("stores"))


@query("sup_candidate_report", "WITH t AS (SELECT role, w, count(*) AS n FROM (SELECT role, unnest(string_split(text, ' ')) AS w FROM msgs) WHERE length(w) >= 5 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, w) AS k FROM t) SELECT role, count(*) AS terms, CAST(sum(n) AS BIGINT) AS occurrences, sha256(string_agg(w, chr(10) ORDER BY k)) AS identity FROM k WHERE k <= 100 GROUP BY role")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best terms of each role and the digest that names this dictionary."""
    t = read(spark, d, "msgs").select("role", F.explode(F.split("text", " ")).alias("w")).where("length(w) >= 5").groupBy("role", "w").agg(F.count("*").alias("n"))
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "w"))).where("k <= 100")
    g = t.groupBy("role").agg(F.count("*").alias("terms"), F.sum("n").alias("occurrences"), F.sort_array(F.collect_list(F.struct("k", "w"))).alias("xs"))
    return g.select("role", "terms", "occurrences", F.sha2(F.array_join("xs.w", "\n"), 256).alias("identity"))


@query("sup_stamp_sequence", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS sequence, 'corpus-' || row_number() OVER (ORDER BY conv_id, turn) AS stamp FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = numbered(read(spark, d, "msgs").withColumn("block", F.expr("conv_id div 1024")), ["block"], ["conv_id", "turn"], "k")
    return m.select("conv_id", "turn", (F.col("k") + 1).alias("sequence"), F.concat(F.lit("corpus-"), F.col("k") + 1).alias("stamp"))


def is_json_object(text: Column) -> Column:
    """The parser passes over what follows a value; within brackets and within braces it does not."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return listed.isNotNull() & named.isNotNull() & F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


@query("sup_json_object", "SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN NULL WHEN id % 4 = 2 THEN NULL ELSE props END AS body FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The text where it is a JSON object, else null."""
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("id") % 4 == 1, "17").when(F.col("id") % 4 == 2, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return read(spark, d, "audit").select("id", F.when(is_json_object(text), text).alias("body"))


@query("sup_response_for", "SELECT id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'result' END AS kind, substr(sha256(id || ':' || props), 1, 16) AS token FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same response to the same request, at any time and place."""
    return read(spark, d, "audit").select("id", F.when(F.col("event_type") == "error", "error").otherwise("result").alias("kind"), F.left(F.sha2(F.concat_ws(":", F.col("id").cast("string"), "props"), 256), F.lit(16)).alias("token"))


@query("sup_rate_limit", "SELECT session_id, id, round(sum(original_size) OVER (PARTITION BY session_id ORDER BY id) * 8 / 1000.0::DOUBLE, 6) AS due_ms FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    """When a link of 1 Mbit/s has sent what a session has asked for so far; idle time is not lost."""
    sent = F.sum("original_size").over(Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return read(spark, d, "audit").select("session_id", "id", F.round(sent * 8 / F.lit(1000.0), 6).alias("due_ms"))


@query("sup_side_channel", "SELECT session_id, CAST(sum(4 + strlen(props)) + sum(4 + strlen(entry_id)) AS BIGINT) AS bytes FROM audit GROUP BY session_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of a session's records, each with a length prefix of four."""
    return read(spark, d, "audit").groupBy("session_id").agg(F.sum(F.octet_length("props").cast("long") + F.octet_length("entry_id") + 8).alias("bytes"))


@query("sup_hot_path_summary", "SELECT codec, profile, CAST(sum(exchanges) AS BIGINT) AS exchanges, round(sum(exchanges) / nullif(sum(p95_ms::DOUBLE) / 1000, 0), 4) AS per_second, round(sum(request_bytes + response_bytes) / sum(exchanges), 6) AS bytes_each, bool_and(verified) AS verified FROM runs GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "runs").groupBy("codec", "profile").agg(F.sum("exchanges").alias("exchanges"), F.sum(F.col("p95_ms").cast("double")).alias("ms"), F.sum(F.col("request_bytes") + F.col("response_bytes")).alias("b"), F.bool_and("verified").alias("verified"))
    return g.select("codec", "profile", "exchanges", F.round(F.try_divide("exchanges", F.col("ms") / 1000), 4).alias("per_second"), F.round(F.try_divide("b", "exchanges"), 6).alias("bytes_each"), "verified")


@query("sup_message_record", "SELECT conv_id, turn, strlen(text) AS bytes, CASE WHEN strlen(text) < 80 THEN 'uncompressed' WHEN contains(text, '{') THEN 'template' ELSE 'dictionary' END AS method, role = 'user' AS inbound, sha256(text) AS digest FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return read(spark, d, "msgs").select("conv_id", "turn", n.alias("bytes"), F.when(n < 80, "uncompressed").when(F.contains(F.col("text"), F.lit("{")), "template").otherwise("dictionary").alias("method"), (F.col("role") == "user").alias("inbound"), F.sha2("text", 256).alias("digest"))


@query("win_running_frequencies", "SELECT session_id, event_type, n, CAST(sum(n) OVER (PARTITION BY session_id ORDER BY event_type) - n AS BIGINT) AS start FROM (SELECT session_id, event_type, count(*) AS n FROM audit GROUP BY ALL)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Where each symbol's slots start in its session's cumulative frequency table."""
    g = read(spark, d, "audit").groupBy("session_id", "event_type").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("session_id").orderBy("event_type").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return g.select("session_id", "event_type", "n", before.alias("start"))


def manifest(fields: dict[str, Column]) -> Column:
    """Canonical JSON of named values: keys in order, no blanks."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


@query("sup_manifest", """SELECT run, m AS manifest, sha256(m) AS digest, sha256(m) = sha256('{"codec":"zlib","profile":"lan","shards":' || shards || '}') AS compatible FROM (SELECT run, shards, '{"codec":"' || codec || '","profile":"' || profile || '","shards":' || shards || '}' AS m FROM runs)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    mine = manifest({"shards": F.col("shards"), "codec": F.lit("zlib"), "profile": F.lit("lan")})
    theirs = manifest({"profile": F.col("profile"), "codec": F.col("codec"), "shards": F.col("shards")})
    digest = F.sha2("manifest", 256)
    return read(spark, d, "runs").withColumns({"manifest": theirs, "mine": F.sha2(mine, 256)}).select("run", "manifest", digest.alias("digest"), (digest == F.col("mine")).alias("compatible"))


@query("sup_dictionary_catalog", "SELECT p_brand AS name, count(*) AS entries, sha256(string_agg(p_name, chr(0) ORDER BY p_partkey)) AS digest FROM part GROUP BY p_brand")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("entries"), F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("xs"))
    return g.select("name", "entries", F.sha2(F.array_join("xs.p_name", "\0"), 256).alias("digest"))


@query("udf_private_dictionary", "SELECT p_brand AS name, CASE WHEN p_brand >= 'Brand#4' THEN 'unknown' WHEN p_brand >= 'Brand#3' THEN 'digest_mismatch' ELSE 'agreed' END AS answer FROM part GROUP BY p_brand")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Extensions are agreed on by digest; their terms are never sent."""
    g = read(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.sort_array(F.collect_set("p_type")).alias("xs"))
    client = g.select("name", F.sha2(F.array_join("xs", "\n"), 256).alias("offered"))
    server = g.where("name < 'Brand#4'").select("name", F.sha2(F.array_join(F.when(F.col("name") >= "Brand#3", F.slice("xs", 2, 1 << 20)).otherwise(F.col("xs")), "\n"), 256).alias("held"))
    return client.join(server, "name", "left").select("name", F.when(F.col("held").isNull(), "unknown").when(F.col("held") != F.col("offered"), "digest_mismatch").otherwise("agreed").alias("answer"))


@query("udf_metadata_aliases", "SELECT id, CASE k.range WHEN 0 THEN 'original_size' ELSE 'compressed_size' END AS name, CASE k.range WHEN 0 THEN original_size ELSE compressed_size END AS value FROM audit CROSS JOIN range(2) k")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Short metadata names back to long ones, through the alias table."""
    from weft.operators.audit import ALIASES

    names = spark.createDataFrame([(v, k) for k, v in ALIASES.items()], "short string, name string")
    a = read(spark, d, "audit").select("id", F.explode(F.create_map(F.lit("os"), F.col("original_size"), F.lit("cs"), F.col("compressed_size"))).alias("short", "value"))
    return a.join(F.broadcast(names), "short").select("id", "name", "value")


def control_message(kind: Column, body: Column, key: Column) -> Column:
    """kind, body and tag of a control message; an unknown kind is null."""
    text = F.concat_ws("\n", kind, body)
    return F.when(kind.isin(CONTROL_TYPES), F.struct(kind.alias("kind"), body.alias("body"), F.pandas_udf(codecs._hmac, "string")(text, key).alias("tag")))


def control_verified(message: Column, key: Column) -> Column:
    text = F.concat_ws("\n", message["kind"], message["body"])
    return message.isNotNull() & message["kind"].isin(CONTROL_TYPES) & (F.pandas_udf(codecs._hmac, "string")(text, key) == message["tag"])


@query("sup_control_messages", "SELECT id, event_type <> 'error' AS built, event_type <> 'error' AS verified, false AS forged_verified FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "gossip").otherwise("hello")
    m = read(spark, d, "audit").select("id", control_message(kind, F.col("props"), F.lit("k")).alias("m"))
    forged = F.when(F.col("m").isNotNull(), F.col("m").withField("body", F.concat(F.col("m.body"), F.lit(" "))))
    m = m.withColumn("f", forged)
    return m.select("id", F.col("m").isNotNull().alias("built"), F.coalesce(control_verified(F.col("m"), F.lit("k")), F.lit(False)).alias("verified"), F.coalesce(control_verified(F.col("f"), F.lit("k")), F.lit(False)).alias("forged_verified"))


PRESET = b"user assistant system the and for that with this from have not are was you"


def measure(df: DataFrame, session: str, order: str, text: str, level: int = 3) -> DataFrame:
    """Per session and codec: frames, raw and wire bytes, and whether all frames came back the same.

    Codecs: raw, zlib frame by frame (best level), a session stream with a preset dictionary, and tokens.
    A session is one task; sessions are what the codecs keep state over."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = [t.encode() for t in pdf.sort_values(order)[text].fillna("")]
        z, back = zlib.compressobj(level, zlib.DEFLATED, -15, zdict=PRESET), zlib.decompressobj(-15, zdict=PRESET)
        alone = [zlib.compress(f, 9) for f in frames]
        stream = [z.compress(f) + z.flush(zlib.Z_SYNC_FLUSH) for f in frames]
        tokens = codecs.tokens_encode([f.decode() for f in frames])
        made = {
            "raw": (frames, frames), "zlib": (alone, [zlib.decompress(a) for a in alone]),
            "stream": (stream, [back.decompress(s) for s in stream]), "token": (tokens, [t.encode() for t in codecs.tokens_decode(tokens)]),
        }
        rows = [(pdf[session].iloc[0], c, len(frames), sum(map(len, frames)), sum(map(len, wire)), got == frames) for c, (wire, got) in made.items()]
        return pd.DataFrame(rows, columns=[session, "codec", "frames", "raw_bytes", "wire_bytes", "verified"])

    cols = df.select(session, order, text)
    return cols.groupBy(session).applyInPandas(run, cols.select(session).schema.add("codec", "string").add("frames", "long").add("raw_bytes", "long").add("wire_bytes", "long").add("verified", "boolean"))


@query("sup_encode_verify", "SELECT codec, CAST(sum(n) AS BIGINT) AS frames, CAST(sum(b) AS BIGINT) AS raw_bytes, true AS verified FROM (SELECT unnest(['raw', 'zlib', 'stream', 'token']) AS codec, 1 AS n, strlen(text) AS b FROM msgs) GROUP BY codec")
def _(spark: SparkSession, d: str) -> DataFrame:
    return measure(read(spark, d, "msgs"), "conv_id", "turn", "text").groupBy("codec").agg(F.sum("frames").alias("frames"), F.sum("raw_bytes").alias("raw_bytes"), F.bool_and("verified").alias("verified"))


@query("agg_codec_measurement")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = measure(read(spark, d, "msgs"), "conv_id", "turn", "text").groupBy("codec").agg(F.sum("frames").alias("frames"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("wire_bytes").alias("wire_bytes"), F.bool_and("verified").alias("verified"))
    return m.withColumns({"ratio": F.try_divide("raw_bytes", "wire_bytes"), "framed_bytes": F.col("wire_bytes") + 4 * F.col("frames"), "bytes_per_frame": F.try_divide("wire_bytes", "frames")})


@query("src_typed_messages", "SELECT ['request', 'response', 'heartbeat', 'alert'][range % 4 + 1] AS kind, count(*) AS n, min(range) AS first FROM range(4096) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("request", "response", "heartbeat", "alert")])
    m = spark.range(4096).select("id", F.to_json(F.struct(F.element_at(kinds, (F.col("id") % 4 + 1).cast("int")).alias("kind"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("load"))).alias("body"))
    return m.groupBy(F.get_json_object("body", "$.kind").alias("kind")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def write_replay(df: DataFrame, path: str) -> None:
    """(sequence, record_type, payload JSON) as canonical JSON lines in order, each with its payload's digest."""
    line = F.pandas_udf(lambda n, k, p: pd.Series([codecs.canonical({"payload": json.loads(x), "payload_sha256": h, "record_type": t, "sequence": int(i)}) for i, t, (x, h) in zip(n, k, zip(p["text"], p["digest"], strict=True), strict=True)]), "string")
    text = codecs.canonical_json("payload")
    d = df.select("sequence", "record_type", text.alias("text")).select("sequence", "record_type", F.struct("text", F.sha2("text", 256).alias("digest")).alias("p"))
    d.orderBy("sequence").select(line("sequence", "record_type", "p").alias("value")).write.mode("overwrite").text(path)


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """Records of a replay log; blank lines are passed over, and a broken line, digest or sequence is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    r = lines.select(F.from_json("value", "sequence long, record_type string, payload_sha256 string").alias("r"), F.get_json_object("value", "$.payload").alias("payload"))
    same = F.sha2(codecs.canonical_json("payload"), 256) == F.col("r.payload_sha256")
    bad = F.raise_error(F.concat(F.lit("bad replay record "), F.coalesce(F.col("r.sequence").cast("string"), F.lit("?"))))
    r = r.select(F.when(F.coalesce(same, F.lit(False)), F.col("r.sequence")).otherwise(bad.cast("long")).alias("sequence"), "r.record_type", "payload")
    n = r.agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("u"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi")).first()
    if n["n"] and (n["u"] != n["n"] or n["lo"] != 0 or n["hi"] != n["n"] - 1):
        raise ValueError("replay log is not continuous")
    return r


def static_dictionary(terms: DataFrame, term: str, weight: str, most: int = 1000, repeats: int = 12, size: int = 32_768) -> DataFrame:
    """payload: the best terms, best last, a line each, repeated so that all lie in the window's end, cut from the end."""
    best = terms.orderBy(F.desc(weight), term).limit(most)
    lines = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(weight).alias("w"), F.col(term).alias("t")))), lambda x: x["t"]), "\n"), F.lit("\n"))
    return best.agg(F.right(F.repeat(lines, F.lit(repeats)), F.lit(size)).alias("payload"))


@query("fn_static_dictionary", "WITH t AS (SELECT p_type AS t, count(*) AS w FROM part GROUP BY p_type ORDER BY w DESC, t LIMIT 1000) SELECT right(repeat(string_agg(t, chr(10) ORDER BY w, t) || chr(10), 12), 32768) AS payload FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    return static_dictionary(read(spark, d, "part").groupBy("p_type").count(), "p_type", "count")
