"""Message protocol operators: phases, kinds, negotiation, control tables, session state and counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.windows import numbered
from weft.registry import query, read

# Operations that need the whole message.
FULL_DECODE = ["display_to_user", "detailed_content_moderation", "extract_entities", "sentiment_analysis", "language_translation", "full_text_search"]
# Intents by category.
CATEGORY_INTENT = {"clarification": "question", "affirmation": "confirmation", "limitation": "denial", "instruction": "instruction", "recommendation": "recommendation", "code_example": "code_example", "fact": "answer", "explanation": "explanation"}

KINDS = "(SELECT id, ['mcp', 'a2a', 'local.agent', 'agent.plan', 'memory.write', 'other'][CAST(id % 6 AS INTEGER) + 1] AS protocol, CASE WHEN id % 4 = 0 THEN 'call' END AS method, CASE WHEN id % 5 = 0 THEN 'tick' END AS event FROM audit)"


def phase(protocol: Column, method: Column, event: Column, index: Column) -> Column:
    """The part of a conversation that a message belongs to, by its protocol."""
    dot = lambda head, *tail: F.concat(head, F.lit("."), F.coalesce(*tail))
    return (
        F.when(protocol == "mcp", dot(F.lit("mcp"), method, F.lit("response"))).when(protocol == "a2a", dot(F.lit("a2a"), event, method, F.lit("response")))
        .when(protocol == "local.agent", dot(F.lit("local"), event, F.lit("event"))).when(protocol.startswith("agent."), dot(protocol, event, F.lit("event")))
        .when(protocol == "memory.write", "memory.write").otherwise(F.concat(F.lit("message."), (index % 4).cast("string")))
    )


@query("flt_phase", f"SELECT id, CASE protocol WHEN 'mcp' THEN 'mcp.' || coalesce(method, 'response') WHEN 'a2a' THEN 'a2a.' || coalesce(event, method, 'response') WHEN 'local.agent' THEN 'local.' || coalesce(event, 'event') WHEN 'agent.plan' THEN 'agent.plan.' || coalesce(event, 'event') WHEN 'memory.write' THEN 'memory.write' ELSE 'message.' || (id % 4) END AS phase FROM {KINDS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    protocol = F.element_at(F.array(*[F.lit(x) for x in ("mcp", "a2a", "local.agent", "agent.plan", "memory.write", "other")]), (F.col("id") % 6 + 1).cast("int"))
    return read(spark, d, "audit").select("id", phase(protocol, F.when(F.col("id") % 4 == 0, "call"), F.when(F.col("id") % 5 == 0, "tick"), F.col("id")).alias("phase"))


@query("flt_input_kind", "SELECT id, CASE WHEN id % 5 = 0 THEN 'nary_client' WHEN id % 5 = 1 THEN 'backend_comparison' WHEN id % 5 = 2 THEN 'coordinator_comparison' WHEN id % 5 = 3 THEN 'stress_client' ELSE 'artifact' END AS kind FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    body = F.element_at(F.array(*[F.lit(x) for x in ('{"mode": "nary_client"}', '{"backend_results": []}', '{"summaries": [], "deltas": []}', '{"results": []}', "{}")]), (F.col("id") % 5 + 1).cast("int"))
    keys = F.json_object_keys("body")
    has = lambda k: F.array_contains(keys, k)
    kind = F.when(F.get_json_object("body", "$.mode") == "nary_client", "nary_client").when(has("backend_results"), "backend_comparison").when(has("summaries") & has("deltas"), "coordinator_comparison").when(has("results"), "stress_client").otherwise("artifact")
    return read(spark, d, "audit").select("id", body.alias("body")).select("id", kind.alias("kind"))


@query("flt_intent", "SELECT id, CASE event_type WHEN 'click' THEN 'question' WHEN 'view' THEN 'answer' ELSE 'statement' END AS intent FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_INTENT.items() for x in kv])
    c = F.when(F.col("event_type") == "click", "clarification").when(F.col("event_type") == "view", "fact").otherwise("general")
    return read(spark, d, "audit").select("id", F.coalesce(names[c], F.lit("statement")).alias("intent"))


@query("flt_needs_decode", "SELECT id, id % 3 = 0 AS needed FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("id") % 3 == 0, F.element_at(F.array(*[F.lit(x) for x in FULL_DECODE]), (F.col("id") % 6 + 1).cast("int"))).otherwise("route")
    return read(spark, d, "audit").select("id", op.isin(FULL_DECODE).alias("needed"))


@query("flt_classify", "SELECT id, CASE WHEN event_type = 'click' THEN 'question' ELSE 'statement' END AS intent, round(original_size / nullif(compressed_size, 0), 6) AS ratio, user_id % 10 <> 0 AS passes FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = F.struct(F.when(F.col("event_type") == "click", "question").otherwise("statement").alias("intent"), F.round(F.try_divide("original_size", "compressed_size"), 6).alias("ratio"), (F.when(F.col("user_id") % 10 == 0, 2).otherwise(0) != 2).alias("passes"))
    return read(spark, d, "audit").select("id", r.alias("r")).select("id", "r.*")


@query("flt_key_subset", "SELECT id, CAST(CASE WHEN method IS NULL THEN 1 ELSE 2 END AS INTEGER) AS n_keys, method FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("method"), F.col("method"), F.lit("kind"), F.col("kind"), F.lit("session_id"), F.col("session_id"))
    kept = F.map_filter(m, lambda k, v: k.isin("method", "kind") & v.isNotNull())
    return read(spark, d, "audit").select("id", F.size(kept).alias("n_keys"), kept["method"].alias("method"))


@query("flt_binary_data", "SELECT item_id, false AS is_binary, item_id % 2 = 0 AS spoilt_is_binary FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    def is_binary(b: Column) -> Column:
        """Not UTF-8, or less than seven tenths printable."""
        odd = F.length(F.regexp_replace(F.hex(b), "(?:2|3|4|5|6|7|8|9|A|B|C|D|E|F)[0-9A-F]|09|0A|0D", "")) / 2
        return ~F.is_valid_utf8(b.cast("string")) | (1 - odd / F.greatest(F.lit(1), F.octet_length(b)) < 0.7)

    b = F.encode("text", "utf-8")
    spoilt = F.when(F.col("item_id") % 2 == 0, F.concat(F.unhex(F.lit("FFFE")), b)).otherwise(b)
    return read(spark, d, "benchmark").select("item_id", is_binary(b).alias("is_binary"), is_binary(spoilt).alias("spoilt_is_binary"))


CODES = {0x1001: "hello", 0x1002: "ready", 0x2001: "diff", 0x2002: "ack", 0x3001: "resume"}


@query("join_control_lut", "WITH c(code, meaning) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in CODES.items()) + ") SELECT id, meaning FROM audit JOIN c ON code = CASE id % 4 WHEN 0 THEN 4097 WHEN 1 THEN 4098 WHEN 2 THEN 8193 ELSE 9999 END")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Two-byte control codes and their JSON bodies, decoded through a table."""
    lut = spark.createDataFrame(list(CODES.items()), "code int, meaning string")
    code = F.when(F.col("id") % 4 == 0, "1001").when(F.col("id") % 4 == 1, "1002").when(F.col("id") % 4 == 2, "2001").otherwise("270F")
    frames = read(spark, d, "audit").select("id", F.concat(F.unhex(code), F.encode("props", "utf-8")).alias("frame"))
    return frames.withColumn("code", F.conv(F.hex(F.expr("substring(frame, 1, 2)")), 16, 10).cast("int")).join(F.broadcast(lut), "code").select("id", "meaning")


@query("join_handshake", "SELECT run, CASE WHEN shards > 7 THEN 'no_shared_version' WHEN codec = 'token' AND NOT verified THEN 'dictionary_mismatch' ELSE 'accepted' END AS answer, CASE WHEN codec IN ('zlib', 'raw') THEN codec ELSE 'zlib' END AS fallback FROM runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    fallback = F.get(F.array_intersect(F.array(F.col("codec"), F.lit("zlib"), F.lit("raw")), F.array(F.lit("zlib"), F.lit("raw"))), F.lit(0))
    return read(spark, d, "runs").select("run", F.when(F.col("shards") > 7, "no_shared_version").when((F.col("codec") == "token") & ~F.col("verified"), "dictionary_mismatch").otherwise("accepted").alias("answer"), fallback.alias("fallback"))


@query("join_profile_resolve", "SELECT r.run, p.name FROM runs r JOIN (VALUES ('lan'), ('wifi'), ('lte'), ('mesh')) p(name) ON CASE WHEN r.run % 2 = 0 THEN 'all' ELSE r.profile END IN ('all', p.name)")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([(x,) for x in ("lan", "wifi", "lte", "mesh")], "name string")
    r = read(spark, d, "runs").select("run", F.when(F.col("run") % 2 == 0, "all").otherwise(F.col("profile")).alias("wanted"))
    return r.join(F.broadcast(p), (F.col("wanted") == "all") | (F.col("wanted") == F.col("name"))).select("run", "name")


@query("join_agents_grid", "SELECT codec, profile, agents, round(agents * avg(request_bytes + response_bytes), 3) AS bytes FROM runs CROSS JOIN (SELECT unnest([1, 16, 64]) AS agents) GROUP BY codec, profile, agents")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "runs").groupBy("codec", "profile").agg(F.avg(F.col("request_bytes") + F.col("response_bytes")).alias("b"))
    return g.withColumn("agents", F.explode(F.array(F.lit(1), F.lit(16), F.lit(64)))).select("codec", "profile", "agents", F.round(F.col("agents") * F.col("b"), 3).alias("bytes"))


@query("agg_session_counters", "SELECT session_id, count(*) AS frames, CAST(sum(original_size) AS BIGINT) AS bytes_in, CAST(sum(compressed_size) AS BIGINT) AS bytes_out, round(sum(original_size) / sum(compressed_size), 6) AS ratio, round(100 * (1 - sum(compressed_size) / sum(original_size)), 6) AS saved_percent FROM audit GROUP BY session_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.sum("original_size"), F.sum("compressed_size")
    return read(spark, d, "audit").groupBy("session_id").agg(F.count("*").alias("frames"), a.alias("bytes_in"), b.alias("bytes_out"), F.round(a / b, 6).alias("ratio"), F.round(100 * (1 - b / a), 6).alias("saved_percent"))


@query("agg_map_merge", "SELECT session_id, CAST(sum(CASE WHEN event_type = 'click' THEN original_size ELSE 0 END) AS BIGINT) AS click, CAST(sum(CASE WHEN event_type = 'view' THEN original_size ELSE 0 END) AS BIGINT) AS view FROM audit GROUP BY session_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Maps of one session added key by key."""
    m = read(spark, d, "audit").select("session_id", F.explode(F.create_map("event_type", "original_size")).alias("k", "v")).groupBy("session_id", "k").agg(F.sum("v").alias("v"))
    merged = m.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return merged.select("session_id", *[F.coalesce(F.col("m")[k], F.lit(0)).alias(k) for k in ("click", "view")])


@query("agg_weight_update", """WITH RECURSIVE r AS (SELECT event_type, (CAST(original_size % 21 AS INTEGER) - 10) / 10.0::DOUBLE AS step, row_number() OVER (PARTITION BY event_type ORDER BY id DESC) AS k FROM audit),
l AS (SELECT event_type, step, row_number() OVER (PARTITION BY event_type ORDER BY k DESC) AS n FROM r WHERE k <= 100),
w AS (SELECT event_type, n, greatest(-1.0, least(1.0, 0.1 * step))::DOUBLE AS weight FROM l WHERE n = 1 UNION ALL SELECT l.event_type, l.n, greatest(-1.0, least(1.0, w.weight + 0.1 * l.step)) FROM w JOIN l ON l.event_type = w.event_type AND l.n = w.n + 1)
SELECT event_type, round(max_by(weight, n), 6) AS weight FROM w GROUP BY event_type""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Last hundred samples of each method, each step clamped to [-1, 1]."""
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("id")))
    last = read(spark, d, "audit").withColumn("k", k).where("k <= 100").groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("id", ((F.col("original_size") % 21 - 10) / 10.0).alias("step")))).alias("xs"))
    return last.select("event_type", F.round(F.aggregate("xs", F.lit(0.0), lambda w, x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w + 0.1 * x["step"]))), 6).alias("weight"))


@query("agg_corpus_digest", "SELECT conv_id, sha256(string_agg(printf('%016x', strlen(text)) || text, '' ORDER BY turn)) AS digest FROM msgs GROUP BY conv_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Length-prefixed messages of a conversation, in order, hashed as one."""
    m = read(spark, d, "msgs").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lower(F.lpad(F.hex(F.octet_length("text")), 16, F.lit("0"))), "text").alias("t")))).alias("xs"))
    return m.select("conv_id", F.sha2(F.array_join("xs.t", ""), 256).alias("digest"))


@query("agg_dictionary_payload", "WITH t AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM msgs WHERE regexp_full_match(text, '[ -~\\n]*')) WHERE length(w) >= 5 GROUP BY w ORDER BY n DESC, w LIMIT 40) SELECT right(string_agg(w, '' ORDER BY n, w DESC), 128) AS payload FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The best terms, best last, cut to 128 bytes from the end."""
    t = read(spark, d, "msgs").where(F.col("text").rlike(r"\A[ -~\n]*\z")).select(F.explode(F.split("text", " ")).alias("w")).where("length(w) >= 5").groupBy("w").count().orderBy(F.desc("count"), "w").limit(40)
    xs = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "w")))
    return t.agg(F.right(F.array_join(F.transform(F.reverse(xs), lambda x: x["w"]), ""), F.lit(128)).alias("payload"))


@query("agg_nested_keys", "SELECT key, sum(n)::BIGINT AS n FROM (SELECT 'k' AS key, count(*) AS n FROM events UNION ALL SELECT 'a', count(*) FROM events UNION ALL SELECT 'list', count(*) FROM events UNION ALL SELECT 'k', count(*) FROM events) GROUP BY key")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Keys at every depth, through objects and lists: of all strings of a JSON text those that a colon follows."""
    body = F.concat(F.lit('{"a": '), "props", F.lit(', "list": ['), "props", F.lit("]}"))
    return nested_keys(read(spark, d, "events").select(body.alias("body")), "body").groupBy("key").agg(F.count("*").alias("n"))


def nested_keys(df: DataFrame, body: str) -> DataFrame:
    """One row (key) per key of each JSON text, unescaped; null texts have none.

    Escaped backslashes and quotes are set aside as control characters, which JSON holds only escaped."""
    plain = F.replace(F.replace(F.col(body), F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    strings = F.regexp_extract_all(plain, F.lit(r'"[^"]*+"\s*:?'), F.lit(0))
    keys = df.select(F.explode(F.filter(strings, lambda s: s.endswith(":"))).alias("s")).withColumn("s", F.regexp_replace("s", r"\s*:$", ""))
    quoted = keys.select(F.replace(F.replace("s", F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\")).alias("s"))
    return quoted.select(F.get_json_object(F.concat(F.lit('{"k":'), "s", F.lit("}")), "$.k").alias("key"))


@query("win_replay_log", "SELECT row_number() OVER (ORDER BY CASE kind WHEN 'compression_failure' THEN 1 ELSE 0 END, id) - 1 AS sequence, id, sha256(props) AS payload_sha256 FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "audit").withColumns({"late": (F.col("kind") == "compression_failure").cast("int"), "block": F.expr("id div 65536")})
    return numbered(a, ["late", "block"], ["id"], "sequence").select("sequence", "id", F.sha2("props", 256).alias("payload_sha256"))


def lru(df: DataFrame, key: str, order: str, item: str, size: int) -> DataFrame:
    """hit, evicted (an item had to go) and held (items afterwards) of each access to a least-recently-used cache per key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, out = pdf.sort_values(order), {}, []
        for x in pdf[item]:
            hit = x in held
            held.pop(x, None)
            held[x] = None
            evicted = len(held) > size
            if evicted:
                held.pop(next(iter(held)))
            out.append((hit, evicted, len(held)))
        return pdf[[key, order]].assign(hit=[x[0] for x in out], evicted=[x[1] for x in out], held=[x[2] for x in out])

    cols = df.select(key, order, item)
    return cols.groupBy(key).applyInPandas(run, cols.select(key, order).schema.add("hit", "boolean").add("evicted", "boolean").add("held", "integer"))


# Stack distances: an access hits if fewer than three other items came since the last one of its own.
_HITS = """SELECT a.session_id, a.id, a.user_id, a.latency_ms, coalesce(p.last IS NOT NULL AND (SELECT count(DISTINCT b.user_id) FROM audit b WHERE b.session_id = a.session_id AND b.id < a.id AND b.id > p.last) < 3, false) AS hit
 FROM audit a LEFT JOIN (SELECT x.id AS at, max(y.id) AS last FROM audit x JOIN audit y ON x.session_id = y.session_id AND x.user_id = y.user_id AND y.id < x.id GROUP BY x.id) p ON p.at = a.id"""


@query("win_lru_hits", f"SELECT session_id, id, hit FROM ({_HITS})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return lru(read(spark, d, "audit"), "session_id", "id", "user_id", 3).select("session_id", "id", "hit")


@query("agg_cache_stats", f"""SELECT session_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 9) AS hit_rate, least(3, count(DISTINCT user_id)) AS size,
 count(*) FILTER (NOT hit) - least(3, count(DISTINCT user_id)) AS evictions FROM ({_HITS}) GROUP BY session_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A cache of three users per session, replayed over the audit log."""
    got = lru(read(spark, d, "audit"), "session_id", "id", "user_id", 3).groupBy("session_id")
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    return got.agg(hits.alias("hits"), misses.alias("misses"), F.round(hits / F.count("*"), 9).alias("hit_rate"), F.max_by("held", "id").cast("long").alias("size"), F.count_if("evicted").alias("evictions"))


@query("agg_accelerator", f"""SELECT count(*) AS messages, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 9) AS hit_rate, round(avg(latency_ms) FILTER (hit), 6) AS mean_ms,
 round(13.0 / avg(latency_ms) FILTER (hit), 6) AS speedup FROM ({_HITS})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the session caches, their mean latency and what that is against a base of 13 ms."""
    a = read(spark, d, "audit")
    got = lru(a, "session_id", "id", "user_id", 3).join(a.select("id", "latency_ms"), "id")
    hits, mean = F.count_if("hit"), F.avg(F.when(F.col("hit"), F.col("latency_ms")))
    return got.agg(F.count("*").alias("messages"), hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(hits / F.count("*"), 9).alias("hit_rate"), F.round(mean, 6).alias("mean_ms"), F.round(13.0 / mean, 6).alias("speedup"))


@query("str_resume_negotiation", """WITH s AS (SELECT user_id % 50 AS peer, event_id % 11 AS state, count(*) AS n, max(event_id) AS entry FROM events WHERE event_type = 'view' GROUP BY ALL),
o AS (SELECT user_id, unnest([1, 2, 3]) AS place, unnest([user_id % 11, (user_id * 3 + 1) % 11, (user_id * 7 + 4) % 11]) AS state FROM (SELECT DISTINCT user_id FROM events)),
m AS (SELECT o.user_id, place, n, entry FROM o JOIN s ON s.peer = o.user_id % 50 AND s.state = o.state)
SELECT u.user_id, CASE WHEN min_by(n, place) IS NULL THEN 'fresh' WHEN min_by(n, place) > 1 THEN 'ambiguous' ELSE 'resumed' END AS answer, CASE WHEN min_by(n, place) = 1 THEN min_by(entry, place) END AS entry
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m USING (user_id) GROUP BY u.user_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The first offered state that the peer's store has; several entries for it are an error, none is a fresh start."""
    e = read(spark, d, "events")
    store = e.where("event_type = 'view'").groupBy((F.col("user_id") % 50).alias("peer"), (F.col("event_id") % 11).alias("state")).agg(F.count("*").alias("n"), F.max("event_id").alias("entry"))
    users = e.select("user_id").distinct()
    offers = users.select("user_id", (F.col("user_id") % 50).alias("peer"), F.posexplode(F.expr("array(user_id % 11, (user_id * 3 + 1) % 11, (user_id * 7 + 4) % 11)")).alias("place", "state"))
    first = offers.join(store, ["peer", "state"]).groupBy("user_id").agg(F.min(F.struct("place", "n", "entry")).alias("m"))
    answer = F.when(F.col("m").isNull(), "fresh").when(F.col("m.n") > 1, "ambiguous").otherwise("resumed")
    return users.join(first, "user_id", "left").select("user_id", answer.alias("answer"), F.when(F.col("m.n") == 1, F.col("m.entry")).alias("entry"))


@query("str_cache_promotion", """SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 THEN 'session' WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 1 THEN 'promoted' ELSE 'miss' END AS answer FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Where each access finds its signature: the session's cache, the platform's (and then the session's too), or nowhere."""
    e = read(spark, d, "events")
    platform = e.groupBy("event_type").agg(F.min("event_id").alias("first"))
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return e.withColumn("k", k).join(platform, "event_type").select("event_id", F.when(F.col("k") > 1, "session").when(F.col("event_id") > F.col("first"), "promoted").otherwise("miss").alias("answer"))


@query("udf_route_handlers", "SELECT id, CASE WHEN event_type = 'click' THEN upper(entry_id) WHEN event_type = 'view' THEN reverse(entry_id) ELSE entry_id END AS handled FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Handlers are named column functions; the route picks one per row."""
    handlers = {"click": F.upper, "view": F.reverse}
    out = F.coalesce(*[F.when(F.col("event_type") == k, f(F.col("entry_id"))) for k, f in handlers.items()], F.col("entry_id"))
    return read(spark, d, "audit").select("id", out.alias("handled"))


def lz_candidates(df: DataFrame, key: str, data: str, window: int = 1024) -> DataFrame:
    """(key, position, distance, length) of the longest, then nearest, earlier match of at least 3 bytes that does not overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b[key], b[data], strict=True):
                raw, seen = (text or "").encode(), {}
                for p in range(len(raw) - 2):
                    best = (0, 0)
                    for q in reversed(seen.get(raw[p : p + 3], [])):
                        if p - q > window:
                            break
                        n = 3
                        while n < p - q and p + n < len(raw) and raw[q + n] == raw[p + n]:
                            n += 1
                        if p - q >= 3 and n > best[1]:
                            best = (p - q, n)
                    if best[1]:
                        rows.append((k, p, *best))
                    seen.setdefault(raw[p : p + 3], []).append(p)
            yield pd.DataFrame(rows, columns=[key, "position", "distance", "length"])

    cols = df.select(key, data)
    return cols.mapInPandas(run, cols.select(key).schema.add("position", "long").add("distance", "long").add("length", "long"))


@query("win_lz_candidates")
def _(spark: SparkSession, d: str) -> DataFrame:
    return lz_candidates(read(spark, d, "benchmark"), "item_id", "text")
