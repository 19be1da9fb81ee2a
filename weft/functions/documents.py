"""File types, semantic chunks, blob descriptors, dictionary hit rates, method ladders and template hashes."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import codecs
from weft.registry import query, read

# Signs of file types, common words and structural marks.
CODE = [r"function\s+\w+\s*\(", r"class\s+\w+\s*[:{]", r"import\s+\w+", r"def\s+\w+\s*\(", r"const\s+\w+\s*=", r"var\s+\w+\s*="]
LOG = [r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}", r"\[(INFO|DEBUG|ERROR|WARN)\]", r"(?m)^\[\d+\]"]
DATA = [r"\{[^}]*\}", r"<[^>]+>", r"^\s*[\w-]+:\s*"]
COMMON = ["the ", " and ", " for ", " that ", " with ", "data", "message", "error", "request", "response", "status"]


def file_type(text: Column) -> Column:
    """code, log or data by the number of signs in the first 5000 characters; generic without any."""
    head = F.left(text, F.lit(5000))
    score = [sum((head.rlike(p).cast("int") for p in ps), F.lit(0)) for ps in (CODE, LOG, DATA)]
    top = F.greatest(*score)
    return F.when(top == 0, "generic").when(score[0] == top, "code").when(score[1] == top, "log").otherwise("data")


def chunk(text: Column, kind: Column, lines: int = 100) -> Column:
    """Records of logs and data, line blocks otherwise; blank chunks are dropped."""
    every = F.split(text, "\n")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / lines).cast("int")), lambda i: F.array_join(F.slice(every, i * lines + 1, F.lit(lines)), "\n"))
    cut = F.when(kind == "code", F.split(text, r"\n(?=(?:function|class|def)\s+\w+)")).when(kind == "log", F.split(text, r"\n(?=\d{4}-\d{2}-\d{2}|\[)")).when(kind == "data", F.split(text, r"\n(?=\{|<)")).otherwise(blocks)
    return F.filter(cut, lambda c: F.trim(c) != "")


def hit_rate(text: Column) -> Column:
    """Share of structural marks and known words in samples from the start, middle and end."""
    n = F.length(text)
    size = F.least(F.lit(300), F.greatest(F.lit(60), F.floor(n / 10).cast("int")))
    mid = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - F.floor(size / 2).cast("int"))
    parts = F.when(n <= 600, F.array(text)).otherwise(F.array(F.left(text, size), F.substring(text, mid + 1, size), F.right(text, size)))
    total = F.aggregate(F.transform(parts, lambda p: F.length(p)), F.lit(0), lambda a, x: a + x)
    marks = F.aggregate(F.transform(parts, lambda p: F.length(p) - F.length(F.translate(p, '{}[]":,<>/=', ""))), F.lit(0), lambda a, x: a + x)
    has = lambda w: F.exists(parts, lambda p: F.lower(p).contains(w))
    words = sum((has(w).cast("int") for w in COMMON), F.lit(0))
    return F.when((n < 10) | (total == 0), 0.0).otherwise(F.least(F.lit(1.0), marks / total * 0.7 + words * 0.05 * 0.3))


def ladder(size: Column, entropy: Column, hits: Column, template: Column) -> Column:
    """Method by size, then entropy and dictionary hits."""
    return (
        F.when(size < 20, "uncompressed").when(template, "semantic").when(size < 80, F.when(entropy < 4.0, "dictionary").otherwise("uncompressed"))
        .when(size < 400, F.when(entropy < 5.5, "dictionary").otherwise("uncompressed")).when(size < 2048, F.when(hits > 0.15, "dictionary").when(entropy < 6.0, "entropy").otherwise("dictionary"))
        .when(size < 1_048_576, "entropy").otherwise("pattern")
    )


SHAPES = [("code", "import x\ndef f(a):\n  pass\nclass B:\n  pass"), ("log", "2024-01-01 00:00:00 [INFO] a\n2024-01-01 00:00:01 [WARN] b"), ("data", '{"a": 1}\n{"b": 2}\n\n{"c": 3}'), ("generic", "plain words only")]


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for _, t in SHAPES])
    return read(spark, d, "part").select("p_partkey", F.element_at(texts, (F.col("p_partkey") % 4 + 1).cast("int")).alias("t"))


@query("flt_file_type", "SELECT p_partkey, ['code', 'log', 'data', 'generic'][p_partkey % 4 + 1] AS kind, [3, 2, 3, 1][p_partkey % 4 + 1] AS n_chunks FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = _shapes(spark, d).withColumn("kind", file_type(F.col("t")))
    return k.select("p_partkey", "kind", F.size(chunk(F.col("t"), F.col("kind"))).alias("n_chunks"))


@query("fn_hit_rate", "SELECT conv_id, turn, CASE WHEN length(text) < 10 THEN 0 ELSE round(least(1.0, (length(text) - length(translate(text, '{}[]\":,<>/=', ''))) / length(text) * 0.7 + len(list_filter(['the ', ' and ', ' for ', ' that ', ' with ', 'data', 'message', 'error', 'request', 'response', 'status'], lambda w: contains(lower(text), w))) * 0.05 * 0.3), 6) END AS rate FROM msgs WHERE length(text) <= 600")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "msgs").where("length(text) <= 600").select("conv_id", "turn", F.round(hit_rate(F.col("text")), 6).alias("rate"))


@query("fn_hit_rate_sampled", """WITH p AS (SELECT conv_id, turn, text, length(text) AS n, least(300, greatest(60, length(text) // 10)) AS k FROM msgs),
s AS (SELECT conv_id, turn, n, CASE WHEN n <= 600 THEN [text] ELSE [left(text, k), substr(text, n // 2 - k // 2 + 1, k), right(text, k)] END AS parts FROM p)
SELECT conv_id, turn, CASE WHEN n < 10 THEN 0 ELSE round(least(1.0, list_sum(list_transform(parts, lambda x: length(x) - length(translate(x, '{}[]":,<>/=', '')))) / list_sum(list_transform(parts, lambda x: length(x))) * 0.7
  + len(list_filter(['the ', ' and ', ' for ', ' that ', ' with ', 'data', 'message', 'error', 'request', 'response', 'status'], lambda w: len(list_filter(parts, lambda x: contains(lower(x), w))) > 0)) * 0.05 * 0.3), 6) END AS rate FROM s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "msgs").select("conv_id", "turn", F.round(hit_rate(F.col("text")), 6).alias("rate"))


@query("fn_method_ladder", "SELECT id, CASE WHEN s < 20 THEN 'uncompressed' WHEN id % 9 = 0 THEN 'semantic' WHEN s < 80 THEN CASE WHEN e < 4 THEN 'dictionary' ELSE 'uncompressed' END WHEN s < 400 THEN CASE WHEN e < 5.5 THEN 'dictionary' ELSE 'uncompressed' END WHEN s < 2048 THEN CASE WHEN h > 0.15 THEN 'dictionary' WHEN e < 6 THEN 'entropy' ELSE 'dictionary' END ELSE 'entropy' END AS method FROM (SELECT id, original_size * 3 - 295 AS s, (compressed_size % 80) / 10 AS e, (id % 40) / 100 AS h FROM audit)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").select("id", ladder(F.col("original_size") * 3 - 295, (F.col("compressed_size") % 80) / 10, (F.col("id") % 40) / 100, F.col("id") % 9 == 0).alias("method"))


def blob_errors(d: Column) -> Column:
    """What is wrong with a blob descriptor."""
    checks = [(d["sha256"].rlike("^[0-9a-f]{64}$"), "sha256"), (d["size"] >= 0, "size"), (F.length(d["type"]) > 0, "type")]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in checks]))


@query("fn_blob_descriptor", "SELECT item_id, sha256(text) AS sha256, strlen(text) AS size, CASE WHEN item_id % 4 = 0 THEN ['type'] ELSE [] END AS errors FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = F.struct(F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"), F.when(F.col("item_id") % 4 == 0, "").otherwise("text").alias("type"))
    return read(spark, d, "benchmark").select("item_id", b.alias("b")).select("item_id", "b.sha256", "b.size", blob_errors(F.col("b")).alias("errors"))


@query("fn_template_set_hash", """SELECT p_brand, sha256('[' || string_agg('{"template_id":' || p_partkey || ',"pattern":"' || p_type || '"}', ',' ORDER BY p_partkey) || ']') AS state FROM part GROUP BY p_brand""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Ordered templates as JSON, hashed."""
    xs = F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("template_id"), F.col("p_type").alias("pattern"))))
    return read(spark, d, "part").groupBy("p_brand").agg(F.sha2(F.to_json(xs), 256).alias("state"))


def anchor(pattern: Column) -> Column:
    """Longest literal between slots; of equal ones the first."""
    parts = F.split(pattern, r"\{\d+\}")
    return F.array_max(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("o"), p.alias("p"))))["p"]


@query("fn_anchor_literal", "SELECT p_partkey, CASE WHEN length(p_brand) > length(CAST(p_size AS VARCHAR)) + 4 THEN p_brand ELSE ' of ' || p_size END AS anchor FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    pattern = F.concat("p_brand", F.lit("{0} of "), F.col("p_size").cast("string"), F.lit("{1}"))
    return read(spark, d, "part").select("p_partkey", anchor(pattern).alias("anchor"))


def tail_p95(probability: Column, pause: Column) -> Column:
    """Pause at the 95th percentile when a pause happens with this probability."""
    q = (0.95 - (1.0 - probability)) / probability
    return F.when((probability <= 0.05) | (pause <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)) * pause)


@query("fn_profile_p95", "SELECT run, round(20 + request_bytes * 8.0 / 10000 + response_bytes * 8.0 / 20000 + 0.9 * (shards + 1) + CASE WHEN exchanges / 100 <= 0.05 THEN 0 ELSE greatest(0, least(1, (0.95 - (1 - exchanges / 100)) / (exchanges / 100))) * 40 END, 6) AS p95 FROM runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    from weft.functions.scoring import serialization_ms

    p = F.col("exchanges") / 100
    return read(spark, d, "runs").select("run", F.round(20 + serialization_ms(F.col("request_bytes"), F.lit(10.0)) + serialization_ms(F.col("response_bytes"), F.lit(20.0)) + 0.9 * (F.col("shards") + 1) + tail_p95(p, F.lit(40.0)), 6).alias("p95"))


@query("fn_json_terms", "SELECT event_id, regexp_extract_all(props, '\"([a-z]+)\"\\s*:', 1) AS keys, regexp_extract_all(props, '[0-9]+') AS numbers FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.regexp_extract_all("props", F.lit(r'"([a-z]+)"\s*:')).alias("keys"), F.regexp_extract_all("props", F.lit("([0-9]+)")).alias("numbers"))


def best_method(text: str) -> tuple[bytes, str]:
    """Method byte and payload of the shortest of raw, deflate and token coding; raw unless another is shorter."""
    raw = text.encode()
    made = [b"\x00" + raw, b"\x01" + zlib.compress(raw, 6), b"\x02" + codecs.tokens_encode([text])[0]]
    best = min(range(3), key=lambda k: (len(made[k]), k))
    return made[best], ("raw", "deflate", "token")[best]


def decode_any(frame: bytes) -> str:
    body = bytes(frame[1:])
    return body.decode() if frame[0] == 0 else zlib.decompress(body).decode() if frame[0] == 1 else codecs.tokens_decode([body])[0]


@query("cod_hybrid_roundtrip", "SELECT conv_id, turn, text FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    encode = F.pandas_udf(lambda s: s.map(lambda t: best_method(t)[0]), "binary")
    decode = F.pandas_udf(lambda s: s.map(decode_any), "string")
    return read(spark, d, "msgs").select("conv_id", "turn", encode("text").alias("frame")).select("conv_id", "turn", decode("frame").alias("text"))


def compressed(text: Column, method: Column) -> Column:
    """The frame of a text under the method named: raw, deflate, token or best; an unknown name is an error."""

    def run(texts: pd.Series, methods: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(texts, methods, strict=True):
            raw = (t or "").encode()
            if m not in ("raw", "deflate", "token", "best"):
                raise ValueError(f"no method {m}")
            out.append(best_method(t or "")[0] if m == "best" else b"\x00" + raw if m == "raw" else b"\x01" + zlib.compress(raw, 6) if m == "deflate" else b"\x02" + codecs.tokens_encode([t or ""])[0])
        return pd.Series(out)

    return F.pandas_udf(run, "binary")(text, method)


@query("sup_explicit_method", "SELECT conv_id, turn, turn % 4 AS byte_or_best, text FROM msgs WHERE turn % 4 < 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Messages framed by the method that their turn names; the first byte tells it again."""
    method = F.element_at(F.array(F.lit("raw"), F.lit("deflate"), F.lit("token")), (F.col("turn") % 4 + 1).cast("int"))
    frames = read(spark, d, "msgs").where("turn % 4 < 3").select("conv_id", "turn", compressed(F.col("text"), method).alias("frame"))
    decode = F.pandas_udf(lambda s: s.map(decode_any), "string")
    return frames.select("conv_id", "turn", F.conv(F.hex(F.substring("frame", 1, 1)), 16, 10).cast("long").alias("byte_or_best"), decode("frame").alias("text"))


@query("cod_token_deflate_roundtrip", "SELECT conv_id, turn, text FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    wire = codecs.token_session_deflate(read(spark, d, "msgs"), "conv_id", "turn", "text")
    return codecs.token_session_inflate(wire, "conv_id", "turn").select("conv_id", "turn", "text")


@query("cod_token_roundtrip", "SELECT conv_id, turn, text FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        return pdf[["conv_id", "turn"]].assign(text=codecs.tokens_decode(codecs.tokens_encode(list(pdf["text"]))))

    return read(spark, d, "msgs").groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, text string")


@query("srt_best_method")
def _(spark: SparkSession, d: str) -> DataFrame:
    name = F.pandas_udf(lambda s: s.map(lambda t: best_method(t)[1]), "string")
    return read(spark, d, "msgs").select("conv_id", "turn", name("text").alias("method"))
