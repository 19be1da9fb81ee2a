"""Corpus generators, pattern mining, layered codecs and template deltas."""

from __future__ import annotations

import difflib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import codecs
from weft.registry import query, read

PROTOCOLS = ["mcp", "a2a", "local.agent", "agent.plan", "memory.write"]


def synthetic_messages(spark: SparkSession, count: int, seed: int = 1729, delta: bool = False) -> DataFrame:
    """seq, protocol and body (JSON) of made-up messages; delta: ten variants, one field changed each."""
    pick = lambda k, n: F.pmod(F.xxhash64("seq", F.lit(seed * 31 + k)), F.lit(n))
    m = spark.range(count).withColumnRenamed("id", "seq").withColumn("protocol", F.element_at(F.array(*[F.lit(p) for p in PROTOCOLS]), (F.col("seq") % len(PROTOCOLS) + 1).cast("int")))
    changed = F.concat(F.lit("field_"), (F.col("seq") % 10).cast("string")) if delta else F.lit(None).cast("string")
    body = F.struct("seq", "protocol", pick(1, 1000).alias("task"), F.concat(F.lit("step "), pick(2, 9).cast("string")).alias("note"), changed.alias("changed_value"))
    return m.select("seq", "protocol", F.to_json(body).alias("body"))


@query("src_synthetic_corpus", "SELECT ['mcp', 'a2a', 'local.agent', 'agent.plan', 'memory.write'][range % 5 + 1] AS protocol, 'field_' || (range % 10) AS changed, count(*) AS n FROM range(2000) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return synthetic_messages(spark, 2000, delta=True).groupBy("protocol", F.get_json_object("body", "$.changed_value").alias("changed")).agg(F.count("*").alias("n"))


@query("src_domain_templates", "SELECT ['greeting', 'fact', 'definition', 'code', 'howto', 'compare', 'explain'][d.range + 1] AS domain, d.range * 200 + t.range AS template_id FROM range(7) d CROSS JOIN range(25) t")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("greeting", "fact", "definition", "code", "howto", "compare", "explain")])
    return spark.range(175).select(F.element_at(names, (F.expr("id div 25") + 1).cast("int")).alias("domain"), F.expr("(id div 25) * 200 + id % 25").alias("template_id"))


def substrings(df: DataFrame, text: str, shortest: int, longest: int) -> DataFrame:
    n = F.explode(F.sequence(F.lit(shortest), F.lit(longest))).alias("n")
    pos = F.explode(F.expr("sequence(1, length(t) - n + 1)"))
    return df.select(F.col(text).alias("t")).select("t", n).where("length(t) >= n").select("n", pos.alias("p"), "t").select(F.expr("substring(t, p, n)").alias("pattern"), "n")


@query("agg_substring_candidates", "SELECT pattern, count(*) AS frequency, (length(pattern) - 2) * count(*) AS saved FROM (SELECT substr(t, p, n) AS pattern FROM (SELECT t, n, unnest(range(1, length(t) - n + 2)) AS p FROM (SELECT text AS t, unnest(range(8, 50)) AS n FROM benchmark) WHERE length(t) >= n)) GROUP BY pattern HAVING count(*) >= 3 ORDER BY saved DESC, pattern LIMIT 1000")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = substrings(read(spark, d, "benchmark"), "text", 8, 49).groupBy("pattern").agg(F.count("*").alias("frequency"))
    s = s.where("frequency >= 3").withColumn("saved", (F.length("pattern") - 2) * F.col("frequency"))
    return s.orderBy(F.desc("saved"), "pattern").limit(1000)


def without_contained(ranked: DataFrame, most: int = 200) -> DataFrame:
    """Best first, those that no better one contains or is contained in; ranked has at most a thousand rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf, kept = pd.concat(list(batches)), []
        for p in pdf.sort_values(["saved", "pattern"], ascending=[False, True])["pattern"]:
            if len(kept) < most and not any(p in k or k in p for k in kept):
                kept.append(p)
        yield pdf[pdf["pattern"].isin(kept)]

    return ranked.coalesce(1).mapInPandas(run, ranked.schema)


@query("agg_mined_patterns")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = substrings(read(spark, d, "benchmark"), "text", 8, 49).groupBy("pattern").agg(F.count("*").alias("frequency")).where("frequency >= 3")
    return without_contained(s.withColumn("saved", (F.length("pattern") - 2) * F.col("frequency")).orderBy(F.desc("saved"), "pattern").limit(1000))


@query("agg_repeated_substrings", "SELECT item_id, count(*) AS n FROM (SELECT item_id, s FROM (SELECT item_id, substr(t, p, n) AS s FROM (SELECT item_id, t, n, unnest(range(1, length(t) - n + 2)) AS p FROM (SELECT item_id, text AS t, unnest(range(4, 21)) AS n FROM benchmark) WHERE length(t) >= n)) GROUP BY item_id, s HAVING count(*) >= 2) GROUP BY item_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "benchmark").select("item_id", F.col("text").alias("t")).withColumn("n", F.explode(F.sequence(F.lit(4), F.lit(20)))).where("length(t) >= n")
    s = t.withColumn("p", F.explode(F.expr("sequence(1, length(t) - n + 1)"))).select("item_id", F.expr("substring(t, p, n)").alias("s"))
    return s.groupBy("item_id", "s").count().where("count >= 2").groupBy("item_id").agg(F.count("*").alias("n"))


@query("fn_whitespace_variant", "SELECT item_id, 2 AS leading, 1 AS trailing, trim(text) AS base FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("  "), F.trim("text"), F.lit(" "))
    return read(spark, d, "benchmark").select("item_id", (F.length(t) - F.length(F.ltrim(t))).alias("leading"), (F.length(t) - F.length(F.rtrim(t))).alias("trailing"), F.trim(t).alias("base"))


@query("fn_cluster_variation", "SELECT id, id % 7 AS lane, (id * 13 + 5) % 11 AS pick, (id * 13 + 5) % 11 < 3 AS varied FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    pick = F.pmod(F.col("id") * 13 + 5, F.lit(11))
    return read(spark, d, "audit").select("id", F.pmod("id", F.lit(7)).alias("lane"), pick.alias("pick"), (pick < 3).alias("varied"))


@query("fn_state_hash", """SELECT p_brand, sha256('{"epoch":' || min(p_size) || ',"templates":[' || string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) || ']}') AS state FROM part GROUP BY p_brand""")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("e"), F.sort_array(F.collect_list("p_partkey")).alias("xs"))
    return g.select("p_brand", F.sha2(F.to_json(F.struct(F.col("e").alias("epoch"), F.col("xs").alias("templates"))), 256).alias("state"))


def line_diff(a: Column, b: Column) -> Column:
    """Changed line pairs of two texts."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str, q: str) -> list[str]:
            return [t for t in difflib.ndiff((p or "").split("\n"), (q or "").split("\n")) if t[:1] in "+-"]

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(run, "array<string>")(a, b)


@query("fn_line_diff", "SELECT p_partkey, ['- ' || p_brand, '+ ' || p_type] AS changes FROM part WHERE p_brand <> p_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    same = F.lit("same\n")
    return read(spark, d, "part").where("p_brand <> p_type").select("p_partkey", F.filter(line_diff(F.concat(same, "p_brand"), F.concat(same, "p_type")), lambda t: ~t.startswith("?")).alias("changes"))


@query("agg_dictionary_sizes")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Wire bytes of each brand's types, deflated with and without a preset dictionary."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = "\n".join(sorted(pdf["p_type"])).encode()
        size = lambda z: len(z.compress(raw) + z.flush())
        return pd.DataFrame({"p_brand": [pdf["p_brand"].iloc[0]], "raw": [len(raw)], "plain": [size(zlib.compressobj(3))], "preset": [size(zlib.compressobj(3, zdict=b"STANDARD ANODIZED PLATED BRUSHED POLISHED TIN STEEL COPPER"))]})

    return read(spark, d, "part").select("p_brand", "p_type").groupBy("p_brand").applyInPandas(run, "p_brand string, raw long, plain long, preset long")


def layered_encode(text: str) -> bytes:
    """LZ tokens as bytes, then an entropy stage under the frequencies of those bytes."""
    out = bytearray()
    for t in codecs.lz_tokens(text.encode()):
        out += bytes([0, t[0]]) if len(t) == 1 else bytes([1]) + codecs.varint(t[0]) + codecs.varint(t[1])
    freq = codecs.ans_frequencies(bytes(out))
    head = b"".join(codecs.varint(f) for f in freq)
    return codecs.varint(len(out)) + head + codecs.ans_encode(bytes(out), freq)


def layered_decode(frame: bytes) -> str:
    n, at = codecs.read_varint(frame, 0)
    freq = []
    for _ in range(256):
        f, at = codecs.read_varint(frame, at)
        freq.append(f)
    raw, tokens, k = codecs.ans_decode(frame[at:], n, freq), [], 0
    while k < len(raw):
        if raw[k] == 0:
            tokens.append((raw[k + 1],))
            k += 2
        else:
            dist, k = codecs.read_varint(raw, k + 1)
            size, k = codecs.read_varint(raw, k)
            tokens.append((dist, size))
    return codecs.lz_bytes(tokens).decode()


@query("cod_layered_roundtrip", "SELECT item_id, text FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    both = F.pandas_udf(lambda s: s.map(lambda t: layered_decode(layered_encode(t))), "string")
    return read(spark, d, "benchmark").select("item_id", both("text").alias("text"))


def pattern_encode(text: str, patterns: list[str]) -> bytes:
    """UTF-8 with patterns as 0xFF and their number; 0xFF never occurs in UTF-8."""
    if not patterns:
        return text.encode()
    number = {p.encode(): k for k, p in reversed(list(enumerate(patterns[:255])))}
    any_of = b"|".join(re.escape(p) for p in sorted(number, key=len, reverse=True))
    return re.sub(any_of, lambda m: bytes([255, number[m[0]]]), text.encode())


def pattern_decode(raw: bytes, patterns: list[str]) -> str:
    return re.sub(rb"\xff(.)", lambda m: patterns[m[1][0]].encode(), bytes(raw), flags=re.S).decode()


@query("cod_pattern_roundtrip", "SELECT item_id, text FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = [r["w"] for r in read(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("length(w) >= 6").groupBy("w").count().orderBy(F.desc("count"), "w").limit(100).collect()]
    both = F.pandas_udf(lambda s: s.map(lambda t: pattern_decode(pattern_encode(t, words), words)), "string")
    return read(spark, d, "benchmark").select("item_id", both("text").alias("text"))


@query("str_delta_apply", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS v FROM part WHERE p_size < 40")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A template map, after the delta between it and the wanted one."""
    from weft.operators.joins import map_diff

    p = read(spark, d, "part")
    old = p.where("p_size > 15").selectExpr("p_partkey", "p_brand AS v")
    new = p.where("p_size < 40").selectExpr("p_partkey", "CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS v")
    j = old.join(map_diff(old, new, "p_partkey", "v"), "p_partkey", "full_outer")
    return j.where("action IS NULL OR action <> 'remove'").select("p_partkey", F.coalesce("new", "v").alias("v"))


@query("udf_custom_templates", "SELECT p_partkey, p_brand FROM part WHERE p_size <> 7 UNION ALL SELECT 1000000 + range, 'custom' FROM range(5)")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_brand")
    added = spark.range(5).select((F.col("id") + 1_000_000).alias("p_partkey"), F.lit("custom").alias("p_brand"))
    return p.join(read(spark, d, "part").where("p_size = 7").select("p_partkey"), "p_partkey", "left_anti").unionByName(added)


@query("agg_container_stats", "SELECT coalesce(method, 'none') AS method, count(*) AS chunks, count(DISTINCT user_id) AS templates, CAST(sum(compressed_size) AS BIGINT) AS payload, round(stddev_samp(original_size / compressed_size), 6) AS spread FROM audit GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("original_size") / F.col("compressed_size")
    return read(spark, d, "audit").groupBy(F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("chunks"), F.count_distinct("user_id").alias("templates"), F.sum("compressed_size").alias("payload"), F.round(F.stddev_samp(r), 6).alias("spread"))


@query("sup_modeled_delay", "SELECT run, CASE WHEN x % 1000 < 20 THEN 250.0::DOUBLE ELSE round(5 + 20 * (x // 1000) / 1000000.0::DOUBLE, 6) END AS delay_ms FROM (SELECT run, CAST('0x' || substr(md5('delay' || run), 1, 8) AS BIGINT) % 1000000000 AS x FROM runs)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Upstream delay: mostly short, with a rare long tail; drawn from the run's hash, so that reruns agree."""
    x = F.conv(F.substring(F.md5(F.concat(F.lit("delay"), F.col("run").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 1_000_000_000
    return read(spark, d, "runs").select("run", x.alias("x")).select("run", F.when(F.col("x") % 1000 < 20, 250.0).otherwise(F.round(5 + 20 * F.expr("x div 1000") / 1_000_000.0, 6)).alias("delay_ms"))


def dictionary_matrix(msgs: DataFrame, session: str, order: str, scope: str, text: str, fixed: bytes = b"assistant user request response status result error message function session", size: int = 512) -> DataFrame:
    """scope, dictionary, frames, raw, wire and ratio: each session's frames deflated under each dictionary.

    The third dictionary holds the scope's most saving words, best last.  They are at most size bytes a scope and
    are shipped with the rows of that scope.
    """
    words = msgs.select(scope, F.explode(F.split(text, r"\s+")).alias("w")).where("length(w) >= 4").groupBy(scope, "w").agg(F.count("*").alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(F.col("n") * (F.octet_length("w") - 2)), "w"))
    best = words.withColumn("k", rank).where(f"k <= {size // 4}").groupBy(scope).agg(F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("k", "w")))), lambda x: x["w"]), " ").alias("own"))
    rows = msgs.select(scope, session, order, text).join(best, scope, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        frames, own = [(t or "").encode() for t in pdf[text]], (pdf["own"].iloc[0] or "").encode()[-size:]
        out = []
        for name, d in (("none", b""), ("fixed", fixed), ("own", own)):
            z = zlib.compressobj(3, zlib.DEFLATED, -15, zdict=d) if d else zlib.compressobj(3, zlib.DEFLATED, -15)
            out.append((pdf[scope].iloc[0], name, len(frames), sum(map(len, frames)), sum(len(z.compress(f) + z.flush(zlib.Z_SYNC_FLUSH)) for f in frames)))
        return pd.DataFrame(out, columns=[scope, "dictionary", "frames", "raw", "wire"])

    each = rows.groupBy(scope, session).applyInPandas(run, f"{scope} string, dictionary string, frames long, raw long, wire long")
    g = each.groupBy(scope, "dictionary").agg(F.sum("frames").alias("frames"), F.sum("raw").alias("raw"), F.sum("wire").alias("wire"))
    return g.withColumn("ratio", F.try_divide("raw", "wire"))
