"""Binary frames in SQL functions: 12-byte metadata headers, lane tags, control codes, varints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, read


def _hex(value: Column, size: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2 * size, F.lit("0"))


def encode_header(method: Column, original: Column, compressed: Column, template: Column, category: Column, slots: Column, flags: Column) -> Column:
    """Method, sizes capped at 65535, template (0xFFFF: none), category, slots, flags, two reserved bytes; big-endian."""
    cap = lambda x: F.least(x, F.lit(65535))
    return F.unhex(F.concat(_hex(method, 1), _hex(cap(original), 2), _hex(cap(compressed), 2), _hex(F.coalesce(template, F.lit(65535)), 2), _hex(category, 1), _hex(slots % 256, 1), _hex(flags, 1), F.lit("0000")))


def _number(b: Column, at: int, size: int) -> Column:
    return F.conv(F.substring(F.hex(b), 2 * at + 1, 2 * size), 16, 10).cast("int")


def decode_header(b: Column) -> Column:
    """The fields of a header; null if the bytes are fewer than 12."""
    template = _number(b, 5, 2)
    return F.when(F.octet_length(b) >= 12, F.struct(_number(b, 0, 1).alias("method"), _number(b, 1, 2).alias("original"), _number(b, 3, 2).alias("compressed"), F.nullif(template, F.lit(65535)).alias("template"), _number(b, 7, 1).alias("category"), _number(b, 8, 1).alias("slots"), _number(b, 9, 1).alias("flags")))


FLAGS = "(CASE WHEN user_id % 9 = 0 THEN 128 WHEN user_id % 9 = 1 THEN 64 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 32 ELSE 0 END + CASE WHEN user_id % 5 = 0 THEN 16 ELSE 0 END)"


@query("fn_header_encode", f"SELECT id, lower(printf('%02x%04x%04x%04x%02x%02x%02x0000', id % 4, least(original_size * 80, 65535), compressed_size, CASE WHEN id % 3 = 0 THEN 65535 ELSE id % 200 END, id % 12, id % 5, {FLAGS})) AS header FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    h = encode_header(F.col("id") % 4, F.col("original_size") * 80, F.col("compressed_size"), F.when(F.col("id") % 3 != 0, F.col("id") % 200), F.col("id") % 12, F.col("id") % 5, F.expr(FLAGS))
    return read(spark, d, "audit").select("id", F.lower(F.hex(h)).alias("header"))


@query("fn_header_decode", f"SELECT id, id % 4 AS method, least(original_size * 80, 65535) AS original, compressed_size AS compressed, CASE WHEN id % 3 <> 0 THEN id % 200 END AS template, id % 12 AS category, id % 5 AS slots, {FLAGS} AS flags FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    h = encode_header(F.col("id") % 4, F.col("original_size") * 80, F.col("compressed_size"), F.when(F.col("id") % 3 != 0, F.col("id") % 200), F.col("id") % 12, F.col("id") % 5, F.expr(FLAGS))
    return read(spark, d, "audit").select("id", decode_header(h).alias("h")).select("id", "h.*")


@query("src_lane_frames", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS lane, text AS payload FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    lane = F.when(F.col("role") == "user", "01").when(F.col("role") == "assistant", "02").otherwise("03")
    f = read(spark, d, "msgs").select("conv_id", "turn", F.concat(F.unhex(lane), F.encode("text", "utf-8")).alias("frame"))
    return f.select("conv_id", "turn", _number(F.col("frame"), 0, 1).alias("lane"), F.decode(F.expr("substring(frame, 2)"), "utf-8").alias("payload"))


@query("fn_lut_code", "SELECT p_partkey, printf('%04x', p_partkey % 65536) AS code, p_partkey % 65536 AS parsed FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.lower(_hex(F.col("p_partkey") % 65536, 2)).alias("code")).withColumn("parsed", F.conv("code", 16, 10).cast("bigint"))


@query("fn_zigzag", "SELECT id, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS coded, v AS decoded FROM (SELECT id, original_size - compressed_size AS v FROM audit)")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "audit").selectExpr("id", "original_size - compressed_size AS v").selectExpr("id", "shiftleft(v, 1) ^ shiftright(v, 63) AS coded")
    return v.selectExpr("id", "coded", "shiftrightunsigned(coded, 1) ^ -(coded & 1) AS decoded")


@query("flt_fast_path", "SELECT id, original_size % 300 <= 120 AND compressed_size % 200 <= 120 AS fast FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(F.col("original_size") % 300, F.col("compressed_size") % 200)
    return read(spark, d, "audit").select("id", ((F.size(ids) > 0) & F.forall(ids, lambda i: i.between(0, 120))).alias("fast"))


def fast_path(header: Column) -> Column:
    """intent, handler, security_passed, ratio and savings of a message, from its 12-byte header alone; null without one.

    Flags: 128 blocked, 64 to be reviewed, 32 code, 16 links."""
    from weft.operators.joins import INTENTS, route_message
    from weft.operators.protocol import CATEGORY_INTENT

    h = decode_header(header)
    flag = lambda n: h["flags"].bitwiseAND(n) > 0
    of_template = F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv])
    category = F.get(F.array(*[F.lit(c) for c in CATEGORY_INTENT]), h["category"])
    intent = F.coalesce(of_template[h["template"]], F.create_map(*[F.lit(x) for kv in CATEGORY_INTENT.items() for x in kv])[category], F.lit("statement"))
    level = F.when(flag(128), 0).when(flag(64), 1).otherwise(2)
    handler = route_message(level, flag(32), intent, flag(16), h["template"], category)
    record = F.struct(intent.alias("intent"), handler.alias("handler"), (~flag(128)).alias("security_passed"), F.round(F.try_divide(h["original"], h["compressed"]), 6).alias("ratio"), F.round(1 - F.try_divide(h["compressed"], h["original"]), 6).alias("savings"))
    return F.when(h.isNotNull(), record)


@query("flt_fast_path_record", f"""WITH h AS (SELECT id, least(original_size * 80, 65535) AS o, compressed_size AS c, CASE WHEN id % 3 <> 0 THEN id % 200 END AS t, id % 12 AS k, {FLAGS} AS f FROM audit),
i(t, intent) AS (VALUES (0, 'limitation'), (1, 'limitation'), (2, 'limitation'), (10, 'fact'), (11, 'fact'), (12, 'fact'), (20, 'definition'), (21, 'definition'), (22, 'definition'), (30, 'code_example'), (31, 'code_example'), (32, 'code_example'), (40, 'instruction'), (41, 'instruction'), (42, 'instruction'), (60, 'comparison'), (61, 'comparison'), (70, 'explanation'), (71, 'explanation'), (80, 'enumeration'), (81, 'enumeration'), (90, 'recommendation'), (91, 'recommendation'), (100, 'clarification'), (101, 'clarification'), (120, 'feature')),
n AS (SELECT h.*, coalesce(intent, ['question', 'confirmation', 'denial', 'instruction', 'recommendation', 'code_example', 'answer', 'explanation'][k + 1], 'statement') AS intent FROM h LEFT JOIN i USING (t))
SELECT id, intent, CASE WHEN f & 128 > 0 THEN 'security_block_handler' WHEN f & 64 > 0 THEN 'human_review_handler' WHEN f & 32 > 0 AND intent = 'question' THEN 'code_interpreter_handler' WHEN f & 16 > 0 THEN 'web_fetch_handler' WHEN t IS NOT NULL THEN 'template_response_handler'
 WHEN k = 0 THEN 'clarification_handler' WHEN k = 3 THEN 'instruction_handler' ELSE 'general_nlp_handler' END AS handler, f & 128 = 0 AS security_passed, round(o / c, 6) AS ratio, round(1 - c / o, 6) AS savings FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    h = encode_header(F.col("id") % 4, F.col("original_size") * 80, F.col("compressed_size"), F.when(F.col("id") % 3 != 0, F.col("id") % 200), F.col("id") % 12, F.col("id") % 5, F.expr(FLAGS))
    return read(spark, d, "audit").select("id", h.alias("header")).select("id", fast_path(F.col("header")).alias("r")).select("id", "r.*")


@query("flt_message_size", "SELECT id, CASE WHEN compressed_size % 3 = 0 THEN compressed_size WHEN original_size % 2 = 0 THEN original_size * 4 ELSE 1000 END AS estimate FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").select("id", F.coalesce(F.when(F.col("compressed_size") % 3 == 0, F.col("compressed_size")), F.when(F.col("original_size") % 2 == 0, F.col("original_size") * 4), F.lit(1000)).alias("estimate"))


@query("flt_analytics", "SELECT id, round(original_size / nullif(compressed_size, 0), 6) AS ratio, round(1 - compressed_size / nullif(original_size, 0), 6) AS savings FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").select("id", F.round(F.try_divide("original_size", "compressed_size"), 6).alias("ratio"), F.round(1 - F.try_divide("compressed_size", "original_size"), 6).alias("savings"))
