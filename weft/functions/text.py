"""Scalar text functions: screening, categories, structure tests, call parsing, hashes and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, read

# Word lists of the screens and categories.
HARMFUL = ["password", "secret", "api_key", "token", "credentials", "hack", "exploit", "vulnerability", "inject", "bypass", "illegal", "weapon", "drug", "harm", "attack"]
BLOCKED = ["hack", "exploit", "malware", "virus"]
REVIEW = ["password", "credit card", "ssn", "private key"]
ASKING = ["what", "how", "why", "when", "where"]
STEPS = ["first", "then", "next", "finally", "step"]
DEFINING = ["is", "are", "means", "refers to"]
FUNCTIONS = {"execute_task": (1, "task_executor"), "query_database": (2, "database_service"), "call_api": (3, "api_gateway"), "process_data": (4, "data_processor"), "generate_response": (5, "response_generator"), "validate_input": (6, "validator"), "transform_data": (7, "transformer"), "send_notification": (8, "notification_service"), "schedule_job": (9, "scheduler"), "get_status": (10, "status_service")}


def has_any(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def is_harmless(pattern: Column, examples: Column) -> Column:
    """No harmful word in the pattern nor in an example."""
    return ~has_any(pattern, HARMFUL) & ~F.exists(examples, lambda e: has_any(e, HARMFUL))


def security_level(text: Column) -> Column:
    """2 blocked, 1 review, 0 safe."""
    return F.when(has_any(text, BLOCKED), 2).when(has_any(text, REVIEW), 1).otherwise(0)


def category(text: Column, template: Column) -> Column:
    """First rule that holds: template, code, question, instruction, definition, general."""
    return (
        F.when(template.isNotNull(), "discovered").when(text.rlike("```|def |class "), "code_example").when(text.contains("?") & has_any(text, ASKING), "clarification")
        .when(has_any(text, STEPS), "instruction").when(has_any(text, DEFINING), "definition").otherwise("general")
    )


def share_of(text: Column, marks: list[str]) -> Column:
    return sum((text.contains(m).cast("int") for m in marks), F.lit(0)) / len(marks)


def looks_structured(text: Column) -> Column:
    """Weighted signs of JSON, XML, key-value lines and CSV, above 0.3."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 5), lambda x: F.trim(x) != "")
    commas = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    csv = text.contains(",") & text.contains("\n") & (F.size(F.array_distinct(commas)) == 1) & (F.element_at(commas, 1) > 0)
    kv = 0.5 * text.rlike(r"\w+\s*=\s*\w+").cast("int") + 0.5 * text.rlike(r"\w+\s*:\s*\w+").cast("int")
    score = share_of(text, ["{", "}", "[", "]", '"', ":", ","]) * 0.4 + share_of(text, ["<", ">", "/", "=", '"']) * 0.3 + kv * 0.2 + F.when(csv, 0.08).otherwise(0.0)
    return (F.length(text) >= 10) & (score > 0.3)


def rolling_hash3(column: str) -> Column:
    """32-bit FNV-1a of every three consecutive bytes."""
    b = F.transform(F.regexp_extract_all(F.hex(F.encode(F.col(column), "utf-8")), F.lit("(..)")), lambda x: F.conv(x, 16, 10).cast("bigint"))
    step = lambda h, v: ((h.bitwiseXOR(v)) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(F.size(b) >= 3, F.transform(F.sequence(F.lit(1), F.size(b) - 2), lambda i: step(step(step(F.lit(2166136261).cast("bigint"), F.element_at(b, i)), F.element_at(b, i + 1)), F.element_at(b, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def parse_call(text: Column) -> Column:
    """(function, id, hint, args) of a call in a text, or null.

    The first form that fits counts: a JSON object with a function, such an object inside the text, name(key=value)
    with a known name, or a known name in words.  Names unknown to the table have null id and hint.
    """
    ids = F.create_map(*[x for k, (i, h) in FUNCTIONS.items() for x in (F.lit(k), F.struct(F.lit(i).alias("id"), F.lit(h).alias("hint")))])
    strings = "map<string,string>"

    def from_json(body: Column) -> tuple[Column, Column]:
        args = F.coalesce(F.get_json_object(body, "$.args"), F.get_json_object(body, "$.arguments"))
        return F.get_json_object(body, "$.function"), F.from_json(args, strings)

    whole, inner = F.trim(text), F.regexp_extract(text, r'(?s)(\{.*"function".*\})', 1)
    name, body = F.regexp_extract(text, r"(\w+)\s*\((.*?)\)", 1), F.regexp_extract(text, r"(\w+)\s*\((.*?)\)", 2)
    pairs = F.filter(F.split(body, ","), lambda x: x.contains("="))
    key, value = lambda x: F.trim(F.substring_index(x, "=", 1)), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "^[^=]*=", "")), "^[\"']+|[\"']+$", "")
    said = F.coalesce(*[F.when(F.lower(text).contains(k.replace("_", " ")), k) for k in FUNCTIONS])
    forms = [from_json(F.when(F.try_parse_json(whole).isNotNull(), whole)), from_json(F.when(F.try_parse_json(whole).isNull() & F.try_parse_json(inner).isNotNull(), inner))]
    forms += [(F.when(name.isin(*FUNCTIONS), name), F.map_from_entries(F.transform(pairs, lambda x: F.struct(key(x), value(x))))), (said, parameters(text))]
    call = lambda n, a: F.when(n.isNotNull() & (n != ""), F.struct(n.alias("function"), ids[n]["id"].alias("id"), ids[n]["hint"].alias("hint"), F.coalesce(a, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("args")))
    return F.coalesce(*[call(n, a) for n, a in forms])


def parameters(text: Column) -> Column:
    """Quoted strings as param_0.. and key: value pairs; of equal keys the last counts."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]*)"'))
    keys, values = (F.regexp_extract_all(text, F.lit(r"(\w+):\s*([^,;.\n]+)"), k) for k in (1, 2))
    named = F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.trim(F.element_at(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda z: z["k"] == k), -1)["v"]).alias("value"))))
    return F.map_concat(F.map_from_entries(F.transform(quoted, lambda q, i: F.struct(F.concat(F.lit("param_"), i.cast("string")).alias("key"), q.alias("value")))), named)


TEXTS = """(SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN text WHEN 1 THEN 'What is the password? ' || text WHEN 2 THEN '{"a": 1, "b": [2], "c": "' || role || '"}' WHEN 3 THEN 'Call get_status(id=5) then exploit' WHEN 4 THEN 'def f(): class A' WHEN 5 THEN 'a,b,c' || chr(10) || '1,2,3' ELSE 'Set mode: fast, name: "x y", mode: slow.' END AS t FROM msgs)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "msgs").selectExpr("conv_id", "turn", """CASE turn % 8 WHEN 0 THEN text WHEN 1 THEN 'What is the password? ' || text WHEN 2 THEN '{"a": 1, "b": [2], "c": "' || role || '"}' WHEN 3 THEN 'Call get_status(id=5) then exploit' WHEN 4 THEN 'def f(): class A' WHEN 5 THEN 'a,b,c' || chr(10) || '1,2,3' ELSE 'Set mode: fast, name: "x y", mode: slow.' END AS t""")


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(t), '{w}')" for w in words) + ")"


@query("flt_safety_screen", f"SELECT conv_id, turn, NOT {_any(HARMFUL)} AS safe FROM {TEXTS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("conv_id", "turn", is_harmless(F.col("t"), F.array("t")).alias("safe"))


@query("flt_security_level", f"SELECT conv_id, turn, CASE WHEN {_any(BLOCKED)} THEN 2 WHEN {_any(REVIEW)} THEN 1 ELSE 0 END AS level, NOT {_any(BLOCKED)} AS passes FROM {TEXTS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    level = security_level(F.col("t"))
    return _texts(spark, d).select("conv_id", "turn", level.alias("level"), (level != 2).alias("passes"))


@query("flt_category", f"SELECT conv_id, turn, CASE WHEN turn % 11 = 9 THEN 'discovered' WHEN contains(t, '```') OR contains(t, 'def ') OR contains(t, 'class ') THEN 'code_example' WHEN contains(t, '?') AND {_any(ASKING)} THEN 'clarification' WHEN {_any(STEPS)} THEN 'instruction' WHEN {_any(DEFINING)} THEN 'definition' ELSE 'general' END AS category FROM {TEXTS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("conv_id", "turn", category(F.col("t"), F.when(F.col("turn") % 11 == 9, 1)).alias("category"))


@query("flt_structured", f"""SELECT conv_id, turn, length(t) >= 10 AND
 (len(list_filter(['{{', '}}', '[', ']', '"', ':', ','], lambda c: contains(t, c))) / 7.0::DOUBLE) * 0.4 + (len(list_filter(['<', '>', '/', '=', '"'], lambda c: contains(t, c))) / 5.0::DOUBLE) * 0.3
 + (CASE WHEN regexp_matches(t, '\\w+\\s*=\\s*\\w+') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(t, '\\w+\\s*:\\s*\\w+') THEN 0.5 ELSE 0 END) * 0.2 + CASE WHEN contains(t, ',') AND contains(t, chr(10)) AND len(list_distinct(commas)) = 1 AND commas[1] > 0 THEN 0.08 ELSE 0 END > 0.3 AS structured
 FROM (SELECT *, list_transform(list_filter(string_split(t, chr(10))[1:5], lambda x: trim(x) <> ''), lambda x: length(x) - length(replace(x, ',', ''))) AS commas FROM {TEXTS})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("conv_id", "turn", looks_structured(F.col("t")).alias("structured"))


CALLS = """(SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN '{"function": "query_database", "args": {"table": "' || role || '"}}' WHEN 1 THEN 'Please run {"function": "unheard_of", "arguments": {"n": "' || turn || '"}} now' WHEN 2 THEN 'Call get_status(id=' || turn || ', mode="' || role || '") soon'
 WHEN 3 THEN 'Could you Schedule Job "' || role || '" for me' WHEN 4 THEN 'print(x=1) and more' WHEN 5 THEN '{"other": 1}' WHEN 6 THEN text ELSE 'validate_input (a=1) then get_status(b=2)' END AS t FROM msgs)"""


@query("fn_parse_call", f"""SELECT conv_id, turn, name AS function, list_position(['execute_task', 'query_database', 'call_api', 'process_data', 'generate_response', 'validate_input', 'transform_data', 'send_notification', 'schedule_job', 'get_status'], name) AS id, arg FROM (
 SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'query_database' WHEN 1 THEN 'unheard_of' WHEN 2 THEN 'get_status' WHEN 3 THEN 'schedule_job' WHEN 7 THEN 'validate_input' END AS name,
 CASE turn % 8 WHEN 0 THEN regexp_extract(t, '"table": "([^"]*)"', 1) WHEN 1 THEN CAST(turn AS VARCHAR) WHEN 2 THEN regexp_extract(t, 'mode="([^"]*)"', 1) WHEN 3 THEN regexp_extract(t, '"([^"]*)"', 1) ELSE '1' END AS arg FROM {CALLS}) WHERE name IS NOT NULL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "msgs").selectExpr("conv_id", "turn", CALLS[len("(SELECT conv_id, turn, ") : -len(" FROM msgs)")])
    c = t.select("conv_id", "turn", parse_call(F.col("t")).alias("c")).where("c IS NOT NULL").select("conv_id", "turn", "c.*")
    first = F.coalesce(*[F.try_element_at("args", F.lit(k)) for k in ("table", "n", "mode", "param_0", "a")])
    return c.select("conv_id", "turn", "function", "id", first.alias("arg"))


@query("fn_parameters", rf"""SELECT conv_id, turn, trim(list_filter(named, lambda z: z[1] = 'mode')[-1][2]) AS mode, trim(list_filter(named, lambda z: z[1] = 'name')[-1][2]) AS name, quoted[1] AS param_0
 FROM (SELECT conv_id, turn, regexp_extract_all(t, '"([^"]*)"', 1) AS quoted, list_zip(regexp_extract_all(t, '(\w+):\s*([^,;.\n]+)', 1), regexp_extract_all(t, '(\w+):\s*([^,;.\n]+)', 2)) AS named FROM {TEXTS})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = _texts(spark, d).select("conv_id", "turn", parameters(F.col("t")).alias("p"))
    return p.select("conv_id", "turn", *[F.col("p")[k].alias(k) for k in ("mode", "name", "param_0")])


@query("fn_sha256", "SELECT item_id, sha256(text) AS digest, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS valid FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("digest")).withColumn("valid", F.col("digest").rlike("^[0-9a-f]{64}$"))


@query("fn_semantic_preview", "SELECT conv_id, turn, array_to_string(list_slice(regexp_extract_all(text, '\\S+'), 1, 5), ' ') AS preview, length(text) AS n FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "msgs").select("conv_id", "turn", F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"(\S+)")), 1, 5), " ").alias("preview"), F.length("text").alias("n"))


@query("fn_chunk_size", "SELECT s, CASE right(s, 1) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 ELSE 1 END * CAST(regexp_extract(s, '[0-9]+') AS BIGINT) AS bytes FROM (SELECT p_size || substr('KMGB', CAST(p_size % 4 + 1 AS INTEGER), 1) AS s FROM part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.col("p_size").cast("string"), F.expr("substring('KMGB', p_size % 4 + 1, 1)"))
    unit = F.element_at(F.create_map(*[F.lit(x) for x in ("K", 1 << 10, "M", 1 << 20, "G", 1 << 30)]), F.right("s", F.lit(1)))
    return read(spark, d, "part").select(s.alias("s")).select("s", (F.coalesce(unit, F.lit(1)).cast("bigint") * F.regexp_extract("s", "[0-9]+", 0).cast("bigint")).alias("bytes"))


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of a set of strings, from its least and greatest."""
    n = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(low), F.length(high)))), lambda i: F.left(low, i) == F.left(high, i)), lambda x: x))
    return F.left(low, n)


@query("fn_longest_prefix", "SELECT p_brand, left(a, (SELECT coalesce(max(i), 0) FROM range(1, 60) r(i) WHERE i <= least(length(a), length(b)) AND left(a, i) = left(b, i))) AS prefix FROM (SELECT p_brand, min('P ' || p_type) AS a, max('P ' || p_type) AS b FROM part GROUP BY p_brand)")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("t", F.concat(F.lit("P "), "p_type"))
    return p.groupBy("p_brand").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("p_brand", common_prefix(F.col("a"), F.col("b")).alias("prefix"))


@query("fn_days_unused", "SELECT id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days FROM audit")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "audit").select("id", F.expr("CAST(floor((unix_micros(cast(ts AS timestamp)) - unix_micros(TIMESTAMP '2024-01-01')) / 86400000000) AS BIGINT)").alias("days"))


@query("fn_split_over_workers", "SELECT p_partkey, p_size // 7 + CASE WHEN p_partkey % 7 < p_size % 7 THEN 1 ELSE 0 END AS share FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.expr("p_size div 7 + CASE WHEN p_partkey % 7 < p_size % 7 THEN 1 ELSE 0 END").alias("share"))


TOKENS = ["ok", "yes", "no", "error", "warn", "info", "true", "false", "null", "pass", "fail", "ready", "status", "success", "failed"]


def incompressible(text: Column) -> Column:
    """Texts that will likely not shrink: short ones without repeats or known tokens, longer ones of high entropy.

    The entropy is that of the characters, over 1000 characters or samples from the start, middle and end.
    """
    n, lower = F.length(text), F.lower(text)
    size = F.length(lower)
    token = F.regexp_replace(lower, r"^[ .,;:\-_]+|[ .,;:\-_]+$", "").isin(TOKENS)
    sample = F.when(n <= 1000, text).otherwise(F.concat(F.left(text, F.lit(333)), F.substring(text, F.floor(n / 2).cast("int") - 165, F.lit(332)), F.right(text, F.lit(333))))
    chars = F.filter(F.split(sample, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))
    total = F.size(chars)
    entropy = F.round(F.aggregate(F.transform(counts, lambda k: -k / total * F.log2(k / total)), F.lit(0.0), lambda a, x: a + x), 9)
    same = F.size(counts) == 1
    units = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(size / 2).cast("int")))
    repeats = (size > 1) & F.exists(units, lambda u: (size % u == 0) & (F.replace(lower, F.left(lower, u), F.lit("")) == ""))
    return (
        F.when(text.isNull() | (n == 0), True).when(n <= 3, ~(((n > 1) & same) | token))
        .when(n < 10, ~((F.array_max(counts) / n >= 0.7) | repeats | token | (entropy <= 2.5))).otherwise(entropy > 7.0)
    )


@query("flt_incompressible_messages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "msgs").select("conv_id", "turn", incompressible(F.col("text")).alias("incompressible"))


@query("flt_incompressible", "SELECT n_regionkey, n_name, length(n_name) <= 3 AS incompressible FROM nation WHERE length(n_name) <= 3 OR length(n_name) > 9")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").where("length(n_name) <= 3 OR length(n_name) > 9")
    return n.select("n_regionkey", "n_name", incompressible(F.col("n_name")).alias("incompressible"))
