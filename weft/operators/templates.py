"""Templates: patterns with {n} slots, full and substring matches, slots, discovery and retirement."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, read


def slot_regex(pattern: str) -> str:
    """Regular expression of a pattern: literals as they are, slots lazily, case ignored."""
    parts = []
    for text, slot, _, _ in string.Formatter().parse(pattern):
        parts.append(re.sub(r"([^\w\s])", r"\\\1", text))
        if slot is not None and slot.isdigit():
            parts.append("(.+?)")
    return "(?i)" + "".join(parts)


def match_templates(df: DataFrame, text: str, templates: list[tuple[int, str]]) -> DataFrame:
    """template_id and slots of the tightest full match (fewest slot characters, then fewest slots)."""
    options = []
    for tid, pattern in templates:
        rx, n = r"\A" + slot_regex(pattern) + r"\z", len(re.findall(r"\{\d+\}", pattern))
        slots = F.array(*[F.regexp_extract(text, rx, k + 1) for k in range(n)]) if n else F.array().cast("array<string>")
        chars = sum((F.length(F.regexp_extract(text, rx, k + 1)) for k in range(n)), F.lit(0))
        options.append(F.when(F.col(text).rlike(rx), F.struct(chars.alias("chars"), F.lit(n).alias("n"), F.lit(tid).alias("template_id"), slots.alias("slots"))))
    return df.withColumn("match", F.array_min(F.array_compact(F.array(*options))))


def fill(pattern: Column, slots: Column) -> Column:
    """The pattern with its slots filled in; braces within slots stay."""
    mark = lambda i: F.concat(F.lit("{"), i.cast("string"), F.lit("}"))
    return F.aggregate(F.transform(slots, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), pattern, lambda acc, x: F.replace(acc, mark(x["i"]), x["s"]))


def spans(df: DataFrame, keys: list[str], text: str, literals: list[tuple[int, str]]) -> DataFrame:
    """Occurrences of templates inside texts, at word boundaries: longest first, none overlapping."""
    compiled = [(t, re.compile(slot_regex(p)[4:], re.IGNORECASE)) for t, p in literals]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                t, found = getattr(r, text) or "", []
                for tid, rx in compiled:
                    for m in rx.finditer(t):
                        if (m.start() == 0 or not t[m.start() - 1].isalnum()) and (m.end() == len(t) or not t[m.end()].isalnum()):
                            found.append((m.start() - m.end(), m.start(), m.end(), tid))
                taken: list[tuple[int, int]] = []
                for _, lo, hi, tid in sorted(found):
                    if all(hi <= a or lo >= z for a, z in taken):
                        taken.append((lo, hi))
                        rows.append([getattr(r, k) for k in keys] + [tid, lo, hi])
            yield pd.DataFrame(rows, columns=[*keys, "template_id", "start_at", "end_at"])

    cols = df.select(*keys, text)
    return cols.mapInPandas(run, cols.select(*keys).schema.add("template_id", "long").add("start_at", "long").add("end_at", "long"))


def longest_span(df: DataFrame, keys: list[str], text: str, templates: list[tuple[int, str]]) -> DataFrame:
    """keys, template_id, start_at and end_at of the longest partial match; slots reach as far as they can."""
    found = []
    for tid, pattern in templates:
        rx = slot_regex(pattern).replace("(.+?)", "(?:.+)")
        part = F.regexp_extract(text, "(" + rx + ")", 1)
        start = F.instr(F.col(text), part) - 1
        found.append(F.when(F.col(text).rlike(rx), F.struct(F.length(part).alias("n"), (-start).alias("before"), F.lit(-tid).alias("order"))))
    best = df.select(*keys, F.array_max(F.array_compact(F.array(*found))).alias("m")).where("m IS NOT NULL")
    return best.select(*keys, (-F.col("m.order")).cast("long").alias("template_id"), (-F.col("m.before")).cast("long").alias("start_at"), (F.col("m.n") - F.col("m.before")).cast("long").alias("end_at"))


PATTERNS = [(1, "{0}ANODIZED {1}"), (2, "{0} PLATED {1}"), (3, "STANDARD {0}"), (4, "{0} {1}")]


@query("join_template_match", "SELECT p_partkey, min_by(id, (chars, n, id)) AS template_id FROM (SELECT p_partkey, 3 AS id, 1 AS n, length(t) - 8 AS chars FROM p WHERE t LIKE 'PART %' AND length(t) > 5 UNION ALL SELECT p_partkey, 4, 2, length(t) - 1 FROM p WHERE t LIKE '%_ _%') GROUP BY p_partkey".replace("FROM p ", "FROM (SELECT p_partkey, 'PART NO ' || p_size AS t FROM part) p ").replace("'PART %'", "'PART NO %'").replace("> 5", "> 8"))
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("PART NO "), F.col("p_size").cast("string")).alias("t"))
    return match_templates(p, "t", [(3, "PART NO {0}"), (4, "{0} {1}")]).select("p_partkey", F.col("match.template_id").alias("template_id"))


@query("fn_fill_template", "SELECT p_partkey, 'Part ' || p_brand || ' of size ' || p_size || '.' AS text FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", fill(F.lit("Part {0} of size {1}."), F.array(F.col("p_brand"), F.col("p_size").cast("string"))).alias("text"))


@query("fn_extract_slots", "SELECT p_partkey, p_brand AS a, CAST(p_size AS VARCHAR) AS b FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Part "), "p_brand", F.lit(" of size "), F.col("p_size").cast("string"), F.lit("."))
    m = match_templates(read(spark, d, "part").select("p_partkey", t.alias("t")), "t", [(7, "Part {0} of size {1}.")])
    return m.select("p_partkey", F.element_at("match.slots", 1).alias("a"), F.element_at("match.slots", 2).alias("b"))


@query("join_substring_spans", "SELECT p_partkey, CAST(9 AS BIGINT) AS template_id, CAST(4 AS BIGINT) AS start_at, CAST(4 + length(p_brand) AS BIGINT) AS end_at FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("the "), "p_brand", F.lit(" part")).alias("t"))
    return spans(p, ["p_partkey"], "t", [(9, "Brand#11"), (9, "Brand#12")])
