"""Template discovery: common affixes and structure of clusters, greedy clustering, and the life of templates.

A set's longest common prefix is that of its least and greatest member, and its longest common suffix that of
the reversed ones, so both are plain aggregates with partial results; no cluster is gathered.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import common_prefix, is_harmless
from weft.operators.templates import fill
from weft.operators.windows import numbered
from weft.registry import query, read

# Least literal characters of a pattern, retirement and cold store limits.
LITERALS, LEAST_USES, MOST_DAYS, COLD = 10, 10, 30, 1000


def affixes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n, prefix and suffix that all texts of a group share; they may overlap."""
    back = F.reverse(F.col(text))
    g = df.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(text).alias("_a"), F.max(text).alias("_b"), F.min(back).alias("_c"), F.max(back).alias("_d"))
    return g.select(*keys, "n", common_prefix(F.col("_a"), F.col("_b")).alias("prefix"), F.reverse(common_prefix(F.col("_c"), F.col("_d"))).alias("suffix"))


def pattern_of(prefix: Column, suffix: Column, reference: Column) -> Column:
    """prefix{0}suffix with literal braces doubled; null without LITERALS characters outside the slot.

    Where the affixes fill the reference (the first text of the group), the suffix is left out.
    """
    doubled = lambda x: F.replace(F.replace(x, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    suffix = F.when(F.length(prefix) + F.length(suffix) >= F.length(reference), "").otherwise(suffix)
    head, tail = doubled(prefix), doubled(suffix)
    return F.when(F.length(head) + F.length(tail) >= LITERALS, F.concat(head, F.lit("{0}"), tail))


def common_structure(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """keys, frequency, pattern, ratio (mean text length over pattern length) and some examples of groups of two texts and more."""
    rows = df.where(F.col(text).isNotNull())
    ends = F.array_distinct(F.array(F.min_by(text, order), F.max_by(text, order), F.min(text), F.max(text)))
    of = rows.groupBy(*keys).agg(F.min_by(text, order).alias("_first"), F.avg(F.length(text)).alias("_mean"), ends.alias("examples"))
    p = affixes(rows, keys, text).join(of, keys).where("n > 1").withColumn("pattern", pattern_of(F.col("prefix"), F.col("suffix"), F.col("_first")))
    return p.where("pattern IS NOT NULL").select(*keys, F.col("n").alias("frequency"), "pattern", (F.col("_mean") / F.length("pattern")).alias("ratio"), "examples")


def clusters(df: DataFrame, block: str, order: str, text: str, least: float = 0.6) -> DataFrame:
    """(block, order, seed): greedy clusters, each of the texts whose similarity ratio to its first text reaches least.

    Texts are compared within their block only, one task a block, so blocks must be of bounded size.  A text that
    cannot reach the ratio by its length is not compared.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        left, seeds = list(zip(pdf[order], pdf[text].fillna(""), strict=True)), {}
        while left:
            at, seed = left[0]
            match, rest = difflib.SequenceMatcher(None, seed), []
            for k, t in left:
                match.set_seq2(t)
                if k == at or match.real_quick_ratio() >= least and match.quick_ratio() >= least and match.ratio() >= least:
                    seeds[k] = at
                else:
                    rest.append((k, t))
            left = rest
        return pdf[[block, order]].assign(seed=[seeds[k] for k in pdf[order]])

    cols = df.select(block, order, text)
    return cols.groupBy(block).applyInPandas(run, cols.select(block, order).schema.add("seed", cols.schema[order].dataType))


def retired(store: DataFrame, now: Column) -> DataFrame:
    """store(template_id, usage_count, last_used) with days, tier (hot or cold) and dropped.

    Little used or long unused templates go to the cold store, which keeps the COLD that were used last.
    """
    days = F.coalesce(F.datediff(now, F.col("last_used")), F.lit(0))
    s = store.withColumn("days", days).withColumn("tier", F.when((F.col("usage_count") < LEAST_USES) | (F.col("days") > MOST_DAYS), "cold").otherwise("hot"))
    cold = numbered(s.where("tier = 'cold'"), ["days"], ["template_id"], "place")
    return s.where("tier = 'hot'").withColumn("dropped", F.lit(False)).unionByName(cold.withColumn("dropped", F.col("place") >= COLD).drop("place"))


class Templates:
    """The store of promoted templates under ids first..last, folded on the driver: its size is bounded by the ids.

    Rows are dicts with template_id, pattern, usage_count, days and tier.
    """

    def __init__(self, rows: list[dict], first: int, last: int):
        self.hot = {r["template_id"]: r for r in rows if r["tier"] == "hot"}
        self.cold = {r["template_id"]: r for r in rows if r["tier"] == "cold"}
        self.next, self.last = max([first - 1, *self.hot, *self.cold]) + 1, last

    def retire(self) -> list[int]:
        """Ids that go to the cold store, least used first."""
        gone = sorted((r["usage_count"], r["days"], k) for k, r in self.hot.items() if r["usage_count"] < LEAST_USES or r["days"] > MOST_DAYS)
        for _, _, k in gone:
            self.cold[k] = self.hot.pop(k) | {"tier": "cold"}
            if len(self.cold) > COLD:
                del self.cold[max(self.cold, key=lambda x: (self.cold[x]["days"], -x))]
        return [k for _, _, k in gone]

    def promote(self, pattern: str) -> int:
        """The id under which pattern is stored: the greatest cold one, a new one, or one that must retire now."""
        if any(r["pattern"] == pattern for r in self.hot.values()):
            raise ValueError("pattern is promoted already")
        k = max(self.cold) if self.cold else self.next if self.next <= self.last else next(iter(self.retire()), None)
        if k is None:
            raise RuntimeError("all template ids are taken and none can retire")
        self.cold.pop(k, None)
        self.next = max(self.next, k + 1)
        self.hot[k] = {"template_id": k, "pattern": pattern, "usage_count": 0, "days": 0, "tier": "hot"}
        return k

    def restore(self, k: int) -> bool:
        """A cold template in much use again becomes hot."""
        if k in self.cold and self.cold[k]["usage_count"] > 2 * LEAST_USES:
            self.hot[k] = self.cold.pop(k) | {"tier": "hot"}
            return True
        return False

    def rows(self) -> list[dict]:
        return [r for _, r in sorted((self.hot | self.cold).items())]


STORE = "template_id long, pattern string, usage_count long, days long, tier string"


def discovery_loop(stream: DataFrame, store: str, checkpoint: str, first: int = 128, last: int = 65_535, least: int = 100, every: str = "1 hour"):  # noqa: ANN201
    """A stream writer that promotes the patterns of each batch of (entry_id, kind, text) rows of at least least messages.

    The store is a Parquet folder a batch, store/batch=n, written whole; a batch that is run again reads the one
    before it and overwrites its own, so it counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, []
        if number:
            rows = [r.asDict() for r in spark.read.schema(STORE).parquet(f"{store}/batch={number - 1}").collect()]
        templates = Templates(rows, first, last)
        if batch.count() >= least:
            found = common_structure(batch, ["kind"], "entry_id", "text")
            known = {r["pattern"] for r in templates.hot.values()}
            for r in found.where(is_harmless(F.col("pattern"), F.col("examples"))).orderBy(F.desc("ratio"), F.desc("frequency"), "pattern").limit(last - first + 1).collect():
                if r["pattern"] not in known:
                    templates.promote(r["pattern"])
        spark.createDataFrame(templates.rows(), STORE).coalesce(1).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every)


TEXT = "CASE WHEN p_size % 2 = 0 THEN '{\"brand\": \"' || p_brand || '\", \"kind\": \"' || p_type || '\"}' ELSE p_name || ' of size ' || p_size || ' by ' || p_brand END"
_PREFIX = "left({a}, (SELECT coalesce(max(i), 0) FROM range(1, 80) r(i) WHERE i <= least(length({a}), length({b})) AND left({a}, i) = left({b}, i)))"
_AFFIXES = f"""SELECT *, {_PREFIX.format(a="a", b="b")} AS prefix, reverse({_PREFIX.format(a="c", b="d")}) AS suffix FROM (SELECT p_brand, p_size % 2 AS form, count(*) AS n, min(t) AS a, max(t) AS b, min(reverse(t)) AS c, max(reverse(t)) AS d,
 min_by(t, p_partkey) AS first_t, avg(length(t)) AS mean FROM (SELECT *, {TEXT} AS t FROM part) GROUP BY ALL)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").selectExpr("p_partkey", "p_brand", "p_size % 2 AS form", f"{TEXT} AS t")


@query("fn_common_affixes", f"SELECT p_brand, form, n, prefix, suffix FROM ({_AFFIXES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return affixes(_parts(spark, d), ["p_brand", "form"], "t")


_STRUCTURE = f"""SELECT p_brand, form, n AS frequency, head || '{{0}}' || tail AS pattern, mean / length(head || '{{0}}' || tail) AS ratio FROM (SELECT *, replace(replace(prefix, '{{', '{{{{'), '}}', '}}}}') AS head,
 CASE WHEN length(prefix) + length(suffix) >= length(first_t) THEN '' ELSE replace(replace(suffix, '{{', '{{{{'), '}}', '}}}}') END AS tail FROM ({_AFFIXES}) WHERE n > 1) WHERE length(head) + length(tail) >= 10"""


@query("fn_common_structure", _STRUCTURE.replace("mean / length(head || '{0}' || tail) AS ratio", "round(mean / length(head || '{0}' || tail), 6) AS ratio"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return common_structure(_parts(spark, d), ["p_brand", "form"], "p_partkey", "t").select("p_brand", "form", "frequency", "pattern", F.round("ratio", 6).alias("ratio"))


@query("str_discover_templates", f"SELECT pattern, frequency, row_number() OVER (ORDER BY frequency DESC, pattern) - 1 AS template_id FROM (SELECT pattern, CAST(sum(frequency) AS BIGINT) AS frequency FROM ({_STRUCTURE}) GROUP BY pattern) WHERE frequency >= 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Common structures of clusters by brand and form, frequent and harmless ones, numbered by rank."""
    c = common_structure(_parts(spark, d), ["p_brand", "form"], "p_partkey", "t").where(is_harmless(F.col("pattern"), F.col("examples")))
    c = c.groupBy("pattern").agg(F.sum("frequency").alias("frequency")).where("frequency >= 3").withColumn("rare", -F.col("frequency"))
    return numbered(c, ["rare"], ["pattern"], "template_id").select("pattern", "frequency", "template_id")


@query("flt_match_valid", "SELECT p_partkey, p_size % 3 <> 0 AS valid FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A match is valid if its template, filled with its slots, is the text again."""
    p = read(spark, d, "part").withColumn("t", F.concat(F.lit("Part "), "p_brand", F.when(F.col("p_size") % 3 == 0, "!").otherwise("."))).withColumn("slots", F.array("p_brand"))
    return p.select("p_partkey", (fill(F.lit("Part {0}."), F.col("slots")) == F.col("t")).alias("valid"))


@query("str_retire_templates", """WITH s AS (SELECT l_partkey AS template_id, count(*) AS usage_count, max(CAST(l_shipdate AS DATE)) AS last_used FROM lineitem GROUP BY l_partkey),
t AS (SELECT *, datediff('day', last_used, (SELECT max(last_used) FROM s)) AS days, usage_count < 10 OR datediff('day', last_used, (SELECT max(last_used) FROM s)) > 30 AS cold FROM s)
SELECT template_id, usage_count, days, CASE WHEN cold THEN 'cold' ELSE 'hot' END AS tier, cold AND row_number() OVER (PARTITION BY cold ORDER BY days, template_id) > 1000 AS dropped FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("template_id")).agg(F.count("*").alias("usage_count"), F.max(F.to_date("l_shipdate")).alias("last_used"))
    now = s.agg(F.max("last_used")).first()[0]
    return retired(s, F.lit(now)).select("template_id", "usage_count", "days", "tier", "dropped")
