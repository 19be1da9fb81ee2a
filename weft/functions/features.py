"""Message features, default weights per method and the blended method score."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import looks_structured
from weft.registry import query, read

# Weights of the features per method, in the order of FEATURES, and the ratio expected before any run.
FEATURES = ["length", "entropy", "has_numbers", "has_special_chars", "word_count", "compression_potential", "pattern_score", "fast_path_potential", "metadata_size_estimate", "template_match_score", "pattern_semantic_score", "semantic_chunks", "ai_patterns_found", "semantic_complexity", "binary_semantic_potential", "structured_data_score", "repetitive_pattern_score"]
SCALES = {"length": 1000.0, "word_count": 50.0, "metadata_size_estimate": 500.0, "semantic_chunks": 10.0, "ai_patterns_found": 5.0}
WEIGHTS = {
    "uncompressed": [0.1, 0.0, 0.0, 0.0, 0.0, -0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "binary_semantic": [0.2, -0.3, 0.4, 0.3, 0.1, 0.2, 0.5, 0.6, -0.2, 0.8, 0.2, 0.3, 0.2, -0.2, 0.8, 0.7, 0.4],
    "pattern_semantic": [0.4, -0.4, 0.3, 0.3, 0.2, 0.6, 0.6, 0.3, 0.1, 0.5, 0.9, 0.8, 0.9, -0.3, 0.5, 0.4, 0.6],
    "layered": [0.4, -0.4, 0.1, 0.1, 0.2, 0.5, 0.4, 0.2, -0.1, 0.3, 0.4, 0.5, 0.6, 0.0, 0.3, 0.2, 0.8],
    "runs": [0.3, -0.2, 0.1, 0.1, 0.3, 0.3, 0.2, 0.1, -0.1, 0.2, 0.2, 0.3, 0.2, 0.0, 0.1, 0.1, 0.2],
    "heavy": [0.5, -0.5, 0.2, 0.2, 0.3, 0.6, 0.5, 0.3, -0.2, 0.4, 0.5, 0.6, 0.7, -0.1, 0.4, 0.3, 0.9],
    "fast_path": [-0.3, 0.0, 0.5, 0.4, 0.2, 0.0, 0.6, 0.8, -0.3, 0.7, 0.3, 0.2, 0.2, -0.2, 0.4, 0.6, 0.3],
    "slow_path": [0.2, 0.3, -0.2, -0.1, 0.1, 0.0, -0.3, -0.6, 0.2, -0.4, 0.1, 0.0, -0.1, 0.4, -0.2, -0.3, -0.2],
    "cached": [0.0] * 17,
}
RATIOS = {"uncompressed": 1.0, "binary_semantic": 1.8, "pattern_semantic": 4.0, "layered": 2.5, "runs": 1.3, "heavy": 3.0, "fast_path": 1.0, "slow_path": 1.0, "cached": 1.0}
# Shares of feature match and past performance, and of ratio and speed within the latter.
MATCH, PAST, RATIO, SPEED = 0.6, 0.4, 0.7, 0.3


def default_weights(spark: SparkSession) -> DataFrame:
    """(method, feature, weight), a dimension of fixed size."""
    return spark.createDataFrame([(m, f, w) for m, ws in WEIGHTS.items() for f, w in zip(FEATURES, ws, strict=True)], "method string, feature string, weight double")


def _five_repeats(text: str) -> float:
    """Distinct substrings of 4 to 20 characters that occur apart from themselves, over five, at most 1."""
    found: set[str] = set()
    for n in range(4, min(21, len(text) // 2 + 1)):
        first: dict[str, int] = {}
        for i in range(len(text) - n + 1):
            s = text[i : i + n]
            if i - first.setdefault(s, i) >= n and first[s] <= len(text) - 2 * n:
                found.add(s)
                if len(found) == 5:
                    return 1.0
    return len(found) / 5


def message_features(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, avg_word_length and FEATURES of every text; a null text is an empty one.

    Only the repeats need Python: up to five of them per text, looked for length by length.
    """
    rows = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    n = F.length("_t")
    chars = rows.where(n > 0).select(*keys, n.alias("_n"), F.explode(F.split("_t", "")).alias("_c")).groupBy(*keys, "_n", "_c").agg(F.count("*").alias("_k"))
    p = F.col("_k") / F.col("_n")
    entropy = chars.groupBy(*keys).agg(F.sum(-p * F.log2(p)).alias("entropy"))
    repeats = F.pandas_udf(lambda s: pd.Series([_five_repeats(t) for t in s]), "double")
    words = F.filter(F.split(F.trim(F.regexp_replace("_t", r"(?U)\s+", " ")), " "), lambda w: w != "")
    f = rows.join(entropy, keys, "left").withColumns({"entropy": F.coalesce("entropy", F.lit(0.0)), "_n": n, "_words": words})
    f = f.withColumns({"_numbers": F.col("_t").rlike(r"\p{Nd}"), "_special": F.col("_t").rlike(r"(?U)[^\p{L}\p{N}\s]"), "_w": F.size("_words").cast("long")})
    each = F.aggregate("_words", F.lit(0), lambda a, x: a + F.length(x))
    f = f.withColumn("avg_word_length", F.coalesce(F.try_divide(each, F.col("_w")), F.lit(0.0)))
    both = F.col("_numbers") & F.col("_special")
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    f = f.withColumn("_pattern", add(F.col("_t").contains(" "), 0.3) + add(both, 0.4) + add(F.col("_n") > 100, 0.2) + add(F.col("entropy") < 4.0, 0.3))
    f = f.withColumn("_template", F.col("_pattern") + add(F.col("_w") > 5, 0.2) + add(F.col("avg_word_length") > 6, 0.1))
    long = F.col("_n") > 50
    looks = long & looks_structured(F.col("_t"))
    f = f.withColumns({"_structured": add(both, 0.5) + add(looks, 0.4), "_repeats": F.when(long, repeats("_t")).otherwise(0.0)})
    binary = F.least(F.lit(1.0), add(looks, 0.6) + F.col("_structured") * 0.3 + F.col("_repeats") * 0.4 + F.col("_template") * 0.3)
    out = {
        "length": F.col("_n").cast("double"), "entropy": F.col("entropy"), "has_numbers": F.col("_numbers").cast("double"), "has_special_chars": F.col("_special").cast("double"), "word_count": F.col("_w").cast("double"),
        "compression_potential": clamp(1.0 - F.col("entropy") / 8.0), "pattern_score": F.least(F.lit(1.0), F.col("_pattern")),
        "fast_path_potential": clamp(add(both, 0.4) + add(F.col("_pattern") > 0.5, 0.3) + add(F.col("_n") < 500, 0.2) - add(F.col("entropy") > 6.0, 0.2)),
        "metadata_size_estimate": 100.0 + add(F.col("_numbers"), 50.0) + add(F.col("_special"), 30.0) + F.least(F.expr("_n div 10"), F.lit(200)), "template_match_score": F.least(F.lit(1.0), F.col("_template")),
        "pattern_semantic_score": F.least(F.lit(1.0), F.col("_pattern") * 0.6), "semantic_chunks": F.greatest(F.lit(1), F.expr("_w div 6")).cast("double"), "ai_patterns_found": F.expr("_w div 12").cast("double"), "semantic_complexity": F.lit(0.5),
        "binary_semantic_potential": clamp(binary), "structured_data_score": clamp(F.col("_structured")), "repetitive_pattern_score": F.col("_repeats"),
    }
    return f.select(*keys, *[out[c].alias(c) for c in FEATURES], "avg_word_length")


def method_scores(features: DataFrame, keys: list[str], weights: DataFrame, stats: DataFrame) -> DataFrame:
    """keys, method, feature_match, performance and score, for stats(method, avg_ratio, avg_time) of past runs.

    weights and stats are dimensions with a row per method and feature, so they are shipped.
    """
    scaled = F.explode(F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f) / SCALES.get(f, 1.0))])).alias("feature", "x")
    match = features.select(*keys, scaled).join(F.broadcast(weights), "feature").groupBy(*keys, "method").agg(F.sum(F.col("x") * F.col("weight")).alias("feature_match"))
    past = stats.select("method", (F.col("avg_ratio") * RATIO + SPEED / F.greatest(F.col("avg_time"), F.lit(0.001))).alias("performance"))
    of = match.join(F.broadcast(past), "method", "left").withColumn("performance", F.coalesce("performance", F.lit(0.0)))
    return of.withColumn("score", F.col("feature_match") * MATCH + F.col("performance") * PAST)


@query("fn_message_features")
def _(spark: SparkSession, d: str) -> DataFrame:
    return message_features(read(spark, d, "msgs"), ["conv_id", "turn"], "text")


@query("fn_default_scores")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The best method of every message under the default weights and the methods' mean ratio and time so far."""
    stats = spark.createDataFrame([("layered", RATIOS["layered"], 2.0), ("runs", RATIOS["runs"], 0.4), ("uncompressed", 1.0, 0.2)], "method string, avg_ratio double, avg_time double")
    scores = method_scores(message_features(read(spark, d, "msgs"), ["conv_id", "turn"], "text"), ["conv_id", "turn"], default_weights(spark), stats)
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "method"))
    return scores.withColumn("rank", rank).where("rank = 1").select("conv_id", "turn", "method", F.round("score", 6).alias("score"))
