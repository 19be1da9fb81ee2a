"""Packing into optimal length buckets.

Dynamic programming over the global histogram of lengths picks the buckets' upper lengths that leave the
least padding; token-budget batches form inside each bucket.  Every length is a class of its own, so the
optimum is that of the corpus.  The driver gets one row per distinct length: a corpus of T tokens has fewer
than sqrt(2 T) of them, and as many as its longest document has tokens at most.  Lengths are words unless a
length column is given.

Defined cases: null and empty texts have length 0 and go to the first bucket; a text longer than the budget
is a batch of its own; rows of one id are neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.exchange import checkpoint
from weft.llm.mixing import word_count

SLOTS = 50_000


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most buckets buckets with the least total padding, for ascending lengths.

    The padded total of lengths i + 1 .. j in one bucket is lengths[j] * (C[j] - C[i]), so the best start for
    each j is the lowest of lines in lengths[j]; their slopes -C[i] fall and the queries rise, hence a
    pointer over the lower hull answers each in constant time on average.
    """
    n = len(lengths)
    if not n:
        return []
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    best = [0] + [None] * n
    starts: list[list[int]] = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, offset, start
        at, after, chosen = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, offset = -total[j - 1], best[j - 1]
                while len(hull) - at >= 2 and (offset - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, offset, j - 1))
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if at < len(hull):
                after[j], chosen[j] = hull[at][0] * x + hull[at][1] + x * total[j], hull[at][2]
        starts.append(chosen)
        best = [None, *after[1:]]
    out, j = [], n
    for chosen in reversed(starts):
        out.append(lengths[j - 1])
        j = chosen[j]
        if j == 0:
            break
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 32_768, buckets: int = 16, length_col: str | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch_id and slot, per row of docs."""
    length = F.coalesce(F.col(length_col).cast("long"), F.lit(0)) if length_col else word_count(text_col)
    rows = checkpoint(docs.select(F.col(id_col).alias("doc_id"), length.alias("n_tokens")))
    hist = rows.groupBy("n_tokens").count().orderBy("n_tokens").toArrow()
    lengths, counts = hist["n_tokens"].to_pylist(), hist["count"].to_pylist()
    bounds = optimal_bounds(lengths, counts, buckets) or [0]
    salts = max(1, -(-sum(counts) // SLOTS))
    upper = F.array(*[F.lit(int(b)) for b in bounds])
    rows = rows.withColumn("bucket", F.size(F.filter(upper, lambda b: b < F.col("n_tokens")))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("bucket", "salt").count()
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offset = counts.select("bucket", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", "n_tokens")) - 1
    rows = rows.withColumn("own", own).join(offset, ["bucket", "salt"]).withColumn("at", F.col("own") + F.col("offset"))
    rows = rows.withColumn("padded_length", F.element_at(upper.cast("array<long>"), F.col("bucket") + 1))
    room = F.greatest(F.lit(1), F.expr(f"{budget} div greatest(padded_length, 1)"))
    return rows.withColumn("room", room).select("doc_id", "n_tokens", "bucket", "padded_length", F.expr("bucket * 1099511627776L + (at div room)").alias("batch_id"), F.expr("cast(at % room AS int)").alias("slot"))
