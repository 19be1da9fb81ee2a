"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by three rounds of random signs and a fast Hadamard transform, and assigns each to
the nearest signed axis; where a bucket would hold over PER_BUCKET vectors on average, a second turn's nearest
axis, among as many as are needed, is the other half of the key.  A query visits, in each table, the buckets
nearest to it in its own order, and ranks every candidate by its exact cosine in double precision on the
original vectors.

Probing widens until it suffices.  A true neighbour is at least as near as the k-th one found so far, and how
often vectors at that cosine meet within so many probes depends on the turns alone; it is measured once, on
made-up pairs.  A query for which that chance is under RECALL goes to the next level of probes, and from the
last one to every bucket.  So do queries that found fewer than k.  Buckets are cut into chunks of candidates
and blocks of queries by their own counts, so that a hot axis is many cells.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.exchange import checkpoint
from weft.llm.vectors import by_length, lists, matrix, sorted_runs, unit, usable

CHUNK, PER_BUCKET, RECALL = 16_384, 8192, 0.95
FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; their number of columns is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    if x.shape[1] < signs.shape[1]:
        x = np.pad(x, ((0, 0), (0, signs.shape[1] - x.shape[1])))
    for s in signs:
        x = hadamard(x * s)
    return x


def _ends(z: np.ndarray) -> np.ndarray:
    """How far each row reaches along each signed axis: axis a's ends are 2 * a (negative) and 2 * a + 1."""
    return np.stack([-z, z], axis=2).reshape(len(z), -1)


class Tables:
    """The tables for vectors of length d; second is the number of axes of the second half of a key."""

    def __init__(self, d: int, tables: int, second: int, seed: int):
        self.width = 1 << max(1, (d - 1).bit_length())
        self.second, self.count = min(second, self.width), tables
        self.signs = np.random.default_rng([seed, d]).choice([-1.0, 1.0], (tables, 2, 3, self.width))
        self.buckets = 2 * self.width * max(1, 2 * self.second)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """rows x tables x probes: the nearest buckets, nearest first."""
        probes, out = min(probes, self.buckets), []
        for one, two in self.signs:
            a = _ends(turned(x, one))
            if not self.second:
                out.append(np.argsort(-a, axis=1, kind="stable")[:, :probes])
                continue
            b = _ends(turned(x, two)[:, : self.second])
            near_a, near_b = (np.argsort(-e, axis=1, kind="stable")[:, :probes] for e in (a, b))
            loss_a, loss_b = ((e.max(axis=1, keepdims=True) - np.take_along_axis(e, n, axis=1)) ** 2 for e, n in ((a, near_a), (b, near_b)))
            both = (loss_a[:, :, None] + loss_b[:, None, :]).reshape(len(x), -1)
            best = np.argsort(both, axis=1, kind="stable")[:, :probes]
            i, j = best // near_b.shape[1], best % near_b.shape[1]
            out.append(np.take_along_axis(near_a, i, axis=1) * (2 * self.second) + np.take_along_axis(near_b, j, axis=1))
        return np.stack(out, axis=1)

    def levels(self, probes: tuple[int, ...]) -> list[int]:
        """The levels that visit a quarter of the buckets at most, so that probing is worth while."""
        return [p for p in probes if 4 * p <= self.buckets]


@functools.lru_cache(maxsize=16)
def tables_of(d: int, tables: int, second: int, seed: int) -> Tables:
    return Tables(d, tables, second, seed)


COSINES = np.linspace(0, 1, 21)


@functools.lru_cache(maxsize=64)
def meeting(d: int, tables: int, second: int, seed: int, probes: int, pairs: int = 400) -> np.ndarray:
    """The share of pairs at each of COSINES that meet in some table within so many probes."""
    made, rng, out = tables_of(d, tables, second, seed), np.random.default_rng(99), []
    for c in COSINES:
        x, y = rng.standard_normal((2, pairs, max(2, d)))[:, :, :d]
        x = unit(x)
        y = y - (y * x).sum(axis=1, keepdims=True) * x
        y = c * x + np.sqrt(1 - c * c) * unit(y) if d > 1 else x
        out.append((made.nearest(x, probes) == made.nearest(y, 1)).any(axis=(1, 2)).mean())
    return np.maximum.accumulate(out)


def suffices(d: int, kth: float, tables: int, second: int, seed: int, probes: int) -> bool:
    """Whether so many probes find a vector at the cosine kth with a chance of RECALL."""
    if probes not in tables_of(d, tables, second, seed).levels((probes,)):
        return False
    # The chance at the next lower of COSINES, so that none is overrated.
    at = int(np.floor(np.clip(kth, 0, 1) * (len(COSINES) - 1) + 1e-9))
    return kth > 0 and bool(meeting(d, tables, second, seed, probes)[at] >= RECALL)


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of a[i] and b[j], in a fixed order of summation, so that equal vectors have equal scores."""
    out, step = np.empty(len(i)), max(1, (1 << 22) // a.shape[1])
    for lo in range(0, len(i), step):
        p, q = a[i[lo : lo + step]], b[j[lo : lo + step]]
        # Scaled by their largest components first, which changes no cosine but by overflow.
        p, q = p / np.abs(p).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
        out[lo : lo + step] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
    return out


def _few_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows without those of a vector that k + 1 smaller ids have too, in ascending order of ids."""
    _, kind = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).reshape(-1), return_inverse=True)
    order = np.lexsort((ids, kind.reshape(-1)))
    kind, own = kind.reshape(-1)[order], ids[order]
    new = np.r_[True, (kind[1:] != kind[:-1]) | (own[1:] != own[:-1])]
    order, kind = order[new], kind[new]
    first = np.searchsorted(kind, kind)
    order = order[np.arange(len(kind)) - first <= k]
    return order[np.argsort(ids[order], kind="stable")]


def best_of_cell(own: np.ndarray, asked: np.ndarray, ids: np.ndarray, items: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, scores): the k best distinct ids of a cell for each query, ties to the smaller id."""
    few = _few_copies(items, ids, k)
    items, ids = items[few], ids[few]
    u, starts = unit(items), np.flatnonzero(np.r_[True, np.diff(ids) != 0])
    for lo in range(0, len(own), 256):
        near = unit(asked[lo : lo + 256]) @ u.T
        near[own[lo : lo + 256][:, None] == ids[None]] = -np.inf
        # Rows of one id count once, by the best of them.
        best = near if len(starts) == len(ids) else np.maximum.reduceat(near, starts, axis=1)
        cut = np.partition(best, -min(k, len(starts)), axis=1)[:, -min(k, len(starts))]
        i, j = np.nonzero((near >= cut[:, None] - 1e-9) & (near > -np.inf))
        score = _exact(asked, items, lo + i, j)
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        _, at = np.unique(np.stack([i, ids[j]]), axis=1, return_index=True)
        at.sort()
        i, j, score = i[at], j[at], score[at]
        left = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield own[lo + i[left]], ids[j[left]], score[left]


def nearest(vectors: DataFrame, query_every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 4, probes: tuple[int, ...] = (4, 24, 96), seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each id divisible by query_every.

    All candidates are returned if there are fewer than k.  Rows that take no part (see usable()) are neither
    queries nor candidates; vectors of different lengths are no candidates for one another.  Equal scores go
    to the smaller vec_id.  Rows of one id count once, by their best score, as queries and as candidates; a
    query never finds its own id.
    """
    good, n = usable(vectors, id_col, vec_col)
    kind = good.schema["v"].dataType.simpleString()
    second = 0
    if n:
        d = good.agg(F.max(F.size("v"))).first()[0]
        first = 2 << max(1, (d - 1).bit_length())
        if n > PER_BUCKET * first:
            second = 1 << max(0, (int(n / (PER_BUCKET * first)) - 1).bit_length() - 1)

    def places(count: int, skip: int = 0):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in by_length(whole):
                    x = unit(matrix(b["v"]))
                    made = tables_of(x.shape[1], tables, second, seed)
                    wanted = count if count == 1 else max([p for p in made.levels(probes) if p <= count], default=0)
                    at = made.nearest(x, wanted)[:, :, skip:] if wanted > skip else np.zeros((len(x), tables, 0), np.int64)
                    at = ((at * tables + np.arange(tables)[None, :, None]) << 20 | x.shape[1] & 0xFFFFF).reshape(len(x), -1)
                    yield pa.record_batch({"id": b["id"], "v": b["v"], "at": lists(at, pa.int64())})

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_runs(batches, "cell"):
            for t in by_length(cell):
                ids, ask = np.asarray(t["id"]), np.asarray(t["ask"]) == 1
                if ask.any() and not ask.all():
                    x = matrix(t["v"])
                    for q, c, s in best_of_cell(ids[ask], x[ask], ids[~ask], x[~ask], k):
                        yield pa.record_batch({"query_id": pa.array(q), "vec_id": pa.array(c), "score": pa.array(s)})

    def searched(index: DataFrame, asks: DataFrame, rows: int) -> DataFrame:
        """The best of every cell, for (id, v, key) of candidates and of queries."""
        cells = index.select("id", "v", "key", F.lit(0).alias("ask")).unionByName(asks.select("id", "v", "key", F.lit(1).alias("ask")))
        size = cells.groupBy("key").agg(F.sum(1 - F.col("ask")).alias("items"), F.sum("ask").alias("asks")).where(f"items > {CHUNK} OR asks > {CHUNK}")
        size = checkpoint(size.select("key", F.ceil(F.col("items") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("asks") / CHUNK).cast("int").alias("blocks")).where("chunks > 0 AND blocks > 0"))
        cells = cells.join(size, "key", "left").withColumns({"chunks": F.coalesce("chunks", F.lit(1)), "blocks": F.coalesce("blocks", F.lit(1))})
        own = "cast(pmod(xxhash64(id, ask), IF(ask = 0, chunks, blocks)) AS int)"
        cells = cells.withColumns({"own": F.expr(own), "other": F.explode(F.expr("sequence(0, IF(ask = 0, blocks, chunks) - 1)"))})
        cells = cells.select("id", "v", "ask", F.expr("xxhash64(key, IF(ask = 0, own, other), IF(ask = 0, other, own))").alias("cell"))
        return cells.repartition(max(8, -(-rows // 40_000)), "cell").sortWithinPartitions("cell").mapInArrow(search, FOUND)

    def top(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def unsure(level: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in by_length(whole):
                    d = len(b["v"][0]) if b.num_rows else 1
                    kth = np.asarray(b["kth"].fill_null(-2.0))
                    wide = [not suffices(d, s, tables, second, seed, level) for s in kth]
                    yield b.filter(pa.array(wide, pa.bool_())).select(["id", "v"])

        return run

    queries = good.where(F.col("id") % query_every == 0)
    if not n:
        return spark_empty(vectors, "query_id long, rank int, vec_id long, score double")
    index = checkpoint(good.mapInArrow(places(1), f"id long, v {kind}, at array<long>")).select("id", "v", F.explode("at").alias("key"))
    left, found, seen = queries, None, 0
    for level in probes:
        asks = left.mapInArrow(places(level, seen), f"id long, v {kind}, at array<long>").select("id", "v", F.explode("at").alias("key"))
        more = searched(index, asks, n * tables)
        found = checkpoint(top(more if found is None else more.unionByName(found.select("query_id", "vec_id", "score"))))
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        left = checkpoint(left.join(kth, "id", "left").select("id", "v", "kth").mapInArrow(unsure(level), f"id long, v {kind}"))
        seen = level
        if not left.take(1) or not [p for p in tables_of(d, tables, second, seed).levels(probes) if p > level]:
            break
    if left.take(1):
        # Every bucket, by the pieces of the index that hold them.
        everywhere = F.size("v").cast("long").alias("key")
        more = searched(good.select("id", "v", everywhere), left.select("id", "v", everywhere), n * max(1, left.count() // CHUNK))
        found = top(more.unionByName(found.select("query_id", "vec_id", "score")))
    return found.select("query_id", "rank", "vec_id", "score")


def spark_empty(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)
