"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector, turned at random in D >= its own number of dimensions, has the signs of its coordinates as its
code o' (each +-1/sqrt(D)); the inner product f = <o', o> is stored with the code as its correction factor.
For another unit vector q, <o', q> / f estimates <o, q> without bias: what is left is <o', r> / f for q's part r
across o, which the rotation makes as small as sqrt((1 - <o, q>^2) (1 - f^2) / (f^2 (D - 1))) on average.  The
side of q is stored as four bits a coordinate, rounded at random, hence without bias; the highest of the four
is the code.  A pair whose cosine reaches the threshold t has an estimate of at least t - SIGMAS deviations at
t but with negligible probability, so only pairs above that bound are computed exactly, in double precision.

Codes are made and stored once.  Only they (D / 2 + 8 bytes) travel to the cells in which pairs are estimated;
vectors follow for those rows of a cell that have a partner above the bound.  Estimates are products of the
unpacked codes in single precision: with numpy that takes a fifth of the time of counting bits.

Up to EXACT vectors all pairs are estimated.  Beyond, pairs to estimate come from tables keyed by some bits of
such codes.  There are about PER_BUCKET vectors to a bucket at any size, as the number of bits follows the
number of vectors, and the number of tables follows the bits: two vectors at the threshold meet in no table
with a probability of at most MISS at every size, those closer with a smaller one.  Equal vectors are one
class with a weight.  Buckets of over BLOCK vectors are split into blocks, and every pair of blocks is a cell
of its own.  A pair that meets in several tables counts in the first.  No pair below the threshold is linked.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.exchange import checkpoint
from weft.llm.graph import components, join_hot
from weft.llm.vectors import by_length, lists, matrix, sorted_runs, unit, usable

SIGMAS, BLOCK, EXACT, PER_BUCKET, MISS = 6.0, 4096, 65_536, 1024, 1e-6
LEAST_DIMENSIONS = 128


@functools.lru_cache(maxsize=16)
def rotations(d: int, count: int, seed: int = 11) -> np.ndarray:
    """count random orthogonal d x d matrices, side by side."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(count)], axis=1)


@functools.lru_cache(maxsize=16)
def turn_of(d: int, seed: int = 12) -> np.ndarray:
    """d orthonormal rows of D columns: a random rotation of vectors padded with zeros to D dimensions."""
    wide = max(LEAST_DIMENSIONS, -(-d // 8) * 8)
    return np.ascontiguousarray(np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((wide, d)))[0].T)


def tables_for(bits: int, threshold: float) -> int:
    """Number of tables in which two vectors at the threshold meet at least once but with probability MISS."""
    meet = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return 1 if meet >= 1 - MISS else int(np.ceil(np.log(MISS) / np.log1p(-meet)))


def bits_for(n: int) -> int:
    return 0 if n <= EXACT else min(28, round(np.log2(n / PER_BUCKET)))


def table_keys(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    keys, d = np.empty((len(x), tables), np.int64), x.shape[1]
    turn = rotations(d, max(1, -(-tables * bits // d)))
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024]
        b = ((part @ turn)[:, : tables * bits] > 0).reshape(len(part), tables, bits)
        keys[lo : lo + 1024] = b @ (1 << np.arange(bits, dtype=np.int64))
    return keys


def encode(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows of bytes: two four-bit coordinates a byte, then factor and step as floats.  x has unit rows."""
    z = x @ turn_of(x.shape[1])
    step = np.abs(z).max(axis=1) / 7.5
    noise = np.random.default_rng([int(ids[0]) & 0xFFFFFFFF, len(ids)]).random(z.shape) if len(ids) else z
    u = np.clip(np.floor(z / step[:, None] + 7.5 + noise), 0, 15).astype(np.uint8)
    f = (np.where(u > 7, 1.0, -1.0) * z).sum(axis=1) / np.sqrt(z.shape[1])
    return np.c_[u[:, ::2] | u[:, 1::2] << 4, np.c_[f, step].astype(np.float32).view(np.uint8)]


def decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes over their factors, four-bit sides, factors and steps; code is a matrix of bytes."""
    tail = np.ascontiguousarray(code[:, -8:]).view(np.float32)
    packed = code[:, :-8]
    u = np.empty((len(code), 2 * packed.shape[1]), np.float32)
    u[:, ::2], u[:, 1::2] = packed & 15, packed >> 4
    u -= np.float32(7.5)
    f, step = tail[:, 0], tail[:, 1]
    return np.sign(u) / (f[:, None] * np.float32(np.sqrt(u.shape[1]))), u * step[:, None], f, step


def bounds(f: np.ndarray, step: np.ndarray, dimensions: int, threshold: float) -> np.ndarray:
    """The least estimate, per coded vector, of a pair whose cosine reaches the threshold.

    A random rounding is off by half a step at most in the mean square.
    """
    across = max(0.0, 1 - threshold * threshold) * np.maximum(0, 1 - f * f) / (f * f * max(1, dimensions - 1))
    rounding = (step.max() if len(step) else 0.0) ** 2 / (4 * f * f)
    return threshold - SIGMAS * np.sqrt(across + rounding)


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _candidates(code: np.ndarray, key: np.ndarray, mine: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a cell whose estimate reaches the bound, row block by row block."""
    o, q, f, step = decode(code)
    least = bounds(f, step, o.shape[1], threshold)
    one, other = np.flatnonzero(mine == mine.min()), np.flatnonzero(mine != mine.min())
    across = len(other) > 0
    for lo in range(0, len(one), 256):
        r, c = one[lo : lo + 256], other if across else one[lo:]
        i, j = np.nonzero(o[r] @ q[c].T >= least[r][:, None])
        i, j = r[i], c[j]
        ok = (key[i] == key[j]) & (across | (i < j))
        yield i[ok], j[ok]


def _reach(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the products of rows i and j of x reach the threshold, in double precision."""
    ok, piece = np.zeros(len(i), bool), max(1, (1 << 21) // x.shape[1])
    for lo in range(0, len(i), piece):
        ok[lo : lo + piece] = (x[i[lo : lo + piece]] * x[j[lo : lo + piece]]).sum(axis=1) >= threshold
    return ok


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index of each index's component."""
    low = np.arange(n)
    while True:
        old = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == old).all():
            return low


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, bits: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept, per row of vectors; links are cosines >= threshold.

    The bits of a key follow the number of vectors unless they are given.

    Rows that take no part (see usable()) have no links and are kept as their own component; those of null
    id have a null component and are not kept.  Vectors of different lengths link with nothing.  Rows with
    equal ids and equal vectors are counted as links.
    """
    good, n = usable(vectors, id_col, vec_col)
    bits = bits_for(n) if bits is None else bits
    tables = tables_for(bits, threshold)
    classes = good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("m"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_length(whole):
                x = unit(matrix(b["v"]))
                keys = (table_keys(x, tables, bits) * tables + np.arange(tables)) << 20 | x.shape[1] & 0xFFFFF
                code = [r.tobytes() for r in encode(x, np.asarray(b["id"]))]
                yield pa.record_batch({"id": b["id"], "m": b["m"], "v": b["v"], "code": pa.array(code, pa.binary()), "keys": lists(keys, pa.int64())})

    kind = good.schema["v"].dataType.simpleString()
    one = checkpoint(classes.mapInArrow(coded, f"id long, m long, v {kind}, code binary, keys array<long>"))
    large = checkpoint(one.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    rows = one.select("id", "code", F.explode("keys").alias("key")).join(large, "key", "left")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
    cells = rows.select("id", "code", "key", "mine", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, "cell"):
            if t.num_rows > 1:
                some, key, mine = np.zeros(t.num_rows, bool), np.asarray(t["key"]), np.asarray(t["mine"])
                for i, j in _candidates(_bytes(t["code"]), key, mine, threshold):
                    some[i] = some[j] = True
                if some.any():
                    t = t.filter(pa.array(some)).select(["id", "key", "mine", "cell"])
                    yield from t.combine_chunks().to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, "cell"):
            if t.num_rows < 2:
                continue
            ids, m, key, mine = (np.asarray(t[c]) for c in ("id", "m", "key", "mine"))
            x = unit(matrix(t["v"]))
            keys, at, pairs = table_keys(x, tables, bits), int((key[0] >> 20) % tables), []
            for i, j in _candidates(_bytes(t["code"]), key, mine, threshold):
                ok = np.ones(len(i), bool)
                for b in range(at):
                    ok &= keys[i, b] != keys[j, b]
                i, j = i[ok], j[ok]
                ok = _reach(x, i, j, threshold)
                pairs.append((i[ok], j[ok]))
            i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
            if not len(i):
                continue
            count = np.zeros(len(ids), np.int64)
            np.add.at(count, i, m[j])
            np.add.at(count, j, m[i])
            low = _stars(i, j, len(ids))
            some = np.flatnonzero(count)
            yield pa.record_batch({"id": pa.array(ids[some]), "links": pa.array(count[some]), "star": pa.array(ids[low[some]])})

    whole = -(-n // BLOCK) if bits == 0 else 1
    parts = max(8, -(-n * tables // 100_000), whole * (whole + 1) // 8)
    asked = checkpoint(cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(partners, "id long, key long, mine int, cell long"))
    full = asked.join(one.select("id", "m", "v", "code"), "id").repartition(parts, "cell").sortWithinPartitions("cell")
    found = checkpoint(full.mapInArrow(links, "id long, links long, star long"))
    comp = components(found.select(F.col("id").alias("a"), F.col("star").alias("b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = classes.join(linked, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    of = of.select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    back = join_hot(good, of, ["v"], classes.select("v", F.col("m").alias("n")), "id", n).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col(id_col).cast("long").alias("id")).join(back, "id", "left")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
