"""Key statistics by packed exchange.

Texts are dealt into groups by a hash of their id.  Each group sends its distinct 64-bit keys, packed as
byte planes, to the bucket that owns the key; the bucket works out one value per key and answers only the
groups that sent it.  A key sends one entry per group and batch however many texts hold it, so hot keys
are combined before the exchange.  Buckets and groups are counted from the bytes of the corpus, so either
holds about PART_BYTES of text (or what becomes of it) at any size.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.words import U

PART_BYTES = 8 << 20
ENTRY = "bucket int, grp int, n int, h binary, v binary, w binary"


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable copy of df in the shared checkpoint folder.

    The folder is the one that the session names in spark.checkpoint.dir.  Where it names none, a local master
    gets a folder of its own; a cluster is an error, as executors share no local folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weft-checkpoints-"))
    return df.checkpoint(eager=True)


def parts_of(df: DataFrame, column: str, part_bytes: int = PART_BYTES) -> int:
    """Number of groups for the texts of df: one per part_bytes."""
    total = df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
    return max(1, -(-int(total) // part_bytes))


def grouped(docs: DataFrame, id_col: str, text_col: str, parts: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, text and group (and a struct of the carried columns), dealt by group.  Every use of the same frame shares one exchange.

    Groups follow id and text, so that many rows of one id, or of none, are spread by their texts.
    """
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rest = [F.struct(*carry).alias("rest")] if carry else []
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.pmod(key, F.lit(parts)).cast("int").alias("grp"), *rest
    ).repartition(parts, "grp")


def pack(a: np.ndarray) -> bytes:
    """Eight-byte integers by byte planes: equal high bytes lie together and compress away."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(b: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def entries(grp: int, h: np.ndarray, v: np.ndarray, w: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ENTRY for keys h with values v and w."""
    at = (h >> U(20)) % U(buckets)
    order = np.lexsort((h, at))
    at, h, v, w = at[order], h[order], v[order], w[order]
    cut = np.flatnonzero(np.diff(at)) + 1
    lo, hi = np.r_[0, cut], np.r_[cut, len(at)]
    if not len(at):
        return
    yield pa.record_batch(
        {
            "bucket": pa.array(at[lo].astype(np.int32)), "grp": pa.array(np.full(len(lo), grp, np.int32)), "n": pa.array((hi - lo).astype(np.int32)),
            "h": pa.array([pack(h[a:b]) for a, b in zip(lo, hi, strict=True)], pa.binary()), "v": pa.array([pack(v[a:b]) for a, b in zip(lo, hi, strict=True)], pa.binary()),
            "w": pa.array([pack(w[a:b]) for a, b in zip(lo, hi, strict=True)], pa.binary()),
        }
    )


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    """Bucket b to partition b."""
    return df.repartitionById(buckets, F.col("bucket"))


def answers(sent: DataFrame, buckets: int, solve: Callable) -> DataFrame:
    """solve(h, v, w) -> (keep, v, w), each as long as h; kept entries go back to the groups that sent them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(g, unpack(h, U), unpack(v), unpack(w)) for b in batches for g, h, v, w in zip(b["grp"].to_pylist(), b["h"].to_pylist(), b["v"].to_pylist(), b["w"].to_pylist(), strict=True)]
        if not got:
            return
        g = np.repeat([x[0] for x in got], [len(x[1]) for x in got])
        h, v, w = (np.concatenate([x[i] for x in got]) for i in (1, 2, 3))
        del got
        keep, v, w = solve(h, v, w)
        g, h, v, w = g[keep], h[keep], v[keep], w[keep]
        order = np.lexsort((h, g))
        g, h, v, w = g[order], h[order], v[order], w[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])] if len(g) else np.zeros(0, bool)
        g, h, v, w = g[new], h[new], v[new], w[new]
        cut = np.flatnonzero(np.diff(g)) + 1
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(g)], strict=True):
            if b > a:
                yield pa.record_batch({"bucket": pa.array([0], pa.int32()), "grp": pa.array([g[a]], pa.int32()), "n": pa.array([b - a], pa.int32()), "h": pa.array([pack(h[a:b])], pa.binary()), "v": pa.array([pack(v[a:b])], pa.binary()), "w": pa.array([pack(w[a:b])], pa.binary())})

    return dealt(sent, buckets).mapInArrow(run, ENTRY)


def table(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted keys that a group got back, with their values."""
    if not rows.num_rows:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.concatenate([unpack(x, U) for x in rows["h"].to_pylist()])
    v = np.concatenate([unpack(x) for x in rows["v"].to_pylist()])
    w = np.concatenate([unpack(x) for x in rows["w"].to_pylist()])
    order = np.argsort(h, kind="stable")
    return h[order], v[order], w[order]


def look_up(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether and where each of h lies in the sorted keys."""
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, at


