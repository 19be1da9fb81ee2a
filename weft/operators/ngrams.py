"""Frequent character n-grams of whole texts, counted exactly.

A place is sent to a bucket by the minimizer of the gram of the level's least length that starts there: the
word of the gram with the least hash, the leftmost of equals.  So all occurrences of a gram meet in one bucket,
and places next to each other mostly go there together, as one segment of text.  Within one segment the places
have their minimizer at different offsets, so no gram occurs twice among them.  At the longer levels, buckets
first count minimizers and name those to each chunk of texts that may be in frequent grams; only segments of
these are sent.  Hashes choose buckets and leave out what cannot be frequent; grams are told apart by their
characters.  Chunks and buckets are counted from the characters of all texts, and equal segments of a chunk are
sent once, with their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From least length to least length, and the minimizers' lengths: shorter ones make longer segments, but all places of one go to one bucket.
LEVELS, WORDS = (10, 16, 32, 100), (8, 12, 20)
#: Characters for each chunk; as far as there are fewer than SPREAD chunks, they may be as small as LEAST.
PART, LEAST, SPREAD = 2 << 20, 1 << 19, 64
#: Longer texts are dealt in pieces, which overlap by what a gram may reach beyond its first place.
PIECE = 1 << 17
ROWS = 1 << 16
U = np.uint64


def _pack(*arrays: np.ndarray) -> bytes:
    """Integers of equal numbers, compressed by planes of bytes."""
    raw = b"".join(np.ascontiguousarray(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(b: bytes, n: int) -> list[np.ndarray]:
    raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)
    return [np.ascontiguousarray(x.reshape(8, -1).T).view(np.int64).reshape(-1) for x in np.frombuffer(raw, np.uint8).reshape(n, -1)]


def _pack_text(t: str) -> bytes:
    raw = t.encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack_text(b: bytes) -> str:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True).decode()


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def _minimizers(codes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the leftmost least word of m characters in the k characters from each place on."""
    n = len(codes) - k + 1
    h, power, size = codes.astype(U) + U(1), 0x9E3779B97F4A7C15, 1
    for bit in bin(m)[3:]:
        h = h[:-size] * U(pow(power, size, 1 << 64)) + h[size:]
        size *= 2
        if bit == "1":
            h = h[:-1] * U(power) + (codes[size : size + len(h) - 1].astype(U) + U(1))
            size += 1
    h ^= h >> U(31)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    p, width = np.arange(len(h), dtype=np.int32), 1

    def least(h: np.ndarray, p: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        right = h[step:] < h[:-step]
        return np.where(right, h[step:], h[:-step]), np.where(right, p[step:], p[:-step])

    while 2 * width <= k - m + 1:
        h, p = least(h, p, width)
        width *= 2
    if width < k - m + 1:
        h, p = least(h, p, k - m + 1 - width)
    return h[:n], p[:n]


def _runs(texts: list[str], own: np.ndarray, low: int, high: int, m: int) -> tuple[np.ndarray, ...]:
    """Of the places of texts, in one row: minimizer, first place, places, end of the segment and text's number for each run of places."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = _codes("".join(texts))
    if len(codes) < low:
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(4))
    h, p = _minimizers(codes, low, m)
    start = np.cumsum(size) - size
    whole = size < LEVELS[-1]  # pieces are longer
    # the first place of a short text ends before the text does, as a gram is shorter than its text
    count = np.maximum(0, np.minimum(own, size - low + 1))
    of = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of]
    first = at == start[of]
    end = (start + size)[of] - (first & whole[of])
    fits = at + low <= end
    of, at, first, end = of[fits], at[fits], first[fits] & whole[of[fits]], end[fits]
    if not len(at):
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(4))
    new = np.r_[True, (p[at[1:]] != p[at[:-1]]) | (at[1:] != at[:-1] + 1) | first[:-1] | (of[1:] != of[:-1])]
    lo = np.flatnonzero(new)
    places = np.diff(np.r_[lo, len(at)])
    return h[at[lo]], at[lo], places, np.minimum(end[lo], at[lo] + places - 1 + high - 1), of[lo]


def _chunk(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], np.ndarray, np.ndarray, list[bytes], int]:
    """Texts of a chunk with the places they own and their numbers; what buckets told of its minimizers."""
    texts, own, n, told, chunk = [], [], [], [], 0
    for b in batches:
        for t, o, k, h, c in zip(*(b[x].to_pylist() for x in ("text", "own", "n", "told", "chunk")), strict=True):
            chunk = c
            if t is None:
                told.append(h)
            else:
                texts.append(t)
                own.append(o)
                n.append(k)
    return texts, np.array(own, np.int64), np.array(n, np.int64), told, chunk


def _buckets(h: np.ndarray, buckets: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """The order of minimizers by bucket; bucket, from and to."""
    at = ((h >> U(20)) % U(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    lo = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    return order, zip(at[order][lo].tolist(), lo.tolist(), [*lo[1:].tolist(), len(at)], strict=True)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    lo = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[lo], np.add.reduceat(n[order], lo)


def _minimizer_counts(texts: DataFrame, low: int, high: int, m: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, own, n, _, chunk = _chunk(batches)
        h, _, _, _, of = _runs(some, own, low, high, m)
        if not len(h):
            return
        h, n = _summed(h, n[of])
        order, parts = _buckets(h, buckets)
        h, n = h[order].view(np.int64), n[order]
        parts = list(parts)
        yield pa.record_batch({"bucket": pa.array([b for b, _, _ in parts], pa.int32()), "chunk": pa.array([chunk] * len(parts), pa.int32()), "h": pa.array([_pack(h[i:j], n[i:j]) for _, i, j in parts], pa.binary())})

    return texts.mapInArrow(run, "bucket int, chunk int, h binary")


def _often(counts: DataFrame, least: int, buckets: int) -> DataFrame:
    """For each chunk, which of its minimizers are frequent over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(c, *_unpack(h, 2)) for b in batches for c, h in zip(b["chunk"].to_pylist(), b["h"].to_pylist(), strict=True)]
        if not got:
            return
        h, n = _summed(np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got]))
        h = h[n >= least]
        for chunk, own, _ in got:
            if len(h) and len(own := own[h[np.minimum(np.searchsorted(h, own), len(h) - 1)] == own]):
                yield pa.record_batch({"chunk": pa.array([chunk], pa.int32()), "told": pa.array([_pack(own)], pa.binary())})

    return counts.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "chunk int, told binary")


def _segments(texts: DataFrame, low: int, high: int, m: int, buckets: int, asked: bool) -> DataFrame:
    """Packed segments by bucket: characters, and lengths, numbers of places and of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, own, n, told, _ = _chunk(batches)
        if asked and not told:
            return
        h, at, places, end, of = _runs(some, own, low, high, m)
        if asked:
            often = np.sort(np.concatenate([_unpack(x, 1)[0] for x in told])).view(np.int64)
            keep = often[np.minimum(np.searchsorted(often, h.view(np.int64)), len(often) - 1)] == h.view(np.int64)
            h, at, places, end, of = (x[keep] for x in (h, at, places, end, of))
        if not len(h):
            return
        order, parts = _buckets(h, buckets)
        at, places, end, n = at[order], places[order], end[order], n[of[order]]
        s = "".join(some)
        for b, i, j in parts:
            found: dict[tuple[str, int], int] = {}
            segments = zip([s[x:y] for x, y in zip(at[i:j].tolist(), end[i:j].tolist(), strict=True)], places[i:j].tolist(), strict=True)
            if (n[i:j] == 1).all():
                found = Counter(segments)
            else:
                for x, k in zip(segments, n[i:j].tolist(), strict=True):
                    found[x] = found.get(x, 0) + k
            each, spans = zip(*found, strict=True)
            sizes = (np.fromiter(x, np.int64, len(each)) for x in (map(len, each), spans, found.values()))
            yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "text": pa.array([_pack_text("".join(each))], pa.binary()), "sizes": pa.array([_pack(*sizes)], pa.binary())})

    return texts.mapInArrow(run, "bucket int, text binary, sizes binary")


def _grams(s: str, size: np.ndarray, places: np.ndarray, times: np.ndarray, low: int, high: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, first places and numbers of the frequent grams that start in the segments of s."""
    codes = _codes(s)
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    codes = (np.cumsum(used, dtype=np.int32) - np.int32(1))[codes]
    bits = max(1, int(used.sum() - 1).bit_length())
    start = np.cumsum(size) - size
    at = (np.arange(places.sum()) - np.repeat(np.cumsum(places) - places - start, places)).astype(np.int32)
    end, n = np.repeat(start + size, places).astype(np.int32), np.repeat(times, places)
    key, width = np.zeros(len(at), np.int64), 0

    for length in range(1, high):
        if length > low:
            fits = at + length <= end
            key, at, end, n = key[fits], at[fits], end[fits], n[fits]
        key = key << bits | codes[at + (length - 1)]
        width += bits
        if length < low and width + bits <= 63:
            continue
        if not len(key):
            return
        order = np.argsort(key)
        key = key[order]
        lo = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total, rows = np.add.reduceat(n[order], lo), np.diff(np.r_[lo, len(key)])
        keep = total >= least
        order, total, rows = order[np.repeat(keep, rows)], total[keep], rows[keep]
        at, end, n = at[order], end[order], n[order]
        # equal keys become one number, so that the next character fits beside it
        key, width = np.repeat(np.arange(len(rows)), rows), len(rows).bit_length()
        if length >= low and len(rows):
            yield length, at[np.cumsum(rows) - rows], total


def _counts(segments: DataFrame, low: int, high: int, least: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, sizes = [], []
        for b in batches:
            texts += map(_unpack_text, b["text"].to_pylist())
            sizes += [_unpack(x, 3) for x in b["sizes"].to_pylist()]
        if not texts:
            return
        s = "".join(texts)
        size, places, times = (np.concatenate([x[i] for x in sizes]) for i in range(3))
        del texts, sizes
        for length, at, n in _grams(s, size, places, times, low, high, least):
            for i in range(0, len(at), ROWS):
                grams = [s[x : x + length] for x in at[i : i + ROWS].tolist()]
                full = np.fromiter((len(g.strip()) >= LEVELS[0] for g in grams), bool, len(grams))
                kept = grams if full.all() else [g for g, f in zip(grams, full.tolist(), strict=True) if f]
                yield pa.record_batch({"gram": pa.array(kept, pa.string()), "n": pa.array(n[i : i + ROWS][full], pa.int64())})

    return segments.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "gram string, n long")


def frequent_ngrams(texts: DataFrame, text_col: str, least: int = 3) -> DataFrame:
    """gram and n: the substrings of 10 to 99 characters, shorter than their text, that occur least times or more.

    Every place of every text counts; grams of under 10 characters between their outer spaces are left out.
    """
    rows = texts.select(F.col(text_col).alias("text")).where(F.length("text") > LEVELS[0])
    size = int(rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0)
    parts = max(1, -(-size // PART), min(SPREAD, -(-size // LEAST)))
    reach, long = LEVELS[-1] - 2, F.length("text")
    # all pieces are longer than any gram; each but the last owns PIECE places
    pieces = F.when(long <= PIECE + reach + 1, F.lit(1)).otherwise(F.ceil((long - (reach + 1)) / PIECE)).cast("int")
    cut = rows.groupBy("text").agg(F.count("*").alias("n")).select("text", "n", pieces.alias("pieces")).select("*", F.explode(F.sequence(F.lit(1), F.col("pieces"))).alias("piece"))
    last = F.col("piece") == F.col("pieces")
    piece = F.when(F.col("pieces") == 1, F.col("text")).otherwise(F.substring("text", (F.col("piece") - 1) * PIECE + 1, F.when(last, long).otherwise(F.lit(PIECE + reach))))
    cut = cut.select(piece.alias("text"), F.when(last, long).otherwise(F.lit(PIECE)).alias("own"), "n")
    chunk = F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("chunk")
    cut = cut.select(chunk, "text", "own", "n", F.lit(None).cast("binary").alias("told"))
    dealt = cut.repartitionById(parts, F.col("chunk"))
    found = []
    for low, high, m in zip(LEVELS, LEVELS[1:], WORDS, strict=False):
        asked = low > LEVELS[0]
        if asked:
            told = _often(_minimizer_counts(dealt, low, high, m, parts), least, parts)
            told = told.select("chunk", F.lit(None).cast("string").alias("text"), F.lit(0).alias("own"), F.lit(0).cast("long").alias("n"), "told")
            segments = _segments(cut.union(told).repartitionById(parts, F.col("chunk")), low, high, m, parts, asked)
        else:
            segments = _segments(dealt, low, high, m, parts, asked)
        found.append(_counts(segments, low, high, least, parts))
    return reduce(DataFrame.union, found)
