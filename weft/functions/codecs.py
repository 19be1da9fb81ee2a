"""Codecs and hashes that SQL functions cannot express, as Arrow-batched functions.

Session codecs keep state from frame to frame, so they run once per session in order; stateless ones run by
batch.  Every codec is tested by a round trip.
"""

from __future__ import annotations

import difflib
import hashlib
import hmac
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query, read

TAIL = b"\x00\x00\xff\xff"


def canonical(value: object) -> str:
    """UTF-8 JSON, keys sorted, no spaces, non-ASCII kept; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_json(column: str) -> Column:
    return F.pandas_udf(_canonical, "string")(column)


def _canonical(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else canonical(json.loads(t)))


def hmac_sha256(column: str, key: Column) -> Column:
    return F.pandas_udf(_hmac, "string")(column, key)


def _hmac(text: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([hmac.new(k.encode(), (t or "").encode(), hashlib.sha256).hexdigest() for t, k in zip(text, key, strict=True)])


def fnv1a64(column: str) -> Column:
    return F.pandas_udf(_fnv, "string")(column)


def _fnv(text: pd.Series) -> pd.Series:
    def one(t: str) -> str:
        h = 0xCBF29CE484222325
        for b in (t or "").encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return text.map(one)


def similarity(a: str, b: str) -> Column:
    return F.pandas_udf(_ratio, "double")(a, b)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def session_deflate(df: DataFrame, session: str, order: str, payload: str, dictionary: bytes = b"", level: int = 3) -> DataFrame:
    """Raw deflate with one window per session and a flush after every frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        z = zlib.compressobj(level, zlib.DEFLATED, -15, zdict=dictionary) if dictionary else zlib.compressobj(level, zlib.DEFLATED, -15)
        return pdf[[session, order]].assign(wire=[z.compress((t or "").encode()) + z.flush(zlib.Z_SYNC_FLUSH) for t in pdf[payload]])

    cols = df.select(session, order, payload)
    return cols.groupBy(session).applyInPandas(run, cols.select(session, order).schema.add("wire", "binary"))


def session_inflate(df: DataFrame, session: str, order: str, wire: str = "wire", dictionary: bytes = b"") -> DataFrame:
    """Inverse of session_deflate; a bad frame fails itself and every later frame of its session."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, failed, out = pdf.sort_values(order), None, []
        z = zlib.decompressobj(-15, zdict=dictionary) if dictionary else zlib.decompressobj(-15)
        for w in pdf[wire]:
            text = None
            if failed is None:
                try:
                    if not bytes(w).endswith(TAIL):
                        raise ValueError("frame is not flushed")
                    text = z.decompress(bytes(w)).decode()
                except (ValueError, zlib.error) as e:
                    failed, text = str(e), None
            out.append((text, failed))
        return pdf[[session, order]].assign(text=[x for x, _ in out], failed=[y for _, y in out])

    cols = df.select(session, order, wire)
    return cols.groupBy(session).applyInPandas(run, cols.select(session, order).schema.add("text", "string").add("failed", "string"))


def token_session_deflate(df: DataFrame, session: str, order: str, payload: str, level: int = 3) -> DataFrame:
    """Token frames, then one deflate window over them, per session: words by number, numbers by the window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        return pdf[[session, order]].assign(wire=[z.compress(f) + z.flush(zlib.Z_SYNC_FLUSH) for f in tokens_encode([t or "" for t in pdf[payload]])])

    cols = df.select(session, order, payload)
    return cols.groupBy(session).applyInPandas(run, cols.select(session, order).schema.add("wire", "binary"))


def token_session_inflate(df: DataFrame, session: str, order: str, wire: str = "wire") -> DataFrame:
    """Inverse of token_session_deflate; from a bad frame on, texts are null and failed says why."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, frames, failed = pdf.sort_values(order), [], None
        z = zlib.decompressobj(-15)
        for w in pdf[wire]:
            try:
                if not bytes(w).endswith(TAIL):
                    raise ValueError("frame is not flushed")
                frames.append(z.decompress(bytes(w)))
            except (ValueError, zlib.error) as e:
                failed = str(e)
                break
        texts = tokens_decode(frames)
        lost = len(pdf) - len(texts)
        return pdf[[session, order]].assign(text=texts + [None] * lost, failed=[None] * len(texts) + [failed] * lost)

    cols = df.select(session, order, wire)
    return cols.groupBy(session).applyInPandas(run, cols.select(session, order).schema.add("text", "string").add("failed", "string"))


def tokens_encode(texts: list[str], least: int = 6, most: int = 4096) -> list[bytes]:
    """Words of a session by table number once seen: 0x01 varint for known ones, 0x00 varint bytes otherwise."""
    table: dict[str, int] = {}
    out = []
    for t in texts:
        frame = bytearray()
        for word in t.split(" "):
            if word in table:
                frame += b"\x01" + varint(table[word])
            else:
                b = word.encode()
                frame += b"\x00" + varint(len(b)) + b
                if len(word) >= least and len(table) < most:
                    table[word] = len(table)
        out.append(bytes(frame))
    return out


def tokens_decode(frames: list[bytes], least: int = 6, most: int = 4096) -> list[str]:
    table: list[str] = []
    out = []
    for f in frames:
        words, at = [], 0
        while at < len(f):
            kind = f[at]
            n, at = read_varint(f, at + 1)
            if kind:
                words.append(table[n])
            else:
                word = f[at : at + n].decode()
                at += n
                if len(word) >= least and len(table) < most:
                    table.append(word)
                words.append(word)
        out.append(" ".join(words))
    return out


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if shift > 63:
            raise ValueError("varint is too long")
        x = b[at]
        n |= (x & 127) << shift
        at, shift = at + 1, shift + 7
        if x < 128:
            return n, at


def lz_tokens(data: bytes, window: int = 32768, least: int = 4, most: int = 255) -> list[tuple]:
    """Greedy matches: (distance, length) of an earlier occurrence in the window, or one literal byte."""
    out: list[tuple] = []
    last: dict[bytes, int] = {}
    at = 0
    while at < len(data):
        p, n = last.get(data[at : at + least], -1), 0
        if p >= 0 and at - p <= window and at + least <= len(data):
            n = least
            while n < most and at + n < len(data) and n < at - p and data[p + n] == data[at + n]:
                n += 1
        if n >= least and at - p >= least:
            out.append((at - p, n))
        else:
            n = 1
            out.append((data[at],))
        for k in range(at, at + n):
            last[data[k : k + least]] = k
        at += n
    return out


def lz_bytes(tokens: list[tuple]) -> bytes:
    out = bytearray()
    for t in tokens:
        if len(t) == 1:
            out.append(t[0])
        else:
            out += out[len(out) - t[0] : len(out) - t[0] + t[1]]
    return bytes(out)


SCALE = 4096


def ans_frequencies(data: bytes) -> list[int]:
    """Byte frequencies, each at least 1, scaled to sum to SCALE; remainders go to the most frequent."""
    count = [1 + data.count(b) for b in range(256)]
    scaled = [max(1, c * SCALE // sum(count)) for c in count]
    order = sorted(range(256), key=lambda b: -scaled[b])
    k = 0
    while (rest := SCALE - sum(scaled)) != 0:
        b = order[k % 256]
        if rest > 0:
            scaled[b] += 1
        elif scaled[b] > 1:
            scaled[b] -= 1
        k += 1
    return scaled


def ans_encode(data: bytes, freq: list[int]) -> bytes:
    """Range asymmetric numeral system, 32-bit state, bytes out; read back from the end."""
    start = [0]
    for f in freq:
        start.append(start[-1] + f)
    x, out, low = 1 << 23, bytearray(), 1 << 23
    for b in reversed(data):
        while x >= ((low // SCALE) << 8) * freq[b]:
            out.append(x & 255)
            x >>= 8
        x = x // freq[b] * SCALE + x % freq[b] + start[b]
    return x.to_bytes(4, "big") + bytes(reversed(out))


def ans_decode(code: bytes, n: int, freq: list[int]) -> bytes:
    start, symbol = [0], []
    for b, f in enumerate(freq):
        start.append(start[-1] + f)
        symbol += [b] * f
    x, at, out, low = int.from_bytes(code[:4], "big"), 4, bytearray(), 1 << 23
    for _ in range(n):
        b = symbol[x % SCALE]
        out.append(b)
        x = freq[b] * (x // SCALE) + x % SCALE - start[b]
        while x < low and at < len(code):
            x, at = x << 8 | code[at], at + 1
    return bytes(out)


@query("cod_session_roundtrip", "SELECT conv_id, turn, text, CAST(NULL AS VARCHAR) AS failed FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return session_inflate(session_deflate(read(spark, d, "msgs"), "conv_id", "turn", "text"), "conv_id", "turn")


@query("cod_session_sizes")
def _(spark: SparkSession, d: str) -> DataFrame:
    return session_deflate(read(spark, d, "msgs"), "conv_id", "turn", "text").groupBy("conv_id").agg(F.sum(F.octet_length("wire")).alias("wire_bytes"), F.count("*").alias("frames"))


@query("cod_binary_semantic", "SELECT p_partkey, p_brand AS a, CAST(p_size AS VARCHAR) AS b FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Template id and length-prefixed slots, encoded and read back in SQL functions."""
    slot = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 4, F.lit("0"))), F.encode(c, "utf-8"))
    p = read(spark, d, "part").select("p_partkey", F.concat(F.unhex(F.lit("000007")), slot(F.col("p_brand")), slot(F.col("p_size").cast("string"))).alias("z"))
    size = lambda at: F.conv(F.hex(F.substring(F.col("z"), at, 2)), 16, 10).cast("int")
    p = p.withColumn("n", size(4))
    return p.select("p_partkey", F.decode(F.expr("substring(z, 6, n)"), "utf-8").alias("a"), F.decode(F.expr("substring(z, 8 + n)"), "utf-8").alias("b"))


@query("cod_canonical_json", "SELECT event_id, '{\"k\":' || CAST(props->'k' AS VARCHAR) || '}' AS canonical FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", canonical_json("props").alias("canonical"))


@query("fn_similarity")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", similarity("p_type", "p_brand").alias("ratio"), fnv1a64("p_brand").alias("hash"), hmac_sha256("p_brand", F.lit("k")).alias("tag"))
