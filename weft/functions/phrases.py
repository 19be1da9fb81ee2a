"""Phrase coding: runs of templates, phrases and literals; back references; payload metadata; fuzzy records."""

from __future__ import annotations

import difflib
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import codecs
from weft.registry import query, read

TEMPLATE, PHRASE, LITERAL, MATCH = range(4)


class PhraseBook:
    """Phrases by number, found longest first at every position of a text."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases = sorted(set(filter(None, phrases)))
        self.number = {p: k for k, p in enumerate(self.phrases)}
        self.found = re.compile("|".join(map(re.escape, sorted(self.phrases, key=len, reverse=True))) or r"(?!)")

    def longest(self, text: str, at: int = 0) -> str | None:
        """The longest phrase that starts at this position."""
        m = self.found.match(text, at)
        return m[0] if m else None

    def pieces(self, text: str) -> list[tuple[int, str]]:
        """(kind, piece) of the whole text: phrases and what lies between them."""
        out, at = [], 0
        for m in self.found.finditer(text):
            out += [(LITERAL, text[at : m.start()])] * (m.start() > at) + [(PHRASE, m[0])]
            at = m.end()
        return out + [(LITERAL, text[at:])] * (at < len(text))


def _block(raw: bytes) -> bytes:
    return codecs.varint(len(raw)) + raw


def _read_block(b: bytes, at: int) -> tuple[bytes, int]:
    n, at = codecs.read_varint(b, at)
    if at + n > len(b):
        raise ValueError("block is cut")
    return b[at : at + n], at + n


def runs_encode(text: str, book: PhraseBook, spans: list[tuple[int, int, int, list[str]]] = ()) -> bytes:
    """Frame of template runs (start, end, template id, slots), phrases and literals; overlapped spans are passed over."""
    out, at = bytearray(), 0

    def plain(piece: str) -> None:
        for kind, p in book.pieces(piece):
            out.append(kind)
            out.extend(codecs.varint(book.number[p]) if kind == PHRASE else _block(p.encode()))

    for start, end, template, slots in sorted(spans):
        if start >= at:
            plain(text[at:start])
            out.append(TEMPLATE)
            out += codecs.varint(template) + codecs.varint(len(slots)) + b"".join(_block(s.encode()) for s in slots)
            at = end
    plain(text[at:])
    return bytes(out)


def runs_walk(frame: bytes) -> list[tuple]:
    """The runs of a frame, without looking anything up."""
    at, out = 0, []
    while at < len(frame):
        kind, at = frame[at], at + 1
        if kind == LITERAL:
            raw, at = _read_block(frame, at)
            out.append((kind, raw.decode()))
        elif kind == PHRASE:
            k, at = codecs.read_varint(frame, at)
            out.append((kind, k))
        elif kind == TEMPLATE:
            template, at = codecs.read_varint(frame, at)
            n, at = codecs.read_varint(frame, at)
            slots = []
            for _ in range(n):
                raw, at = _read_block(frame, at)
                slots.append(raw.decode())
            out.append((kind, template, slots))
        else:
            raise ValueError(f"unknown run {kind}")
    return out


def runs_decode(frame: bytes, book: PhraseBook, templates: dict[int, str]) -> str:
    def filled(pattern: str, slots: list[str]) -> str:
        return re.sub(r"\{(\d+)\}", lambda m: slots[int(m[1])], pattern)

    return "".join(r[1] if r[0] == LITERAL else book.phrases[r[1]] if r[0] == PHRASE else filled(templates[r[1]], r[2]) for r in runs_walk(frame))


def references_encode(text: str, book: PhraseBook) -> bytes:
    """Phrases by number; what lies between them as literal bytes and back references, without an entropy stage."""
    out = bytearray()
    for kind, piece in book.pieces(text):
        if kind == PHRASE:
            out += bytes([PHRASE]) + codecs.varint(book.number[piece])
            continue
        held = bytearray()
        for t in [*codecs.lz_tokens(piece.encode()), None]:
            if t is not None and len(t) == 1:
                held.append(t[0])
                continue
            if held:
                out += bytes([LITERAL]) + _block(bytes(held))
                held = bytearray()
            if t is not None:
                out += bytes([MATCH]) + codecs.varint(t[0]) + codecs.varint(t[1])
        out.append(TEMPLATE)  # end of the piece
    return bytes(out)


def references_decode(frame: bytes, book: PhraseBook) -> str:
    at, tokens, out = 0, [], []
    while at < len(frame):
        kind, at = frame[at], at + 1
        if kind == PHRASE:
            k, at = codecs.read_varint(frame, at)
            out.append(book.phrases[k])
        elif kind == LITERAL:
            raw, at = _read_block(frame, at)
            tokens += [(x,) for x in raw]
        elif kind == MATCH:
            far, at = codecs.read_varint(frame, at)
            size, at = codecs.read_varint(frame, at)
            tokens.append((far, size))
        else:
            out.append(codecs.lz_bytes(tokens).decode())
            tokens = []
    return "".join(out)


# Few enough to be shipped with every task: the most frequent words of a column, as phrases.
def book_of(df: DataFrame, text: str, most: int = 200, least: int = 6) -> PhraseBook:
    w = df.select(F.explode(F.split(text, " ")).alias("w")).where(F.length("w") >= least).groupBy("w").count()
    return PhraseBook([r["w"] for r in w.orderBy(F.desc("count"), "w").limit(most).collect()])


@query("cod_runs_roundtrip", "SELECT item_id, 'Part ' || item_id || ' of store: ' || text AS text FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "benchmark")
    book, templates = book_of(b, "text"), {7: "Part {0} of store: "}

    def both(item: pd.Series, text: pd.Series) -> pd.Series:
        full = [(str(i), f"Part {i} of store: {t}") for i, t in zip(item, text, strict=True)]
        return pd.Series([runs_decode(runs_encode(t, book, [(0, len(f"Part {i} of store: "), 7, [i])]), book, templates) for i, t in full])

    return b.select("item_id", F.pandas_udf(both, "string")("item_id", "text").alias("text"))


@query("cod_references_roundtrip", "SELECT item_id, text FROM benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "benchmark")
    book = book_of(b, "text")
    return b.select("item_id", F.pandas_udf(lambda s: s.map(lambda t: references_decode(references_encode(t, book), book)), "string")("text").alias("text"))


@query("cod_longest_phrase", """WITH p(w) AS (VALUES ('Brand'), ('Brand#1'), ('Brand#11'), ('Brand#2')) SELECT p_partkey, max_by(w, length(w)) AS phrase FROM part JOIN p ON starts_with(p_brand, w) GROUP BY p_partkey""")
def _(spark: SparkSession, d: str) -> DataFrame:
    book = PhraseBook(["Brand", "Brand#1", "Brand#11", "Brand#2"])
    return read(spark, d, "part").select("p_partkey", F.pandas_udf(lambda s: s.map(book.longest), "string")("p_brand").alias("phrase"))


def partial_plan(start: Column, end: Column, text: Column, method: Column, small: int = 32) -> Column:
    """How a text is coded of which a template covers [start, end): exactly, raw where little is left over, else by
    the method's fallback."""
    left = F.octet_length(text) - F.octet_length(F.substring(text, start + 1, end - start))
    by_method = F.when(method == "entropy", "entropy_fallback").when(method.isin("phrase", "semantic"), "phrase_fallback").otherwise("raw_fallback")
    how = F.when(end <= start, "raw").when(left == 0, "exact_match").when(left <= small, "raw_fallback").otherwise(by_method)
    return F.struct(how.alias("strategy"), left.alias("leftover_bytes"), F.round(F.try_divide(end - start, F.length(text)), 6).alias("coverage"))


@query("cod_partial_templates", """SELECT item_id, CASE WHEN strlen(text) - strlen(substr(text, 1, k)) = 0 THEN 'exact_match' WHEN strlen(text) - strlen(substr(text, 1, k)) <= 32 THEN 'raw_fallback' WHEN item_id % 3 = 0 THEN 'entropy_fallback' WHEN item_id % 3 = 1 THEN 'phrase_fallback' ELSE 'raw_fallback' END AS strategy,
 strlen(text) - strlen(substr(text, 1, k)) AS leftover_bytes, round(k / length(text), 6) AS coverage FROM (SELECT *, CASE WHEN item_id % 5 = 0 THEN length(text) WHEN item_id % 5 = 1 THEN length(text) - 3 ELSE length(text) // 2 END AS k FROM benchmark)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    end = F.when(F.col("item_id") % 5 == 0, n).when(F.col("item_id") % 5 == 1, n - 3).otherwise(F.expr("int(length(text) div 2)"))
    method = F.when(F.col("item_id") % 3 == 0, "entropy").when(F.col("item_id") % 3 == 1, "phrase").otherwise("plain")
    return read(spark, d, "benchmark").select("item_id", partial_plan(F.lit(0), end, F.col("text"), method).alias("p")).select("item_id", "p.*")


def one_shot(text: str, least: int = 64) -> bytes:
    """Deflated where that is shorter, else raw; a byte says which. Short texts are raw."""
    raw = text.encode()
    packed = zlib.compress(raw, 6) if len(raw) >= least else raw
    return b"\x01" + packed if len(packed) < len(raw) else b"\x00" + raw


def one_shot_text(frame: bytes) -> str:
    return (zlib.decompress(frame[1:]) if frame[0] else bytes(frame[1:])).decode()


@query("cod_one_shot_roundtrip", "SELECT conv_id, turn, text FROM msgs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "msgs").select("conv_id", "turn", F.pandas_udf(lambda s: s.map(lambda t: one_shot_text(one_shot(t))), "string")("text").alias("text"))


def _runs_metadata(frame: pd.Series) -> pd.DataFrame:
    runs = [runs_walk(bytes(f)) for f in frame]
    return pd.DataFrame({"template_ids": [[r[1] for r in x if r[0] == TEMPLATE] for x in runs], "has_literals": [any(r[0] == LITERAL for r in x) for x in runs]})


def payload_metadata(df: DataFrame, frame: str) -> DataFrame:
    """method, bytes, template ids and fast-path flag of frames, read from their first bytes; only phrase runs are
    walked, nothing is decoded."""
    code, body = F.expr(f"conv(hex(substring({frame}, 1, 1)), 16, 10)").cast("int"), F.expr(f"substring({frame}, 2)")
    df = df.withColumns({"__code": code, "__body": body})
    method = F.element_at(F.array(*[F.lit(x) for x in ("semantic", "runs", "entropy", "raw")]), F.col("__code") + 1)
    df = df.withColumn("__runs", F.pandas_udf(_runs_metadata, "template_ids array<int>, has_literals boolean")(F.when(F.col("__code") == 1, F.col("__body")).otherwise(F.lit(b""))))
    first = F.array(F.expr("conv(hex(substring(__body, 1, 2)), 16, 10)").cast("int"))
    ids = F.when(F.col("__code") == 0, F.when(F.octet_length("__body") < 3, F.array().cast("array<int>")).otherwise(first)).when(F.col("__code") == 1, F.col("__runs.template_ids")).otherwise(F.array().cast("array<int>"))
    fast = (F.size(ids) > 0) & ((F.col("__code") == 0) | ~F.col("__runs.has_literals"))
    return df.withColumns({"method": method, "payload_bytes": F.octet_length("__body"), "template_ids": ids, "fast_path": fast}).drop("__code", "__body", "__runs")


@query("fn_payload_metadata", """SELECT p_partkey, ['semantic', 'runs', 'entropy', 'raw'][p_size % 4 + 1] AS method, CAST(CASE p_size % 4 WHEN 0 THEN 2 + strlen(p_brand) WHEN 1 THEN 4 + strlen(p_brand) ELSE strlen(p_brand) END AS INTEGER) AS payload_bytes,
 CASE p_size % 4 WHEN 0 THEN [7] WHEN 1 THEN [9] ELSE [] END::INTEGER[] AS template_ids, p_size % 4 < 2 AS fast_path FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    b, k = F.encode("p_brand", "utf-8"), F.col("p_size") % 4
    run = F.concat(F.unhex(F.lit("01000901")), F.unhex(F.lpad(F.hex(F.octet_length("p_brand")), 2, F.lit("0"))), b)
    frame = F.when(k == 0, F.concat(F.unhex(F.lit("000007")), b)).when(k == 1, run).when(k == 2, F.concat(F.unhex(F.lit("02")), b)).otherwise(F.concat(F.unhex(F.lit("03")), b))
    return payload_metadata(read(spark, d, "part").select("p_partkey", frame.alias("f")), "f").drop("f")


FUZZY = "pattern string, similarity double, distance int, differences int, original_length int, estimated_length int"


def fuzzy_record(df: DataFrame, text: str, patterns: list[str], least: float = 0.6) -> DataFrame:
    """match: the most similar pattern (of equal ones the first), or null if none reaches least."""

    def best(t: str | None) -> dict | None:
        scored = [(difflib.SequenceMatcher(None, t or "", p).ratio(), -k) for k, p in enumerate(patterns)]
        ratio, k = max(scored, default=(0.0, 0))
        if t is None or ratio < least:
            return None
        ops = [o for o in difflib.SequenceMatcher(None, t, patterns[-k]).get_opcodes() if o[0] != "equal"]
        changed = sum(len(t[a:b]) + 2 for _, a, b, _, _ in ops)
        return {"pattern": patterns[-k], "similarity": ratio, "differences": len(ops), "original_length": len(t), "estimated_length": changed + 100}

    kind = FUZZY.replace("distance int, ", "")
    udf = F.pandas_udf(lambda s: pd.DataFrame([best(t) or dict.fromkeys(("pattern", "similarity", "differences", "original_length", "estimated_length")) for t in s], columns=["pattern", "similarity", "differences", "original_length", "estimated_length"]).astype({"differences": "Int32", "original_length": "Int32", "estimated_length": "Int32", "similarity": "float64"}), kind)
    m = df.withColumn("match", udf(F.col(text)))
    return m.withColumn("match", F.when(F.col("match.pattern").isNotNull(), F.col("match").withField("distance", F.levenshtein(F.col(text), F.col("match.pattern")))))


@query("fn_fuzzy_record")
def _(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_record(read(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["STANDARD ANODIZED TIN", "PROMO PLATED STEEL", "ECONOMY BRUSHED COPPER"]).select("p_partkey", "match.*")
