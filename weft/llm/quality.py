"""Quality scores by compression.

Two zstandard dictionaries are trained by zstandard itself on good and on bad labelled texts.  A text is cut
into blocks of BLOCK bytes, all of which are compressed with either; the difference of the two compressed
sizes, normalised by the text's length, is calibrated to a probability by a logistic curve.  Short texts show
little either way, so PRIOR bytes of the average difference are added to every text.  Nothing else enters the
score.

The model is fitted on at most LABELLED rows of either label, those with the least hash of their id, and of them
on so many as have SAMPLE_BYTES of text together (one at least).  One half trains the dictionaries on its whole
texts, in pieces of PIECE bytes; the other half, scored whole, calibrates.  Rows are weighted so that the classes
have the shares they have among all labels.

Defined cases: null and empty texts get the score of no evidence, like any other; labels other than 0 and 1
and ids without text are not learnt from; an id with several labels has the least of them, and all of its
texts are learnt from; without both labels the score is the share of good labels; texts too few for training
are a dictionary as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.words import flat

LABELLED, SAMPLE_BYTES, PIECE, DICTIONARY, BLOCK, LEVEL, PRIOR = 4000, 32 << 20, 256, 256 << 10, 1024, 3, 64
HELD_OUT = "crc32(cast(cast(id AS string) AS binary)) % 5 = 0"
_ready: dict[bytes, zstandard.ZstdCompressor] = {}


@dataclass
class Model:
    good: bytes
    bad: bytes
    average: float
    least: float
    intercept: float
    slope: float

    def score(self, more: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.maximum(self.least, (more + PRIOR * self.average) / (n + PRIOR))
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * x, -40, 40)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if dictionary not in _ready:
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if d:
            d.precompute_compress(level=LEVEL)
        _ready[dictionary] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    return _ready[dictionary]


def differences(column: pa.Array, good: bytes, bad: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that each text takes more with the bad dictionary than with the good one, and its own."""
    data, off = flat(column)
    raw, g, b = data.tobytes(), _compressor(good), _compressor(bad)
    more = np.zeros(len(off) - 1)
    for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        for p in range(lo, hi, BLOCK):
            piece = raw[p : min(p + BLOCK, hi)]
            more[i] += len(b.compress(piece)) - len(g.compress(piece))
    return more, np.diff(off)


def dictionary_of(texts: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY bytes, trained on the whole texts."""
    pieces = [t[p : p + PIECE] for t in texts for p in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:DICTIONARY]


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """A model from labelled rows outside the held-out fold."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("good")).where(f"good IN (0, 1) AND id IS NOT NULL AND NOT ({HELD_OUT})").groupBy("id").agg(F.min("good").cast("int").alias("good"))
    counts = {r["good"]: r["count"] for r in marks.groupBy("good").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        p = (n1 + 1) / (n1 + n0 + 2)
        return Model(b"", b"", 0.0, -np.inf, float(np.log(p / (1 - p))), 0.0)
    least = [marks.where(F.col("good") == y).orderBy(F.xxhash64("id"), "id").limit(labelled) for y in (0, 1)]
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(least[0].unionByName(least[1])), "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)))
    order = Window.partitionBy("good", "part").orderBy(F.xxhash64("id"), "id", "size", "hash")
    rows = rows.withColumns({"size": F.octet_length("text"), "hash": F.xxhash64("text")})
    rows = rows.withColumns({"upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(order)}).where(f"upto <= {SAMPLE_BYTES // 2} OR nth = 1")
    taken = rows.where("part = 0").select("good", "text", "nth").orderBy("good", "nth").collect()
    good, bad = (dictionary_of([r["text"].encode() for r in taken if r["good"] == y]) for y in (1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            more, n = differences(t["text"], good, bad)
            yield pa.record_batch({"good": t["good"].cast(pa.int32()), "nth": t["nth"], "more": pa.array(more), "n": pa.array(n)})

    got = rows.where("part = 1").select("good", "nth", "text").mapInArrow(run, "good int, nth int, more double, n long").orderBy("good", "nth").collect()
    more, n, y = (np.array([r[c] for r in got], float) for c in ("more", "n", "good"))
    if not len(y):
        more, n, y = np.zeros(1), np.zeros(1), np.ones(1)
    weight = np.where(y == 1, n1 / max(1, y.sum()), n0 / max(1, (1 - y).sum()))
    weight, w = weight / weight.mean(), np.zeros(2)
    average = float((weight * more / np.maximum(1, n)).mean())
    x = (more + PRIOR * average) / (n + PRIOR)
    # Differences below those of most bad texts tell no more, and would flatten the curve where the classes meet.
    least = float(np.median(x[y == 0])) if (y == 0).any() else -np.inf
    x = np.maximum(least, x)
    scale = x.std() + 1e-9
    a = np.c_[np.ones(len(x)), x / scale]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        w = w - np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2), a.T @ (weight * (p - y)) + 0.05 * w)
    return Model(good, bad, average, least, float(w[0]), float(w[1] / scale))


def score(documents: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """documents with a score column (a column of that name is replaced)."""
    kept = [c for c in documents.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = model.score(*differences(t[text_col], model.good, model.bad))
            yield pa.RecordBatch.from_arrays([*(t[c] for c in kept), pa.array(x)], names=[*kept, out])

    schema = documents.select(*kept).schema.add(out, "double")
    return documents.select(*kept).mapInArrow(run, schema)


def quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted, per row of documents."""
    model = fit(documents, labels, id_col, text_col)
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = score(rows, model).withColumn("held_out", F.coalesce(F.expr(HELD_OUT), F.lit(False)))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
