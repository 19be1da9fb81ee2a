"""Substring dedup by Relative Lempel-Ziv parsing.

Every document is a reference for the documents with greater ids.  Its blocks are runs of min_words words.
Each block is reached through its anchor, the least hash among its 5-word grams, so equal blocks have equal
anchors.  Documents first exchange only their distinct anchors; blocks whose anchor two documents share are
then indexed: block hash -> first place (document, word) that holds it, and each group gets the part of that
index which its own texts need.

A document is parsed greedily from its start.  At a word whose block is not indexed the parse moves one word on
(a literal).  At an indexed one it takes the longest factor: the block, and every next word as long as the
block that ends there continues the same reference; then it jumps behind the factor.  A factor may end only
because its reference does, while the words around its end stand in another one.  So at each factor boundary
the blocks across it are asked for as well, and those indexed are factors too, which bridge the boundary.
Factors of min_words words and more are duplicate spans; they are exactly the words covered by some block of
min_words words that also starts in a document with a smaller id.

Defined cases: null text has no words; a null id is kept whole and is no reference (it is neither smaller
nor greater); rows with equal ids are no references for one another; documents shorter than min_words stay.
Blocks are compared by 64-bit hashes among blocks of one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.exchange import ENTRY, PART_BYTES, answers, entries, grouped, look_up, parts_of, table
from weft.llm.words import U, Words, slices

GRAM = 5
NO_ID = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,length:int,ref_doc:long,ref_start:int>>, kept_text string"


def _anchors(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and the anchor of each block."""
    at, gram = words.starts(k), words.grams(min(GRAM, k))
    least = gram[at] if len(at) else np.zeros(0, U)
    for j in range(1, k - min(GRAM, k) + 1):
        least = np.minimum(least, gram[at + j])
    return at, least


def _first(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct h: its least document and place there, and whether several documents have it."""
    order = np.lexsort((place, doc, h))
    h, doc, place = h[order], doc[order], place[order]
    lo = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    hi = np.r_[lo[1:], len(h)]
    return h[lo], doc[lo], place[lo], doc[lo] != doc[hi - 1] if len(h) else np.zeros(0, bool)


def _solve(h: np.ndarray, doc: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """w: 2 * place + 1 if several documents of the sender have h."""
    order = np.lexsort((w, doc, h))
    s = h[order]
    lo = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    n = np.diff(np.r_[lo, len(s)])
    first = order[lo]
    several = (np.maximum.reduceat(w[order] & 1, lo) > 0) | (doc[first] != doc[order[lo + n - 1]])
    keep, v, place = np.empty(len(h), bool), np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    keep[order], v[order], place[order] = np.repeat(several, n), np.repeat(doc[first], n), np.repeat(w[first] >> 1, n)
    return keep, v, place


def _sent(ids: np.ndarray, text: pa.Array, grp: int, k: int, buckets: int, keys: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Anchors of a group's documents, or (with the shared anchors) its blocks."""
    got: list[tuple] = []
    for lo, _, data, off in slices(text):
        words = Words(data, off)
        at, h = _anchors(words, k)
        doc = ids[lo + words.text_of(at)]
        place = at - words.first[words.text_of(at)]
        ok = doc != NO_ID
        if keys is not None:
            ok &= look_up(keys, h)[0]
            h = words.grams(k, 7)[at] ^ h if len(at) else h
        else:
            place = np.zeros_like(place)
        x = _first(h[ok], doc[ok], place[ok])
        got.append((x[0], x[1], 2 * x[2] + x[3]))
    if got:
        h, doc, w = (np.concatenate([x[i] for x in got]) for i in range(3))
        order = np.lexsort((w, doc, h))
        h, doc, w = h[order], doc[order], w[order]
        lo = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        if len(lo):
            several = (np.maximum.reduceat(w & 1, lo) > 0) | (doc[lo] != doc[np.r_[lo[1:], len(h)] - 1])
            yield from entries(grp, h[lo], doc[lo], (w[lo] | 1) - 1 + several, buckets)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NO_ID), np.int64)


def _split(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table]]:
    t, g = pa.table(batch), np.asarray(batch["grp"])
    for x in np.unique(g):
        yield int(x), t.filter(pa.array(g == x))


def factor(ref: np.ndarray, place: np.ndarray, found: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, reference document, start there) of one document, in order.

    ref, place and found say for each block start what the index holds.  Factors overlap only where some bridge
    a boundary.
    """
    hits = np.flatnonzero(found)
    if not len(hits):
        return []
    # The last of the hits that continue one reference from each hit on.
    goes_on = (np.diff(hits) == 1) & (ref[hits[1:]] == ref[hits[:-1]]) & (np.diff(place[hits]) == 1)
    breaks = np.r_[np.flatnonzero(~goes_on), len(hits) - 1]
    out, at = [], 0
    while at < len(hits):
        start = int(hits[at])
        last = int(hits[breaks[np.searchsorted(breaks, at)]])
        end = last + k
        out.append((start, end - start, int(ref[start]), int(place[start])))
        # Blocks that begin inside the factor and end behind it.
        lo, at = int(np.searchsorted(hits, last, "right")), int(np.searchsorted(hits, end))
        while lo < at:
            upto = min(int(breaks[np.searchsorted(breaks, lo)]), at - 1)
            first = int(hits[lo])
            out.append((first, int(hits[upto]) + k - first, int(ref[first]), int(place[first])))
            lo = upto + 1
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, with_text: bool = False, carry: tuple[str, ...] = (), part_bytes: int = PART_BYTES) -> DataFrame:
    """Factors, kept-word digest and (with_text) the text without its duplicate words, per row of docs.

    A text that loses no word is returned unchanged; otherwise each removed word goes together with the
    white space after it.  The columns named in carry come back in a struct named rest.
    """
    k, n = min_words, parts_of(docs, text_col, part_bytes)
    texts = grouped(docs, id_col, text_col, n, carry)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, t in _split(batch):
                yield from _sent(_ids(t["id"]), t["text"], g, k, n, None)

    def blocks(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(_sent(_ids(left["id"]), left["text"], key[0].as_py(), k, n, table(right)[0])) if left.num_rows and right.num_rows else []
        empty = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("n", pa.int32()), ("h", pa.binary()), ("v", pa.binary()), ("w", pa.binary())])
        return pa.Table.from_batches(rows, rows[0].schema if rows else empty)

    def parse(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, first, where = table(right)
        ids, out = _ids(left["id"]), {x: [] for x in ("n_words", "n_removed", "kept_sha256", "factors", "kept_text")}
        for lo, to, data, off in slices(left["text"]):
            words = Words(data, off)
            at, h = _anchors(words, k)
            found, hit = look_up(keys, words.grams(k, 7)[at] ^ h) if len(at) else (np.zeros(0, bool), np.zeros(0, np.int64))
            ref, place = (first[hit], where[hit]) if len(keys) else (np.zeros(len(at), np.int64),) * 2
            doc = words.text_of(at)
            found &= (ref < ids[lo + doc]) & (ids[lo + doc] != NO_ID)
            bound, raw = np.searchsorted(doc, np.arange(to - lo + 1)), data.tobytes()
            for i in range(to - lo):
                a, b, w0, w1 = bound[i], bound[i + 1], words.first[i], words.first[i + 1]
                parts = factor(ref[a:b], place[a:b], found[a:b], k)
                gone = np.zeros(w1 - w0 + 1, np.int64)
                for s, m, _, _ in parts:
                    gone[s] += 1
                    gone[s + m] -= 1
                keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + w0
                s, e = words.start[keep].tolist(), words.end[keep].tolist()
                kept = b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)])
                out["n_words"].append(int(w1 - w0))
                out["n_removed"].append(int(w1 - w0 - len(keep)))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["factors"].append([dict(zip(("start", "length", "ref_doc", "ref_start"), x, strict=True)) for x in parts])
                if with_text and len(keep) < w1 - w0:
                    follows = np.r_[words.start[w0 + 1 : w1], off[i + 1]][keep - w0].tolist()
                    head = raw[off[i] : words.start[w0]]
                    out["kept_text"].append((head + b"".join([raw[x:y] for x, y in zip(s, follows, strict=True)])).decode() if len(keep) else "")
                else:
                    out["kept_text"].append(left["text"][lo + i].as_py() if with_text else None)
        factors = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
        return pa.table({"doc_id": left["id"], "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "factors": pa.array(out["factors"], factors), "kept_text": pa.array(out["kept_text"], pa.string())} | ({"rest": left["rest"]} if carry else {}))

    shared = answers(texts.mapInArrow(anchors, ENTRY), n, _solve)
    by = texts.groupBy("grp")
    index = answers(by.cogroup(shared.groupBy("grp")).applyInArrow(blocks, ENTRY), n, _solve)
    result = RESULT + (f", rest {texts.schema['rest'].dataType.simpleString()}" if carry else "")
    return by.cogroup(index.groupBy("grp")).applyInArrow(parse, result)
