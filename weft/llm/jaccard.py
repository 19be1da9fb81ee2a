"""Exact n-gram Jaccard join over inverted lists, with two kinds of skipping between related sets.

1. Documents with the same shingle set form a class; its least id stands for it from then on.
2. Shingles have one global order, by document frequency.  Two sets with similarity t share a shingle among
   their first n - ceil(t n) + 1, and shingles of one document join nothing, so a set whose prefix has only
   those is out.  A first round counts a quarter of all shingles (by hash; the others come last in the
   order); a second one counts every shingle of the sets that are left, among those sets.  The number of
   shingles that a set shares with any other bounds its overlap with each.
3. Lists are joined by blocks of size and position.  Block headers tell whether two blocks can hold a pair
   that reaches the overlap; only then their entries are read (index-level skipping).
4. Answers of a list are derived from those of its pivot, the set with the fewest shingles of its own, so
   that most others of the list are highly similar to it: links to the pivot come first; sets already in one component need no further check; and of
   the rest a pair is skipped if the difference of the two known distances to the pivot exceeds 1 - t, as
   Jaccard distance is a metric (answer-level skipping).
Every remaining pair is compared on its whole sets, so no link between components is lost.

Defined cases: null or empty text has the empty set and links with nothing; a text with fewer words than
the shingle length is one shingle; null ids get a null component; rows with equal ids share one component.
Set sizes count 64-bit shingle hashes; 48 bits of them are compared within a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.exchange import ENTRY, PART_BYTES, answers, checkpoint, entries, grouped, look_up, parts_of, table
from weft.llm.graph import components, join_hot
from weft.llm.words import U, Words, slices

EMPTY = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("n", pa.int32()), ("h", pa.binary()), ("v", pa.binary()), ("w", pa.binary())])
SETS = "id long, grp int, n long, s1 long, s2 long"
LEFT = "id long, grp int, n long, shingles binary"
LISTS = "id long, n long, r long, shingles binary, posts array<struct<h:long,pos:int>>"


def shingle_sets(text: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, hashes) per slice: the sorted distinct shingles of row i lie at bounds[i]:bounds[i + 1]."""
    for lo, to, data, off in slices(text):
        words = Words(data, off, lower=True)
        at = words.starts(k)
        doc, h = words.text_of(at), words.grams(k)[at] if len(at) else np.zeros(0, U)
        for m in range(1, k):
            few = np.flatnonzero(words.n_words == m)
            if len(few):
                doc, h = np.r_[doc, few], np.r_[h, words.grams(m, 100 + m)[words.first[few]]]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        doc, h = doc[new], h[new]
        yield lo, np.searchsorted(doc, np.arange(to - lo + 1)), h


def _sums(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[U(0), np.cumsum(h, dtype=U)]
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _sampled(h: np.ndarray) -> np.ndarray:
    return (h & U(3)) == 0


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _solve(h: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    s = h[order]
    lo = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    total = np.empty(len(h), np.int64)
    total[order] = np.repeat(np.add.reduceat(v[order], lo), np.diff(np.r_[lo, len(s)]))
    return total > 1, total, w


def _cut(h: np.ndarray) -> bytes:
    """The upper 48 bits of every hash, sorted, six bytes each."""
    return np.ascontiguousarray((np.sort(h) >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _uncut(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(U).reshape(-1)


def shared_counts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with na, nb and the number of shingles that both sets have."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            inter = [len(np.intersect1d(_uncut(p), _uncut(q), assume_unique=True)) for p, q in zip(x["sa"].to_pylist(), x["sb"].to_pylist(), strict=True)]
            yield pa.record_batch({"a": x["a"], "b": x["b"], "na": x["na"], "nb": x["nb"], "shared": pa.array(inter, pa.int64())})

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, na long, nb long, shared long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable over links), per row of docs.

    Documents link when 100 * intersection >= percent * union of their sets.
    """
    k, n = words, parts_of(docs, text_col, part_bytes)
    texts = grouped(docs, id_col, text_col, n)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo, bounds, h in shingle_sets(x["text"], k):
                m = len(bounds) - 1
                s2 = _sums(h * U(0x9E3779B97F4A7C15) ^ (h >> U(31)), bounds)
                yield pa.record_batch({"id": x["id"].slice(lo, m), "grp": x["grp"].slice(lo, m), "n": pa.array(np.diff(bounds).astype(np.int64)), "s1": pa.array(_sums(h, bounds)), "s2": pa.array(s2)})

    def count(grp: int, hs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, c = np.unique(np.concatenate(hs), return_counts=True)
        return entries(grp, h, c.astype(np.int64), np.zeros(len(h), np.int64), n)

    def frequencies(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        copies, hs = set(right["id"].to_pylist()), [np.zeros(0, U)]
        ids = left["id"].to_pylist()
        for lo, bounds, h in shingle_sets(left["text"], k):
            one = np.array([x is not None and x not in copies for x in ids[lo : lo + len(bounds) - 1]])
            hs.append(h[np.repeat(one, np.diff(bounds)) & _sampled(h)])
        return pa.Table.from_batches(list(count(key[0].as_py(), hs)), EMPTY)

    def able(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        copies = set(right.filter(pa.compute.equal(right["kind"], 1))["id"].to_pylist())
        keys, _, _ = table(right.filter(pa.compute.equal(right["kind"], 0)))
        out, ids = {"id": [], "n": [], "shingles": []}, left["id"].to_pylist()
        for lo, bounds, h in shingle_sets(left["text"], k):
            open_ = look_up(keys, h)[0] | ~_sampled(h)
            alone = np.r_[0, np.cumsum(~open_)]
            for i in range(len(bounds) - 1):
                a, b = bounds[i], bounds[i + 1]
                if a < b and ids[lo + i] is not None and ids[lo + i] not in copies and alone[b] - alone[a] < prefix_length(int(b - a), percent):
                    out["id"].append(ids[lo + i])
                    out["n"].append(int(b - a))
                    out["shingles"].append(_cut(h[a:b]))
        return pa.table({"id": pa.array(out["id"], pa.int64()), "grp": pa.array([key[0].as_py()] * len(out["id"]), pa.int32()), "n": pa.array(out["n"], pa.int64()), "shingles": pa.array(out["shingles"], pa.binary())})

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            grp, sets = np.asarray(x["grp"]), x["shingles"].to_pylist()
            for g in np.unique(grp):
                yield from count(int(g), [_uncut(sets[i]) << U(16) for i in np.flatnonzero(grp == g)])

    def prefixes(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, df, _ = table(right)
        out = {"id": [], "n": [], "r": [], "shingles": [], "posts": []}
        for x, b in zip(left["id"].to_pylist(), left["shingles"].to_pylist(), strict=True):
            h = _uncut(b) << U(16)
            found, at = look_up(keys, h)
            often = np.where(found, df[at] if len(keys) else 0, 1)
            alone, size = int((~found).sum()), prefix_length(len(h), percent)
            if alone < size:
                order = np.lexsort((h, often))[alone:size]
                out["id"].append(x)
                out["n"].append(len(h))
                out["r"].append(len(h) - alone)
                out["shingles"].append(b)
                out["posts"].append([{"h": int(y), "pos": alone + p} for p, y in enumerate(h[order].view(np.int64))])
        return pa.table({"id": pa.array(out["id"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "r": pa.array(out["r"], pa.int64()), "shingles": pa.array(out["shingles"], pa.binary()), "posts": pa.array(out["posts"], pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())])))})

    each = checkpoint(texts.mapInArrow(sizes, SETS))
    known = each.where("n > 0 AND id IS NOT NULL")
    same = checkpoint(known.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    total, by_size = each.count(), same.withColumnRenamed("n", "size")
    counts = by_size.select("size", "s1", "s2", "rep", F.col("copies").alias("n"))
    copies = join_hot(known.withColumnRenamed("n", "size"), by_size.drop("copies"), ["size", "s1", "s2"], counts, "id", total)
    copies = checkpoint(copies.where("id <> rep").select("id", "grp", "rep"))
    by = texts.groupBy("grp")
    often = answers(by.cogroup(copies.groupBy("grp")).applyInArrow(frequencies, ENTRY), n, _solve)
    told = often.select("grp", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "h", "v", "w").unionByName(
        copies.select("grp", F.lit(1).alias("kind"), "id", *[F.lit(None).cast("binary").alias(c) for c in "hvw"])
    )
    left = checkpoint(by.cogroup(told.groupBy("grp")).applyInArrow(able, LEFT))
    left = left.repartition(n, "grp")
    often = answers(left.mapInArrow(recount, ENTRY), n, _solve)
    lists = checkpoint(left.groupBy("grp").cogroup(often.groupBy("grp")).applyInArrow(prefixes, LISTS))
    links = _links(lists, percent)
    found = components(links)
    part = copies.select("id", F.col("rep").alias("node")).distinct()
    label = each.select("id", F.col("n").alias("n_shingles")).join(part.groupBy("id").agg(F.min("node").alias("rep")), "id", "left")
    label = join_hot(label.withColumn("node", F.coalesce("rep", "id")), found, ["node"], counts.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("n")), "id", total, "left")
    return label.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "node").alias("component_id"))


def _links(lists: DataFrame, percent: int) -> DataFrame:
    """Links enough to connect every component of the sets in lists."""
    similar = F.expr(f"100 * shared >= {percent} * (na + nb - shared)")

    def able(n: str, m: str, r: str, q: str) -> str:
        return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) AND {100 + percent} * least({r}, {q}) >= {percent} * ({n} + {m})"

    posts = lists.select("id", "n", "r", F.explode("posts").alias("p")).select("id", "n", "r", "p.h", "p.pos")
    typical = F.struct((F.col("n") - F.col("r")).alias("own"), F.xxhash64("id").alias("o"), "id", "n", "r")
    full = posts.groupBy("h").agg(F.count("*").alias("entries"), F.min(typical).alias("pivot")).where("entries > 1")
    posts = checkpoint(posts.join(full.select("h", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pn"), F.col("pivot.r").alias("pr")), "h"))
    pairs = posts.where(f"id <> pivot AND {able('n', 'pn', 'r', 'pr')}").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    first = checkpoint(shared_counts(pairs, lists))
    links = first.where(similar).select("a", "b")
    # A second pivot per list, for the sets that the first did not reach.
    for seed in (1, None):
        comp = checkpoint(components(links))
        at = posts.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = at.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(F.struct(F.xxhash64("id", F.lit(seed or 0)).alias("o"), "id", "n", "r", "component")).alias("next")).where("x < y")
        at = checkpoint(at.join(mixed.select("h", "next"), "h"))
        if not at.take(1):
            break
        if seed is not None:
            more = at.where(f"id <> next.id AND component <> next.component AND {able('n', 'next.n', 'r', 'next.r')}").select(F.col("id").alias("a"), F.col("next.id").alias("b")).distinct()
        else:
            more = _between(at, first, percent)
        links = checkpoint(links.unionByName(shared_counts(more, lists).where(similar).select("a", "b")))
    return links


def _between(at: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list, in different components, that neither block bounds nor the pivot's answers rule out."""
    far = first.select(F.col("a").alias("id"), F.col("b").alias("pivot"), (1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("d"))
    at = at.join(far, ["id", "pivot"], "left").withColumn("d", F.when(F.col("id") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("d")))
    base = float(np.log(100 / percent))
    at = at.withColumn("sb", F.floor(F.log("n") / base).cast("int")).withColumn("pb", F.expr("pos div 8")).select("h", "sb", "pb", "id", "n", "r", "pos", "component", "d")
    head = at.groupBy("h", "sb", "pb").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("r").alias("r1"), F.min("pos").alias("p0"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    x, y = (head.select("h", *[F.col(c).alias(f"{s}{c}") for c in head.columns if c != "h"]) for s in "xy")
    able = x.join(y, "h").where(
        "xsb <= ysb AND ysb - xsb <= 1 AND (xsb < ysb OR xpb <= ypb) AND NOT (xc0 = xc1 AND yc0 = yc1 AND xc0 = yc0)"
        f" AND {100 + percent} * least(xn1 - xp0, yn1 - yp0, xr1, yr1) >= {percent} * (xn0 + yn0)"
    )
    left = at.select("h", F.col("sb").alias("xsb"), F.col("pb").alias("xpb"), *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "r", "pos", "component", "d")])
    right = at.select("h", F.col("sb").alias("ysb"), F.col("pb").alias("ypb"), *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "r", "pos", "component", "d")])
    both = able.select("h", "xsb", "xpb", "ysb", "ypb").join(left, ["h", "xsb", "xpb"]).join(right, ["h", "ysb", "ypb"])
    return both.where(
        "x_component <> y_component AND x_id <> y_id"
        f" AND 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)"
        f" AND {100 + percent} * least(x_n - x_pos, y_n - y_pos, x_r, y_r) >= {percent} * (x_n + y_n)"
        f" AND NOT coalesce(abs(x_d - y_d) > {(100 - percent) / 100} + 1e-9, false)"
    ).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
