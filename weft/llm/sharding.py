"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash of the id.  A bucket over the byte limit splits on one
bit more, and only that bucket; shards are the shallowest prefixes that fit.  Bytes are summed once by a prefix
of as many bits as an even table needs and some spare; the sums of all shorter prefixes follow from those.
Buckets that are too large even there go on alone, some bits at a time, until all HASH_BITS are used.  What the
bits cannot split (rows of one hash, hence mostly of one id) is cut into overflow parts that fit as well, by
running sums over its counts of equal rows, so that no task holds a hot id.

Unless it is given, the limit grows with the square root of the corpus, so that shards become larger and more
numerous alike: 1.4 MB of 0.5 GB, 640 MB of 100 TB.

Defined cases: null texts have no bytes; null ids hash as 'null'; a document over half the limit is a part of
its own where rows are cut into parts, and a document over the limit the only kind of part that exceeds it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.exchange import checkpoint

HASH_BITS, SPARE_BITS, MORE_BITS, STEP, SALTS = 60, 5, 8, 8, 64
LEAST_LIMIT, GROWTH = 64 << 10, 64


def limit_for(total: int) -> int:
    """The byte limit of a shard for so many bytes of text."""
    return max(LEAST_LIMIT, int(GROWTH * total**0.5))


def _leaves(cells: DataFrame, above: int, deep: int, limit: int) -> DataFrame:
    """cell, depth, node and node_bytes: the shallowest prefix that fits, or else the cell itself, for cells of deep bits.

    Prefixes of above bits and fewer are known to be over the limit, unless above is 0.  STEP bits are worked out
    at a time, from sums of that many bits, so a prefix has at most 2**STEP descendants in a step.
    """
    left, found = cells.select("cell", "bytes"), []
    for upper in range(above, deep, STEP) if deep else [0]:
        low = min(deep, upper + STEP)
        coarse = left.groupBy(F.expr(f"shiftright(cell, {deep - low})").alias("c")).agg(F.sum("bytes").alias("bytes"))
        depths = F.sequence(F.lit(upper if upper == above else upper + 1), F.lit(low))
        levels = coarse.withColumn("depth", F.explode(depths)).withColumn("node", F.expr(f"shiftright(c, {low} - depth)"))
        nodes = levels.groupBy("depth", "node").agg(F.sum("bytes").alias("node_bytes"))
        fits = levels.join(nodes, ["depth", "node"]).where(f"node_bytes <= {limit}" + (f" OR depth = {deep}" if low == deep else ""))
        leaf = fits.groupBy("c").agg(F.min(F.struct("depth", "node", "node_bytes")).alias("leaf"))
        at = left.withColumn("c", F.expr(f"shiftright(cell, {deep - low})")).join(leaf, "c", "left")
        at = checkpoint(at) if low < deep else at
        found.append(at.where("leaf IS NOT NULL").select("cell", "leaf.*"))
        left = at.where("leaf IS NULL").select("cell", "bytes")
    return reduce(DataFrame.unionByName, found)


def _parts(over: DataFrame, limit: int) -> DataFrame:
    """Rows of buckets that hashes cannot split, with their part: small rows by running sums of half the limit, others alone.

    Rows of one id and size are interchangeable, so their order is by salts; running sums are taken over counts
    of (hash, id, size, salt), then within each of those.
    """
    same, half = ["node", "h", "doc_id", "n_bytes"], limit // 2
    counts = over.groupBy(*same, "salt").agg(F.count("*").alias("rows"))
    small = F.col("n_bytes") <= half
    before = Window.partitionBy("node").orderBy("h", "doc_id", "n_bytes", "salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({
        "upto": F.coalesce(F.sum(F.when(small, F.col("n_bytes") * F.col("rows")).otherwise(0)).over(before), F.lit(0)),
        "alone": F.coalesce(F.sum(F.when(small, 0).otherwise(F.col("rows"))).over(before), F.lit(0)),
    })
    name = F.xxhash64(*same, "salt")
    own = F.row_number().over(Window.partitionBy("place").orderBy("salt"))
    rows = over.withColumn("place", name).withColumn("own", own).join(counts.select(name.alias("place"), "upto", "alone"), "place")
    part = F.when(small, F.ceil((F.col("upto") + F.col("own") * F.col("n_bytes")) / half)).otherwise(-(F.col("alone") + F.col("own")))
    return rows.withColumn("part", part.cast("long")).drop("place", "own", "upto", "alone")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, depth, prefix (of depth bits, as '0101'), part and shard_bytes, per row of docs.

    With carry, each row also has its own row of docs, as the struct row.
    """
    rest = ["row"] if carry else []
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    salt = F.floor(F.rand(7) * SALTS).cast("int")
    rows = checkpoint(docs.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), h.alias("h"), salt.alias("salt"), *row))
    total = int(rows.agg(F.sum("n_bytes")).first()[0] or 0)
    limit = limit_for(total) if limit is None else limit
    deep, above, done = min(HASH_BITS, max(0, (total // limit).bit_length()) + SPARE_BITS), 0, []
    while True:
        rows = rows.withColumn("cell", F.shiftright("h", HASH_BITS - deep))
        cells = checkpoint(rows.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), (F.min("h") != F.max("h")).alias("splits")))
        leaves = _leaves(cells, above, deep, limit).join(cells.select("cell", "splits"), "cell")
        rows = rows.join(leaves, "cell").drop("cell")
        go_on = F.col("splits") & (F.col("node_bytes") > limit) & (F.col("depth") == deep)
        if deep == HASH_BITS or not cells.where(f"splits AND bytes > {limit}").take(1):
            done.append(rows)
            break
        rows = checkpoint(rows)
        done.append(rows.where(~go_on))
        rows = rows.where(go_on).drop("depth", "node", "node_bytes", "splits")
        above, deep = deep, min(HASH_BITS, deep + MORE_BITS)
    kept = ["doc_id", "n_bytes", "h", "salt", *rest, "depth", "node", "node_bytes"]
    rows = done[0].select(*kept)
    for more in done[1:]:
        rows = rows.unionByName(more.select(*kept))
    over = _parts(rows.where(f"node_bytes > {limit}"), limit)
    rows = rows.where(f"node_bytes <= {limit}").withColumn("part", F.lit(0).cast("long")).unionByName(over)
    sizes = rows.groupBy("depth", "node", "part").agg(F.sum("n_bytes").alias("shard_bytes"))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("node"), F.col("depth"), F.lit("0")))
    return rows.join(sizes, ["depth", "node", "part"]).select("doc_id", "n_bytes", F.col("depth").cast("int"), bits.alias("prefix"), "part", "shard_bytes", *rest)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None) -> None:
    """docs as Parquet under path, one folder per shard; every row goes to the shard of its own."""
    of = shard(docs, id_col, text_col, limit, carry=True).select("row.*", F.concat_ws("-", "depth", "prefix", "part").alias("shard"))
    of.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
