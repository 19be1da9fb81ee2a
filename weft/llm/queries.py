"""The queries of this subpackage, with their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.rlz import dedup_substrings

    return dedup_substrings(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 12), ' ') AS block FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d)),
f AS (SELECT block, min(doc_id) AS first_id FROM b GROUP BY block),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT b.doc_id, unnest(range(b.s, b.s + 13)) AS i FROM b JOIN f USING (block) WHERE f.first_id < b.doc_id)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT w.doc_id, count(*) AS n_kept, string_agg(w.word, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.jaccard import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
  SELECT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0))),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * c >= 85 * (zx.n + zy.n - c)),
e AS (SELECT x AS u, y AS v FROM l UNION SELECT y, x FROM l),
r AS (SELECT u AS node, u AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node) m USING (doc_id)
"""


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.binary_codes import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE g AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT u AS node, u AS reach FROM l UNION SELECT r.node, l.v FROM r JOIN l ON l.u = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node), k AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.u = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.cross_polytope import nearest

    return nearest(_read(spark, sf_dir, "embeddings"))



def op2_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.quality import quality

    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s0),
s2 AS (SELECT *, 3 * source_size / weight AS fill FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY fill, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY fill, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s2),
s4 AS (SELECT source, source_size, coalesce(least(3.0::DOUBLE * source_size, weight * (SELECT arg_min(lv, fill) FROM s3 WHERE lv <= fill)), 0) AS target FROM s3),
v0 AS (SELECT source, length(bin(size)) AS w, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
v1 AS (SELECT v0.source, w, words, source_size, target, coalesce(sum(words) OVER (PARTITION BY v0.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over,
    sum(words * w) OVER (PARTITION BY v0.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM v0 JOIN s4 ON v0.source IS NOT DISTINCT FROM s4.source),
v2 AS (SELECT *, CASE WHEN rest > 0 THEN (target - 3 * over) / rest END AS lv FROM v1),
v3 AS (SELECT source, arg_max(lv, w) AS lv FROM v2 WHERE lv * w <= 3 GROUP BY source),
v4 AS (SELECT v2.source, w, words, source_size, target, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, coalesce(w * v3.lv, 3)) ELSE 0 END AS r FROM v2 LEFT JOIN v3 ON v2.source IS NOT DISTINCT FROM v3.source),
s5 AS (SELECT *, target - sum(floor(r) * words) OVER (PARTITION BY source) AS missing FROM v4),
a AS (SELECT d.*, source_size, target, floor(r) AS whole, r - floor(r) AS p, missing FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source AND length(bin(d.size)) = w),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS rank FROM a WHERE p > 0),
b AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id) AS upto FROM q UNION ALL SELECT *, NULL, NULL FROM a WHERE p <= 0),
c AS (SELECT *, coalesce(2 * upto - size <= 2 * missing, false) AS picked FROM b),
g AS (SELECT source, any_value(missing) - sum(CASE WHEN picked THEN size ELSE 0 END) AS gap FROM c WHERE p > 0 GROUP BY source),
f AS (SELECT c.source, first(doc_id ORDER BY abs(gap - CASE WHEN picked THEN -size ELSE size END), rank, doc_id) AS flip FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
    WHERE p > 0 AND size > 0 AND abs(gap - CASE WHEN picked THEN -size ELSE size END) < abs(gap) GROUP BY c.source)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN picked <> (flip IS NOT NULL AND flip = doc_id) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c LEFT JOIN f ON c.source IS NOT DISTINCT FROM f.source
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.html import extract

    return extract(_read(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.sharding import shard

    return shard(_read(spark, sf_dir, "documents"))


OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
k AS (SELECT greatest(65536, CAST(floor(64 * sqrt(coalesce(sum(n_bytes), 0))) AS BIGINT)) AS most FROM d),
t AS (SELECT doc_id, n_bytes, h, 0 AS depth, CAST(0 AS BIGINT) AS node, sum(n_bytes) OVER () AS node_bytes, min(h) OVER () < max(h) OVER () AS splits FROM d
  UNION ALL
  SELECT doc_id, n_bytes, h, depth + 1, h >> (59 - depth), sum(n_bytes) OVER w, min(h) OVER w < max(h) OVER w
  FROM t, k WHERE node_bytes > most AND depth < 60 AND (splits OR depth < (SELECT CASE WHEN sum(n_bytes) // most = 0 THEN 0 ELSE CAST(floor(log2(sum(n_bytes) // most)) AS INTEGER) + 1 END + 5 FROM d, k GROUP BY most))
  WINDOW w AS (PARTITION BY h >> (59 - depth))),
l AS (SELECT t.*, most FROM t, k WHERE node_bytes <= most OR depth = 60 OR NOT (splits OR depth < (SELECT CASE WHEN sum(n_bytes) // most = 0 THEN 0 ELSE CAST(floor(log2(sum(n_bytes) // most)) AS INTEGER) + 1 END + 5 FROM d, k GROUP BY most))),
o AS (SELECT *, CASE WHEN node_bytes <= most THEN 0 WHEN n_bytes <= most // 2
    THEN ceil(sum(CASE WHEN n_bytes <= most // 2 THEN n_bytes ELSE 0 END) OVER w / CAST(most // 2 AS DOUBLE)) ELSE -sum(CASE WHEN n_bytes <= most // 2 THEN 0 ELSE 1 END) OVER w END AS part
  FROM l WINDOW w AS (PARTITION BY depth, node ORDER BY h, doc_id, n_bytes ROWS UNBOUNDED PRECEDING))
SELECT doc_id, n_bytes, depth, right(repeat('0', 60) || bin(node), depth) AS prefix, CAST(part AS BIGINT) AS part, CAST(sum(n_bytes) OVER (PARTITION BY depth, node, part) AS BIGINT) AS shard_bytes FROM o
"""


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.chat import link_quotes

    return link_quotes(_read(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS raw, regexp_matches(coalesce(text, ''), '(^|\n)\s*>') AS quotes FROM conversations),
l AS (SELECT conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^\s*(>[\s>]*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^\s*(>[\s>]*)', '') AS body
  FROM (SELECT DISTINCT conv_id, turn, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM m WHERE quotes)),
o AS (SELECT conv_id, turn, coalesce(regexp_replace(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), '^\n+|\n+$', '', 'g'), '') AS own, count(*) FILTER (level > 0) AS n_quoted FROM l GROUP BY ALL),
t AS (SELECT m.conv_id, m.turn, m.role, CASE WHEN quotes THEN own ELSE raw END AS text, CASE WHEN quotes THEN n_quoted ELSE 0 END AS n_quoted
  FROM m LEFT JOIN o ON quotes AND m.conv_id IS NOT DISTINCT FROM o.conv_id AND m.turn IS NOT DISTINCT FROM o.turn),
p AS (SELECT conv_id, turn, level, string_agg(body, chr(10) ORDER BY i) AS body FROM (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS island FROM l WHERE level > 0) GROUP BY conv_id, turn, level, island),
a AS (SELECT DISTINCT conv_id, turn, level, kind, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS body
  FROM (SELECT conv_id, turn, level, 0 AS kind, body FROM p UNION ALL SELECT conv_id, turn, level, 1, unnest(string_split(body, chr(10))) FROM p) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
u AS (SELECT conv_id, turn, unnest(list_concat([text], regexp_split_to_array(text, '\n\s*\n'), string_split(text, chr(10)))) AS body FROM t),
f AS (SELECT conv_id, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS body, min(turn) AS said FROM u GROUP BY 1, 2),
r AS (SELECT conv_id, turn, first(said ORDER BY level, kind, said DESC) AS reply_to FROM a JOIN f USING (conv_id, body) WHERE body <> '' AND said < turn GROUP BY conv_id, turn),
c AS (SELECT conv_id, turn, reply_to AS up FROM r UNION ALL SELECT c.conv_id, c.turn, r.reply_to FROM c JOIN r ON r.conv_id = c.conv_id AND r.turn = c.up),
z AS (SELECT conv_id, turn, min(up) AS thread_root FROM c GROUP BY conv_id, turn)
SELECT t.conv_id, t.turn, role, text, CAST(n_quoted AS INTEGER) AS n_quoted, reply_to, coalesce(thread_root, t.turn) AS thread_root,
  CASE WHEN t.conv_id IS NOT NULL AND t.turn IS NOT NULL THEN rank() OVER (PARTITION BY t.conv_id, t.turn IS NULL ORDER BY coalesce(thread_root, t.turn), t.turn) END AS position
FROM t LEFT JOIN r USING (conv_id, turn) LEFT JOIN z USING (conv_id, turn)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_length_packing": op2_length_packing,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_quality": op4_quality,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_sharding": op9_sharding,
    "op10_chat": op10_chat,
}
SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op3_embedding_near_dedup": OP3_SQL, "op6_ngram_jaccard": OP6_SQL, "op7_mixing": OP7_SQL, "op9_sharding": OP9_SQL, "op10_chat": OP10_SQL}
