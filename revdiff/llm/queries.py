"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, langid, lattice_lm, minhash, neighbours, packing, prefix_trie, quality, resample, secret_scan, sharding, token_count
from .storage import staged

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of at least 0.85, all of ``documents``."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


OP1_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ASCII_UPPER}', '{_ASCII_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT a, b FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
"""

def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words of ``benchmark`` in all of ``documents``."""
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP2_SQL = rf"""
WITH low AS (
  SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), '{_ASCII_UPPER}', '{_ASCII_UPPER.lower()}') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, translate(coalesce(text, ''), '{_ASCII_UPPER}', '{_ASCII_UPPER.lower()}') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
win AS (
  SELECT DISTINCT id AS item_id, least(len(w), 13) AS n,
    unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS key
  FROM w WHERE kind = 1 AND len(w) > 0),
pos AS (SELECT id AS doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w WHERE kind = 0),
occ AS (
  SELECT doc_id, p, win.n, item_id
  FROM (SELECT doc_id, p, l.n, array_to_string(w[p:p + l.n - 1], ' ') AS key
        FROM pos, (SELECT DISTINCT n FROM win) l WHERE p + l.n - 1 <= len(w)) q
  JOIN win ON win.key = q.key AND win.n = q.n),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT doc_id, p, n FROM occ)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.id LEFT JOIN items ON items.doc_id = w.id WHERE w.kind = 0
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of all of ``documents``."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all of ``documents``."""
    return lattice_lm.score_documents(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all of ``documents``."""
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all of ``embeddings`` for each row whose id is divisible by 100."""
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 7 of near-equal bytes."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 8)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of all of ``documents``, as ``labels.quality`` marks it."""
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all of ``documents``; the counts are those of the base spans."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of 1024 tokens; for the ids their checksum stands."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), size=1024).drop("ids")


#: crc32 in SQL: a table ``l`` of 256 remainders, and the checksum of bytes written in hexadecimal (``h``).
_CRC_TABLE = """step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS l FROM step WHERE k = 8)"""
_CRC_OF_HEX = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])))"""


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, each rebuilt after the first turns of another one."""
    ordered = staged(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(*prefix_trie.rebuilt_turns(ordered, span=5, most=9))


OP11_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
    md5(coalesce(role, '')) || md5(coalesce(text, '')) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, n, {_CRC_OF_HEX} % 9 AS h FROM (SELECT conv_id, count(*) AS n, hex(encode(CAST(conv_id AS VARCHAR))) AS h FROM t GROUP BY conv_id), crc),
m AS (SELECT c.conv_id, c.h, least(c.h, coalesce(o.n, 0)) AS m FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 5),
s AS (
  SELECT m.conv_id, k, x, b FROM m JOIN t ON t.conv_id = m.conv_id - m.conv_id % 5 WHERE k <= m.m
  UNION ALL SELECT m.conv_id, m.m + k - m.h, x, b FROM m JOIN t ON t.conv_id = m.conv_id WHERE k > m.h),
p AS (
  SELECT conv_id, k AS depth, string_agg(x, '') OVER w AS path, b FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY k)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT conv_id, max(depth) AS n FROM p GROUP BY conv_id),
node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY path, depth),
kids AS (SELECT path[:64 * (depth - 1)] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
up AS (SELECT path[:64 * d] AS path, path AS low FROM (SELECT path, unnest(range(depth + 1)) AS d FROM node)),
sub AS (
  SELECT up.path, count(*) AS n_nodes, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * b) AS BIGINT) AS saved_tokens
  FROM up JOIN node ON node.path = up.low LEFT JOIN kids ON kids.path = up.low GROUP BY up.path)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_nodes, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN sub USING (path) LEFT JOIN kids USING (path) LEFT JOIN node above ON node.depth > 0 AND above.path = node.path[:64 * (node.depth - 1)]
"""


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity of at least 0.85, all of ``documents``."""
    return jaccard_join.similar_sets(_table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


OP12_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ASCII_UPPER}', '{_ASCII_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT a, b FROM u UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of ``documents`` of 20 words or more drawn towards ``benchmark``, by single words in 10,000 buckets."""
    found = resample.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, min_words=20, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
txt AS (
  SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), '{_ASCII_UPPER}', '{_ASCII_UPPER.lower()}') AS t FROM documents
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), '{_ASCII_UPPER}', '{_ASCII_UPPER.lower()}') FROM benchmark),
w AS (SELECT row_number() OVER () AS r, kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM txt),
f AS (SELECT r, kind, unnest(w) AS f FROM w),
hexed AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM f),
coded AS (
  SELECT f, {_CRC_OF_HEX} % 10000 AS bucket FROM hexed, crc),
fb AS (SELECT r, kind, bucket FROM f JOIN coded USING (f)),
total AS (SELECT count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM fb),
gain AS (
  SELECT bucket, floor(1000 * ln((n.t + 1)::DOUBLE * (total.s + 10000) / ((n.s + 1)::DOUBLE * (total.t + 10000)))) AS g
  FROM (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM fb GROUP BY bucket) n, total),
mean AS (SELECT r, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM fb JOIN gain USING (bucket) WHERE kind = 0 GROUP BY r),
d AS (
  SELECT r, id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST(concat('0x', left(sha256('2024:' || coalesce(CAST(id AS VARCHAR), '')), 8)) AS BIGINT) AS h
  FROM w LEFT JOIN mean USING (r) WHERE kind = 0),
scored AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_lm_scores": op4_lm_scores,
    "op5_language_id": op5_language_id,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {"op1_minhash_near_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op11_conversation_prefix_trie": OP11_SQL, "op12_ngram_jaccard_join": OP12_SQL, "op13_importance_resampling": OP13_SQL}
