"""The corpus operators' registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, decontam, langid, license, linededup, neardup, pii, quality, shards, topk
from tidemill.session import read_table


def remainder(n: int):
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(read_table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign(read_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def held_out(n: int, m: int):
    """Whether a row's remainder mod n is m. A row without an id has none: it isn't held out, nor learned from."""
    return F.coalesce(remainder(n) == m, F.lit(False)).alias("held_out")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, remainder(3) != 1)
    return quality.predict(docs, model).select("doc_id", held_out(3, 1), "score", "predicted")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs, remainder(4) != 2)
    return langid.predict(docs, model).select("doc_id", held_out(4, 2), "lang_pred", "score", "rejected")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read_table(spark, sf_dir, "documents"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source / thousand / doc_id.txt; a null is `none` there, and its doc_id null."""
    docs = read_table(spark, sf_dir, "documents")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    path = F.concat_ws("/", name(F.col("source")), name(F.expr("doc_id div 1000")), F.concat(name(F.col("doc_id")), F.lit(".txt")))
    files = license.scan(docs.select(path.alias("path"), "text"))
    return files.select(F.regexp_extract("path", "([^/]*)[.]txt$", 1).try_cast("long").alias("doc_id"), "path", "license", "score", "origin", "evidence")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_decontamination, op3_minhash, op4_sharding, op5_topk, op6_quality, op7_langid, op8_line_dedup, op9_license, op10_pii)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 13 words (or a whole shorter item) on both sides, joined as strings.
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, dw.n, i FROM dw JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: All pairs that share a shingle, and the links' transitive closure by least id.
OP3_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(3, len(w))], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(len(w) - least(3, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT id, b FROM reach JOIN both_ways ON other = a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id, min(other) = d.doc_id AS kept
FROM d JOIN reach ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

#: CRC-32 by its table, made bit by bit; then the same ranks, positions and cuts with plain windows.
OP4_SQL = """
WITH RECURSIVE t8(i, k, v) AS (SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t8 WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM t8 WHERE k = 8),
b AS (SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
        string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ') AS xs FROM documents),
d AS (SELECT doc_id, source, h, size, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || x AS BIGINT) FOR x IN xs IF x <> '']), lambda a, x: xor(t[1 + (xor(a, x) & 255)], a >> 8)), 4294967295) AS text_crc32 FROM b, tab),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS position FROM d),
g AS (SELECT *, row_number() OVER (ORDER BY position, h, doc_id, text_crc32, size) - 1 AS g, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(g * 24 // n AS INTEGER) AS shard, g - (g * 24 // n * n + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM g
"""

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_KEY = _LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")

OP8_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, line, i, {_KEY} AS key FROM l),
c AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT doc_id, line, i, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLE = {"op2_decontamination": OP2_SQL, "op3_minhash": OP3_SQL, "op4_sharding": OP4_SQL, "op5_topk": OP5_SQL, "op8_line_dedup": OP8_SQL}
