"""The registered queries ``opN_<name>`` of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import bpe, embedding, exact_dedup, lines, minhash, packing, quality, sharding, substring, warc
from lodeworks.llm.common import settled


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    coded = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), path), path)
    return settled(coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "bpe")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("text_md5")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_md5")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    return out.select("record_id", "canonical_url", "ts", "refers_to", "outcome", shown.alias("headers"), "payload_digest")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.cut_repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return settled(out.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n_spans"), spans.alias("spans"), "source_ids", F.sha2("kept_text", 256).alias("kept_sha256")), "substring")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return settled(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"), "packing")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    forest = quality.train(documents, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(documents, forest)
    scored = settled(scored, "quality")
    return scored.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_bpe, op2_sharding, op3_exact_dedup, op4_minhash, op5_embeddings, op6_warc_revisits, op7_substring, op8_line_dedup, op9_packing, op10_quality]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op4_minhash": OP4, "op5_embeddings": OP5, "op6_warc_revisits": OP6, "op8_line_dedup": OP8}


OP3 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM n WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""

OP5 = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND array_cosine_similarity(x.e, y.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node AND r.root < l.b),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN m ON node = vec_id
"""

OP6 = r"""
WITH p AS (
  SELECT page_id AS n, md5(coalesce(html, '')) AS digest, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
q AS (
  SELECT n, digest,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))) AS parts
  FROM p),
c AS (
  SELECT n, digest, place || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END AS canonical_url,
    CASE WHEN n % 5 <> 0 THEN '"' || substr(digest, 1, 16) || '"' END AS etag, CASE WHEN n % 35 <> 0 THEN CAST(n * 10 AS VARCHAR) END AS modified
  FROM q),
r AS (SELECT *, n * 10 AS ts FROM c WHERE n % 13 <> 0),
v AS (SELECT n, canonical_url, n * 10 + CASE WHEN n % 11 = 0 THEN -5 ELSE 5 END AS ts,
        CASE WHEN n % 7 = 0 THEN '"stale"' ELSE etag END AS bare_etag, CASE WHEN n % 7 = 0 THEN '"stale"' ELSE 'W/' || etag END AS etag, modified
      FROM c),
b AS (SELECT v.*, r.n AS rn, r.ts AS rts, r.etag AS retag, r.modified AS rmod, r.digest AS rdigest,
        coalesce(v.bare_etag = r.etag, v.modified = r.modified) AS agree
      FROM v ASOF LEFT JOIN r ON v.canonical_url = r.canonical_url AND v.ts > r.ts),
o AS (SELECT *, CASE WHEN rn IS NULL THEN 'no_response' WHEN agree IS NULL THEN 'no_validator' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS outcome FROM b)
SELECT 'v' || n AS record_id, canonical_url, ts, CASE WHEN outcome = 'resolved' THEN 'r' || rn END AS refers_to, outcome,
  CASE WHEN outcome = 'resolved' THEN concat_ws('; ', 'cache-control: max-age=120', 'content-type: text/html', 'date: ' || ts,
    'etag: ' || coalesce(etag, retag), 'last-modified: ' || coalesce(modified, rmod)) END AS headers,
  CASE WHEN outcome = 'resolved' THEN rdigest END AS payload_digest
FROM o
"""

OP8 = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s),
k AS (SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.owner AS lost FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

# 5-word shingles with all their words; only pairs that share a shingle can be similar.
OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles FROM w),
z AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(shingles)) AS sh FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM e x JOIN e y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * common >= 75 * (za.n + zb.n - common)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM z UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.node AND r.root < g.b),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM z JOIN m ON node = doc_id
"""
