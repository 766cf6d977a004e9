"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thalweg.llm import fingerprints, hard_negatives, html_text, line_dedup, merkle, mixing, neardup, packing, quality, secret_scan, sharding, tokens, warc
from thalweg.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_classes(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_table(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.embedding_negatives(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = [op1_token_counts, op2_html_extraction, op3_document_fingerprints, op4_warc, op5_source_mixing, op6_quality_rules, op7_secret_scans, op8_packing, op9_simhash_near_dedup, op10_sharding, op11_merkle_manifest, op12_line_dedup, op13_hard_negatives, pipeline]
    return {q.__name__: q for q in own}


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, {k} * 10 + 1, 10))::BIGINT >> {s}) & 31)::INT, 1)"
_BASE32 = " || ".join(_DIGIT.format(k=k, s=s) for k in range(4) for s in range(35, -1, -5))

OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""


OP11_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS tree, text,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
                     lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS reg,
         concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
  FROM documents),
own AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS presented
  FROM (SELECT *, CASE WHEN xor(reg, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown FROM docs)),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS nodes FROM own),
up AS (
  SELECT tree, 0 AS level, pos, nodes, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, (nodes + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE nodes > 1 GROUP BY tree, level, pos // 3, nodes),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS tree_pos, count(*) OVER () AS trees FROM up WHERE nodes = 1),
over_ AS (
  SELECT 0 AS level, tree_pos AS pos, trees AS nodes, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (nodes + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM over_ WHERE nodes > 1 GROUP BY level, pos // 3, nodes),
beside AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM up a JOIN up b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.nodes > 1 GROUP BY 1, 2, 3),
over_beside AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM over_ a JOIN over_ b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.nodes > 1 GROUP BY 1, 2),
steps AS (
  SELECT p.tree, p.pos, b.level, b.before, b.after FROM placed p JOIN beside b ON b.tree = p.tree AND b.pos = p.pos // (3 ** b.level)::BIGINT
  UNION ALL
  SELECT p.tree, p.pos, 1000 + b.level, b.before, b.after FROM placed p JOIN subroots s ON s.tree = p.tree JOIN over_beside b ON b.pos = s.tree_pos // (3 ** b.level)::BIGINT),
ordered AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY level) AS k, count(*) OVER (PARTITION BY tree, pos) AS n FROM steps),
folds AS (
  SELECT tree, pos, 0 AS k, presented AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.pos, o.k, sha256(o.before || f.digest || o.after) FROM folds f JOIN ordered o ON o.tree = f.tree AND o.pos = f.pos AND o.k = f.k + 1),
folded AS (SELECT tree, pos, max_by(digest, k) AS folded_root FROM folds GROUP BY 1, 2),
proofs AS (SELECT tree, pos, string_agg(before || after, '' ORDER BY k) AS proof FROM ordered GROUP BY 1, 2)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = r.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN folded f USING (tree, pos) LEFT JOIN proofs q USING (tree, pos) CROSS JOIN (SELECT digest FROM over_ WHERE nodes = 1) r
"""

OP12_SQL = """
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
shared AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
decided AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.top AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM decided GROUP BY doc_id
"""

OP13_SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other, b.label, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM own a, own b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, anchor_label, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)::INT AS rank, n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> p.anchor_label AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    """The rest can't be expressed in SQL."""
    return {"op4_warc": OP4_SQL, "op11_merkle_manifest": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}


