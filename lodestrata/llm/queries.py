"""The queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import free_name, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]

#: Session setting that names the folder of the token counts that runs share; each call starts a new one where it is unset.
TOKEN_CACHE = "spark.lodestrata.tokenCache"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in 16 batches, are compacted, and come back from the newest manifest's shards."""
    from lodestrata.llm.shards import ShardStore

    store = ShardStore(spark, shared_dir(spark, "shards"), target_bytes=64 << 20)
    docs = table(spark, sf_dir, "documents")
    arrival = free_name(docs, "arrival")
    store.append(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(16))), by=arrival)
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.jaccard import near_copies

    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.tokencount import TokenCache, token_counts

    place = spark.conf.get(TOKEN_CACHE, None) or shared_dir(spark, "token-cache")
    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), TokenCache(spark, place))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.toxicity import flagged

    return flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestrata.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.langid import language_id

    return language_id(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose decimal doc_id has a CRC-32 that 5 divides are verified with A-Z of their text lower-cased."""
    from lodestrata.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


#: Levels of 16 by recursion, first of the sources' trees, then of the top tree; CRC-32 bit by bit.
OP11_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(4294967295, list_reduce(list_prepend(4294967295, range(8 * length(doc_id::VARCHAR))), lambda c, j: CASE WHEN ((CASE WHEN j % 8 = 0 THEN xor(c, ascii((doc_id::VARCHAR)[(j // 8 + 1)::BIGINT])) ELSE c END) & 1) = 1
      THEN xor((CASE WHEN j % 8 = 0 THEN xor(c, ascii((doc_id::VARCHAR)[(j // 8 + 1)::BIGINT])) ELSE c END) >> 1, 3988292384) ELSE (CASE WHEN j % 8 = 0 THEN xor(c, ascii((doc_id::VARCHAR)[(j // 8 + 1)::BIGINT])) ELSE c END) >> 1 END)) % 5 = 0 AS tampered
  FROM documents),
hashed AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text) || ':' || CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS changed FROM docs),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS total FROM hashed),
low AS (
  SELECT 0 AS level, s, i, total, leaf AS d FROM numbered
  UNION ALL
  SELECT level + 1, s, i // 16, (total + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE total > 1 GROUP BY level, s, i // 16, total),
top AS (
  SELECT 0 AS level, 0 AS s, s AS i, (SELECT max(s) + 1 FROM numbered) AS total, d FROM low WHERE total = 1
  UNION ALL
  SELECT level + 1, s, i // 16, (total + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE total > 1 GROUP BY level, s, i // 16, total),
nodes AS (SELECT level, s, i, total, d FROM low WHERE total > 1 UNION ALL SELECT 1000 + level, 0, i, total, d FROM top),
climb AS (
  SELECT doc_id, leaf, s AS source_no, CASE WHEN total = 1 THEN 1000 ELSE 0 END AS level, CASE WHEN total = 1 THEN 0 ELSE s END AS s, CASE WHEN total = 1 THEN s ELSE i END AS i, changed AS d, '' AS proof, false AS done FROM numbered
  UNION ALL
  SELECT c.doc_id, c.leaf, c.source_no,
    CASE WHEN c.level < 1000 AND n.total <= 16 THEN 1000 ELSE c.level + 1 END, CASE WHEN c.level < 1000 AND n.total > 16 THEN c.s ELSE 0 END, CASE WHEN c.level < 1000 AND n.total <= 16 THEN c.source_no ELSE c.i // 16 END,
    sha256(string_agg(CASE WHEN n.i = c.i THEN c.d ELSE n.d END, '' ORDER BY n.i)), c.proof || coalesce(string_agg(n.d, '' ORDER BY n.i) FILTER (n.i <> c.i), ''), false
  FROM climb c JOIN nodes n ON n.level = c.level AND n.s = c.s AND n.i // 16 = c.i // 16 AND n.total > 1
  GROUP BY c.doc_id, c.leaf, c.source_no, c.level, c.s, c.i, c.d, c.proof, n.total),
root AS (SELECT d FROM top WHERE total = 1),
ended AS (SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY level DESC) AS k FROM climb)
SELECT e.doc_id, e.leaf, l.d AS subroot, root.d AS root, sha256(e.proof) AS proof_sha256, e.d AS folded_root, e.d = root.d AS verified
FROM ended e JOIN low l ON l.s = e.source_no AND l.total = 1, root WHERE e.k = 1"""


def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.minmax import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) e ON e.x = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
parsed AS (SELECT *, regexp_extract_all(t, '[^ 	-]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
failing AS (SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails FROM parsed),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM failing LEFT JOIN said USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[1 : step - 1] AS earlier FROM orders, range(1, 6) r(step)),
told AS (SELECT part, filter_order, step, f, good, toxic, fails, contains(fails, f) AS fails_here, earlier <> '' AND length(translate(fails, earlier, '')) < length(fails) AS gone FROM docs, steps),
counted AS (SELECT part, filter_order, step, f, count(*) FILTER (NOT fails_here AND NOT gone) AS kept, count(*) FILTER (fails_here AND NOT gone) AS removed, count(*) FILTER (fails_here AND gone) AS redundant, count(*) FILTER (fails = f) AS unique_fails,
  count(*) FILTER (fails_here AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (fails_here AND NOT gone AND toxic = 1) AS toxic_lost FROM told GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_compaction, op3_leaks, op4_jaccard_join, op5_token_counts, op6_pii, op7_toxicity, op8_quality_rules, op9_pack, op10_language_id,
        op11_merkle_manifest, op12_minmax_dedup, op13_filter_audit,
    )
}  # fmt: skip
ORACLE_SQL: dict[str, str] = {"op2_compaction": OP2_SQL, "op11_merkle_manifest": OP11_SQL, "op12_minmax_dedup": OP12_SQL, "op13_filter_audit": OP13_SQL}
