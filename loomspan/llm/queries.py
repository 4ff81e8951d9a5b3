"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.alignment import aligned
from loomspan.llm.common import shipped
from loomspan.llm.factors import digest as duplicates_digest
from loomspan.llm.langid import languages
from loomspan.llm.manifest import tampering
from loomspan.llm.mixing import mixed
from loomspan.llm.near_dedup import near_duplicates
from loomspan.llm.neighbours import nearest
from loomspan.llm.pieces import round_trip
from loomspan.llm.pitman_yor import scored
from loomspan.llm.repeats import digest as repeats_digest
from loomspan.llm.secret_scan import digest as secrets_digest
from loomspan.llm.sharding import sharded
from loomspan.llm.simhash import compared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public vocabulary file; LOOMSPAN_TOKENIZERS names another folder."""
    folder = os.environ.get("LOOMSPAN_TOKENIZERS")
    if folder is None:
        found = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(found.origin) if found and found.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text and its edited text; near fingerprints of every 50th document."""
    return compared(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans, and runs that the character models take for random."""
    return secrets_digest(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector."""
    return nearest(table(shipped(spark), sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fold 2 of 4 is held out of training."""
    return languages(table(shipped(spark), sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; fold 0 of 10 is held out of training."""
    return scored(table(shipped(spark), sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece counts, id digests and round trips of every document."""
    return round_trip(table(shipped(spark), sf_dir, "documents"), tokenizer())


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards along a Hilbert curve."""
    return sharded(table(shipped(spark), sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot for every document; sources are tempered by the power 0.7."""
    return mixed(table(shipped(spark), sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of repeated strings of 400 bytes."""
    return repeats_digest(table(shipped(spark), sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes: five words, Jaccard similarity of 0.75 or more."""
    return near_duplicates(table(shipped(spark), sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words of windows of 20 words that start earlier, too."""
    return duplicates_digest(table(shipped(spark), sf_dir, "documents")).drop("spans", "kept")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root; every seventh document (by CRC-32 of its id) is tampered with and must not verify."""
    return tampering(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two public tokenizers' tokens of every document meet, and how common its links are in the corpus."""
    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(tokenizer(name), "rb") as f:
            files.append(f.read())
    return aligned(table(shipped(spark), sf_dir, "documents"), *files)[0]


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base patterns' counts of every document, through the operator, whose other spans have no SQL."""
    return secrets_digest(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, bytes and slots of each shard: what the law says of counts, whatever the curve."""
    out = sharded(table(shipped(spark), sf_dir, "documents")).groupBy("shard")
    return out.agg(F.count("*").alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_secret_scan": op2_secret_scan,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_language_id": op4_language_id,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_hilbert_sharding": op10_hilbert_sharding,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "secret_base_counts": secret_base_counts,
    "shard_counts": shard_counts,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7]), lambda d, i: xor(d // 2, 3988292384 * (d % 2)))))"


def _leaf(n_chars: str) -> str:
    part = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    return "sha256(" + " || ".join(part(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")) + ")"


#: DuckDB's SQL for what it can express: all pairs that share a shingle, then all documents reachable.
ORACLE_SQL: dict[str, str] = {
    "op8_minhash_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
 n AS (SELECT doc_id, len(sh) AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS k FROM s),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
 m AS (SELECT a, min(b) AS c FROM r GROUP BY 1) SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN m ON a = doc_id""",
    "op11_substring_dedup": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 k AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS k FROM w WHERE len(ws) >= 20),
 r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM k),
 g AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE r > 1)),
 p AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w),
 t AS (SELECT p.doc_id, count(g.j) AS gone, string_agg(x, ' ' ORDER BY p.j) FILTER (WHERE g.j IS NULL) AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.j = p.j GROUP BY 1)
 SELECT doc_id, len(ws) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)""",
    "op12_merkle_manifest": f"""WITH RECURSIVE c AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf(f"(n_chars + CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END)")} AS bad FROM documents),
 d AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM c),
 t(k, level, i, m, h) AS (SELECT k, 0, i, m, leaf FROM d UNION ALL SELECT k, level + 1, i // 2, any_value(m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE m > 1 GROUP BY k, level, i // 2),
 r AS (SELECT k, h, count(*) OVER () AS m FROM t WHERE m = 1),
 u(level, i, m, h) AS (SELECT 0, k, m, h FROM r UNION ALL SELECT level + 1, i // 2, any_value(m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE m > 1 GROUP BY level, i // 2),
 p(doc_id, leaf, k, place, level, i, m, proof, folded) AS (SELECT doc_id, leaf, k, i, 0, i, m, '', bad FROM d UNION ALL
  SELECT p.doc_id, p.leaf, p.k, p.place, p.level + 1, p.i // 2, (p.m + 1) // 2, p.proof || coalesce(t.h, ''), sha256(CASE WHEN p.i % 2 = 1 THEN t.h || p.folded ELSE p.folded || coalesce(t.h, '') END)
  FROM p LEFT JOIN t ON t.k = p.k AND t.level = p.level AND t.i = p.i + 1 - 2 * (p.i % 2) WHERE p.m > 1),
 q(doc_id, leaf, subroot, level, i, m, proof, folded) AS (SELECT doc_id, leaf, r.h, 0, k, r.m, proof, folded FROM p JOIN r USING (k) WHERE p.m = 1 UNION ALL
  SELECT q.doc_id, q.leaf, q.subroot, q.level + 1, q.i // 2, (q.m + 1) // 2, q.proof || coalesce(u.h, ''), sha256(CASE WHEN q.i % 2 = 1 THEN u.h || q.folded ELSE q.folded || coalesce(u.h, '') END)
  FROM q LEFT JOIN u ON u.level = q.level AND u.i = q.i + 1 - 2 * (q.i % 2) WHERE q.m > 1)
 SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.h AS verified FROM q, u WHERE q.m = 1 AND u.m = 1""",
    "secret_base_counts": r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 8)) AS BIGINT) AS n_assign,
 CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 16)) AS BIGINT) AS n_access,
 CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 32)) AS BIGINT) AS n_hex FROM documents""",
    "shard_counts": """WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT CAST(i AS INTEGER) AS shard, ceil((i + 1) * n / 8) - ceil(i * n / 8) AS c FROM n, range(8) AS t(i))
 SELECT shard, CAST(c AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(c - 1 AS BIGINT) AS last FROM s WHERE c > 0""",
}
