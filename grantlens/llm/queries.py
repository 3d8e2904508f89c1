"""The registered ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontam, linededup, merkle, minhash, packing, phrases, rules, slots, superkmer, tokencount, tokenfile, vecjoin
from .common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, each filled with a seed's BM25 neighbours."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors of one label at a cosine of 0.98 or more, and their components."""
    return vecjoin.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, by a rebalanced map of virtual slots."""
    placed = slots.shard_documents(_table(spark, sf_dir, "documents"), shared_path(spark, "slot-map"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in Simple-8b segments, written in ascending doc_id order and read back."""
    path = shared_path(spark, "token-files")
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), path, _vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over distinct 4-word shingles at a Jaccard similarity of 0.8 or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside an occurrence of a 10-word benchmark window."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10).drop("spans")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 20 code points found in at least 3 documents stay only in the largest doc_id."""
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text by a rule ensemble learnt from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = rules.fit(docs, _table(spark, sf_dir, "labels"))
    return rules.quality_scores(docs, model).select("row.doc_id", "held_out", "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts through a digest cache that starts empty."""
    cache = shared_path(spark, "token-count-cache")
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), cache, _vocabulary("piece_bpe_32k.model"), limit=4096)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of words covered by a 20-word window that also starts earlier."""
    out = superkmer.remove_repeats(_table(spark, sf_dir, "documents"), k=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, per lang and over all; every third text is folded with its A-Z lower-cased."""
    out = merkle.manifest(_table(spark, sf_dir, "documents"), tampered=merkle.lowered_every_third())
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings")


def op12_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all whole texts by context-tree weighting, with the add-one unigram base."""
    out = ctw.score_texts(_table(spark, sf_dir, "documents"), folds=7, held_fold=2)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of 2 to 3 words of each language over all documents."""
    return phrases.collocations(_table(spark, sf_dir, "documents"), width=3, min_count=10, share=50, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_packing, op3_embedding_dedup, op4_sharding, op5_token_files, op6_minhash_dedup, op7_line_dedup, op8_quality_classifier, op9_token_counts, op10_substring_dedup,
                                      op11_merkle_manifest, op12_context_tree, op13_collocations)}


#: Lines are unnested with their document; a key's documents are counted and its largest doc_id kept.
OP7_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS line, len(parts) AS n_lines
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, max(n_lines) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id
"""


#: Phrases of each length are extracted and counted by themselves; products are 128-bit integers.
OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), place AS (
  SELECT lang, unnest(w) AS w1, unnest(list_concat(w[2:], [''])) AS w2, unnest(list_concat(w[3:], ['', ''])) AS w3 FROM words
), f AS (
  SELECT lang, 1 AS m, w1 AS phrase, count(*) AS n FROM place WHERE w1 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM place WHERE w1 IS NOT NULL AND w2 <> '' GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM place WHERE w1 IS NOT NULL AND w3 <> '' GROUP BY ALL
), candidate AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE m > 1 AND n >= 10
), cut AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, l.n AS l, r.n AS r,
    CAST(1000000::HUGEINT * c.a::HUGEINT * c.a::HUGEINT // (l.n::HUGEINT * r.n::HUGEINT) AS BIGINT) AS score
  FROM (SELECT *, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM candidate, (VALUES (1), (2)) AS size(k) WHERE k < m) c
  JOIN f l ON l.lang = c.lang AND l.m = c.k AND l.phrase = c.head
  JOIN f r ON r.lang = c.lang AND r.m = c.m - c.k AND r.phrase = c.rest
), scored AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS longer FROM candidate, (VALUES (1), (2)) AS start(s) WHERE m = 3 GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, t.n, s.score
FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang) t ON t.lang = s.lang
WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
QUALIFY rank <= 2000
"""


def _op11_sql(levels: int = 9, outer: int = 4) -> str:
    """Trees of up to 8**levels leaves a lang and 8**outer langs, a level each time as a table; DuckDB has no CRC-32, so it is spelt out."""
    value = "CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    fields = " || ".join(value.format(c=c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),"
           " lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)")
    sql = [f"""WITH shown AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {lower} ELSE text END AS seen FROM documents),
leaf AS (SELECT doc_id, lang, sha256({fields} || {value.format(c='text')}) AS leaf, sha256({fields} || {value.format(c='seen')}) AS shown FROM shown),
t0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
n0 AS (SELECT lang, pos, n, leaf AS node FROM t0), f0 AS (SELECT doc_id, lang, leaf, pos, shown AS node, '' AS proof FROM t0)"""]

    def level(k: int, nodes: str, folded: str, key: str) -> str:
        part = f"{key}, pos // 8"
        run = f"OVER (PARTITION BY {part} ORDER BY pos ROWS BETWEEN {{}})"
        return f"""{nodes}{k + 1} AS (SELECT {part} AS pos, max((n + 7) // 8) AS n, CASE WHEN max(n) = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node
  FROM {nodes}{k} GROUP BY {part}),
s_{nodes}{k} AS (SELECT {key}, pos, n, coalesce(string_agg(node, '') {run.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS l,
  coalesce(string_agg(node, '') {run.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS r FROM {nodes}{k}),
{folded}{k + 1} AS (SELECT f.* REPLACE (f.pos // 8 AS pos, CASE WHEN s.n = 1 THEN f.node ELSE sha256(s.l || f.node || s.r) END AS node, f.proof || s.l || s.r AS proof)
  FROM {folded}{k} f JOIN s_{nodes}{k} s ON s.{key} IS NOT DISTINCT FROM f.{key} AND s.pos = f.pos)"""

    sql += [level(k, "n", "f", "lang") for k in range(levels)]
    sql.append(f"""langs AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM n{levels}),
m0 AS (SELECT 0 AS tree, pos, n, subroot AS node FROM langs),
g0 AS (SELECT f.doc_id, f.leaf, l.subroot, 0 AS tree, l.pos, f.node, f.proof FROM f{levels} f JOIN langs l ON l.lang IS NOT DISTINCT FROM f.lang)""")
    sql += [level(k, "m", "g", "tree") for k in range(outer)]
    return ",\n".join(sql) + f"""
SELECT g.doc_id, g.leaf, g.subroot, r.node AS root, sha256(g.proof) AS proof_sha256, g.node AS folded_root, g.node = r.node AS verified,
  CAST(length(g.proof) // 64 AS BIGINT) AS n_siblings FROM g{outer} g, m{outer} r"""


OP11_SQL = _op11_sql()


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op13_collocations": OP13_SQL}
