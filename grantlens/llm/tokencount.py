"""Token counts with a digest cache.

A cache entry is (content_digest, tokenizer_digest, n_tokens).  The content
digest is the SHA-256 of the normalised text (null becomes empty; nothing else
may change, since any other change could change the count), the tokenizer
digest that of the vocabulary file with the library's name and version.
Documents are joined to the cache by both digests; only distinct texts that
miss are encoded, and their counts are appended.  Entries of other tokenizer
versions stay and are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, id_and_text, stored, text_batches

CACHE = "content_digest string, tokenizer_digest string, n_tokens long"
_LOADED: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def counter(path: str):
    """A function from texts to token counts by the file's library, without added tokens, truncation or padding."""
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _LOADED[path] = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            s = SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(ids) for ids in s.encode(texts, num_threads=1)]
    return _LOADED[path]


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored entries; a cache that has not been written yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE).parquet(cache)
    return spark.createDataFrame([], CACHE)


def append_misses(docs: DataFrame, cache: str, path: str) -> None:
    """Encode the distinct texts that the cache lacks for this tokenizer and append their counts.

    Equal texts are folded before the shuffle, so a group of copies sends one
    row a task.  A writer that dies leaves no entry (Spark's commit); two
    writers at once may append an entry twice, which readers fold."""
    spark = docs.sparkSession
    text_batches(spark)
    version = tokenizer_digest(path)
    known = read_cache(spark, cache).where(F.col("tokenizer_digest") == version).select("content_digest").distinct()
    distinct = docs.select(F.coalesce("text", F.lit("")).alias("content")).select(F.sha2("content", 256).alias("content_digest"), "content").dropDuplicates(["content_digest"])
    schema, arrow = arrow_schema("content_digest string, n_tokens long")

    def run(batches):
        count = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], schema=arrow)

    misses = distinct.join(known, "content_digest", "left_anti").mapInArrow(run, schema)
    misses.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, cache: str, path: str, limit: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``cache`` is a folder on storage that all executors see.  Null and empty
    texts count as the empty text; repeated rows stay."""
    docs = id_and_text(docs)
    append_misses(docs, cache, path)
    counts = (read_cache(docs.sparkSession, cache).where(F.col("tokenizer_digest") == tokenizer_digest(path))
              .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))
    counts = stored(counts, "token-counts")  # read back, so the join below can split a hot digest
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content")).select(
        "doc_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("content_digest"))
    return rows.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
