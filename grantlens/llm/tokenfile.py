"""Token ids on disk: segments of Simple-8b words in ascending document order.

Documents are range-partitioned and sorted by id, so each task holds one
stretch of the order and writes it as a sequence of segments.  A segment is a
self-contained binary: a header, each document's id and number of tokens, and
one Simple-8b stream (``simple8b``) with its block offsets, so a reader can
take any document without decoding what comes before it.  Segments are stored
as rows of a Parquet table through Spark's writer, which reaches any store
that Spark reaches and commits a task's output at once: a lost executor leaves
no partial file.  ``part`` and ``segment`` give the order, ``part_start`` the
number of ids before the segment in its part.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import arrow_schema, id_and_text, text_batches
from .tokens import encoder, id_dtype

SEGMENT_IDS = 1 << 19
SEGMENTS = "part int, segment int, first_id long, last_id long, n_docs long, n_tokens long, part_start long, payload binary"


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """Number of documents, a null bitmap, ids, lengths, then the Simple-8b stream of all token ids."""
    null = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
    return (struct.pack("<I", len(ids)) + null + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([len(x) for x in ids], "<u8").tobytes()
            + simple8b.encode(np.concatenate(ids) if ids else np.zeros(0, np.uint64)))


def segment_docs(payload: bytes) -> tuple[list[int | None], np.ndarray, int]:
    """Document ids, numbers of tokens and where the Simple-8b stream begins."""
    (n,) = struct.unpack_from("<I", payload)
    size = -(-n // 8)
    null = np.unpackbits(np.frombuffer(payload, np.uint8, size, 4))[:n]
    at = 4 + size
    ids = np.frombuffer(payload, "<i8", n, at).tolist()
    return [None if x else d for d, x in zip(ids, null)], np.frombuffer(payload, "<u8", n, at + 8 * n).astype(np.int64), at + 16 * n


def read_document(payload: bytes, nth: int) -> np.ndarray:
    """The token ids of one document of a segment: only the blocks that hold it are decoded."""
    _, sizes, at = segment_docs(payload)
    begin = int(sizes[:nth].sum())
    first, last = begin // simple8b.BLOCK, -(-(begin + int(sizes[nth])) // simple8b.BLOCK)
    values = simple8b.decode(payload[at:], first, last)
    return values[begin - first * simple8b.BLOCK:][:int(sizes[nth])]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS,
                 memo_words: int = 450_000) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the segments to ``path``.

    Rows without doc_id come last; rows with equal doc_id are ordered by a hash of their text.  ``memo_words``
    bounds the words whose ids a Python worker keeps (about 300 bytes each); a third of it is for new words."""
    text_batches(docs.sparkSession)
    schema, arrow = arrow_schema(SEGMENTS)
    dtype = np.dtype(id_dtype(tokenizer) if end_id < 1 << 16 else "<u4").str
    end = np.array([end_id], dtype).tobytes()

    def run(batches):
        encode = encoder(tokenizer, memo_words, dtype).encode
        part = TaskContext.get().partitionId()
        state = {"segment": 0, "start": 0}
        ids, tokens, held = [], [], 0

        def emit():
            n = sum(len(x) for x in tokens)
            real = [i for i in ids if i is not None]
            row = [part, state["segment"], real[0] if real else None, real[-1] if real else None, len(ids), n, state["start"], pack_segment(ids, tokens)]
            state["segment"] += 1
            state["start"] += n
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow.types)], schema=arrow)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode(["" if t is None else t for t in texts])):
                ids.append(doc_id)
                tokens.append(np.frombuffer(raw + end, dtype))
                held += len(tokens[-1])
                if held >= segment_ids:
                    yield emit()
                    ids, tokens, held = [], [], 0
        if ids:
            yield emit()

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = id_and_text(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(run, schema).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``: the number of ids in all segments before."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))  # one row a write task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("before"))
    return segments.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("part_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per written document: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    text_batches(spark, 8)
    schema, arrow = arrow_schema("doc_id long, start long, n_tokens long, ids binary")

    def run(batches):
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                payload = payload.as_py()
                doc_ids, sizes, at = segment_docs(payload)
                raw = simple8b.decode(payload[at:]).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                for i in range(0, len(sizes), 512):
                    b, e = begins[i:i + 512], ends[i:i + 512]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids[i:i + 512], pa.int64()), pa.array(b + start), pa.array(sizes[i:i + 512]),
                        pa.array([raw[4 * x:4 * y] for x, y in zip(b.tolist(), e.tolist())], pa.binary())], schema=arrow)

    return read_segments(spark, path).select("start", "payload").mapInArrow(run, schema)
