"""Line deduplication with DataFrame functions only.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and
A-Z lower-cased.  The keys' 128-bit hashes, one row per document and key with
the positions in it, are range-partitioned by hash with a secondary sort by
document (largest first) and written to the shared folder.  A document is part
of the range key, so the rows of a hot line spread over several tasks.  The
first occurrences are streamed per hash: each task keeps at most ``min_docs``
rows of a key before the shuffle (a window group limit), which is all that
decides it: the first says which document keeps the line, the last that there
are enough documents.  The result per document is a compressed bitmap of lines
to drop, not text: 64 positions a word, and only words with a bit set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, key_id, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"


def lines(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: F.Column) -> F.Column:
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, did, pos) of each line whose key has at least ``min_chars`` code points."""
    # a key has no more code points than its line, so short lines need no key
    rows = docs.select("did", F.posexplode(lines(F.col("text"))).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    rows = rows.select("did", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "did", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(did, drop) for documents that lose lines; drop maps a word number to 64 bits, bit ``pos % 64`` of word ``pos / 64``."""
    by = [F.col("h1"), F.col("h2"), F.col("did").desc(), F.col("pos")]
    runs = stored(occurrences(docs, min_chars).repartitionByRange(*by).sortWithinPartitions(*by), "line-runs")
    # one row a document and key, then the first documents of each key in sort order
    held = runs.select("h1", "h2", "did").distinct()
    first = Window.partitionBy("h1", "h2").orderBy(F.col("did").desc())
    first = held.withColumn("nth", F.row_number().over(first)).where(f"nth <= {min_docs}")
    repeated = (first.groupBy("h1", "h2").agg(F.max("did").alias("keeper"), F.count("*").alias("n_docs"))
                .where(f"n_docs >= {min_docs}").select("h1", "h2", "keeper"))
    repeated = stored(repeated, "repeated-lines")  # read back, so the join below can split a hot hash
    dropped = runs.join(repeated, ["h1", "h2"]).where("did <> keeper")
    word = F.shiftright("pos", 6).alias("word")
    bits = dropped.select("did", word, F.expr("shiftleft(1L, pos & 63)").alias("bit")).groupBy("did", "word").agg(F.bit_or("bit").alias("bits"))
    return bits.groupBy("did").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per input row: row (a struct of all its columns), n_lines, n_dropped, kept_text.

    A text is split at \\n (null or empty: one empty line).  Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents lose
    their lines everywhere but in the largest doc_id that holds them.  Other
    lines stay as they are, joined by \\n.  Rows with equal doc_id and equal
    text are one document; with equal doc_id and different texts they count
    as several, ordered by a hash of the text.  A missing doc_id is larger
    than all others.
    """
    did = F.struct(key_id().alias("id"), F.xxhash64("text").alias("tkey"))
    drop = drop_bitmaps(id_and_text(docs).select(did.alias("did"), "text"), min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("row", "text", did.alias("did")).join(drop.hint("shuffle_hash"), "did", "left")
    rows = rows.select("row", "drop", F.coalesce("text", F.lit("")).alias("text"), lines(F.col("text")).alias("lines"))
    bits = lambda i: F.coalesce(F.try_element_at("drop", F.shiftright(i, 6)), F.lit(0).cast("long"))
    kept = F.filter("lines", lambda x, i: F.getbit(bits(i), i.bitwiseAND(63)) == 0)
    rows = rows.select("row", "drop", "text", "lines", F.when(F.col("drop").isNotNull(), kept).alias("kept"))
    n_dropped = F.coalesce(F.size("lines") - F.when(F.col("drop").isNotNull(), F.size("kept")), F.lit(0))
    return rows.select("row", F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"),
                       F.coalesce(F.array_join("kept", "\n"), "text").alias("kept_text"))
