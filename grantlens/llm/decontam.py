"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers are normalised to lower-case words joined by single
spaces.  Every window of ``width`` consecutive words of an item (the whole
item where it has fewer) is a pattern " w1 w2 ... ", so the surrounding spaces
pin it to word edges.  All patterns form one automaton; a document is
normalised the same way and scanned once, whatever the number of items.  Only
for documents with a match are the words mapped back to their places in the
original text.

The automaton is sent to every task, so its size is checked: patterns are
counted in Spark first, and where they exceed ``shard_windows`` the items are
dealt into shards by a hash and the documents pass one automaton after the
other, with the hits so far kept in columns of a table in the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_schema, id_and_text, stored, text_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
# Byte by byte: A-Z to lower case, what cannot be in a word to a space, bytes of longer characters as they are.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def item_windows(text: str | None, width: int) -> set[str]:
    """The distinct patterns of an item."""
    w = words(text)
    if len(w) < width:
        return {f" {' '.join(w)} "} if w else set()
    return {f" {' '.join(w[i:i + width])} " for i in range(len(w) - width + 1)}


def automaton(items: list[tuple[int | None, str | None]], width: int):
    """(pyahocorasick automaton or None where there is no pattern); values are (characters, words, item ids)."""
    import ahocorasick

    by_pattern: dict[str, set] = {}
    for item_id, text in items:
        for p in item_windows(text, width):
            by_pattern.setdefault(p, set()).add(item_id)
    if not by_pattern:
        return None
    found = ahocorasick.Automaton()
    for p, ids in by_pattern.items():
        found.add_word(p, (len(p), p.count(" ") - 1, frozenset(ids)))
    found.make_automaton()
    return found


def scan(folded: str, machine) -> Iterator[tuple[int, int, frozenset]]:
    """(first character, words, items) of each occurrence in a folded text ``" w1 w2 ... "``."""
    for end, (size, n, items) in machine.iter(folded):
        yield end - size + 1, n, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find_hits(docs: DataFrame, items: DataFrame, width: int = 10, shard_windows: int = 1_000_000) -> DataFrame:
    """One row per input row: row (a struct of all its columns), n_words, items (array<long>), spans.

    ``items`` (item_id, text) are the benchmark; ``spans`` is an array of
    (first_word, end_word, first_char, end_char), merged and ascending: the
    hit words of the document and their place in the original text (ends
    exclusive, in characters).  Null texts have no words; items without words
    or without item_id match nothing; equal item rows count once.
    """
    spark = docs.sparkSession
    text_batches(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word takes two bytes at least, so this many windows at most
    shards = -(-(total // 2 + 1) // shard_windows)
    span = "array<struct<first_word: long, end_word: long, first_char: long, end_char: long>>"
    carried = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    schema, _ = arrow_schema(f"n_words long, items array<long>, spans {span}")
    schema = T.StructType([*carried.schema.fields, *schema.fields])
    arrow = to_arrow_schema(schema)
    fields = ("first_word", "end_word", "first_char", "end_char")

    def scanner(part):
        def run(batches):
            machine = automaton(part, width)
            for batch in batches:
                text_col = batch.column("text")
                raw = text_col.cast(pa.binary()).to_pylist()
                before_items, before_spans = (batch.column(c).to_pylist() if c in batch.schema.names else None for c in ("items", "spans"))
                n_words, hit_items, hit_spans = [], [], []
                for i, text in enumerate(raw):
                    w = (text or b"").translate(_FOLD).split()
                    n_words.append(len(w))
                    ids = set(before_items[i]) if before_items else set()
                    places = [(s["first_word"], s["end_word"]) for s in before_spans[i]] if before_spans else []
                    if machine is not None and w:
                        folded = b" ".join([b"", *w, b""]).decode("utf-8", "replace")
                        hits = list(scan(folded, machine))
                        if hits:
                            at = np.flatnonzero(np.frombuffer(folded.encode("utf-32-le"), np.uint32) == 32)
                            first = np.searchsorted(at, [h[0] for h in hits]).tolist()
                            places += [(a, a + h[1]) for a, h in zip(first, hits)]
                            for h in hits:
                                ids |= h[2]
                    hit_items.append(sorted(ids))
                    if places:
                        places = _merge(places)
                        where = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace").translate(_LOWER))]
                        hit_spans.append([dict(zip(fields, (a, b, where[a][0], where[b - 1][1]))) for a, b in places])
                    else:
                        hit_spans.append([])
                yield pa.RecordBatch.from_arrays([batch.column("row"), text_col, pa.array(n_words, pa.int64()),
                                                  pa.array(hit_items, arrow.field("items").type), pa.array(hit_spans, arrow.field("spans").type)], schema=arrow)
        return run

    out = carried
    for shard in range(shards):
        mine = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        part = [(r.item_id, r.text) for r in mine.distinct().collect()]  # bounded by shard_windows
        out = out.mapInArrow(scanner(part), schema)
        if shard + 1 < shards:
            out = stored(out, "hits")
    return out.drop("text")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, shard_windows: int = 1_000_000) -> DataFrame:
    """Per input row: doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated, spans."""
    hits = find_hits(id_and_text(docs), items, width, shard_windows)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")
