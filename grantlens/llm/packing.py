"""Lexical retrieval packing: sequences filled from a sharded BM25 index.

Every document becomes token ids plus an end id.  What fills whole windows is
cut off the front; the rest of each document (its tail) is a unit to be packed.
Token ids are the index terms, so the document frequencies have at most one
entry per vocabulary id and are counted over the units of all documents.

Units are range-partitioned by their two rarest terms (the largest ids: merges
learnt last) and a hash of the id, so units that share rare words meet in one
shard and a large group of copies is spread over several.  A task takes its
stretch of that order in shards of bounded size and builds an inverted index
for each.  A seed unit queries it with its heaviest terms; unused neighbours
fill the window by descending score, whole where they fit, and the best that
does not fit is cut to fill the window exactly.  Its rest is the next seed.
So only the last sequence of a task is not full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, id_and_text, stored, text_batches, text_buffer
from .tokens import encoder, id_dtype

K1, B = 1.2, 0.75
TOKENS = "doc_id long, doc_tokens long, rare_1 int, rare_2 int, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, window: int, dtype: str) -> DataFrame:
    """One row per document with all ids (little-endian, of ``dtype``) and the two rarest terms of its tail."""
    schema, arrow = arrow_schema(TOKENS)
    end, size = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize

    def run(batches):
        encode = encoder(tokenizer, dtype=dtype).encode
        for batch in batches:
            ids = [x + end for x in encode(["" if t is None else t for t in batch.column(1).to_pylist()])]
            rare = []
            for x in ids:
                tail = np.frombuffer(x, dtype)[len(x) // size // window * window:]
                first = int(tail.max()) if len(tail) else -1
                rest = tail[tail < first] if len(tail) else tail
                rare.append((first, int(rest.max()) if len(rest) else -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // size for x in ids], pa.int64()), pa.array([r[0] for r in rare], pa.int32()),
                                              pa.array([r[1] for r in rare], pa.int32()), pa.array(ids, pa.binary())], schema=arrow)

    return id_and_text(docs).mapInArrow(run, schema)


def _tails(batch_ids: pa.Array, window: int, dtype: str) -> list[np.ndarray]:
    data, offsets = text_buffer(batch_ids)
    flat = np.frombuffer(data.tobytes(), dtype)
    at = offsets // np.dtype(dtype).itemsize
    return [flat[a + (b - a) // window * window:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def term_statistics(tokens: DataFrame, window: int, dtype: str) -> tuple[dict[int, int], int, float]:
    """(units that hold each term, number of units, their mean length), over the tails of all documents.

    A task sends one row per term it met; the result has one entry per vocabulary id at most."""
    schema, arrow = arrow_schema("term int, units long, length long")

    def run(batches):
        held, units, length = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for tail in _tails(batch.column(0), window, dtype):
                if len(tail):
                    terms = np.unique(tail).astype(np.int64)
                    if terms[-1] >= len(held):
                        held = np.append(held, np.zeros(terms[-1] + 1, np.int64))
                    held[terms] += 1
                    units, length = units + 1, length + len(tail)
        terms = np.append(np.flatnonzero(held), -1)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(np.append(held[terms[:-1]], units)),
                                          pa.array(np.append(np.zeros(len(terms) - 1, np.int64), length))], schema=arrow)

    rows = tokens.select("ids").mapInArrow(run, schema).groupBy("term").agg(F.sum("units").alias("units"), F.sum("length").alias("length")).collect()
    total = {r.term: r for r in rows}.pop(-1, None)
    units = total.units if total else 0
    return {r.term: r.units for r in rows if r.term >= 0}, units, (total.length / units if units else 0.0)


class Bm25Shard:
    """An inverted index over the units of one shard."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, weights, unit = [], [], []
        for i, ids in enumerate(units):
            t, n = np.unique(ids, return_counts=True)
            terms.append(t)
            weights.append(idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ids) / mean)))
            unit.append(np.full(len(t), i, np.int32))
        self.of_unit = list(zip(terms, weights))
        flat = np.concatenate(terms)
        order = np.argsort(flat, kind="stable")
        self.terms, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat))
        self.units = np.concatenate(unit)[order]
        self.weights = np.concatenate(weights)[order].astype(np.float32)
        self.size = len(units)

    def scores(self, unit: int, query_terms: int) -> np.ndarray:
        """BM25 of every unit for the heaviest terms of ``unit``."""
        terms, weights = self.of_unit[unit]
        if len(terms) > query_terms:
            terms = terms[np.sort(np.argsort(-weights, kind="stable")[:query_terms])]
        out = np.zeros(self.size, np.float32)
        for i in np.searchsorted(self.terms, terms).tolist():
            a, b = self.bounds[i], self.bounds[i + 1]
            out[self.units[a:b]] += self.weights[a:b]
        return out


def pack_shard(units: list[np.ndarray], idf: np.ndarray, mean: float, window: int, query_terms: int, neighbours: int, last: bool):
    """Greedy windows over one shard: lists of (unit, first id in the unit, length).

    Returns (full windows, rest): the rest is a last window that is not full;
    unless ``last``, it is left to the next shard."""
    index = Bm25Shard(units, idf, mean)
    begin = [0] * len(units)  # ids of a unit that are already placed
    free = np.ones(len(units), bool)
    out, seed, turn = [], None, 0
    while True:
        if seed is None:
            while turn < len(units) and not free[turn]:
                turn += 1
            if turn == len(units):
                return out, []
            seed = turn
        free[seed] = False
        left = len(units[seed]) - begin[seed]
        row, room = [(seed, begin[seed], left)], window - left
        ranked: list[int] = []
        if room and free.any():
            score = index.scores(seed, query_terms)
            score[~free] = -1.0
            top = min(neighbours, len(units))
            best = np.argpartition(-score, top - 1)[:top]
            ranked = [i for i in best[np.lexsort((best, -score[best]))].tolist() if score[i] > 0]
        for i in ranked:
            if room and len(units[i]) <= room:
                free[i] = False
                row.append((i, 0, len(units[i])))
                room -= len(units[i])
        seed = None
        while room:
            rest = next((i for i in ranked if free[i]), None)
            if rest is None:  # no neighbour left: the next unit in order
                while turn < len(units) and not free[turn]:
                    turn += 1
                if turn == len(units):
                    return (out + [row], []) if last else (out, row)
                rest = turn
            free[rest] = False
            n = min(room, len(units[rest]))
            row.append((rest, 0, n))
            room -= n
            if n < len(units[rest]):
                begin[rest], seed = n, rest
        out.append(row)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, query_terms: int = 16, neighbours: int = 32,
         shard_units: int = 2048, shard_tokens: int = 1 << 20, task_tokens: int = 4 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Pieces of one ``sequence_id`` lie without gaps from offset 0 and hold at
    most ``window`` ids; each id of a document, its end id included, lies in
    exactly one piece.  ``ids`` are little-endian unsigned 32-bit.  Null texts
    are empty (the end id alone); repeated rows are packed once each; rows
    without doc_id keep null.
    """
    spark = docs.sparkSession
    text_batches(spark)
    dtype = id_dtype(tokenizer)
    tokens = stored(tokenised(docs, tokenizer, end_id, window, dtype), "tokens")
    counts, n_units, mean = term_statistics(tokens, window, dtype)
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    size = max(counts, default=0) + 1
    idf = np.zeros(size, np.float32)
    for term, n in counts.items():
        idf[term] = np.log1p((n_units - n + 0.5) / (n + 0.5))
    schema, arrow = arrow_schema(PIECES)

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        units: list[tuple] = []  # (doc_id, doc_tokens, first id in the document, ids)

        def rows(found):
            columns = list(zip(*found)) if found else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

        def sequence(pieces):
            nonlocal made
            at, out = 0, []
            for (doc_id, n, first, ids), a, size in pieces:
                out.append((doc_id, first + a, size, ids[a:a + size].astype("<u4").tobytes(), n, base + made, at))
                at += size
            made += 1
            return out

        def shard(last):
            nonlocal units
            windows, rest = pack_shard([u[3] for u in units], idf, mean, window, query_terms, neighbours, last)
            found = [r for w in windows for r in sequence([(units[i], a, n) for i, a, n in w])]
            # what is left of a window starts the next shard as units of their own
            units = [(units[i][0], units[i][1], units[i][2] + a, units[i][3][a:a + n]) for i, a, n in rest]
            return rows(found)

        held = 0
        for batch in batches:
            full = []
            for doc_id, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(ids.as_py(), dtype)
                cut = n // window * window
                for a in range(0, cut, window):
                    full += sequence([((doc_id, n, a, ids[a:a + window]), 0, window)])
                if cut < n:
                    units.append((doc_id, n, cut, ids[cut:].copy()))
                    held += n - cut
                if len(units) >= shard_units or held >= shard_tokens:
                    yield rows(full)
                    full = []
                    yield shard(last=False)
                    held = sum(len(u[3]) for u in units)
            yield rows(full)
        if units:
            yield shard(last=True)

    tasks = max(1, -(-total // task_tokens))
    order = [F.col("rare_1"), F.col("rare_2"), F.xxhash64("doc_id", "doc_tokens")]
    placed = tokens.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "doc_id", "ids")
    return placed.select("doc_id", "doc_tokens", "ids").mapInArrow(run, schema)
