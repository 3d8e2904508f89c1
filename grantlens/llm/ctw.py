"""Language-model scores by context-tree weighting over bytes.

A text is its words, A-Z lower-cased, joined by one space, and one line end.
Each byte is eight binary decisions.  Every node of that decision tree has a
context tree over the ``depth`` bytes before, nearest first: a context holds
the zeros and ones seen in training and their Krichevsky-Trofimov estimate,
and its weighted probability is half the estimate and half the product over
its longer contexts.  The probability of a bit is the mixture of the estimates
of all depths on the path that these weights give (Willems, Shtarkov, Tjalkens
1995), conditional on the whole training set, which is counted in full.

Contexts and bytes are one integer each, so texts never leave the task that
reads them:

* documents are written as compressed chunks of some MB;
* a chunk asks for its distinct (context, byte) pairs, with their counts in
  training texts, and for its distinct words; requests go to buckets by the
  hash of the ``split`` nearest bytes, sorted and compressed;
* a bucket adds the counts and weighs all contexts longer than ``split`` bytes;
  the shorter ones are summed level by level as DataFrames, and their weights
  come back to the buckets as one linear map a node;
* the bucket answers with a log-probability a pair, and the chunk adds them up.

A pair is one entry a chunk however often it occurs, so a passage that a third
of all documents share makes no large bucket.  Chunks, requests and levels are
written to the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, importable, stored
from .wordhash import mix, word_hashes, word_spans

_U = np.uint64
#: Positions are sorted in blocks of this many, which fit the processor's cache.
BLOCK = 1 << 20
_SMALL = np.arange(512)
_HALF = np.array([math.lgamma(n + 0.5) for n in _SMALL])
_WHOLE = np.array([math.lgamma(n + 1.0) for n in _SMALL])


def _log_gamma(n: np.ndarray, add: float, table: np.ndarray) -> np.ndarray:
    """log Gamma(n + add) of counts: a table, and Stirling's series beyond it."""
    x = np.maximum(n, len(table) - 1) + add
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros, 0.5, _HALF) + _log_gamma(ones, 0.5, _HALF) - math.log(math.pi) - _log_gamma(zeros + ones, 1.0, _WHOLE)


def own_share(estimate: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """The share of a context's own estimate in its mixture, given both log-probabilities of the training bits."""
    return 1 / (1 + np.exp(np.clip(longer - estimate, -700, 700)))


# --- chunks ---------------------------------------------------------------------

CHUNK = "chunk long, rows array<long>, ids array<long>, held array<boolean>, sizes array<long>, data binary"


def text_bytes(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def chunks(docs: DataFrame, depth: int, chunk_bytes: int) -> DataFrame:
    """Compressed chunks of pieces; a piece is ``depth`` bytes of context and text that ends with a word.

    ``rows`` numbers the input rows, since ids may be missing or repeated."""
    schema, arrow = arrow_schema(CHUNK)
    cut = min(chunk_bytes, BLOCK)

    def run(batches):
        import zstandard

        task, n_chunks, row = TaskContext.get().partitionId() << 32, 0, 0
        held_rows: list[tuple] = []
        data: list[bytes] = []
        size = 0

        def flush():
            nonlocal n_chunks, size
            columns = [pa.array([list(c)], arrow.field(i + 1).type) for i, c in enumerate(zip(*held_rows))]
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(data))
            out = pa.RecordBatch.from_arrays([pa.array([task + n_chunks], pa.int64()), *columns, pa.array([blob], pa.binary())], schema=arrow)
            held_rows.clear(), data.clear()
            n_chunks, size = n_chunks + 1, 0
            return out

        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                body = text_bytes(text.as_py() or b"")
                at, before = 0, b"\n" * depth
                while at < len(body):
                    end = len(body)
                    if end - at > cut:  # a long text is cut behind a space
                        end = body.rfind(b" ", at, at + cut) + 1 or body.find(b" ", at + cut) + 1 or len(body)
                    piece = before + body[at:end]
                    held_rows.append((task + row, doc_id, held, len(piece)))
                    data.append(piece)
                    size += len(piece)
                    at, before = end, piece[-depth:] if depth else b""
                    if size >= chunk_bytes:
                        yield flush()
                row += 1
        if held_rows:
            yield flush()

    return docs.mapInArrow(run, schema)


class Chunk:
    """The arrays of one chunk row."""

    def __init__(self, row: dict, depth: int):
        import zstandard

        self.rows, self.ids, self.held, self.sizes = row["rows"], row["ids"], np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
        self.offsets = np.zeros(len(self.sizes) + 1, np.int64)
        np.cumsum(self.sizes, out=self.offsets[1:])
        self.depth = depth
        context = np.zeros(len(self.data) + 1, np.int8)
        context[self.offsets[:-1]] += 1
        context[self.offsets[:-1] + depth] -= 1
        self.body = np.cumsum(context[:-1], dtype=np.int8) == 0

    def pairs(self, begin: int, end: int) -> np.ndarray:
        """Context and byte of the positions from ``begin`` on: the nearest byte of the context leads, the byte itself is last."""
        data = self.data[max(begin - self.depth, 0):end].astype(_U)
        skip = min(begin, self.depth)
        key = data[skip:].copy()
        for j in range(1, self.depth + 1):
            back = np.zeros(end - begin, _U)  # only the context at the chunk's begin has none
            part = data[max(skip - j, 0):len(data) - j]
            back[end - begin - len(part):] = part
            key |= back << _U(8 * (self.depth + 1 - j))
        return key

    def blocks(self):
        for begin in range(0, len(self.data), BLOCK):
            end = min(begin + BLOCK, len(self.data))
            yield begin, end, self.pairs(begin, end)

    def distinct_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct pairs of the chunk's texts, and their counts in training texts."""
        learn = np.repeat(~self.held, self.sizes) & self.body
        found = [(np.zeros(0, _U), np.zeros(0, np.int64))]
        for begin, end, key in self.blocks():
            train, counts = np.unique(key[learn[begin:end]], return_counts=True)
            other = np.unique(key[self.body[begin:end] & ~learn[begin:end]])
            found += [(train, counts), (other, np.zeros(len(other), np.int64))]
        return add_up(found)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each word and the piece that it is in, taken from some pieces at a time."""
        found, i, n = [(np.zeros(0, _U), np.zeros(0, np.int64))], 0, len(self.sizes)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + BLOCK, side="right")) - 1)
            begin, end = self.offsets[i], self.offsets[j]
            text = np.where(self.body[begin:end], self.data[begin:end], np.uint8(32))
            starts, ends, first = word_spans(text, self.offsets[i:j + 1] - begin)
            found.append((word_hashes(text, starts, ends), np.repeat(np.arange(i, j), np.diff(first))))
            i = j
        return np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found])

    def distinct_words(self, words: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        learn = ~self.held[piece]
        train, counts = np.unique(words[learn], return_counts=True)
        other = np.unique(words[~learn])
        return add_up([(train, counts), (other, np.zeros(len(other), np.int64))])


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all parts with the sums of their counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], np.add.reduceat(counts[order], head)


# --- requests -------------------------------------------------------------------

PAIRS, WORDS = 0, 1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as compressed byte planes."""
    import zstandard

    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(blob: bytes, n: int, *types: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for t in types:
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(t).reshape(n))
        at += n * width
    return out


def dealt(keys: np.ndarray, kind: int, depth: int, split: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket (and within it), and where each bucket begins."""
    lead = keys >> _U(8 * (depth + 1 - split)) if kind == PAIRS else keys
    bucket = (mix(lead) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def requests(stored_chunks: DataFrame, depth: int, split: int, buckets: int) -> DataFrame:
    """(kind, bucket, chunk, n, packed): the distinct pairs and words of each chunk, with their counts in its training texts."""
    schema, arrow = arrow_schema("kind int, bucket int, chunk long, n int, packed binary")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                row = batch.slice(row, 1).to_pylist()[0]
                chunk = Chunk(row, depth)
                out = []
                for kind, (keys, counts) in ((PAIRS, chunk.distinct_pairs()), (WORDS, chunk.distinct_words(*chunk.words()))):
                    order, at = dealt(keys, kind, depth, split, buckets)
                    for b in np.flatnonzero(np.diff(at)).tolist():
                        mine = order[at[b]:at[b + 1]]
                        step = np.diff(keys[mine], prepend=_U(0))
                        out.append((kind, b, row["chunk"], len(mine), pack(step, counts[mine].astype("<u4"))))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return stored_chunks.mapInArrow(run, schema)


def _read(table: pa.Table, kind: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, keys, counts) of the requests of one kind."""
    out = []
    for row in table.select(["kind", "chunk", "n", "packed"]).to_pylist():
        if row["kind"] == kind:
            step, counts = unpack(row["packed"], row["n"], "<u8", "<u4")
            out.append((row["chunk"], np.cumsum(step, dtype=_U), counts.astype(np.int64)))
    return out


# --- context trees --------------------------------------------------------------

class Level:
    """The pairs of contexts of one length, and their binary nodes: node ``j`` of a pair is the context with the first ``j`` bits of the byte."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts
        self.node, self.first, self.bit, self.zeros, self.ones = [], [], [], [], []
        for j in range(8):
            prefix = pairs >> _U(8 - j)
            new = np.append(True, prefix[1:] != prefix[:-1]) if len(pairs) else np.zeros(0, bool)
            node = np.cumsum(new) - 1
            bit = (pairs >> _U(7 - j)) & _U(1) == 1
            total, ones = np.bincount(node, counts), np.bincount(node, counts * bit)
            self.node.append(node), self.first.append(np.flatnonzero(new)), self.bit.append(bit)
            self.ones.append(ones), self.zeros.append(total - ones)
        self.estimate = [log_kt(a, b) for a, b in zip(self.zeros, self.ones)]
        self.weighted = self.estimate
        self.share = None

    def over(self, longer: Level, parent: np.ndarray) -> None:
        """Mix with the next longer contexts; ``parent`` is the pair here of each of their pairs."""
        sums = [np.bincount(self.node[j][parent[longer.first[j]]], longer.weighted[j], len(self.estimate[j])) for j in range(8)]
        self.share = [own_share(e, s) for e, s in zip(self.estimate, sums)]
        self.weighted = [np.logaddexp(e, s) - math.log(2) for e, s in zip(self.estimate, sums)]


def subtrees(pairs: np.ndarray, counts: np.ndarray, depth: int, split: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels of ``depth`` down to ``split`` bytes of context, and the pair of each pair in the next level."""
    levels, parents = [Level(pairs, counts)], []
    for _ in range(depth - split):
        last = levels[-1]
        shorter = (last.pairs >> _U(16) << _U(8)) | (last.pairs & _U(255))  # without the farthest byte
        kept, parent = np.unique(shorter, return_inverse=True)
        levels.append(Level(kept, np.bincount(parent, last.counts, len(kept))))
        levels[-1].over(last, parent)
        parents.append(parent)
    return levels, parents


def node_names(level: Level, j: int) -> np.ndarray:
    """Context and the bits before, with a leading one: unique over all ``j``."""
    first = level.pairs[level.first[j]]
    return ((first >> _U(8) << _U(8)) | _U(1 << j) | ((first & _U(255)) >> _U(8 - j))).astype(np.int64)


def bit_probabilities(levels: list[Level], parents: list[np.ndarray]):
    """Per bit: (nodes of the shortest level of each pair, the bit, its probability given contexts of ``split`` bytes and more)."""
    at = np.arange(len(levels[0].pairs))
    path = [at]
    for parent in parents:
        at = parent[at]
        path.append(at)
    for j in range(8):
        p, bit = None, levels[0].bit[j]
        for level, where in zip(levels, path):
            node = level.node[j][where]
            zeros, ones = level.zeros[j][node], level.ones[j][node]
            own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
            p = own if p is None else level.share[j][node] * (own - p) + p
        yield j, levels[-1].node[j][path[-1]], bit, p


def bucket_nodes(spark_requests: DataFrame, depth: int, split: int) -> DataFrame:
    """(kind, bucket, node, zeros, ones, weighted): the nodes of contexts of ``split`` bytes; of words one row (zeros: occurrences, ones: distinct)."""
    schema, arrow = arrow_schema("kind int, bucket int, node long, zeros double, ones double, weighted double")

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out = []
        pairs, counts = add_up([(k, c) for _, k, c in _read(table, PAIRS)] or [(np.zeros(0, _U), np.zeros(0, np.int64))])
        if len(pairs):
            levels, _ = subtrees(pairs, counts, depth, split)
            top = levels[-1]
            for j in range(8):
                out.append((np.full(len(top.first[j]), PAIRS), node_names(top, j), top.zeros[j], top.ones[j], top.weighted[j]))
        _, counts = add_up([(k, c) for _, k, c in _read(table, WORDS)] or [(np.zeros(0, _U), np.zeros(0, np.int64))])
        out.append((np.array([WORDS]), np.zeros(1, np.int64), np.array([counts.sum()]), np.array([(counts > 0).sum()]), np.zeros(1)))
        kind, node, zeros, ones, weighted = (np.concatenate(c) for c in zip(*out))
        arrays = [kind.astype(np.int32), np.full(len(kind), bucket, np.int32), node, zeros.astype(float), ones.astype(float), weighted]
        return pa.Table.from_arrays([pa.array(a) for a in arrays], schema=arrow)

    return spark_requests.groupBy("bucket").applyInArrow(run, schema)


def shorter_contexts(nodes: DataFrame, split: int) -> DataFrame:
    """(bucket, node, zero, one, rest) of the nodes of ``split`` bytes: a bit has the probability zero or one + rest * that in the longer contexts."""
    schema, arrow = arrow_schema("node long, zeros double, ones double, share double, weighted double")

    def weigh(batches):
        for batch in batches:
            node, zeros, ones, longer = (batch.column(i).to_numpy() for i in range(4))
            estimate = log_kt(zeros, ones)
            arrays = [node, zeros, ones, own_share(estimate, longer), np.logaddexp(estimate, longer) - math.log(2)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=arrow)

    up = F.expr("shiftleft(shiftright(node, 16), 8) | (node & 255)")  # without the farthest byte
    levels = [nodes]
    for _ in range(split):
        sums = levels[-1].groupBy(up.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("longer"))
        levels.append(stored(sums.mapInArrow(weigh, schema), "ctw-level"))
    total = F.col("zeros") + F.col("ones") + 1
    maps = None
    for level in reversed(levels[1:]):
        own = level.select("node", "share", ((F.col("zeros") + 0.5) / total).alias("p0"), ((F.col("ones") + 0.5) / total).alias("p1"))
        if maps is None:
            maps = own.select("node", (F.col("share") * F.col("p0")).alias("zero"), (F.col("share") * F.col("p1")).alias("one"), (1 - F.col("share")).alias("rest"))
        else:
            j = own.withColumn("up", up).join(maps.withColumnRenamed("node", "up"), "up")
            maps = j.select("node", (F.col("zero") + F.col("rest") * F.col("share") * F.col("p0")).alias("zero"),
                            (F.col("one") + F.col("rest") * F.col("share") * F.col("p1")).alias("one"), (F.col("rest") * (1 - F.col("share"))).alias("rest"))
    if maps is None:
        return nodes.select("bucket", "node", F.lit(0.0).alias("zero"), F.lit(0.0).alias("one"), F.lit(1.0).alias("rest"))
    return nodes.select("bucket", "node", up.alias("up")).join(maps.withColumnRenamed("node", "up"), "up").drop("up")


def answers(spark_requests: DataFrame, maps: DataFrame, depth: int, split: int) -> DataFrame:
    """(chunk, kind, bucket, packed): per request the natural logarithms of its pairs' probabilities, or its words' counts."""
    schema, arrow = arrow_schema("chunk long, kind int, bucket int, packed binary")

    def run(table: pa.Table, linear: pa.Table) -> pa.Table:
        out = []
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        asked = _read(table, PAIRS)
        if asked:
            pairs, counts = add_up([(k, c) for _, k, c in asked])
            levels, parents = subtrees(pairs, counts, depth, split)
            names = linear.column("node").to_numpy()
            order = np.argsort(names)
            zero, one, rest = (linear.column(c).to_numpy()[order] for c in ("zero", "one", "rest"))
            logs = np.zeros(len(pairs))
            for j, node, bit, p in bit_probabilities(levels, parents):
                at = np.searchsorted(names[order], node_names(levels[-1], j))[node]
                logs += np.log(np.where(bit, one[at], zero[at]) + rest[at] * p)
            out += [(chunk, PAIRS, pack(logs[np.searchsorted(pairs, keys)].astype("<f4"))) for chunk, keys, _ in asked]
        asked = _read(table, WORDS)
        if asked:
            words, counts = add_up([(k, c) for _, k, c in asked])
            out += [(chunk, WORDS, pack(counts[np.searchsorted(words, keys)].astype("<u8"))) for chunk, keys, _ in asked]
        chunk, kind, packed = zip(*out) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array(list(chunk), pa.int64()), pa.array(list(kind), pa.int32()), pa.array([bucket] * len(kind), pa.int32()), pa.array(list(packed), pa.binary())], schema=arrow)

    return spark_requests.groupBy("bucket").cogroup(maps.groupBy("bucket")).applyInArrow(run, schema)


def piece_scores(stored_chunks: DataFrame, replies: DataFrame, depth: int, split: int, buckets: int, known_end: bool, base_size: int) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, n_known, base, score, n_bytes) of each piece; ``base_size`` is the divisor of the base model."""
    schema, arrow = arrow_schema("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long")

    def values(table: pa.Table, kind: int, keys: np.ndarray, dtype: str) -> np.ndarray:
        """The answers of all buckets, in the order of ``keys``."""
        packed = {r["bucket"]: r["packed"] for r in table.to_pylist() if r["kind"] == kind}
        order, at = dealt(keys, kind, depth, split, buckets)
        out = np.zeros(len(keys), dtype)
        for b in np.flatnonzero(np.diff(at)).tolist():
            out[order[at[b]:at[b + 1]]] = unpack(packed[b], at[b + 1] - at[b], dtype)[0]
        return out

    def run(table: pa.Table, replied: pa.Table) -> pa.Table:
        rows = []
        for row in table.to_pylist():
            chunk = Chunk(row, depth)
            keys, _ = chunk.distinct_pairs()
            logs = values(replied, PAIRS, keys, "<f4")
            sums = np.zeros(len(chunk.data) + 1)
            for begin, end, key in chunk.blocks():
                mine, back = np.unique(key, return_inverse=True)  # context bytes have pairs of their own, which count as 0
                found = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                sums[begin + 1:end + 1] = np.where(chunk.body[begin:end], logs[found][back], 0)
            np.cumsum(sums, out=sums)
            score = sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]
            words, piece = chunk.words()
            known, _ = chunk.distinct_words(words, piece)
            counts = values(replied, WORDS, known, "<u8")
            c = counts[np.searchsorted(known, words)].astype(float) if len(words) else np.zeros(0)
            n = len(chunk.sizes)
            last = (chunk.data[chunk.offsets[1:] - 1] == 10).astype(np.int64)  # the piece with the text's end token
            tokens = np.bincount(piece, minlength=n)
            rows.append([chunk.rows, chunk.ids, chunk.held, tokens + last, np.bincount(piece, c > 0, n).astype(np.int64) + last * known_end,
                         np.bincount(piece, np.log10(c + 1), n) - tokens * math.log10(base_size), score / math.log(10), chunk.sizes - depth])
        columns = [pa.concat_arrays([pa.array(r[i], f.type) for r in rows]) if rows else pa.array([], f.type) for i, f in enumerate(arrow)]
        return pa.Table.from_arrays(columns, schema=arrow)

    return stored_chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def score_texts(docs: DataFrame, folds: int = 7, held_fold: int = 2, depth: int = 5, split: int = 3, chunk_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held_fold`` are held
    out, all others train the model; a row without id trains.  ``score`` is the
    model's log10 probability of the whole text, ``bits_per_byte`` its code
    length.  ``base_score`` is that of the add-one unigram model over words and
    one end token a text.  Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are
    lower-cased; null and empty texts are the end token alone.  Repeated rows
    count and are scored each.  Long texts are cut behind a word into pieces
    that keep their context.  Other columns do not count; an empty table has
    no rows; without training rows every byte has probability 1/256 and every
    token 1.  ``split`` is at most ``depth``, which is at most 7.  64-bit
    hashes stand for words in the base model; contexts are exact.
    """
    importable(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    sizes = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(~F.col("held"), 1))).first()
    trained = sizes[1]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes[0] or 0) // bucket_bytes))
    stored_chunks = stored(chunks(rows, depth, chunk_bytes), "ctw-chunks")
    asked = stored(requests(stored_chunks, depth, split, buckets), "ctw-requests")
    nodes = stored(bucket_nodes(asked, depth, split), "ctw-nodes")
    words = nodes.where(F.col("kind") == WORDS).agg(F.sum("zeros"), F.sum("ones")).first()
    train_tokens, distinct = int(words[0] or 0) + trained, int(words[1] or 0) + (trained > 0)
    maps = shorter_contexts(nodes.where(F.col("kind") == PAIRS), split)
    pieces = piece_scores(stored_chunks, answers(asked, maps, depth, split), depth, split, buckets, trained > 0, train_tokens + distinct + 1)
    end = math.log10((trained + 1) / (train_tokens + distinct + 1))
    out = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "n_bytes")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.lit(end)).alias("base_score"),
                      "score", "n_bytes", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
