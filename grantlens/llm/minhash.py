"""MinHash near-duplicate removal with min-max hashing.

Each permutation is evaluated once per shingle and gives two signature values,
its minimum and its maximum (min-max hashing), so ``2 * permutations`` values
cost ``permutations`` evaluations.  Signatures are cut into bands; documents
that share a band are candidates, and every link is confirmed by comparing
the whole shingle sets.

Copies are folded first: rows with the same shingle set form one class.  No
list of all pairs of a group is made.  Buckets of at most ``small`` classes
give their pairs, less those that a 1-bit sketch of the signature shows to be
too far apart.  Larger buckets
are sifted by the same sketch in chunks.  Members with few candidates give
their pairs too.  Those with many are in a dense group: they are dealt into
blocks by the smallest member of their dense buckets, so a group fills few
blocks, and two blocks that share a dense bucket are compared at once, as one product of their shingle matrices, which returns
a spanning forest of the links found.  So a bucket of thousands of near copies
sends rows in proportion to its members, and no pair of candidates stays
undecided.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, arrow_schema, id_and_text, key_id, stored, text_batches, text_buffer
from .components import Forest, connected_components
from .wordhash import mix, windows, word_hashes, word_spans

_U = np.uint64
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    """The distinct word shingles of a text; with fewer words, the whole sequence as one."""
    words = WORDS.findall((text or "").translate(_LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    runs = windows(words, width)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(runs[a:b - width + 1])
        elif b > a:
            yield windows(words[a:b], b - a)
        else:
            yield np.zeros(0, _U)


class MinMax:
    """Band keys from minima and maxima of linear permutations of 32-bit hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        if rows % 2:
            raise ValueError("rows per band must be even: each permutation gives two")
        rng = np.random.Generator(np.random.PCG64(seed))
        perms = bands * rows // 2
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**32, perms, dtype=np.uint64) | _U(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 2**32, perms, dtype=np.uint64).astype(np.uint32)[:, None]
        self.fold = rng.integers(1, 2**63, rows, dtype=np.uint64) | _U(1)
        self.salt = mix(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> _U(32)).astype(np.uint32)
        low = high = None
        for i in range(0, len(x), 2048):  # stays in the cache, and long texts need no large matrix
            v = x[None, i:i + 2048] * self.a + self.b
            lo, hi = v.min(axis=1), v.max(axis=1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        return np.stack([low, high], axis=1).reshape(-1)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        v = signatures.reshape(len(signatures), self.bands, self.rows).astype(_U)
        return mix((v * self.fold).sum(axis=2, dtype=_U) + self.salt)


def sketches(values: np.ndarray) -> np.ndarray:
    """One bit of each signature value, packed into 64-bit words."""
    bits = ((values >> np.uint32(9)) & np.uint32(1)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(_U)


def sketch_room(bits: int, percent: int, miss: float = 1e-7) -> int:
    """Differing bits that all but a share ``miss`` of pairs at the threshold keep within."""
    p, tail, k = (1 - percent / 100) / 2, 0.0, bits
    while k > 0 and tail + comb(bits, k) * p**k * (1 - p) ** (bits - k) <= miss:
        tail += comb(bits, k) * p**k * (1 - p) ** (bits - k)
        k -= 1
    return k


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(did, tkey, n_shingles, set_a, set_b, bands, sketch) per row; tkey is a hash of the text; set_a and set_b together identify the shingle set."""
    schema, arrow = arrow_schema("did long, tkey long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>")

    def run(batches):
        kind = MinMax(bands, rows)
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            sets = list(shingle_hashes(data, offsets, width))
            n = np.array([len(s) for s in sets], np.int64)
            sums = np.array([[mix(s).sum(dtype=_U), mix(s ^ _U(0xA5A5A5A5DEADBEEF)).sum(dtype=_U)] for s in sets], _U).reshape(-1, 2)
            full = np.flatnonzero(n)
            values = np.stack([kind.signature(sets[i]) for i in full]) if len(full) else np.zeros((0, bands * rows), np.uint32)

            def lists(x, field):
                ends = np.zeros(len(n) + 1, np.int32)
                np.cumsum((n > 0) * x.shape[1], out=ends[1:])
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1).view(np.int64))).cast(arrow.field(field).type)

            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)),
                lists(kind.keys(values), "bands"), lists(sketches(values), "sketch")], schema=arrow)

    return _keyed(docs).mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(key_id().alias("did"), F.xxhash64("text").alias("tkey"), "text")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets, made anew from the whole texts, are similar enough."""
    schema, _ = arrow_schema("a long, b long")

    def run(batches):
        last, mine = None, None
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                if a[i] != last:
                    last, mine = a[i], shingles(ta[i], width)
                other = shingles(tb[i], width)
                both = len(mine & other)
                keep.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, schema)


def _blocks(texts: DataFrame, rows: int, size: int) -> DataFrame:
    """(block, nodes, texts): ``texts`` (node, main, text) with equal main, dealt by a hash into blocks of
    about ``rows`` texts and ``size`` bytes."""
    texts = texts.withColumn("bytes", F.octet_length("text"))
    parts = texts.groupBy("main").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("bytes") / size)).alias("parts"))
    block = F.xxhash64("main", F.pmod(F.xxhash64("node"), "parts"))
    return (texts.join(parts, "main").groupBy(block.alias("block"))
            .agg(F.collect_list(F.struct("node", "text")).alias("held"))
            .select("block", F.col("held.node").alias("nodes"), F.col("held.text").alias("texts")))


def _chunks(members: DataFrame, rows: int) -> DataFrame:
    """(key, chunk, members): each bucket's members dealt by a hash into chunks of about ``rows``."""
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / rows))
    return members.withColumn("chunk", chunk).groupBy("key", "chunk").agg(F.collect_list(F.struct("node", "n", "sketch")).alias("members"))


def _sift_chunks(chunks: DataFrame, percent: int, room: int, few: int) -> DataFrame:
    """(a, b, dense) from the members of each bucket whose sizes and sketches allow a link.

    A member with at most ``few`` of them in a pair of chunks, or an eighth of the chunk, gives its pairs (a, b)
    with dense false.  Of pairs between members with more, the members are given as (node, bucket), dense true."""
    schema, arrow = arrow_schema("a long, b long, dense boolean")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, same = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                (node, size, x), (node_2, size_2, y) = (_columns(batch.column(c)[i].values) for c in (2, 3))
                differ = np.zeros((len(node), len(node_2)), np.int16)
                for w in range(x.shape[1]):
                    differ += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
                ok = (differ <= room) & (100 * np.minimum(size[:, None], size_2) >= percent * np.maximum(size[:, None], size_2))
                if same:
                    np.fill_diagonal(ok, False)
                scarce = ok & ((ok.sum(axis=1) <= max(few, len(node_2) // 8))[:, None] | (ok.sum(axis=0) <= max(few, len(node) // 8))[None, :])
                p, q = np.nonzero(np.triu(scarce) if same else scarce)
                a, b = node[p], node_2[q]
                many = ok & ~scarce
                dense = np.union1d(node[many.any(axis=1)], node_2[many.any(axis=0)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.minimum(a, b), dense])), pa.array(np.concatenate([np.maximum(a, b), np.full(len(dense), key)])),
                                                  pa.array(np.arange(len(a) + len(dense)) >= len(a))], schema=arrow)

    right = chunks.select("key", F.col("chunk").alias("other"), F.col("members").alias("members_2"))
    pairs = chunks.join(right, "key").where("chunk <= other").select("key", (F.col("chunk") == F.col("other")).alias("same"), "members", "members_2")
    return pairs.repartition("key", F.xxhash64(F.col("members")[0]["node"], F.col("members_2")[0]["node"])).mapInArrow(run, schema)


def _columns(members: pa.StructArray) -> tuple[np.ndarray, ...]:
    node, size = (members.field(f).to_numpy() for f in ("node", "n"))
    return node, size, members.field("sketch").flatten().to_numpy().view(_U).reshape(len(node), -1)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, as a product of 0/1 matrices in slices of columns."""
    out = np.zeros((len(left), len(right)), np.float32)
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    places = []
    for sets in (left, right):
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, flat)
        hit = at < len(common)
        hit[hit] = common[at[hit]] == flat[hit]
        at, row = at[hit], row[hit]
        order = np.argsort(at, kind="stable")
        places.append((at[order], row[order]))
    for c in range(0, len(common), columns):
        grids = []
        for (at, row), sets in zip(places, (left, right)):
            a, b = np.searchsorted(at, [c, c + columns])
            grid = np.zeros((len(sets), min(columns, len(common) - c)), np.float32)
            grid[row[a:b], at[a:b] - c] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def _compare_blocks(pairs: DataFrame, blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the links inside each pair of blocks, over whole shingle sets."""
    schema, arrow = arrow_schema("a long, b long")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py() == batch.column(1)[i].as_py()
                nodes = [batch.column(c)[i].values.to_numpy() for c in (2, 4)]
                sets = [list(shingle_hashes(*text_buffer(batch.column(c)[i].values), width)) for c in (3, 5)]
                sizes = [np.array([len(s) for s in x], np.float64) for x in sets]
                both = _overlaps(*sets).astype(np.float64)
                linked = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
                if same:
                    linked = np.triu(linked, 1)
                forest = Forest()
                for x in np.flatnonzero(linked.any(axis=1)).tolist():
                    a = int(nodes[0][x])
                    for b in nodes[1][linked[x]].tolist():
                        forest.add(a, b)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in forest.links], pa.int64()), pa.array([b for _, b in forest.links], pa.int64())], schema=arrow)

    left = blocks.select("block", "nodes", "texts")
    right = blocks.select(F.col("block").alias("other"), F.col("nodes").alias("nodes_2"), F.col("texts").alias("texts_2"))
    work = pairs.join(left, "block").join(right, "other").select("block", "other", "nodes", "texts", "nodes_2", "texts_2")
    return work.repartition("block", "other").mapInArrow(run, schema)


def classify(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, small: int = 16,
                    chunk_rows: int = 1024, block_rows: int = 512, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, did (null as the largest), tkey (hash of the text).

    Documents are linked when ``100 * |intersection| >= percent * |union|`` of
    their distinct ``width``-word shingles (words ``[^\\x20\\x09-\\x0D]+``,
    A-Z lower-cased; a shorter text is one shingle).  ``component_id`` is the
    smallest doc_id reachable by links; ``kept`` says that it is the row's own.
    Texts without words (null, empty, blank) link with nothing and are kept.
    Rows without doc_id count as the largest id; they report component_id null
    and are kept unless a row with an id is reachable.  With 32 bands of 4
    values a pair at the threshold is missed with probability below 1e-6.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = id_and_text(docs)
    sigs = stored(signatures(docs, width, bands, rows), "signatures")
    full = sigs.where("n_shingles > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min(F.struct("did", "tkey")).alias("rep"), F.max("n_shingles").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = (full.join(classes, ["set_a", "set_b"]).where("did = rep.did and tkey = rep.tkey")
            .select("node", "n", "bands", "sketch").dropDuplicates(["node"]))
    keys = reps.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(keys.join(stored(shared, "buckets"), "key").select("key", "node", "size"), "members")
    needed = members.select("node").distinct().join(classes.select("node", "rep.did", "rep.tkey"), "node")
    texts = stored(_keyed(docs).join(needed, ["did", "tkey"]).select("node", "text").dropDuplicates(["node"]), "texts")

    few = members.where(F.col("size") <= small).join(reps.select("node", "n", "sketch"), "node")
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("sketch_b"))
    differ = F.aggregate(F.zip_with("sketch", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    pairs = (few.join(other, "key").where("node < b").where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
             .where(differ <= sketch_room(bands * rows, percent)).select(F.col("node").alias("a"), "b"))

    many = members.where(F.col("size") > small)
    text_batches(spark, 4)
    chunks = _chunks(many.join(reps.select("node", "n", "sketch"), "node"), chunk_rows)
    near = stored(_sift_chunks(stored(chunks, "chunks"), percent, sketch_room(bands * rows, percent), small), "sifted")
    pairs = pairs.unionByName(near.where("not dense").select("a", "b")).distinct()
    dense = stored(near.where("dense").select(F.col("a").alias("node"), F.col("b").alias("key")).distinct(), "dense")
    leaders = dense.groupBy("key").agg(F.min("node").alias("leader"))
    main = dense.join(leaders, "key").groupBy("node").agg(F.min("leader").alias("main"))
    blocks = stored(_blocks(texts.join(main, "node"), block_rows, block_bytes), "blocks")
    held = blocks.select("block", F.explode("nodes").alias("node")).join(dense, "node").select("block", "key").distinct()
    meet = held.join(held.withColumnRenamed("block", "other"), "key").where("block <= other").select("block", "other").distinct()
    links = _compare_blocks(meet, blocks, width, percent)
    text_batches(spark)
    links = links.unionByName(_confirm(pairs, texts, width, percent))
    labels = connected_components(links)

    out = sigs.join(classes.select("set_a", "set_b", "node", F.col("rep.did").alias("least")), ["set_a", "set_b"], "left")
    out = out.withColumn("least", F.when(F.col("n_shingles") > 0, F.coalesce("least", "did")).otherwise(F.col("did")))
    smallest = labels.join(classes, "node").groupBy("component").agg(F.min("rep.did").alias("component_id"))
    ids = stored(labels.join(smallest, "component").select("node", "component_id"), "component-ids")
    out = out.join(ids, "node", "left").withColumn("component_id", F.coalesce("component_id", "least"))
    real = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
    return out.select(real("did").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"),
                      (F.col("did") == F.col("component_id")).alias("kept"), "did", "tkey")


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of :func:`classify`, one row per input row."""
    return classify(docs, **parameters).drop("did", "tkey")


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`classify` keeps; rows with equal id and equal text stay once."""
    kept = classify(docs, **parameters).where("kept").select("did", "tkey").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("row", key_id().alias("did"), F.xxhash64("text").alias("tkey")).join(kept, ["did", "tkey"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("did", "tkey").orderBy("did"))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")
