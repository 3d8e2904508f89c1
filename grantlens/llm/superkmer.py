"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``k`` consecutive words.  Its minimiser is the smallest hash among
its runs of ``m`` words, so equal windows have equal minimisers and meet in
one bucket.  Consecutive windows that share a minimiser travel to that bucket
together as one packed string (a super-k-mer) instead of ``k`` words each.  In
the bucket the windows are unpacked and sorted by a 128-bit hash with their
place, and every occurrence but the earliest is marked.

Bounded memory: a map task buffers ``buffer_bytes`` of packed strings, folds
equal ones (all but the earliest are marked at once, so a passage that a third
of the documents share leaves one row a flush), and compresses them by bucket
group.  A reduce task holds one group; where a group is larger than
``group_bytes`` it is taken in parts, and the earliest windows of all its
parts meet in a second, window-wise aggregation, which combines before it
shuffles.  Nothing is dropped or capped on either way.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, id_and_text, key_id, stored, text_batches, text_buffer
from .wordhash import mix, windows, word_hashes, word_spans

_U = np.uint64
SUBS = 256


def minimisers(words: np.ndarray, k: int, m: int) -> np.ndarray:
    """Per window of ``k`` words the smallest hash among its ``m``-word runs."""
    low = windows(words, m, lane=2)
    have, want = 1, k - m + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    return low


def super_kmers(data: np.ndarray, offsets: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(text no., first word in the text, byte start, byte end, minimiser) of each super-k-mer."""
    starts, ends, first = word_spans(data, offsets)
    low = minimisers(word_hashes(data, starts, ends), k, m)
    n_windows = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    nth = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = first[doc] + nth  # the window's first word
    low = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1 if len(head) else head
    return doc[head], nth[head], starts[at[head]], ends[at[tail] + k - 1] if len(tail) else tail, low[head]


_PARTS = (("did", "<i8"), ("tkey", "<i4"), ("start", "<u4"), ("sub", "u1"), ("size", "<u4"),
          ("gone_did", "<i8"), ("gone_tkey", "<i4"), ("gone_start", "<u4"), ("gone_n", "<u4"))


def _pack(columns: dict[str, np.ndarray], text: bytes) -> bytes:
    import zstandard

    raw = struct.pack("<II", len(columns["did"]), len(columns["gone_did"]))
    raw += b"".join(columns[c].astype(t).tobytes() for c, t in _PARTS) + text
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, gone = struct.unpack_from("<II", raw)
    at, out = 8, {}
    for c, t in _PARTS:
        out[c] = np.frombuffer(raw, t, gone if c.startswith("gone") else n, at)
        at += out[c].nbytes
    return out, raw[at:]


class _Buffer:
    """Packed strings of a map task, folded and compressed by bucket group at each flush."""

    def __init__(self, groups: int, k: int):
        self.groups, self.k = groups, k
        self.pieces, self.columns, self.bytes = [], [], 0

    def add(self, did, tkey, data, offsets, m):
        doc, nth, lo, hi, low = super_kmers(data, offsets, self.k, m)
        low = mix(low)
        raw = data.tobytes()
        self.pieces += [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        self.columns.append((did[doc], tkey[doc], nth, low % _U(self.groups), (low // _U(self.groups)) % _U(SUBS)))
        self.bytes += int((hi - lo).sum()) + 120 * len(lo)

    def flush(self):
        if not self.pieces:
            return
        did, tkey, start, group, sub = (np.concatenate(c) for c in zip(*self.columns))
        pieces = self.pieces
        self.pieces, self.columns, self.bytes = [], [], 0
        order = np.lexsort((start, tkey, did))
        seen: dict[bytes, int] = {}
        heads = np.array([seen.setdefault(pieces[i], i) for i in order.tolist()])
        lead = heads == order
        same = (did[heads] == did[order]) & (tkey[heads] == tkey[order]) & (start[heads] == start[order])
        keep, gone = order[lead], order[~lead & ~same]
        keep, gone = keep[np.argsort(group[keep], kind="stable")], gone[np.argsort(group[gone], kind="stable")]
        for g in np.unique(group).tolist():
            a, b = np.searchsorted(group[keep], [g, g + 1])
            c, d = np.searchsorted(group[gone], [g, g + 1])
            mine, lost = keep[a:b], gone[c:d]
            texts = [pieces[i] for i in mine.tolist()]
            n = np.array([len(pieces[i].split()) - self.k + 1 for i in lost.tolist()], np.uint32)
            yield int(g), _pack({"did": did[mine], "tkey": tkey[mine], "start": start[mine], "sub": sub[mine],
                                 "size": np.array([len(t) + 1 for t in texts], np.uint32), "gone_did": did[lost],
                                 "gone_tkey": tkey[lost], "gone_start": start[lost], "gone_n": n}, b"".join(t + b" " for t in texts))


def _runs(flag: np.ndarray, break_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of true flags; a run ends where ``break_before`` is true."""
    begin = flag.copy()
    begin[1:] &= ~flag[:-1] | break_before[1:]
    head = np.flatnonzero(begin)
    total = np.cumsum(flag)
    ends = np.append(total[head[1:] - 1], total[-1]) if len(head) else head
    return head, ends - (total[head] - 1)


def _judge(columns: dict[str, np.ndarray], text: bytes, k: int, whole: bool, limit: int = 2 << 20):
    """Rows (did, tkey, start, n, wa, wb): runs of windows that are not the earliest, and, where the
    group is not whole, each distinct window's earliest place with its hash."""
    at = np.zeros(len(columns["size"]) + 1, np.int64)
    np.cumsum(columns["size"], out=at[1:])
    order = np.lexsort((columns["start"], columns["tkey"], columns["did"], columns["sub"]))
    sub, size = columns["sub"][order], columns["size"][order].astype(np.int64)
    i = 0
    while i < len(order):
        filled = np.cumsum(size[i:])
        j = i + int(np.searchsorted(filled, limit)) + 1
        if j < len(order):  # a chunk ends where a sub-bucket ends
            j = int(np.searchsorted(sub, sub[j - 1], side="right"))
        mine = order[i:j]
        i = j
        data = np.frombuffer(b"".join(text[at[x]:at[x + 1]] for x in mine.tolist()), np.uint8)
        offsets = np.zeros(len(mine) + 1, np.int64)
        np.cumsum(columns["size"][mine], out=offsets[1:])
        starts, ends, first = word_spans(data, offsets)
        lanes = [windows(word_hashes(data, starts, ends, lane), k, lane) for lane in (0, 1)]
        n = np.diff(first) - k + 1
        row = np.repeat(np.arange(len(mine)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wa, wb = (lane[first[row] + nth] for lane in lanes)
        did, tkey, place = columns["did"][mine][row], columns["tkey"][mine][row], columns["start"][mine][row].astype(np.int64) + nth
        by = np.argsort(wa, kind="stable")  # ties stay in order of their place
        if ((wa[by][1:] == wa[by][:-1]) & (wb[by][1:] != wb[by][:-1])).any():
            by = np.lexsort((wb, wa))
        lead = np.ones(len(by), bool)
        lead[1:] = (wa[by][1:] != wa[by][:-1]) | (wb[by][1:] != wb[by][:-1])
        head = by[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        gone = np.zeros(len(by), bool)
        gone[by] = (did[head] != did[by]) | (tkey[head] != tkey[by]) | (place[head] != place[by])
        begin, length = _runs(gone, nth == 0)
        yield did[begin], tkey[begin], place[begin], length, None, None
        if not whole:
            own = by[lead]
            yield did[own], tkey[own], place[own], np.zeros(len(own), np.int64), wa[own].view(np.int64), wb[own].view(np.int64)


def repeated_windows(texts: DataFrame, k: int, m: int, buffer_bytes: int, group_bytes: int) -> DataFrame:
    """(did, tkey, start, n): runs of ``n`` windows, from word ``start`` on, that also start earlier.

    ``texts`` has did (long), tkey (int) and text; a row's place is (did, tkey, word)."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * total // group_bytes) * 3)
    packed, packed_arrow = arrow_schema("bucket_group int, packed binary")
    found, found_arrow = arrow_schema("did long, tkey int, start long, n long, wa long, wb long")

    def send(batches):
        buffer = _Buffer(groups, k)

        def rows():
            out = list(buffer.flush())
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], schema=packed_arrow)

        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            did, tkey = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            step = 0
            while step < len(did):  # slices of some MB, or one long text
                end = max(step + 1, int(np.searchsorted(offsets, offsets[step] + (2 << 20))))
                end = min(end, len(did))
                buffer.add(did[step:end], tkey[step:end], data[offsets[step]:offsets[end]], offsets[step:end + 1] - offsets[step], m)
                step = end
                if buffer.bytes >= buffer_bytes:
                    yield rows()
        yield rows()

    def settle(batches):
        held, texts_held, size, parts = [], [], 0, 0

        def emit(whole):
            columns = {c: np.concatenate([h[c] for h in held]) for c, _ in _PARTS}
            rows = [(columns["gone_did"], columns["gone_tkey"], columns["gone_start"], columns["gone_n"], None, None)]
            rows += _judge(columns, b"".join(texts_held), k, whole)
            for row in rows:
                arrays = [pa.array(x.astype(np.int32 if i == 1 else np.int64)) if x is not None else pa.nulls(len(row[0]), pa.int64()) for i, x in enumerate(row)]
                yield pa.RecordBatch.from_arrays(arrays, schema=found_arrow)

        for batch in batches:
            for blob in batch.column(1):
                columns, text = _unpack(blob.as_py())
                if held and size + len(text) + 25 * len(columns["did"]) > group_bytes * 2:
                    yield from emit(whole=False)
                    held, texts_held, size, parts = [], [], 0, parts + 1
                held.append(columns)
                texts_held.append(text)
                size += len(text) + 25 * len(columns["did"])
        if held:
            yield from emit(whole=parts == 0)

    rows = texts.select("did", "tkey", "text").mapInArrow(send, packed)
    rows = rows.repartitionById(groups, F.col("bucket_group"))
    rows = stored(rows.mapInArrow(settle, found), "windows")
    certain = rows.where("wa is null and n > 0").select("did", "tkey", "start", "n")
    open_rows = rows.where("wa is not null")
    if open_rows.isEmpty():
        return certain
    # windows of groups taken in parts: the earliest by one combined aggregation, then all others
    earliest = stored(open_rows.groupBy("wa", "wb").agg(F.min(F.struct("did", "tkey", "start")).alias("head"), F.count("*").alias("places")).where("places > 1"), "earliest")
    late = (open_rows.join(earliest, ["wa", "wb"]).where(F.struct("did", "tkey", "start") != F.col("head"))
            .select("did", "tkey", "start", F.lit(1).cast("long").alias("n")))
    return certain.unionByName(late)


def remove_repeats(docs: DataFrame, k: int = 20, m: int = 3, buffer_bytes: int = 48 << 20, group_bytes: int = 48 << 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes when a window of
    ``k`` words that covers it also starts earlier: in a row with a smaller
    doc_id, or earlier in the same text.  Windows are judged on the input.
    ``kept_text`` is the other words joined by one space.  Null texts have no
    words.  Rows without doc_id come last.  Rows with equal doc_id and equal
    text are one document; with equal doc_id and different texts they are
    ordered by a hash of the text.
    """
    text_batches(docs.sparkSession)
    texts = id_and_text(docs).withColumns({"did": key_id(), "tkey": F.hash("text")})
    gone = repeated_windows(texts.where("text is not null"), k, m, buffer_bytes, group_bytes)
    gone = gone.groupBy("did", "tkey").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("gone"))
    schema, arrow = arrow_schema("doc_id long, n_words long, n_removed long, kept_text string")

    def cut(batches):
        for batch in batches:
            ids, all_texts, lists = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(all_texts):
                words = (text or b"").split()
                n_words.append(len(words))
                if lists[i].is_valid:
                    flat = lists[i].values
                    at, n = (flat.field(f).to_numpy() for f in ("start", "n"))
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + n + k - 1, -1)
                    keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()
                    words = [words[j] for j in keep]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema=arrow)

    joined = texts.join(gone.hint("shuffle_hash"), ["did", "tkey"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(cut, schema)


def judge_by_text(texts: list[tuple[int, str]], k: int) -> dict[int, tuple[int, str]]:
    """The same rule in plain Python, for tests: doc_id -> (n_removed, kept text)."""
    from collections import defaultdict

    places = defaultdict(list)
    words = {i: (t or "").encode().split() for i, t in texts}
    for i, w in words.items():
        for s in range(len(w) - k + 1):
            places[tuple(w[s:s + k])].append((i, s))
    drop = {i: [False] * len(w) for i, w in words.items()}
    for at in places.values():
        for i, s in sorted(at)[1:]:
            drop[i][s:s + k] = [True] * k
    return {i: (sum(drop[i]), b" ".join(x for x, d in zip(w, drop[i]) if not d).decode()) for i, w in words.items()}
