"""Simple-8b word-aligned coding of unsigned integers, vectorised with numpy.

A 64-bit word has a selector in its top 4 bits and a fixed number of values of
a fixed width in the other 60.  Values of 60 bits and more do not fit: their
word has selector 15 with all 60 bits set (the escape) and the next word holds
the value.  Values are coded in blocks of ``BLOCK``; a block's words do not
depend on other blocks, and the offsets of all blocks are stored, so blocks
decode on their own and all words with one selector decode at once.
"""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64
#: Values in a word, and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 60) - 1
BLOCK = 1024
MAGIC = b"S8B1"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 61 for what must be escaped."""
    if not len(values) or int(values.max()) < 1 << 16:
        return _SMALL[values.astype(np.uint16)]
    out = np.zeros(len(values), np.uint8)
    rest = values
    for n in (32, 16, 8, 4, 2, 1):
        big = rest >= (_U(1) << _U(n))
        rest = np.where(big, rest >> _U(n), rest)
        out += big * np.uint8(n)
    out += rest > 0
    out[values >= _U(ESCAPE)] = 61
    return out


_SMALL = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.uint8)


def _choose(values: np.ndarray) -> np.ndarray:
    """Per position the smallest selector whose word could start there (16: escape), a row for each block."""
    width = np.full(-(-len(values) // BLOCK) * BLOCK, 255, np.uint8)  # no word takes what fills up the last block
    width[:len(values)] = _bits(values)
    running = width.reshape(-1, BLOCK)  # running[:, i]: the largest width among values i .. i+have-1 of a block
    best = np.uint8(16) - (running <= 60).view(np.uint8)
    have = 1
    for s in range(14, -1, -1):
        want = int(COUNTS[s])
        while have < want:
            step = min(have, want - have)
            running = np.maximum(running[:, :-step], running[:, step:])
            have += step
        fits = running <= int(WIDTHS[s])
        if not fits.any():  # nor does any smaller selector: more values in fewer bits
            break
        best[:, :running.shape[1]] -= fits.view(np.uint8)  # where it fits, all larger selectors did
    return best


def _starts(selector: np.ndarray, n: int) -> np.ndarray:
    """Where each of the words of ``n`` values starts; the blocks advance together, a word a round."""
    jump, selector = np.append(COUNTS, 1), selector.ravel()
    at = np.arange(0, n, BLOCK)
    end, rounds = np.minimum(at + BLOCK, n), []
    while len(at):
        rounds.append(at)
        at = at + jump[selector[at]]
        go = at < end
        if not go.all():
            at, end = at[go], end[go]
    return np.sort(np.concatenate(rounds)) if rounds else at


def _encode_blocks(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of whole blocks (the last may be short), and the word offset at which each block ends."""
    selector = _choose(v)
    starts = _starts(selector, len(v))
    chosen = selector.ravel()[starts]
    escaped = chosen == 16
    place = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    out = np.zeros(len(starts) + int(escaped.sum()), _U)
    for s in np.flatnonzero(np.bincount(chosen)).tolist():
        mine = np.flatnonzero(chosen == s)
        if s == 16:
            out[place[mine]] = _U(0xFFFFFFFFFFFFFFFF)
            out[place[mine] + 1] = v[starts[mine]]
            continue
        packed = np.full(len(mine), s << 60, _U)
        if WIDTHS[s]:
            at = starts[mine]
            for i in range(int(COUNTS[s])):
                packed |= v[at + i] << _U(i * int(WIDTHS[s]))
        out[place[mine]] = packed
    heads = np.searchsorted(starts, np.arange(BLOCK, len(v) + BLOCK, BLOCK))
    return out, np.append(place, len(out))[heads]


def encode(values: np.ndarray) -> bytes:
    """MAGIC, number of values, number of blocks, word offset of each block and of the end, then the words."""
    values = np.ascontiguousarray(values, _U)
    words, offsets, base = [], [np.zeros(1, np.int64)], 0
    for i in range(0, len(values), 1024 * BLOCK):
        out, ends = _encode_blocks(values[i:i + 1024 * BLOCK])
        words.append(out.astype("<u8").tobytes())
        offsets.append(ends + base)
        base += len(out)
    offsets = np.concatenate(offsets)
    return MAGIC + struct.pack("<QI", len(values), len(offsets) - 1) + offsets.astype("<u8").tobytes() + b"".join(words)


def _decode_words(words: np.ndarray, n: int) -> np.ndarray:
    selector = (words >> _U(60)).astype(np.int64)
    marker = np.flatnonzero(words == _U(0xFFFFFFFFFFFFFFFF))
    raw = np.zeros(len(words), bool)
    last = -2
    for i in marker.tolist():  # a raw word may look like a marker: in order, a marker claims its next word
        if i != last + 1:
            raw[i + 1] = True
            last = i
    count = COUNTS[selector]
    count[raw] = 1
    count[:-1][raw[1:]] = 0
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), _U)
    out[at[raw]] = words[raw]
    plain = ~raw & (count > 0)
    for s in np.unique(selector[plain]).tolist():
        if WIDTHS[s]:
            mine = plain & (selector == s)
            shift = np.arange(COUNTS[s], dtype=_U) * _U(WIDTHS[s])
            out[at[mine][:, None] + np.arange(COUNTS[s])] = (words[mine][:, None] >> shift) & _U((1 << int(WIDTHS[s])) - 1)
    return out[:n]


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks ``first`` to ``last`` (exclusive; all by default)."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b stream")
    n, blocks = struct.unpack_from("<QI", data, 4)
    offsets = np.frombuffer(data, "<u8", blocks + 1, 16)
    words = np.frombuffer(data, "<u8", -1, 16 + 8 * (blocks + 1))
    last = blocks if last is None else last
    if first >= last:
        return np.zeros(0, _U)
    # every block but the last ends with a full word or with values cut at the block's end, so it gives BLOCK values
    return _decode_words(words[int(offsets[first]):int(offsets[last])], min(n, last * BLOCK) - first * BLOCK)
