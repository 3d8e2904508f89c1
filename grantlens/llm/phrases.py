"""Phrase collocations from padded longest windows and one rollup.

Each word of a piece leads one window: itself and its lead words, padded at the
end of the piece.  Only these longest windows are counted.  Shorter phrases are
never extracted: ``f(w1 w2)`` is the sum of the windows that begin with
``w1 w2``, so one Spark ROLLUP over (lang, w1, ..., w_width) sums all prefixes,
down to the words of a language.

Most windows are rare, and a rare window matters to its prefixes only.  A map
task counts a bounded number of windows at a time and sends them, sorted and
compressed, to the bucket of their hash, where equal windows are added up.  One
below ``min_count`` loses its last word there and goes on to the bucket of what
is left, with as many rounds as windows have words; frequent ones travel along
with their prefix, which then stays as it is.  The counts that remain are
disjoint and sum to the same totals for every prefix of a candidate.  A window
is one line a flush and a prefix one line a bucket, so the words that a third
of all documents share do not make a large bucket.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, importable, stored

#: ``.,;:!?`` and \x0A-\x0D end a piece; words are split at \x20 and \x09.
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
PAD = ""


def pieces(text: bytes) -> list[list[bytes]]:
    """The words of each piece, A-Z lower-cased."""
    found = [piece.split() for piece in text.lower().translate(_PIECES).split(b"\n")]
    return [words for words in found if words]


def lead_windows(words: list[bytes], width: int):
    """Each word with its ``width - 1`` lead words, padded with empty ones."""
    return zip(words, *(words[k:] + [b""] * min(k, len(words)) for k in range(1, width)))


Counts = dict[str, dict[bytes, int]]


def packed_lines(counts: Counts, frequent: dict[str, list[tuple[bytes, int]]], buckets: int, words: int):
    """(bucket, lang, packed): lines by the bucket of their first ``words`` words: those that count 1, the others, and frequent ones."""
    import zstandard

    for lang in counts.keys() | frequent.keys():
        salt = crc32(lang.encode())
        ones, more, whole = defaultdict(list), defaultdict(list), defaultdict(list)
        for line, n in counts.get(lang, {}).items():
            (ones if n == 1 else more)[crc32(line, salt) % buckets].append(line if n == 1 else b"%b\t%d" % (line, n))
        for line, n in frequent.get(lang, []):
            whole[crc32(b" ".join(line.split(b" ")[:words]), salt) % buckets].append(b"%b\t%d" % (line, n))
        for bucket in ones.keys() | more.keys() | whole.keys():
            parts = [b"\n".join(sorted(part.get(bucket, []))) for part in (ones, more, whole)]
            yield bucket, lang, zstandard.ZstdCompressor(level=3).compress(b"\n\n".join(parts))


def added_up(batches) -> tuple[Counts, dict[str, dict[bytes, int]]]:
    """The sums of the lines of a bucket by language, and the frequent longer windows that came along."""
    import zstandard

    sums, frequent = defaultdict(Counter), defaultdict(dict)
    for batch in batches:
        for lang, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
            ones, more, whole = zstandard.ZstdDecompressor().decompress(blob.as_py()).split(b"\n\n")
            mine = sums[lang]
            mine.update(ones.split(b"\n") if ones else ())
            for line in more.split(b"\n") if more else ():
                window, _, n = line.partition(b"\t")
                mine[window] += int(n)
            for line in whole.split(b"\n") if whole else ():
                window, _, n = line.partition(b"\t")
                frequent[lang][window] = int(n)
    return sums, frequent


def shortened(sums: Counts, frequent: dict[str, dict[bytes, int]], words: int, min_count: int) -> tuple[Counts, dict[str, list[tuple[bytes, int]]]]:
    """Windows of ``words`` words below ``min_count`` without their last word, and all frequent ones.

    A window that ends with a pad is no phrase of that length; one that begins a longer frequent one stays."""
    short, kept = {}, defaultdict(list)
    for lang in list(sums):
        longer = frequent.pop(lang, {})
        kept[lang] += longer.items()
        begun = {b" ".join(line.split(b" ")[:words]) for line in longer}
        rest, mine = Counter(), sums.pop(lang)
        cut = []
        for line, n in mine.items():
            if line in begun or (n >= min_count and line[-1:] != b" "):
                kept[lang].append((line, n))
            elif n == 1:
                cut.append(line[:max(line.rfind(b" "), 0)])
            else:
                rest[line[:max(line.rfind(b" "), 0)]] += n
        mine.clear()
        rest.update(cut)
        short[lang] = rest
    for lang, longer in frequent.items():  # their prefixes have no windows of their own
        kept[lang] += longer.items()
    return short, kept


def longest_windows(docs: DataFrame, width: int, min_count: int, flush_windows: int, bucket_bytes: int) -> DataFrame:
    """(lang, w1, ..., w_width, n): disjoint counts of padded windows; those below ``min_count`` are shortened, a language's rare words to pads alone."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))  # by size alone: a flush sends one row a bucket and language
    packed, packed_arrow = arrow_schema("bucket int, lang string, packed binary")
    counted, counted_arrow = arrow_schema("lang string, " + ", ".join(f"w{k} string" for k in range(1, width + 1)) + ", n long")

    def batch_of(rows, schema) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    def send(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def flush():
            lines = {lang: dict(zip(map(b" ".join, windows), windows.values())) for lang, windows in held.items()}
            held.clear()
            return batch_of(packed_lines(lines, {}, buckets, width), packed_arrow)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                mine = held[lang]
                for words in pieces(text.as_py()):
                    mine.update(lead_windows(words, width))
                if sum(map(len, held.values())) >= flush_windows:
                    yield flush()
        if held:
            yield flush()

    def settle(words: int):
        def run(batches):
            yield batch_of(packed_lines(*shortened(*added_up(batches), words, min_count), buckets, words - 1), packed_arrow)

        return run

    def last(batches):
        rest, kept = shortened(*added_up(batches), 1, min_count)
        for lang in rest.keys() | kept.keys():
            lines = kept.get(lang, []) + ([(b"", n)] if (n := sum(rest.get(lang, {}).values())) else [])
            for i in range(0, len(lines), 50_000):
                rows = [(lang, *(w.decode("utf-8", "replace") for w in (line.split(b" ") + [b""] * width)[:width]), n) for line, n in lines[i:i + 50_000]]
                yield batch_of(rows, counted_arrow)

    rows = docs.where("text is not null").mapInArrow(send, packed)
    for words in range(width, 0, -1):
        run, schema = (settle(words), packed) if words > 1 else (last, counted)
        rows = rows.repartitionById(buckets, F.col("bucket")).mapInArrow(run, schema)
    return rows


def phrase_counts(windows: DataFrame, width: int, min_count: int) -> DataFrame:
    """(lang, w1, ..., w_width, n, words) by one rollup: ``words`` leading words counted together, the others null.

    Phrases below ``min_count`` are left out, since none of their extensions is a candidate; ``words`` = 0 is the language."""
    names = [f"w{k}" for k in range(1, width + 1)]
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    # level 2**j - 1: the last j columns are summed over; a phrase has no pads among its words
    whole = F.col("level") == 2**width - 1
    for m in range(1, width + 1):
        whole = whole | ((F.col("level") == 2**(width - m) - 1) & (F.col(f"w{m}") != PAD))
    words = F.when(F.col("w1").isNull(), 0)
    for m in range(2, width + 1):
        words = words.when(F.col(f"w{m}").isNull(), m - 1)
    return sums.where(whole).select("lang", *names, "n", words.otherwise(width).alias("words")).where((F.col("n") >= min_count) | (F.col("words") == 0))


def collocations(docs: DataFrame, width: int = 3, min_count: int = 10, share: int = 50, top: int = 2000, scale: int = 1_000_000,
                 flush_windows: int = 400_000, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``width`` words of each language.

    Texts are taken whole, A-Z lower-cased; ``.,;:!?`` and line ends cut them
    into pieces, spaces and tabs these into words.  A null lang is ``und``.
    ``a`` counts a phrase's occurrences within pieces, ``n`` the language's
    words.  Each cut into a first part (``l``) and a rest (``r``) gives
    floor(scale * a * a / (l * r)) in exact decimal arithmetic; the lowest
    counts, ties to the shortest first part.  A candidate (a >= ``min_count``)
    goes where 100 * f >= ``share`` * a for a longer candidate f that contains
    it.  Ties in score fall to the larger ``a``, then to the phrase bytewise.
    Null and empty texts have no words, repeated rows count as often as they
    are there, doc_id and other columns do not count, and a text without
    candidates, or an empty table, adds no rows.  A map task holds one text
    and ``flush_windows`` windows, a bucket some ``bucket_bytes`` of text.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    windows = longest_windows(rows, width, min_count, flush_windows, bucket_bytes)
    counts = stored(phrase_counts(windows, width, min_count), "phrase-counts")

    def table(m: int, places: list[int], value: str) -> DataFrame:
        """The phrases of ``m`` words, their words named as at ``places`` of a longer one."""
        part = counts.where(F.col("words") == m)
        return part.select("lang", *(F.col(f"w{i}").alias(f"w{p}") for i, p in enumerate(places, 1)), F.col("n").alias(value))

    def exact(value) -> str:
        return f"cast({value} as decimal(38,0))"

    found = []
    for m in range(2, width + 1):
        at = list(range(1, m + 1))
        c = table(m, at, "a")
        best = None
        for k in range(1, m):
            c = c.join(table(k, at[:k], f"l{k}"), ["lang", *(f"w{p}" for p in at[:k])]).join(table(m - k, at[k:], f"r{k}"), ["lang", *(f"w{p}" for p in at[k:])])
            score = F.expr(f"({exact(scale)} * {exact('a')} * {exact('a')}) div ({exact(f'l{k}')} * {exact(f'r{k}')})")
            cut = F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
            best = cut if best is None else F.least(best, cut)
        words = F.array(*(F.col(f"w{p}") for p in at))
        c = c.select("lang", words.alias("words"), "a", best.alias("cut"))
        found.append(c.select("lang", "words", "a", "cut.l", "cut.r", "cut.score"))
    out = found[-1]
    for m in range(2, width):
        inside = [F.slice("words", s + 1, m) for s in range(width)]
        longer = None
        for n in range(m + 1, width + 1):
            part = table(n, list(range(1, n + 1)), "a").select("lang", F.array(*(F.col(f"w{p}") for p in range(1, n + 1))).alias("words"), "a")
            part = part.select("lang", F.explode(F.array(*inside[:n - m + 1])).alias("words"), F.col("a").alias("longer"))
            longer = part if longer is None else longer.unionByName(part)
        longer = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
        kept = found[m - 2].join(longer, ["lang", "words"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        out = out.unionByName(kept.drop("longer"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = out.withColumn("phrase", F.array_join("words", " ")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
