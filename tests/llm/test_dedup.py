"""MinHash, line and substring deduplication against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from grantlens.llm import linededup, minhash, superkmer
from grantlens.llm.components import connected_components

from .conftest import sentence


def roots(n, pairs):
    up = {x: x for x in n}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in n}


def near_by_hand(rows, width, percent):
    sets = {i: minhash.shingles(t, width) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, roots(sets, links)


def check_near(df, rows, **parameters):
    width = parameters.get("width", 5)
    sets, component = near_by_hand(rows, width, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, **parameters).collect()}
    assert len(got) == len(rows)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), component[i], component[i] == i), i


def test_near_duplicates(docs, rows):
    check_near(docs, rows, width=4)


def near_group(n=70):
    """Copies of one text with more and more words changed: many pairs are just below the threshold."""
    rng = random.Random(3)
    base = sentence(rng, 150).split()
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(i % 9):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append((i + 10, " ".join(words)))
    return out


def test_large_buckets_lose_no_link(spark):
    rows = near_group()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(df, rows, width=4, small=2, block_rows=16)
    check_near(df, rows, width=4, small=2, chunk_rows=8, block_rows=16)
    check_near(df, rows, width=4, small=10**6)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.kept, r.n_shingles) for r in minhash.near_duplicates(odd_docs).collect()))
    assert got == sorted([(-1, 5, False, 36), (-1, 5, False, 36), (-1, 6, False, 36), (-1, -1, True, 0), (5, 5, True, 36), (5, 5, True, 36),
                          (6, 6, True, 36), (6, 5, False, 36), (7, 7, True, 0), (7, 7, True, 0)])
    assert minhash.near_duplicates(no_docs).count() == 0
    kept = minhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:1]) for r in kept.collect()) == [(-1, ""), (5, "w"), (6, "v"), (7, "")]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    kind = minhash.MinMax(bands=32, rows=4)
    for share in (0.3, 0.8):
        found = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 800, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            both = int(400 * 2 * share / (1 + share))
            a, b = x[:400], np.concatenate([x[:both], x[400:800 - both]])
            found.append((kind.signature(a) == kind.signature(b)).mean())
        assert abs(np.mean(found) - share) < 0.04


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    names = rng.sample(range(10**6), 200)
    links = list(zip(names, names[1:])) + [(2 * 10**6, 3 * 10**6)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{n: min(names) for n in names}, 2 * 10**6: 2 * 10**6, 3 * 10**6: 2 * 10**6}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def lines_by_hand(rows, min_chars=20, min_docs=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = {}
    for i, t in rows:
        x = (t or "").split("\n")
        kept = [y for y in x if len(key(y)) < min_chars or len(held[key(y)]) < min_docs or max(held[key(y)]) == i]
        out[i] = (len(x), len(x) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, rows):
    # lines past position 64 need a second bitmap word
    rng = random.Random(8)
    long_rows = [(2000 + i, "\n".join([sentence(rng, 2)] * 3 + [f"this line is common {j} to all of them" for j in range(150)])) for i in range(4)]
    more = docs.sparkSession.createDataFrame([(i, t) for i, t in long_rows], "doc_id long, text string")
    everything = docs.unionByName(more, allowMissingColumns=True)
    want = lines_by_hand(rows + long_rows)
    got = linededup.dedup_lines(everything).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert sum(w[1] for w in want.values()) > 450


def test_line_dedup_is_native_and_handles_odd_rows(docs, odd_docs, no_docs):
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert linededup.dedup_lines(no_docs).count() == 0
    got = linededup.dedup_lines(odd_docs).select("row.doc_id", "n_lines", "n_dropped").collect()
    # the first text has three documents (none, 5, 6): rows without id hold it last and keep it
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped) for r in got) == sorted(
        [(-1, 1, 0)] * 4 + [(5, 1, 1)] * 2 + [(6, 1, 0), (6, 1, 1)] + [(7, 1, 0)] * 2)


def check_windows(df, rows, **parameters):
    want = superkmer.judge_by_text(rows, parameters.get("k", 20))
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in superkmer.remove_repeats(df, **parameters).collect()}
    assert got == want
    return sum(n for n, _ in want.values())


def test_repeated_windows(docs, rows):
    assert check_windows(docs, rows) > 500
    assert check_windows(docs, rows, k=6, m=2) > 500


def test_repeated_windows_in_small_parts(docs, rows):
    # groups larger than allowed are taken in parts, whose windows meet in a second aggregation
    check_windows(docs, rows, buffer_bytes=3000, group_bytes=2000)


def test_repeated_windows_inside_one_text(spark):
    rows = [(1, "a b " * 40), (2, "x"), (3, "a " * 19), (4, "a " * 20), (5, "a " * 50)]
    check_windows(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_repeated_windows_of_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in superkmer.remove_repeats(odd_docs).collect())
    assert got == sorted([(-1, 40, 40)] * 3 + [(-1, 0, 0)] + [(5, 40, 0)] * 2 + [(6, 40, 0), (6, 40, 40)] + [(7, 0, 0)] * 2)
    assert superkmer.remove_repeats(no_docs).count() == 0


def test_queries_at_small_scale(spark):
    from grantlens.llm import queries as Q

    data = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = superkmer.judge_by_text(rows, 20)
    got = {r.doc_id: r for r in Q.op10_substring_dedup(spark, data).collect()}
    assert {i: (r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: (n, hashlib.sha256(t.encode()).hexdigest()) for i, (n, t) in want.items()}
    sets, component = near_by_hand(rows, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op6_minhash_dedup(spark, data).collect()} == {i: (len(sets[i]), component[i]) for i in sets}
