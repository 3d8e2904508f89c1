"""Merkle manifest, context-tree scores and collocations against plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from grantlens.llm import ctw, merkle, phrases, queries

from .conftest import corpus

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest -------------------------------------------------------------------

def manifest_by_hand(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run, k = level[i // 8 * 8:i // 8 * 8 + 8], i % 8
            yield "".join(run[:k]), "".join(run[k + 1:])
            i //= 8

    groups = defaultdict(list)
    for d, t, lang, source, n in rows:
        seen = t.translate(LOWER) if t is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else t
        leaf, shown = (sha("".join(map(value, (d, source, lang, n, x)))) for x in (t, seen))
        groups[lang].append((d is not None, d or 0, leaf, shown))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([leaf for *_, leaf, _ in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    for at, g in enumerate(names):
        for i, (known, d, leaf, shown) in enumerate(sorted(groups[g])):
            steps = [*path(trees[g], i), *path(top, at)]
            node = shown
            for left, right in steps:
                node = sha(left + node + right)
            yield (d if known else None, leaf, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, at int, node string"


def manifest_rows():
    langs = [None, "", "en", "é", "de"] + [f"l{i}" for i in range(12)]
    rows = [(i, t, "en" if i % 3 else langs[i % 17], "S" if i % 2 else None, len(t or "") or None) for i, t in corpus(n=90)]
    rows += [(None, "No Id", "en", "s", 1), (None, "No Id", "en", "s", 1), (5, "A", "one", "s", 1), (7, "Twice", "de", "s", 1), (7, "Twice", "de", "s", 1), (7, "other", "de", "s", 1)]
    return rows


@pytest.mark.parametrize("span", [8, 512])
def test_manifest(spark, span):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "g", 1, "n") for r in rows], SCHEMA).repartition(4)
    out = merkle.manifest(docs, tampered=merkle.lowered_every_third(), span=span)
    assert sorted((tuple(r) for r in out.drop("n_siblings").collect()), key=str) == sorted(manifest_by_hand(rows), key=str)
    if span == 8:
        assert merkle.manifest(docs.where("false"), span=span).count() == 0
        assert merkle.manifest(docs.where("lang = 'one'"), span=span).select("leaf", "root", "verified").first().verified


# --- context trees ----------------------------------------------------------------

def scores_by_hand(rows, depth, folds=7, held=2):
    words = lambda t: (t or "").encode().lower().split()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % folds == held
    counts, seen = Counter(), defaultdict(lambda: [0, 0])

    def steps(t):
        full = b"\n" * depth + b" ".join(words(t)) + b"\n"
        for i in range(depth, len(full)):
            tag = 1
            for k in range(7, -1, -1):
                bit = full[i] >> k & 1
                yield full[i - depth:i], tag, bit
                tag = tag * 2 + bit

    for d, t in rows:
        if not out(d):
            counts.update([*words(t), "end"])
            for context, tag, bit in steps(t):
                for k in range(depth + 1):
                    seen[context[depth - k:], tag][bit] += 1
    longer = defaultdict(set)
    for context, tag in seen:
        if context:
            longer[context[1:], tag].add((context, tag))
    log_kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted, share = {}, {}
    for node in sorted(seen, key=lambda n: -len(n[0])):
        own = log_kt(*seen[node])
        if len(node[0]) == depth:
            weighted[node] = own
            continue
        rest = sum(weighted[x] for x in longer[node])
        weighted[node] = max(own, rest) + math.log1p(math.exp(-abs(own - rest))) - math.log(2)
        share[node] = 1 / (1 + math.exp(min(700, rest - own)))
    total, distinct = sum(counts.values()), len(counts)
    for d, t in rows:
        score = 0.0
        for context, tag, bit in steps(t):
            p = None
            for k in range(depth, -1, -1):
                node = context[depth - k:], tag
                n = seen.get(node, (0, 0))
                own = (n[bit] + .5) / (sum(n) + 1)
                p = own if p is None else p + share.get(node, .5) * (own - p)
            score += math.log10(p)
        tokens = [*words(t), "end"]
        yield d, out(d), len(tokens), sum(counts[x] > 0 for x in tokens), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in tokens), score


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: str(r)), sorted(want, key=lambda r: str(r))):
        assert tuple(g[:5]) == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-6, abs=1e-6) and g[6] == pytest.approx(w[6], rel=1e-5, abs=1e-5)


def test_context_tree_scores(spark):
    rows = [r for r in corpus(n=24) if not r[1] or len(r[1]) < 3000] + [(None, "no id"), (7, "twice twice"), (7, "twice twice")]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, chunk int, node string").repartition(3)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ctw.score_texts(docs, depth=3, split=2, chunk_bytes=2000).collect()]
    key = lambda r: (str(r[0]), r[2], round(r[6], 3))
    close(sorted(got, key=key), sorted(scores_by_hand(rows, 3), key=key))
    assert ctw.score_texts(docs.where("false")).count() == 0
    only = ctw.score_texts(docs.where("crc32(cast(doc_id as string)) % 7 = 2")).collect()  # nothing to learn from
    assert only and all(r.train_tokens == 0 and r.base_score == 0 and r.bits_per_byte == pytest.approx(8) for r in only)


# --- collocations -----------------------------------------------------------------

def collocations_by_hand(rows, least=3, share=50, top=20):
    import re

    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        longer = defaultdict(int)
        for p, a in c.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in c.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and p in longer and 100 * longer[p] >= share * a):
                score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n, -score


def test_collocations(spark):
    rows = [("en" if i % 3 else None, (t or "")[:600] if i % 4 else None) for i, t in corpus(n=80)]
    rows += [("de", "Ü a, Ü a. ü a\tb c;b c:b  c!b c? d"), ("de", "a b c a b c a b c\na b c"), (None, ""), ("fr", None), ("und", "x y x y x y"), ("en", "., !\n")] * 2
    docs = spark.createDataFrame([(l, t, 1, "w") for l, t in rows], "lang string, text string, n int, w1 string").repartition(3)
    want = sorted(collocations_by_hand(rows))
    for kw in ({}, {"flush_windows": 50, "bucket_bytes": 2000}):
        got = sorted(map(tuple, phrases.collocations(docs, min_count=3, top=20, **kw).collect()))
        assert got == want and len(want) > 20
    assert phrases.collocations(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_collocations"])
def test_registered_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    df = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(queries.oracle_sql()[name]).select(*df.columns).fetchall())
