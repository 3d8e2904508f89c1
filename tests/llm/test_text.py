"""Decontamination, packing, token files, token counts and the quality classifier."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from tokenizers import Tokenizer

from grantlens.llm import decontam, packing, rules, simple8b, tokencount, tokenfile
from grantlens.llm.common import shared_path
from grantlens.llm.tokens import WordMemo

from .conftest import corpus, sentence

BYTES, WORDS_49K, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def hits_by_hand(rows, items, width=10):
    patterns = {}
    for i, t in items:
        w = decontam.words(t)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            patterns.setdefault(tuple(w[s:s + width]), set()).add(i)
    out = []
    for doc, t in rows:
        w, hit, ids = decontam.words(t), set(), set()
        for p, who in patterns.items():
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s:s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    ids |= who
        out.append((doc, len(w), len(hit), sorted(ids)))
    return out


@pytest.fixture(scope="module")
def bench_rows(rows):
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    return [(1, " ".join(texts[0].split()[5:27])), (2, texts[1].split()[3]), (10, " ".join(texts[2].split()[:10]).upper()), (3, None), (4, ""),
            (5, "-- !!"), (6, " ".join(texts[0].split()[5:27])), (7, "never seen words anywhere at all in these few documents of ours")]


@pytest.mark.parametrize("shard_windows", [10**6, 60])
def test_contamination(spark, docs, rows, bench_rows, shard_windows):
    bench = spark.createDataFrame(bench_rows + [(None, "the"), (1, bench_rows[0][1])], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, bench, shard_windows=shard_windows).collect()}
    want = hits_by_hand(rows, bench_rows)
    assert len(got) == len(want) and sum(w[2] > 0 for w in want) > 2
    for doc, n, hit, ids in want:
        import hashlib
        r = got[doc]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    text = dict(rows)
    for r in got.values():
        for s in r.spans:  # the places are those of the original text
            assert decontam.words(text[r.doc_id][s.first_char:s.end_char]) == decontam.words(text[r.doc_id])[s.first_word:s.end_word]


def test_contamination_of_empty_tables(spark, docs, no_docs, bench_rows):
    bench = spark.createDataFrame(bench_rows, "item_id long, text string")
    assert decontam.contamination(no_docs, bench).count() == 0
    assert decontam.contamination(docs, bench.where("false")).where("n_hit > 0 or contaminated").count() == 0
    assert decontam.find_hits(docs, bench).select("row.*").columns == docs.columns


def library_ids(path, texts, end):
    t = Tokenizer.from_file(path)
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch(["" if x is None else x for x in texts], add_special_tokens=False)]


@given(st.lists(st.text(st.sampled_from(list("ab 'sé́  \n\t\r.,1Ａ東​\u0085\x1c<|>")) | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
@settings(max_examples=300, deadline=None)
def test_word_memo_gives_the_library_ids(texts):
    texts = texts + ["a <|endoftext|> b", " <|startoftext|>x", "I'm  two", "end "]
    for path in (BYTES, WORDS_49K):
        memo = MEMOS.setdefault(path, WordMemo(path, entries=40))
        assert memo.encode(texts) == [e.tobytes() for e in (np.array(x.ids, "<u4") for x in memo.library.encode_batch(texts, add_special_tokens=False))]


MEMOS: dict = {}


@given(st.lists(st.text(st.sampled_from(list("ab'é́.,;:!?#$%&*1-<|> \n"))), max_size=5))
@settings(max_examples=200, deadline=None)
def test_word_memo_cuts_before_signs(texts):
    texts = texts + ["don't, x-, été.%% it'#", "<|endoftext|>! a<|endoftext|>.", "ÿ?! 12, ª*"]
    for path in (BYTES, WORDS_49K):
        memo = MEMOS.get(path) or MEMOS.setdefault(path, WordMemo(path, entries=40))
        assert memo.encode(texts) == [e.tobytes() for e in (np.array(x.ids, "<u4") for x in memo.library.encode_batch(texts, add_special_tokens=False))]


def test_word_memo_keeps_words_that_come_back(monkeypatch):
    """Words met once do not take the room of those met again, nor does a word with other signs behind it ask anew."""
    memo, asked = WordMemo(BYTES, entries=150), []
    for name in ("letters", "ask"):
        monkeypatch.setattr(memo, name, lambda *a, real=getattr(memo, name): (asked.append(a), real(*a))[1])
    letters = "abcdefghijklmnop"
    words = ["z" + "".join(letters[i >> k & 15] for k in (0, 4, 8)) for i in range(1000)]
    once, common = words[:900], words[960:]
    memo.encode(["a " + " ".join(once)])
    asked.clear()
    text = "a " + " ".join(w + end for end in ("", "", ".", "", "%%%", ",") for w in common)
    for _ in range(3):
        memo.encode([text])
    assert len(asked) < 2 * len(common)
    assert len(memo.led) + len(memo.led.new) <= 150
    memo.encode(["a " + "q" * 500])
    assert max(map(len, [*memo.led, *memo.led.new])) < 100  # a store of so many words has a bounded size


def check_pieces(pieces, rows, window, end=1):
    ids = {}
    for (i, _), x in zip(rows, library_ids(WORDS_49K, [t for _, t in rows], end)):
        ids.setdefault(i, []).append(x.tobytes())
    found = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id or -1, p.start)):
        assert len(p.ids) == 4 * p.length and 0 < p.length <= window
        found.setdefault(p.doc_id, []).append(p)
    for i, texts in ids.items():
        if len(texts) == 1:
            assert b"".join(bytes(p.ids) for p in found[i]) == texts[0]
            assert all(p.doc_tokens == len(texts[0]) // 4 for p in found[i])
        assert sum(p.length for p in found[i]) == sum(map(len, texts)) // 4
    assert set(found) == set(ids)
    rows_of = {}
    for p in pieces:
        rows_of.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in rows_of.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return [sum(n for _, n in s) for s in rows_of.values()]


def test_packing(docs, rows):
    filled = check_pieces(packing.pack(docs, WORDS_49K, window=256).collect(), rows, 256)
    assert sum(n < 256 for n in filled) <= 1
    # several tasks and shards: one sequence a task may be short
    filled = check_pieces(packing.pack(docs, WORDS_49K, window=256, shard_units=5, task_tokens=8000).collect(), rows, 256)
    assert sum(n < 256 for n in filled) <= 5


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(0)
    units = [np.unique(rng.integers(100 * (i % 4), 100 * (i % 4) + 100, 60)).astype(np.uint32) for i in range(400)]
    windows, rest = packing.pack_shard(units, np.ones(400, np.float32), float(np.mean([len(u) for u in units])), 200, 16, 32, last=True)
    same = [len({u % 4 for u, _, _ in w}) == 1 for w in windows[:20]]
    assert all(same) and not rest
    placed = sorted((u, a, n) for w in windows for u, a, n in w)
    assert sum(n for _, _, n in placed) == sum(map(len, units))


def test_packing_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_pieces(packing.pack(odd_docs, WORDS_49K, window=64).collect(), rows, 64)
    assert packing.pack(no_docs, WORDS_49K).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70) | st.just(0) | st.just(2**60 - 1) | st.just(2**64 - 1), max_size=3000), st.integers(1, 700))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(values, repeat):
    v = np.repeat(np.array(values, np.uint64), repeat)[:6000]
    data = simple8b.encode(v)
    assert (simple8b.decode(data) == v).all()
    if len(v) > simple8b.BLOCK:
        assert (simple8b.decode(data, 1, 2) == v[simple8b.BLOCK:2 * simple8b.BLOCK]).all()


def test_simple8b_rejects_other_data():
    with pytest.raises(ValueError):
        simple8b.decode(b"not a stream at all")


def test_token_files(spark, docs, rows):
    path = shared_path(spark, "test-token-files")
    tokenfile.write_tokens(docs, path, BYTES, segment_ids=700)
    rows = sorted(rows)
    want, start = [], 0
    for (i, _), x in zip(rows, library_ids(BYTES, [t for _, t in rows], 2)):
        want.append((i, start, len(x), x.tobytes()))
        start += len(x)
    got = sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokenfile.read_tokens(spark, path).collect())
    assert got == want
    # one document of a segment, without decoding the others
    segment = next(r for r in spark.read.parquet(path).collect() if r.n_docs > 2)
    doc_ids, _, _ = tokenfile.segment_docs(bytes(segment.payload))
    assert tokenfile.read_document(bytes(segment.payload), 1).astype("<u4").tobytes() == {w[0]: w[3] for w in want}[doc_ids[1]]


def test_token_files_are_read_without_a_shuffle(spark, docs):
    """Only the number of ids of each part is shuffled; the segments stay where they are read."""
    path = shared_path(spark, "test-token-files")
    tokenfile.write_tokens(docs, path, BYTES, segment_ids=700)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = tokenfile.read_segments(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_token_files_odd_rows(spark, odd_docs, no_docs):
    path = shared_path(spark, "test-token-files")
    tokenfile.write_tokens(odd_docs, path, BYTES)
    got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [5, 5, 6, 6, 7, 7, None, None, None, None]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    path = shared_path(spark, "test-token-files")
    tokenfile.write_tokens(no_docs, path, BYTES)
    assert tokenfile.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_token_counts_and_cache(spark, docs, rows, odd_docs, no_docs, path):
    cache = shared_path(spark, "test-token-cache")
    count = tokencount.counter(path)
    want = {i: n for (i, _), n in zip(rows, count([t or "" for _, t in rows]))}
    got = {r.doc_id: r for r in tokencount.token_counts(docs, cache, path, limit=500).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 500) for r in got.values())
    assert {i: r.n_bytes for i, r in got.items()} == {i: len((t or "").encode()) for i, t in rows}
    entries = spark.read.parquet(cache)
    assert entries.count() == len({t or "" for _, t in rows})
    # known texts are not encoded again; new ones are appended
    tokencount.append_misses(docs, cache, path)
    assert spark.read.parquet(cache).count() == entries.count()
    assert tokencount.token_counts(odd_docs, cache, path).count() == 10
    assert spark.read.parquet(cache).count() == entries.count() + 2
    assert tokencount.token_counts(no_docs, cache, path).count() == 0
    # entries of another tokenizer version are ignored
    other = shared_path(spark, "test-token-cache")
    spark.read.parquet(cache).selectExpr("content_digest", "'older' AS tokenizer_digest", "7L AS n_tokens").write.parquet(other)
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, other, path).collect()} == want


def test_tree_paths():
    text = "Forest\n  Tree 0 (weight 1.0):\n    If (feature 1 <= 0.5)\n     If (feature 0 <= 2.0)\n      Predict: 0.0\n     Else (feature 0 > 2.0)\n      Predict: 1.0\n    Else (feature 1 > 0.5)\n     Predict: 0.0\n  Tree 1 (weight 1.0):\n    If (feature 1 <= 0.5)\n     Predict: 0.0\n    Else (feature 1 > 0.5)\n     Predict: 1.0\n"
    inf = float("inf")
    assert rules.tree_paths(text, ["a", "b"]) == {
        frozenset({("b", -inf, 0.5)}), frozenset({("b", -inf, 0.5), ("a", -inf, 2.0)}), frozenset({("b", -inf, 0.5), ("a", 2.0, inf)}), frozenset({("b", 0.5, inf)})}


def test_quality_classifier_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = rules.fit(docs, labels)
    assert 0 < len(model.weights) < 60
    got = {r.doc_id: r for r in rules.quality_scores(docs, model).select("row.doc_id", "held_out", "score", "predicted").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(held) > 80 and sum(p == q for p, q in held) / len(held) >= 0.97
    # labels of held-out rows, and other columns, have no influence
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(rules.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = rules.fit(docs.withColumn("lang", F.lit("x")), flipped)
    assert again.weights == model.weights and again.intercept == model.intercept


def test_quality_classifier_odd_rows(spark, docs, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 0), (None, 0, 0), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = rules.fit(docs, labels)  # one class only
    assert not model.weights
    assert rules.quality_scores(docs, model).count() == docs.count()
    assert rules.quality_scores(docs, model).select("row.*").columns == docs.columns
    none = rules.fit(no_docs, labels.where("false"))
    assert {r.score for r in rules.quality_scores(odd_docs, none).collect()} == {0.5}
    assert rules.quality_scores(no_docs, none).count() == 0


def test_corpus_is_what_the_tests_need():
    texts = [t for _, t in corpus()]
    assert None in texts and "" in texts and len(texts) > len(set(texts)) and max(len(t or "") for t in texts) > 30_000
    assert sentence(random.Random(1), 5) == sentence(random.Random(1), 5)


def test_rule_fit_runs_few_jobs(spark):
    """Each job broadcasts from the driver; a gradient method took some 180 of them to weigh the rules."""
    rng = random.Random(8)
    data = [(i, sentence(rng, rng.randrange(5, 60)) + ("  !!" if i % 3 else "") + (" AB" if rng.random() < 0.5 else "")) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int((len(t) > 150) != (rng.random() < 0.1))) for i, t in data], "doc_id long, quality int")
    spark.sparkContext.setJobGroup("rule-fit", "")
    try:
        model = rules.fit(docs, labels)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.weights and len(spark.sparkContext.statusTracker().getJobIdsForGroup("rule-fit")) < 100


def test_lasso_weights_are_the_optimum(spark):
    rng = random.Random(9)
    data = []
    for _ in range(300):
        x = [float(rng.random() < 0.2 + 0.1 * k) for k in range(6)]
        data.append((float(rng.random() < 1 / (1 + math.exp(1 - 2 * x[0] + 3 * x[4]))), [*x, x[1], 1.0 - x[2], 1.0]))  # repeated, opposite and constant columns
    rows = spark.createDataFrame(data, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    flags = np.array([x for _, x in data])
    label, spread = np.array([y for y, _ in data]), flags.std(axis=0, ddof=1)

    def objective(intercept, weights):
        eta = intercept + flags @ np.array(weights)
        return np.mean(np.logaddexp(0, eta) - eta * label) + 0.02 * np.abs(np.array(weights) * spread).sum()

    intercept, weights = rules.lasso(rows, 0.02)
    other = LogisticRegression(elasticNetParam=1.0, regParam=0.02, maxIter=1000, tol=1e-12).fit(rows)
    assert objective(intercept, weights) <= objective(other.intercept, other.coefficients.toArray()) * (1 + 1e-4)
    assert weights[0] > 0 > weights[4] and weights[8] == 0
    stopped = rules.lasso(rows, 0.02, rounds=0)  # no Newton step: the gradient method
    assert abs(objective(*stopped) - objective(intercept, weights)) < 1e-4
