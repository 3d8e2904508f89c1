"""Sharding and the vector join, and the pipeline as a whole."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantlens.llm import minhash, rules, slots, vecjoin
from grantlens.llm.common import shared_path

from .test_dedup import lines_by_hand, near_by_hand
from .test_text import check_pieces, hits_by_hand


def check_shards(df, rows, shards, slots_n=slots.SLOTS):
    got = slots.shard_documents(df, shared_path(df.sparkSession, "test-slots"), shards, slots_n).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    for s in range(shards):
        places = sorted(r.slot for r in got if r.shard == s)
        assert places == list(range(len(places)))
    return [sum(r.size for r in got if r.shard == s) for s in range(shards)]


def test_sharding(spark, docs, rows, odd_docs, no_docs):
    # the long text is the one record that cannot be cut
    sizes = sorted(check_shards(docs, rows, 3))
    largest = max(len((t or "").encode()) + 1 for _, t in rows)
    assert sizes[-1] - sizes[0] <= max(largest - sum(sizes) // 3, 200) * 2
    check_shards(docs, rows, 3, slots_n=16)
    check_shards(odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()], 4)
    assert check_shards(no_docs, [], 2) == [0, 0]
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = check_shards(sf, [(r.doc_id, r.text) for r in sf.collect()], 8)
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 8


def test_slot_map_versions(spark):
    path = shared_path(spark, "test-map")
    rng = np.random.default_rng(4)
    sizes = {n: (int(s), 1) for n, s in enumerate(rng.pareto(3.0, 1000) * 1000 + 1)}
    slots.store_map(spark, path, 1, slots.first_map(1000, 8))
    first = slots.load_map(spark, path, 1)
    assert first == [n % 8 for n in range(1000)]
    even = slots.rebalance(first, sizes, 8)
    load = lambda m, k: [sum(sizes[n][0] for n in range(1000) if m[n] == s) for s in range(k)]
    assert max(load(even, 8)) - min(load(even, 8)) < 0.01 * sum(load(even, 8)) / 8
    # an even map is not touched, a ninth shard takes about a ninth of the bytes, a shard taken away leaves the others' slots where they are
    assert sum(a != b for a, b in zip(even, slots.rebalance(even, sizes, 8))) <= 40
    grown = slots.rebalance(even, sizes, 9)
    moved = [n for n in range(1000) if grown[n] != even[n]]
    assert sum(sizes[n][0] for n in moved) < 0.2 * sum(s for s, _ in sizes.values())
    assert max(load(grown, 9)) < 1.02 * sum(load(grown, 9)) / 9
    shrunk = slots.rebalance(even, sizes, 7)
    assert set(shrunk) == set(range(7))
    slots.store_map(spark, path, 2, grown)
    assert slots.load_map(spark, path, 1) == first and slots.load_map(spark, path, 2) == grown
    with pytest.raises(Exception):
        slots.store_map(spark, path, 2, even)


def vectors_by_hand(rows, threshold=0.98):
    unit = {}
    for k, (i, v, label) in enumerate(rows):
        if v is not None and len(v) and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[k] = x / np.linalg.norm(x)
    linked = {k: set() for k in range(len(rows))}
    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                linked[a].add(b)
                linked[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in linked[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        component = min(ids) if ids else None
        out.append((i, len(linked[k]), component, component == i))
    return out


def vector_rows():
    rng = np.random.default_rng(9)
    rows = []
    for g in range(12):  # groups of near copies, some of which chain
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 40)):
            base = base + rng.normal(size=16) * 0.04 * (g % 3)
            rows.append((base + rng.normal(size=16) * 0.08).tolist())
    rows += [rows[5]] * 60 + [(np.array(rows[5]) * 3).tolist()] + rng.normal(size=(150, 16)).tolist()
    data = [(i + 100, v, int(rng.integers(0, 2)) if i % 2 else 1) for i, v in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    data += [(1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [nan] + [1.0] * 15, 1), (5, [inf] * 16, 1), (6, [None] + [1.0] * 15, 1), (7, rows[5], None),
             (8, rows[5][:8], 1), (9, rows[5][:8], 1), (10, [1.0], 0), (11, [2.0], 0), (12, [-2.0], 0)]
    return data


@pytest.mark.parametrize("block_rows,lead", [(1024, 8), (30, 3), (90, 1)])
def test_near_vectors(spark, block_rows, lead):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", df_lit())
    got = vecjoin.near_vectors(df, 0.98, lead=lead, block_rows=block_rows).collect()
    want = vectors_by_hand(rows)
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(w[1] for w in want) > 3000


def df_lit():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_near_vectors_without_ids(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(None, v, 1), (None, v, 1), (None, w, 1), (4, w, 1), (5, v, 2), (5, v, 2)], schema)
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in vecjoin.near_vectors(df).collect()))
    assert got == sorted([(-1, 1, -1, True)] * 2 + [(-1, 1, 4, False), (4, 1, 4, True)] + [(5, 1, 5, True)] * 2)
    assert vecjoin.near_vectors(df.where("false")).count() == 0
    assert [tuple(r) for r in vecjoin.near_vectors(df.where("vec_id = 4").withColumn("label", df_lit().cast("int") * None)).collect()] == [(4, 0, 4, True)]


def test_pipeline_against_its_stages_by_hand(spark):
    import public_tokenizers  # noqa: F401

    import corpus_pipeline as C

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = rules.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = [(r.row.doc_id, r.row.text) for r in rules.quality_scores(docs, model).where("score >= 0.5").collect()]
    rows = [(i, kept) for i, (_, _, kept) in lines_by_hand(rows).items()]
    sets, component = near_by_hand(rows, 5, 80)
    rows = [(i, t) for i, t in rows if component[i] == i]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {d for d, _, hit, _ in hits_by_hand(rows, bench) if not hit}
    rows = [(i, t) for i, t in rows if i in clean]
    assert 100 < len(rows) < 200
    check_pieces(C.run(spark, data).collect(), rows, 2048)


def test_pipeline_stages_keep_columns_and_empty_tables(spark, docs, no_docs):
    import corpus_pipeline as C

    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
        assert stage(spark, no_docs, "/root/testdata/sf0.001").count() == 0, name
    assert minhash.near_duplicates(no_docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_sharding_of_equal_rows(spark):
    """Equal rows without id share one hash; they are dealt all the same, and the law holds."""
    same = spark.range(0, 20_000, numPartitions=5).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    sizes = check_shards(same, [(None, "the same text")] * 20_000, 8)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 8
    mixed = same.limit(3000).unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")))
    sizes = check_shards(mixed, [(r.doc_id, r.text) for r in mixed.collect()], 8)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8


def test_written_shards_hold_every_record(spark, docs, odd_docs, no_docs):
    for df in (docs, odd_docs, odd_docs.withColumn("shard", F.lit("own")), no_docs):
        path, placed = shared_path(spark, "test-shards"), None
        placed = slots.shard_documents(df, shared_path(spark, "test-slots"), 3, carry=True).cache()
        slots.write_shards(placed, path)
        folder = "_shard" if "shard" in df.columns else "shard"
        if df.isEmpty():
            continue
        back = spark.read.parquet(path)
        assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
        assert sorted(r[0] for r in back.select(folder).collect()) == sorted(r[0] for r in placed.select("shard").collect())
