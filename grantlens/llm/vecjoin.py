"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label and dimension are scaled to unit length, so a cosine of
at least ``t`` is a distance of at most ``eps = sqrt(2 - 2t)``.  They are
rotated to their principal axes (second moments summed in Spark over all
vectors), laid on a grid of width eps over the leading axes and sorted by grid
cell, first axis first: the epsilon grid order.  The sorted sequence is cut
into blocks of bounded size that carry their bounding box.  Blocks are joined
with blocks whose cells on the first axes touch, never all with all, and a
pair of blocks is joined by recursion: halves whose boxes are farther apart
than eps are skipped, small ones are compared by cosine in double precision.

Equal vectors of a label are folded first and counted.  A pair of blocks
returns the number of links of each vector and a spanning forest of the links
it found, never the list of all pairs, so a large group of near copies stays
linear in rows sent.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, arrow_schema, stored, text_batches
from .components import Forest, connected_components

LEAF = 64
#: Rounding room for boxes and rotated vectors; cosines themselves are compared exactly as computed.
ROOM = 1e-9


def _vector(values: pa.Scalar) -> np.ndarray | None:
    """The vector in double precision, or None where it cannot link."""
    if not values.is_valid or values.values.null_count or not len(values.values):
        return None
    v = values.values.to_numpy().astype(np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _parsed(vectors: DataFrame) -> DataFrame:
    """(vid, label, dim, vector) per row; dim and vector (its doubles as bytes) are null where it cannot link."""
    schema, arrow = arrow_schema("vid long, label long, dim int, vector binary")

    def run(batches):
        for batch in batches:
            rows = [_vector(v) for v in batch.column(2)]
            label = batch.column(1)
            ok = [v is not None and label[i].is_valid for i, v in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), label, pa.array([len(v) if u else None for v, u in zip(rows, ok)], pa.int32()),
                                              pa.array([v.tobytes() if u else None for v, u in zip(rows, ok)], pa.binary())], schema=arrow)

    return vectors.mapInArrow(run, schema)


def _axes(blocks: DataFrame, dim: int, lead: int) -> np.ndarray:
    """The ``lead`` leading principal axes of all unit vectors of one dimension (dim squared sums reach the driver)."""
    schema, arrow = arrow_schema("cell int, total double")

    def run(batches):
        moment = np.zeros((dim, dim))
        for batch in batches:
            m = np.stack([np.frombuffer(v.as_py()) for v in batch.column(0)])
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            moment += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim), pa.int32()), pa.array(moment.reshape(-1))], schema=arrow)

    rows = blocks.where(F.col("dim") == dim).select("vector").mapInArrow(run, schema).groupBy("cell").agg(F.sum("total").alias("total")).collect()
    moment = np.zeros(dim * dim)
    for r in rows:
        moment[r.cell] = r.total
    values, axes = np.linalg.eigh(moment.reshape(dim, dim))
    return axes[:, ::-1][:, :lead]


def _unit(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob).reshape(-1, dim)


def _box_gap(lo_a, hi_a, lo_b, hi_b) -> float:
    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(np.sqrt((gap * gap).sum()))


def join_blocks(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, same: bool, eps: float, threshold: float):
    """Recursive join of two sequences in grid order: per row the index pairs that link.

    ``a``, ``b`` are vectors (any length), ``pa_``, ``pb`` their unit vectors on the leading axes.
    Yields (rows of a, rows of b) of linked pairs, each unordered pair once where ``same``."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        if same and k < i:  # the mirror image is joined
            continue
        if _box_gap(pa_[i:j].min(axis=0), pa_[i:j].max(axis=0), pb[k:m].min(axis=0), pb[k:m].max(axis=0)) > eps + ROOM:
            continue
        if max(j - i, m - k) <= LEAF:
            cos = (a[i:j] @ b[k:m].T) / (na[i:j, None] * nb[None, k:m])
            x, y = np.nonzero(cos >= threshold)
            if same and i == k:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x + i, y + k
            continue
        left = [(i, j)] if j - i <= LEAF else [(i, (i + j) // 2), ((i + j) // 2, j)]
        right = [(k, m)] if m - k <= LEAF else [(k, (k + m) // 2), ((k + m) // 2, m)]
        stack += [(*p, *q) for p in left for q in right]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, lead: int = 8, block_rows: int = 1024) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their dimensions
    are equal and their cosine in double precision is at least ``threshold``
    (above 0).  Vectors that are null, empty or zero, or that hold null or
    non-finite components, link with nothing.  ``n_links`` counts the other
    rows linked directly, copies included; ``component_id`` is the smallest
    vec_id reachable; ``kept`` says that it is the row's own.  Rows without
    vec_id count as the largest id and report null for it.
    """
    spark = vectors.sparkSession
    text_batches(spark, 4096)
    eps = math.sqrt(2 - 2 * threshold)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("vid"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stored(_parsed(rows).withColumn("usable", F.col("vector").isNotNull()).withColumn("digest", F.sha2("vector", 256)), "vectors")
    usable = rows.where("usable")
    # one vector for each group of equal ones; its smallest id stands for the group
    groups = usable.groupBy("label", "dim", "digest").agg(F.min("vid").alias("least"), F.count("*").alias("copies"))
    groups = stored(groups.withColumn("rid", F.monotonically_increasing_id()), "vector-groups")
    reps = (usable.select("label", "dim", "digest", "vid", "vector").join(groups, ["label", "dim", "digest"]).where("vid = least")
            .select("rid", "label", "dim", "copies", "vector").dropDuplicates(["rid"]))
    reps = stored(reps, "vector-reps")
    dims = [r.dim for r in reps.select("dim").distinct().collect()]
    sizes, links = [], []
    for dim in sorted(dims):
        n, found = _join_dimension(reps, dim, _axes(reps, dim, min(lead, dim)), eps, threshold, block_rows)
        sizes.append(n)
        links.append(found)
    out = rows.join(groups, ["label", "dim", "digest"], "left").select("vid", "usable", "copies", "least", "rid")
    if not dims:
        return _finish(out.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vid")}))
    more, found = sizes[0], links[0]
    for n, f in zip(sizes[1:], links[1:]):
        more, found = more.unionByName(n), found.unionByName(f)
    more = more.groupBy("rid").agg(F.sum("linked").alias("linked"))
    labels = connected_components(found).withColumnRenamed("node", "rid")
    smallest = labels.join(groups, "rid").groupBy("component").agg(F.min("least").alias("component_id"))
    labels = stored(labels.join(smallest, "component").select("rid", "component_id"), "vector-components")
    out = out.join(more, "rid", "left").join(labels, "rid", "left")
    n_links = F.when(F.col("usable"), F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return _finish(out.withColumns({"n_links": n_links, "component_id": F.coalesce("component_id", "least", "vid")}))


def _finish(out: DataFrame) -> DataFrame:
    real = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
    return out.select(real("vid").alias("vec_id"), "n_links", real("component_id").alias("component_id"), (F.col("vid") == F.col("component_id")).alias("kept"))


def _join_dimension(reps: DataFrame, dim: int, axes: np.ndarray, eps: float, threshold: float, block_rows: int):
    """(rid, linked) sums and a forest of links (a, b) over the distinct vectors of one dimension."""
    lead = axes.shape[1]
    grid, grid_arrow = arrow_schema("rid long, label long, copies long, cells array<int>, vector binary")

    def place(batches):
        for batch in batches:
            m = np.stack([np.frombuffer(v.as_py()) for v in batch.column(3)])
            y = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ axes
            cells = pa.array(np.floor(y / eps).astype(np.int32).tolist(), grid_arrow.field("cells").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), cells, batch.column(3)], schema=grid_arrow)

    block, block_arrow = arrow_schema("block long, label long, lo array<double>, hi array<double>, rids array<long>, copies array<long>, vectors binary")

    def cut(batches):
        from pyspark import TaskContext

        base, made, held, now = TaskContext.get().partitionId() << 32, 0, [], None

        def emit():
            m = _unit(b"".join(h[2] for h in held), dim)
            y = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ axes
            row = [base + made, now, y.min(axis=0).tolist(), y.max(axis=0).tolist(), [h[0] for h in held], [h[1] for h in held], m.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, block_arrow.types)], schema=block_arrow)

        for batch in batches:
            for rid, label, copies, vector in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if held and (label != now or len(held) >= block_rows):
                    yield emit()
                    held, made = [], made + 1
                now = label
                held.append((rid, copies, vector))
        if held:
            yield emit()

    ordered = reps.where(F.col("dim") == dim).select("rid", "label", "copies", "vector").mapInArrow(place, grid)
    by = ["label", "cells", "rid"]
    blocks = stored(ordered.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(cut, block), "vector-blocks")
    # blocks meet when their cells on the first two axes touch: one side listed by its cells, the other by cells one wider
    def cells(column, widen):
        at = lambda c: F.floor(F.col(c)[column] / eps)
        return F.sequence(at("lo") - widen, at("hi") + widen)

    axis = 1 if lead > 1 else 0
    boxes = blocks.select("block", "label", "lo", "hi")
    own = boxes.withColumn("c0", F.explode(cells(0, 0))).withColumn("c1", F.explode(cells(axis, 0)))
    wide = boxes.withColumn("c0", F.explode(cells(0, 1))).withColumn("c1", F.explode(cells(axis, 1)))
    wide = wide.select(F.col("block").alias("other"), "label", F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), "c0", "c1")
    gap = F.aggregate(F.zip_with(F.zip_with("lo", "other_hi", lambda x, y: x - y), F.zip_with("other_lo", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))),
                      F.lit(0.0), lambda s, g: s + g * g)
    pairs = own.join(wide, ["label", "c0", "c1"]).where("block <= other").where(F.sqrt(gap) <= eps + ROOM).select("block", "other").distinct()
    body = blocks.select("block", "rids", "copies", "vectors")
    right = body.select(*(F.col(c).alias(f"{c}_2") for c in body.columns))
    work = pairs.join(body, "block").join(right, F.col("other") == F.col("block_2"))
    work = work.select("block", "other", "rids", "copies", "vectors", "rids_2", "copies_2", "vectors_2")
    result, result_arrow = arrow_schema("a long, b long, linked long")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block_a, block_b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                same = block_a == block_b
                ra, ca, rb, cb = (batch.column(c)[i].values.to_numpy() for c in (2, 3, 5, 6))
                a, b = _unit(batch.column(4)[i].as_py(), dim), _unit(batch.column(7)[i].as_py(), dim)
                ya, yb = ((m / np.linalg.norm(m, axis=1, keepdims=True)) @ axes for m in (a, b))
                na, nb = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
                forest = Forest()
                for x, y in join_blocks(a, ya, b, yb, same, eps, threshold):
                    np.add.at(na, x, cb[y])
                    np.add.at(na if same else nb, y, ca[x])
                    for p, q in zip(x.tolist(), (y if same else y + len(ra)).tolist()):
                        forest.add(p, q)
                ids = np.concatenate([ra, rb])
                link = np.array(forest.links, np.int64).reshape(-1, 2)
                hit_a, hit_b = np.flatnonzero(na), np.flatnonzero(nb)
                out_a = np.concatenate([ids[link[:, 0]], ra[hit_a], rb[hit_b]])
                out_b = np.concatenate([ids[link[:, 1]], ra[hit_a], rb[hit_b]])
                linked = np.concatenate([np.zeros(len(link), np.int64), na[hit_a], nb[hit_b]])
                yield pa.RecordBatch.from_arrays([pa.array(out_a), pa.array(out_b), pa.array(linked)], schema=result_arrow)

    spark = reps.sparkSession
    text_batches(spark, 16)
    rows = stored(work.repartition("block", "other").mapInArrow(compare, result), "vector-links")
    return rows.where("linked > 0").select(F.col("a").alias("rid"), "linked"), rows.where("linked = 0").select("a", "b")
