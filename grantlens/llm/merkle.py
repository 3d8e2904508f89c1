"""Merkle manifest of a table: per group a tree over its ordered rows, and one tree over the groups.

A node is a lowercase hex SHA-256; every eight consecutive nodes (the last run:
fewer, even one) become the hash of their concatenation until one is left.

Rows are numbered by a range partitioning with counts per task, so a group of
any share of the rows spreads over all tasks.  ``span`` = 512 consecutive nodes
of a group are a superblock, three levels of the tree.  Upwards, each round
reduces superblocks to their tops, which are the rows of the next round: the
rows shrink 512-fold, and the number of rounds is the logarithm of the largest
group.  Downwards, a round cogroups the rows of a superblock with the one outer
row of its top: the siblings on the way from there to the root.  In that
``applyInPandas`` call the superblock is reduced again, its own siblings are
joined to the outer ones, and the proof of each row is folded.  A task never
holds more than one superblock and one outer path.

Every round is written to the shared folder: a lost executor repeats a task.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, stored
from .linededup import LOWER, UPPER

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(columns: list[Column]) -> Column:
    """Hash of a row: ``-`` for null, else the UTF-8 byte count, ``:`` and the value, concatenated."""
    values = [c.cast("string") for c in columns]
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def climb(nodes: list[str], n: int, span: int) -> list[list[str]]:
    """The levels of a superblock of a group of ``n`` nodes, from its nodes up to its top."""
    levels, width = [nodes], 1
    while n > 1 and width < span:
        nodes = [digest("".join(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)]
        n, width = -(-n // FAN), width * FAN
        levels.append(nodes)
    return levels


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """(left siblings, right siblings) of node ``i`` on each level below the top."""
    out = []
    for level in levels[:-1]:
        at = i - i % FAN
        out.append(("".join(level[at:i]), "".join(level[i + 1:at + FAN])))
        i //= FAN
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that ``node`` and its siblings give."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place in its group ``g`` in the order of ``by``, and ``n``, the group's rows.

    Equal rows are told apart by their place in a stored copy, so the order is total."""
    names = rows.columns
    marked = stored(rows.withColumn("mark", F.monotonically_increasing_id()), "merkle-rows")
    order = ["g", *by, "mark"]
    in_order = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(in_order.select(*names, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("serial")), "merkle-order")
    # one row a task and group: at most as many as there are tasks and groups together
    runs = placed.groupBy("g", "part").agg(F.min("serial").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("g")
    runs = runs.select("g", "part", "first", F.sum("rows").over(group).alias("n"),
                       (F.sum("rows").over(group.orderBy("part")) - F.col("rows")).alias("before"))
    return placed.join(runs, ["g", "part"]).select(*names, (F.col("serial") - F.col("first") + F.col("before")).alias("at"), "n")


def tops(rows: DataFrame, span: int) -> DataFrame:
    """One row (g, at, n, node) a superblock of ``rows``: its top, numbered in its group."""
    def top(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        n = int(block["n"].iloc[0])
        return pd.DataFrame({"g": [key[0]], "at": [key[1]], "n": [-(-n // span)], "node": [climb(block["node"].tolist(), n, span)[-1][0]]})

    return rows.select("g", "at", "n", "node").groupBy("g", F.expr(f"at div {span}")).applyInPandas(top, "g string, at long, n long, node string")


def rounds_up(rows: DataFrame, span: int) -> list[DataFrame]:
    """``rows`` and the tops of each round, down to one row a group."""
    out = [rows]
    size = rows.agg(F.max("n")).first()[0] or 1
    while size > 1 or len(out) == 1:
        out.append(stored(tops(out[-1], span), "merkle-tops"))
        size = -(-size // span)
    return out


def rounds_down(rounds: list[DataFrame], outer: DataFrame, span: int) -> DataFrame:
    """The siblings of the rows of the first of ``rounds`` in its superblocks; ``outer`` (g, at, path, ends) belongs to the last round's rows."""
    def extend(key: tuple, block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block, levels, above, ends = _open(block, over, span)
        paths = [[{"left": a, "right": b} for a, b in siblings(levels, i) + above] for i in range(len(block))]
        return pd.DataFrame({"g": block["g"], "at": block["at"], "path": paths, "ends": [ends] * len(block)})

    for rows in reversed(rounds[1:-1]):
        outer = stored(_cogrouped(rows.select("g", "at", "n", "node"), outer, span).applyInPandas(extend, f"g string, at long, path {PATH}, ends array<string>"), "merkle-paths")
    return outer


def _cogrouped(rows: DataFrame, outer: DataFrame, span: int):
    return rows.groupBy("g", F.expr(f"at div {span}")).cogroup(outer.groupBy("g", "at"))


def _open(block: pd.DataFrame, over: pd.DataFrame, span: int):
    """A superblock in order, its levels, the siblings above its top and the nodes where its trees end."""
    block = block.sort_values("at").reset_index(drop=True)
    levels = climb(block["node"].tolist(), int(block["n"].iloc[0]), span)
    above = [(step["left"], step["right"]) for step in over["path"].iloc[0]]
    return block, levels, above, list(over["ends"].iloc[0])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None,
             span: int = FAN ** 3) -> DataFrame:
    """One row per input row: ``key``, leaf, subroot, root, proof_sha256, n_siblings, folded_root, verified.

    Leaves hash ``fields``; those of a group ascend by ``key`` (null first, ties
    by leaf; equal leaves are interchangeable), a null group is one of its own.
    Subroots are ordered by group, null first, then bytewise.  ``proof_sha256``
    hashes the siblings up to the root.  ``tampered`` replaces fields (it may
    leave a row as it is): ``folded_root`` comes from the leaf of those values
    and the siblings of the table as it is, and ``verified`` says that it is
    the root.  Repeated rows are leaves each; texts are hashed whole, however
    long, and never leave the JVM; other columns, whatever their names, do not
    count; an empty table has no rows.
    """
    importable(docs.sparkSession)
    changed = tampered or {}
    g = F.when(F.col(group).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(group).cast("string")))  # null sorts first
    rows = docs.select(F.col(key).cast("long").alias("key"), g.alias("g"), leaf_hash([F.col(c) for c in fields]).alias("node"),
                       leaf_hash([changed.get(c, F.col(c)) for c in fields]).alias("shown"))
    rows = stored(numbered(rows, ["key", "node"]), "merkle-leaves")
    inner = rounds_up(rows, span)
    subroots = inner[-1].select(F.lit("").alias("g"), "node", F.col("g").alias("name"))
    subroots = stored(numbered(subroots, ["name"]), "merkle-subroots")
    across = rounds_up(subroots, span)
    root = across[-1].select("g", "at", F.lit(None).cast(PATH).alias("path"), F.array("node").alias("ends")).withColumn("path", F.coalesce("path", F.array().cast(PATH)))

    def to_subroot(key: tuple, block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block, levels, above, ends = _open(block, over, span)
        paths = [[{"left": a, "right": b} for a, b in siblings(levels, i) + above] for i in range(len(block))]
        return pd.DataFrame({"g": block["name"], "at": 0, "path": paths, "ends": [[node, *ends] for node in block["node"]]})

    outer = rounds_down(across, root, span)
    outer = stored(_cogrouped(subroots, outer, span).applyInPandas(to_subroot, f"g string, at long, path {PATH}, ends array<string>"), "merkle-paths")
    outer = rounds_down(inner, outer, span)

    def finish(_: tuple, block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block, levels, above, (subroot, root) = _open(block, over, span)
        tail = "".join(a + b for a, b in above)
        proofs, folded, counts = [], [], []
        for i, shown in enumerate(block["shown"].tolist()):
            own = siblings(levels, i)
            proof = "".join(a + b for a, b in own) + tail
            proofs.append(digest(proof))
            counts.append(len(proof) // 64)
            folded.append(fold(shown, own + above))
        return pd.DataFrame({key: block["key"], "leaf": block["node"], "subroot": subroot, "root": root, "proof_sha256": proofs, "n_siblings": counts,
                             "folded_root": folded, "verified": [f == root for f in folded]})

    out = f"`{key}` long, leaf string, subroot string, root string, proof_sha256 string, n_siblings long, folded_root string, verified boolean"
    return _cogrouped(rows, outer, span).applyInPandas(finish, out)


def lowered_every_third(key: str = "doc_id") -> dict[str, Column]:
    """The tampering that the registered query checks: A-Z of ``text`` lower-cased where 3 divides the CRC-32 of the decimal key."""
    third = F.crc32(F.col(key).cast("string")) % 3 == 0
    return {"text": F.when(third, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}
