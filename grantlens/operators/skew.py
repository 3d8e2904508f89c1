"""Joins of a bag with one row per key, where one key may hold a large share of the bag.

The right side comes out of an aggregate on the key, so AQE cannot split the
join by itself: its skew join needs an exchange of its own on both sides.  Here
heavy keys are found first, by a sketch of bounded size (``approx_top_k`` over
key hashes), and only they are treated: their bag rows get a salt, and their
one context row is repeated for every salt.  All other rows are joined as they
were, under salt 0.

The salt is the number of the map partition that reads the row.  It does not
depend on the order of rows within a task, so a task that runs again after a
lost executor deals its rows as before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heavy keys that a sketch looks for, and the items that it tracks to find them.
MAX_HEAVY, TRACKED = 64, 4096
#: A bag whose sources are below this size could be joined by one task whole: no sketch is taken.
SMALL_BYTES = 256 << 20


def source_bytes(df: DataFrame) -> int:
    """Size of the tables that ``df`` reads (an estimate of ``df`` itself multiplies the sides of every join)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def heavy_keys(bag: DataFrame, keys: Sequence[str], partitions: int) -> list[int]:
    """Hashes of the keys that hold more rows than the average join task, at most ``MAX_HEAVY``.

    A sketch over-counts by at most rows / ``TRACKED``; a key that is taken for heavy without being so
    is only salted for nothing.  Rows with a null in a key join nothing and are left out."""
    known = bag.dropna(subset=list(keys)).select(_key_hash(keys).alias("h"))
    row = known.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {MAX_HEAVY}, {TRACKED})").alias("top")).first()
    return [item["item"] for item in row["top"] or [] if item["count"] > row["n"] / partitions]


def split_join(bag: DataFrame, context: DataFrame, keys: Sequence[str], how: str = "left", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """``bag.join(context, keys, how)`` for ``how`` = left or inner, with heavy keys of ``bag`` split over many tasks.

    ``context`` should have one row a key (more are right as well, only repeated more often).  It is hashed: its keys spread
    over the tasks, and the bag, which may hold a key often, streams past it and is never sorted.
    Column order is that of the plain join: keys, other columns of ``bag``, other columns of ``context``."""
    if how not in ("left", "inner"):
        raise ValueError(f"split_join keeps the rows of its left side: {how}")
    if source_bytes(bag) < small_bytes:
        return bag.join(context.hint("shuffle_hash"), list(keys), how)
    partitions = int(bag.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(bag, keys, partitions)
    if not heavy:
        return bag.join(context.hint("shuffle_hash"), list(keys), how)
    salts = max(16, 2 * partitions)
    is_heavy = F.coalesce(_key_hash(keys).isin(heavy), F.lit(False))
    dealt = bag.withColumn("_salt", F.when(is_heavy, F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0)))
    repeated = context.withColumn("_salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated.hint("shuffle_hash"), [*keys, "_salt"], how).drop("_salt")
