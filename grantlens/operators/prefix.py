"""What came before each row of its key, where one key may hold a large share of all rows.

A window over the key puts all rows of a key into one task.  Here the rows are
range-partitioned by (key, order) instead, so a hot key is cut into segments
that follow each other.  Every segment is folded to one row a key (last value,
sums), the folds are carried forward, and each row then combines what its own
segment holds before it with what was carried in.  Folds compose, so the
result is that of the window.

In a sorted segment only the first key can go on from an earlier one: the
carried folds that anything takes are at most one row a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .skew import SMALL_BYTES, source_bytes


def _checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _ordered(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], last: Sequence[str] = (), sums: Sequence[str] = (),
           small_bytes: int = SMALL_BYTES, segments: int | None = None,
           keep: Callable[[DataFrame], DataFrame] = _checkpointed) -> DataFrame:
    """``rows`` with ``<c>_before`` for each column of ``last`` (its value in the row before; null in a key's first row)
    and of ``sums`` (its sum over all rows before; 0 in the first row).

    ``order`` (nulls first) must tell the rows of a key apart.  Null keys are
    one key; columns of ``last`` hold no nulls, a null in ``sums`` counts as 0.
    Rows whose sources are below ``small_bytes`` are windowed by key at once.
    ``keep`` stores the segmented rows: their numbers must not change when an
    executor is lost and a task runs again."""
    exact = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if source_bytes(rows) < small_bytes:
        w = Window.partitionBy(*keys).orderBy(*_ordered(order))
        return rows.select("*", *(F.lag(c).over(w).alias(f"{c}_before") for c in last),
                           *(F.coalesce(F.sum(c).over(exact(w)), F.lit(0)).alias(f"{c}_before") for c in sums))
    segments = segments or 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = keep(rows.repartitionByRange(segments, *_ordered([*keys, *order])).withColumn("_segment", F.spark_partition_id()))
    folds = cut.groupBy("_segment", *keys).agg(
        *(F.max_by(c, F.struct(*order)).alias(f"_last_{c}") for c in last), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{c}") for c in sums))
    over = Window.partitionBy(*keys).orderBy("_segment")
    carried = folds.select(F.col("_segment").alias("_at_segment"), *(F.col(k).alias(f"_key_{k}") for k in keys), F.row_number().over(over).alias("_nth"),
                           *(F.lag(f"_last_{c}").over(over).alias(f"_carry_{c}") for c in last),
                           *(F.sum(f"_sum_{c}").over(exact(over)).alias(f"_carry_{c}") for c in sums)).where("_nth > 1").drop("_nth")
    here = Window.partitionBy("_segment", *keys).orderBy(*_ordered(order))
    own = cut.select("*", *(F.lag(c).over(here).alias(f"_own_{c}") for c in last), *(F.sum(c).over(exact(here)).alias(f"_own_{c}") for c in sums))
    same = F.col("_segment") == F.col("_at_segment")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    zero = F.lit(0).cast("long")
    return own.join(F.broadcast(carried), same, "left").select(  # at most one row a segment
        *rows.columns, *(F.coalesce(f"_own_{c}", f"_carry_{c}").alias(f"{c}_before") for c in last),
        *((F.coalesce(f"_own_{c}", zero) + F.coalesce(f"_carry_{c}", zero)).alias(f"{c}_before") for c in sums))
