"""Bindings as validity intervals (#29, #34, #42): storage that grows with changes, not with days.

A snapshot history repeats every binding every day.  An interval says once that
a binding was there from one snapshot until before another: ``valid_from`` is
the first snapshot that has it, ``valid_to`` the first one after that lacks it
(null: the newest snapshot still has it), ``last_seen`` the last one with it.

``binding_intervals`` builds them from a history; ``interval_delta`` maintains
them from one snapshot to the next and touches open intervals only.  Closed
ones never change, so they are appended; the open ones are as many as there
are bindings.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import TRIPLE, ts
from ..sources import sinks

INTERVAL = [*TRIPLE, "valid_from", "last_seen", "valid_to", "snapshots"]
OPEN_TABLE, CLOSED_TABLE = "iam_binding_intervals_open", "iam_binding_intervals_closed"


def binding_intervals(raw_hist: DataFrame, ts_col: str = "assessment_timestamp") -> DataFrame:
    """Intervals of every triple over all snapshots of a history (a null principal is a value like any other).

    The snapshots are numbered in one small window (one row each) and that list is broadcast: a shuffle by time would
    leave a whole snapshot to one task.  A triple's rows are at most one a snapshot."""
    times = raw_hist.select(F.col(ts_col).alias("at")).distinct()
    order = Window.orderBy("at")
    times = times.select("at", F.row_number().over(order).alias("nth"), F.lead("at").over(order).alias("next"))
    seen = raw_hist.select(*TRIPLE, F.col(ts_col).alias("at")).distinct().join(F.broadcast(times), "at")
    # consecutive snapshots of one binding have the same difference between their number and its rank
    run = F.col("nth") - F.row_number().over(Window.partitionBy(*TRIPLE).orderBy("nth"))
    return (seen.withColumn("run", run).groupBy(*TRIPLE, "run")
            .agg(F.min("at").alias("valid_from"), F.max("at").alias("last_seen"), F.max_by("next", "nth").alias("valid_to"), F.count(F.lit(1)).alias("snapshots"))
            .select(*INTERVAL))


def interval_delta(open_intervals: DataFrame, snapshot: DataFrame, at: str | _dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(intervals that the snapshot closes, the open ones after it), by one aggregate over both sides.

    Like the reconciliation it needs no join: a binding that a third of all rows repeat folds before the shuffle."""
    now = ts(at)
    old = open_intervals.select(*TRIPLE, F.struct("valid_from", "last_seen", "snapshots").alias("old"), F.lit(False).alias("there"))
    new = snapshot.select(*TRIPLE, F.lit(None).cast(old.schema["old"].dataType).alias("old"), F.lit(True).alias("there"))
    both = old.unionByName(new).groupBy(*TRIPLE).agg(F.max("old").alias("old"), F.bool_or("there").alias("there"))
    closed = both.filter(~F.col("there")).select(*TRIPLE, "old.valid_from", "old.last_seen", now.alias("valid_to"), "old.snapshots")
    still = both.filter("there").select(
        *TRIPLE, F.coalesce("old.valid_from", now).alias("valid_from"), now.alias("last_seen"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        (F.coalesce("old.snapshots", F.lit(0)) + 1).cast("long").alias("snapshots"))
    return closed, still


def bindings_at(intervals: DataFrame, t: str | _dt.datetime) -> DataFrame:
    """#34 from intervals: the distinct triples of the newest snapshot at or before ``t``."""
    return intervals.filter((F.col("valid_from") <= ts(t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts(t)))).select(*TRIPLE)


def first_seen(intervals: DataFrame) -> DataFrame:
    """#29 from intervals: first and last snapshot time and snapshot count per triple."""
    return intervals.groupBy(*TRIPLE).agg(F.min("valid_from").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("snapshots").alias("snapshots"))


def store_snapshot(spark: SparkSession, root: str, snapshot: DataFrame, at: str | _dt.datetime) -> dict[str, int]:
    """Fold one snapshot into the stored intervals: closed ones are appended, the open ones replaced.

    Closed rows are written first, and only those that the table lacks, so a run that failed in between can be
    run again; a snapshot that was folded already (``last_seen`` = ``at``) changes nothing."""
    if sinks.table_exists(spark, root, OPEN_TABLE):
        before = sinks.read_current(spark, root, OPEN_TABLE)
    else:
        before = binding_intervals(snapshot.withColumn("at", ts(at)), "at").limit(0)
    if not before.filter(F.col("last_seen") >= ts(at)).isEmpty():
        return {"closed": 0, "open": 0}
    closed, still = interval_delta(before, snapshot, at)
    n = sinks.append_new(closed, root, CLOSED_TABLE, [*TRIPLE, "valid_from"], p_date=str(at)[:10])
    return {"closed": n, "open": sinks.replace_snapshot(still, root, OPEN_TABLE)}


def read_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Closed and open intervals as stored."""
    still = sinks.read_current(spark, root, OPEN_TABLE).select(*INTERVAL)
    if not sinks.table_exists(spark, root, CLOSED_TABLE):
        return still
    return sinks.read_current(spark, root, CLOSED_TABLE).select(*INTERVAL).unionByName(still)
