"""Snapshot catalogue: which snapshots a history table holds, and in which day folders.

A history table gets one snapshot a run (#9, #14, #42).  Finding the newest one,
or the newest at some time, by an aggregate over the history reads every day
that was ever stored.  The catalogue has one row per (snapshot, day) instead:
``<table>/_snapshots/part-*.parquet`` with execution_id, snapshot_at, p_date,
rows and the table version that holds them.  It is appended after the data, so
a snapshot that is listed is stored in full; a crash in between leaves rows
that no lookup returns until :func:`rebuild` lists them.

Lookups sort the catalogue, take one row to the driver, and read the history
with that row's day and id as literals: one day folder is scanned.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ts
from . import sinks

SNAPSHOTS = "_snapshots"
ENTRY = "execution_id string, snapshot_at timestamp_ntz, p_date date, rows long, version string"

#: History tables that hold snapshots, and the column with a snapshot's time.
SNAPSHOT_TIME = {
    "iam_policy_bindings_raw_history": "assessment_timestamp",
    "iam_permission_bindings_history": "recorded_at",
    "gcp_resource_inventory_history": "assessed_at",
    "google_group_membership_history": "assessed_at",
}


def _path(root: str, table: str) -> str:
    return os.path.join(root, table, SNAPSHOTS)


def _entries(rows: DataFrame, table: str, version: str) -> DataFrame:
    at = F.col(SNAPSHOT_TIME[table])
    return (rows.groupBy("execution_id", at.alias("snapshot_at"), at.cast("date").alias("p_date"))
            .agg(F.count(F.lit(1)).alias("rows")).withColumn("version", F.lit(version)))


def read_catalogue(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The current version's snapshots, one row per (execution_id, snapshot_at, p_date).

    A run that was appended in parts, or again after a failure, has several entries: their rows are added."""
    version = sinks.current_version(spark, root, table)
    if version is None or not sinks.path_exists(spark, _path(root, table)):
        return spark.createDataFrame([], ENTRY)
    entries = spark.read.schema(ENTRY).parquet(_path(root, table)).where(F.col("version") == version)
    return entries.groupBy("execution_id", "snapshot_at", "p_date", "version").agg(F.sum("rows").alias("rows"))


def append_snapshot(df: DataFrame, root: str, table: str, keys: list[str] | None = None, **same: str) -> int:
    """Append snapshot rows, then their catalogue entries; returns rows written.

    With ``keys`` rows that the table has already are left out (see ``sinks.append_new``), so that a run that is
    repeated lists and stores nothing twice.  Entries are counted from what was stored: the days that ``df``
    touches, and of them only the ids."""
    spark = df.sparkSession
    at = F.col(SNAPSHOT_TIME[table])
    runs = df.select("execution_id", at.cast("date").alias("p_date")).distinct().collect()  # a run is one id on one day
    before = {(r.execution_id, r.p_date): r.rows for r in _stored_runs(spark, root, table, runs).collect()}
    n = sinks.append_new(df, root, table, keys, **same) if keys else sinks.write_table(df, root, table)
    version = sinks.current_version(spark, root, table)
    after = _entries(_stored_rows(spark, root, table, runs), table, version)
    new = [(r.execution_id, r.snapshot_at, r.p_date, r.rows - before.get((r.execution_id, r.p_date), 0), version) for r in after.collect()]
    new = [row for row in new if row[3] > 0]
    if new:
        spark.createDataFrame(new, ENTRY).coalesce(1).write.mode("append").parquet(_path(root, table))
    return n


def _stored_rows(spark: SparkSession, root: str, table: str, runs: list) -> DataFrame:
    """The stored rows of the given (execution_id, p_date) runs: only their day folders are read."""
    days, ids = sorted({r.p_date for r in runs if r.p_date}), sorted({r.execution_id for r in runs if r.execution_id})
    return sinks.read_current(spark, root, table).where(F.col("p_date").isin(days) & F.col("execution_id").isin(ids))


def _stored_runs(spark: SparkSession, root: str, table: str, runs: list) -> DataFrame:
    listed = read_catalogue(spark, root, table)
    return listed.groupBy("execution_id", "p_date").agg(F.sum("rows").alias("rows"))


def rebuild(spark: SparkSession, root: str, table: str) -> int:
    """List every stored snapshot of the current version anew (one scan of two columns); returns the entries."""
    version = sinks.current_version(spark, root, table)
    entries = _entries(sinks.read_current(spark, root, table), table, version)
    entries.write.mode("overwrite").parquet(_path(root, table))
    return spark.read.schema(ENTRY).parquet(_path(root, table)).count()


def latest_entry(spark: SparkSession, root: str, table: str, as_of: str | _dt.datetime | None = None):
    """#65: the newest snapshot (at or before ``as_of``) as a row, or None; ties go to the larger id."""
    listed = read_catalogue(spark, root, table)
    if as_of is not None:
        listed = listed.where(F.col("snapshot_at") <= ts(as_of))
    found = listed.orderBy(F.col("snapshot_at").desc_nulls_last(), F.col("execution_id").desc()).limit(1).collect()
    return found[0] if found else None


def read_snapshot(spark: SparkSession, root: str, table: str, as_of: str | _dt.datetime | None = None) -> DataFrame:
    """#34, #48: the rows of the newest snapshot (at or before ``as_of``); no rows where there is none."""
    rows = sinks.read_current(spark, root, table)
    entry = latest_entry(spark, root, table, as_of)
    if entry is None:
        return rows.where("false")
    at = F.col(SNAPSHOT_TIME[table])
    return rows.where((F.col("p_date") == F.lit(entry.p_date)) & (F.col("execution_id") == entry.execution_id) & (at == ts(entry.snapshot_at)))
