"""Table writers (#8-13, #15-17): the only library code that touches storage.

Conventions:
* every write makes a batch: ``<root>/<table>/data/batch=<id>/p_date=<day>/*.parquet``,
  sorted within files on its clustering keys (the reference's DAY partitioning
  and clustering), so date filters prune folders and key filters use row-group
  min/max statistics;
* a batch counts once an entry of ``<table>/_pointers`` names it.  Entries are
  numbered and list all batches of the table as it then is; the newest is
  current.  An entry is written aside and renamed to its number, which fails
  where another writer has made that number (HDFS renames are atomic; on an
  object store use a file system that is): that writer's entry is then read and
  the commit is made on top of it, so an append that races a replace or another
  append loses nothing.  Readers see a table before or after a commit, never
  in between, and never the rows of a write that failed;
* a replace lists its own batch alone, an append adds one, ``upsert`` adds the
  rows that changed (merge on read: a row is hidden where a later change batch
  has its key) and ``compact`` folds them into one batch when they have grown;
* rows are rebalanced by day before a write: small days share a task and a hot
  day is split by AQE, so neither tasks x days small files nor one huge task;
* row counts come from ``DataFrame.observe`` on the write itself (no second
  pass over the data).
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
import json
import os
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ts

POINTERS = "_pointers"
DATA = "data"

# table -> (timestamp column for the DAY partition, clustering keys)
TABLE_LAYOUT: dict[str, tuple[str, list[str]]] = {
    "iam_access_requests": ("requested_at", ["status", "principal_email", "role"]),
    "iam_access_request_history": ("event_at", ["request_id"]),
    "iam_access_change_log": ("executed_at", ["request_id", "result"]),
    "iam_policy_permissions": ("assessment_timestamp", ["principal_email", "resource_name", "role"]),
    "iam_policy_bindings_raw_history": ("assessment_timestamp", ["principal_email", "resource_name", "role"]),
    "iam_permission_bindings_history": ("recorded_at", ["principal_email", "resource_name", "iam_role"]),
    "iam_reconciliation_issues": ("detected_at", ["issue_type", "principal_email"]),
    "iam_pipeline_job_reports": ("occurred_at", ["job_type", "result"]),
    "gcp_resource_inventory_history": ("assessed_at", ["resource_type", "resource_id"]),
    "google_group_membership_history": ("assessed_at", ["group_email", "member_email"]),
    "iam_binding_intervals_closed": ("valid_to", ["principal_email", "resource_name", "role"]),
}


def _files(spark: SparkSession, path: str):
    """(file system, path) of the store that ``path`` lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return bool(fs.exists(at))


def _observed(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """``df`` with its rows counted by the action that runs it, and a function that gives the number.

    Where the optimizer finds the plan empty it drops the count as well, and the metrics have no columns."""
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    out = df.observe(obs, F.count(F.lit(1)).alias("n"))
    return out, lambda: int(obs.get["n"]) if obs._jo.getRow().schema() is not None else 0


def write_partitioned(df: DataFrame, path: str, date_col: str | None, sort_cols: Sequence[str] = (),
                      mode: str = "append") -> int:
    """#17: write with a DAY partition on ``date_col`` and in-file clustering; returns rows written."""
    out, rows = _observed(df)
    days = []
    if date_col:
        out = out.withColumn("p_date", F.col(date_col).cast("date")).hint("rebalance", "p_date")
        days = ["p_date"]
    if days or sort_cols:
        out = out.sortWithinPartitions(*days, *sort_cols)
    writer = out.write.mode(mode)
    if days:
        writer = writer.partitionBy(*days)
    writer.parquet(path)
    return rows()


class CommitClash(RuntimeError):
    """Another writer has committed to the table in between."""


@dataclasses.dataclass(frozen=True)
class Head:
    """A table as one entry describes it: (batch, rows, holds changes) in commit order.

    ``version`` names the last replace; ``keys`` are those by which change batches hide earlier rows."""

    number: int = 0
    version: str | None = None
    batches: tuple[tuple[str, int, bool], ...] = ()
    keys: tuple[str, ...] = ()

    def replaced(self, batch: str, rows: int, version: str | None = None) -> Head:
        return Head(self.number + 1, version or batch, ((batch, rows, False),))

    def appended(self, batch: str, rows: int, keys: Sequence[str] = ()) -> Head:
        if keys and self.keys and tuple(keys) != self.keys:
            raise ValueError(f"rows are changed by {self.keys}, not by {tuple(keys)}")
        return Head(self.number + 1, self.version or batch, (*self.batches, (batch, rows, bool(keys))), tuple(keys) or self.keys)


def read_head(spark: SparkSession, root: str, table: str) -> Head:
    """The newest entry; number 0 where the table has never been written."""
    fs, at = _files(spark, os.path.join(root, table, POINTERS))
    names = sorted(name for f in fs.listStatus(at) if (name := f.getPath().getName()).isdigit()) if fs.exists(at) else []
    if not names:
        return Head()
    stream = fs.open(_files(spark, os.path.join(root, table, POINTERS, names[-1]))[1])
    try:
        entry = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Head(int(names[-1]), entry["version"], tuple(tuple(b) for b in entry["batches"]), tuple(entry["keys"]))


def commit(spark: SparkSession, root: str, table: str, head: Head) -> None:
    """Create the entry ``head.number``; ``CommitClash`` where it exists."""
    folder = os.path.join(root, table, POINTERS)
    fs, aside = _files(spark, os.path.join(folder, f".{uuid.uuid4().hex}"))
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps({"version": head.version, "batches": head.batches, "keys": head.keys}).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(aside, _files(spark, os.path.join(folder, f"{head.number:012d}"))[1], no_overwrite)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise CommitClash(f"{table}: entry {head.number} was made by another writer") from e
        raise


def _write_batch(df: DataFrame, root: str, table: str, keep_empty: bool = False) -> tuple[str, int]:
    """Write rows as a batch that no entry names yet; returns (batch, rows)."""
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d%H%M%S")
    batch = f"b-{stamp}-{uuid.uuid4().hex[:8]}"
    date_col, keys = TABLE_LAYOUT.get(table, (None, []))
    path = os.path.join(root, table, DATA, f"batch={batch}")
    n = write_partitioned(df.drop("p_date"), path, date_col if date_col in df.columns else None, [k for k in keys if k in df.columns])
    if n == 0 and keep_empty:  # partitioned writes of no rows leave no file to take the schema from
        df.drop("p_date").limit(0).coalesce(1).write.mode("append").parquet(path)
    return batch, n


def current_version(spark: SparkSession, root: str, table: str) -> str | None:
    """The name of the last replace, or None where the table has never been written."""
    return read_head(spark, root, table).version


def table_exists(spark: SparkSession, root: str, table: str) -> bool:
    return read_head(spark, root, table).number > 0


def write_table(df: DataFrame, root: str, table: str) -> int:
    """Append rows; the first append creates the table.  After a clash the same batch is committed on the newer entry."""
    spark = df.sparkSession
    batch, n = _write_batch(df, root, table, keep_empty=not table_exists(spark, root, table))
    while True:
        head = read_head(spark, root, table)
        if n == 0 and head.number:
            return 0
        try:
            commit(spark, root, table, head.appended(batch, n))
            return n
        except CommitClash:
            continue


def append_new(df: DataFrame, root: str, table: str, keys: Sequence[str], **same: str) -> int:
    """Append the rows whose ``keys`` the table lacks, so a job that is run again adds nothing twice.

    ``same`` are column values that all rows share (an execution id, say, or with ``p_date`` their day): only
    stored rows with them are compared, and with ``p_date`` only that day's folder is read.  After a clash the
    keys are compared again, with what the other writer has added."""
    spark = df.sparkSession
    while True:
        head, new = read_head(spark, root, table), df
        if head.number:
            have = read_at(spark, root, table, head)
            for column, value in same.items():
                if column != "p_date" or column in have.columns:
                    have = have.where(F.col(column) == F.lit(value).cast(have.schema[column].dataType))
            have = have.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
            new = df.join(have, _same_key([(k, f"_{k}") for k in keys]), "left_anti")
        batch, n = _write_batch(new, root, table, keep_empty=not head.number)
        if n == 0 and head.number:
            return 0
        try:
            commit(spark, root, table, head.appended(batch, n))
            return n
        except CommitClash:
            continue


def replace_snapshot(df: DataFrame, root: str, table: str, base: Head | None = None) -> int:
    """#8: full replace; an empty input leaves an empty (truncated) table.  Returns rows written.

    Rows that were made from the table itself are given with the ``base`` that they were read at: the replace
    fails (``CommitClash``) where anything was committed since.  Without it the last replace wins."""
    spark = df.sparkSession
    batch, n = _write_batch(df, root, table, keep_empty=True)
    while True:
        head = base or read_head(spark, root, table)
        try:
            commit(spark, root, table, head.replaced(batch, n))
            return n
        except CommitClash:
            if base is not None:
                raise


def upsert(spark: SparkSession, root: str, table: str, keys: Sequence[str], changes: Callable[[DataFrame], DataFrame]) -> int:
    """Write the rows that ``changes`` makes of the current ones: they stand in for all earlier rows with their
    ``keys`` (null is a key like any other), or are new.  Writes in proportion to the changes; returns their number.

    ``changes`` is called again on the newer rows where another writer commits in between."""
    while True:
        head = read_head(spark, root, table)
        batch, n = _write_batch(changes(read_at(spark, root, table, head)), root, table)
        if n == 0:
            return 0
        try:
            commit(spark, root, table, head.appended(batch, n, keys))
            return n
        except CommitClash:
            continue


def compact(spark: SparkSession, root: str, table: str, max_batches: int = 64, max_share: float = 0.2) -> bool:
    """Fold a table into one batch where it has over ``max_batches``, or change rows over ``max_share`` of the others.

    The version stays, as the rows are the same.  Of two writers the other goes first: then nothing is done here."""
    head = read_head(spark, root, table)
    changed = sum(n for _, n, change in head.batches if change)
    if len(head.batches) <= max_batches and changed <= max_share * (sum(n for _, n, _ in head.batches) - changed):
        return False
    batch, n = _write_batch(read_at(spark, root, table, head), root, table, keep_empty=True)
    try:
        commit(spark, root, table, head.replaced(batch, n, head.version))
    except CommitClash:
        return False
    return True


def clean_up(spark: SparkSession, root: str, table: str, before: _dt.datetime) -> list[str]:
    """Delete the batches that the newest entry does not name and that were last written before ``before``
    (an aware time, further back than the longest job: readers and unfinished writes need theirs); returns their names."""
    named = {name for name, _, _ in read_head(spark, root, table).batches}
    fs, at = _files(spark, os.path.join(root, table, DATA))
    gone = []
    for f in fs.listStatus(at) if fs.exists(at) else []:
        name = f.getPath().getName().removeprefix("batch=")
        if name not in named and f.getModificationTime() < before.timestamp() * 1000:
            fs.delete(f.getPath(), True)
            gone.append(name)
    return gone


def _same_key(pairs: Sequence[tuple[str, str]]) -> Column:
    match = F.lit(True)
    for left, right in pairs:
        match = match & F.col(left).eqNullSafe(F.col(right))
    return match


def read_at(spark: SparkSession, root: str, table: str, head: Head) -> DataFrame:
    """The rows of the table as of an entry (with ``p_date`` where it is partitioned).

    Rows that a later change batch replaces are left out by a join with the change batches' keys, which are
    few beside the rows (see ``compact``)."""
    if not head.number:
        raise FileNotFoundError(f"table {table} has not been written under {root}")
    names = [b for b in head.batches if b[1]] or list(head.batches[-1:])  # empty batches have no day folders
    base = os.path.join(root, table, DATA)
    rows = spark.read.option("basePath", base).parquet(*(os.path.join(base, f"batch={b}") for b, _, _ in names))
    changes = [b for b, _, change in names if change]
    if not changes:
        return rows.drop("batch")
    nth = F.create_map(*(F.lit(x) for i, (b, _, _) in enumerate(names) for x in (b, i)))[F.col("batch")]
    last = rows.where(F.col("batch").isin(changes)).groupBy(*(F.col(k).alias(f"_{k}") for k in head.keys)).agg(F.max(nth).alias("_last"))
    return rows.join(last, _same_key([(k, f"_{k}") for k in head.keys]), "left") \
        .where(F.col("_last").isNull() | (nth >= F.col("_last"))).drop("batch", "_last", *(f"_{k}" for k in head.keys))


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The current rows of the table (with ``p_date`` where the table is partitioned)."""
    return read_at(spark, root, table, read_head(spark, root, table))


def replace_permissions_snapshot(df: DataFrame, root: str) -> int:
    return replace_snapshot(df, root, "iam_policy_permissions")


def append_resource_inventory(df: DataFrame, root: str) -> int:
    """#9: append one inventory run (no 500-row chunking needed)."""
    return write_table(df, root, "gcp_resource_inventory_history")


def append_memberships(df: DataFrame, root: str) -> int:
    return write_table(df, root, "google_group_membership_history")


def prepare_requests(df: DataFrame, as_of: str | _dt.datetime) -> DataFrame:
    """#10: request rows as stored: group id defaults to the request id, created/updated stamps."""
    now = ts(as_of)
    out = evolve_request_group_id(df)
    for c in ("created_at", "updated_at"):
        out = out.withColumn(c, F.coalesce(F.col(c), now) if c in out.columns else now)
    return out


def append_requests(df: DataFrame, root: str, as_of: str | _dt.datetime) -> int:
    return write_table(prepare_requests(df, as_of), root, "iam_access_requests")


def prepare_history_events(df: DataFrame) -> DataFrame:
    """#11: details given as a struct/map become JSON text (nulls kept)."""
    dtype = dict(df.dtypes).get("details", "string")
    if dtype != "string":
        return df.withColumn("details", F.to_json("details", {"ignoreNullFields": "false"}))
    return df


def append_history_events(df: DataFrame, root: str) -> int:
    return write_table(prepare_history_events(df), root, "iam_access_request_history")


def append_change_log(df: DataFrame, root: str) -> int:
    """#12: append execution results."""
    return write_table(df, root, "iam_access_change_log")


def prepare_job_report(df: DataFrame) -> DataFrame:
    """#13: counts / details maps or structs as JSON text."""
    out = df
    for c in ("counts", "details"):
        if c in out.columns and dict(out.dtypes)[c] != "string":
            out = out.withColumn(c, F.to_json(c, {"ignoreNullFields": "false"}))
    return out


def append_job_report(df: DataFrame, root: str) -> int:
    return write_table(prepare_job_report(df), root, "iam_pipeline_job_reports")


def evolve_request_group_id(df: DataFrame) -> DataFrame:
    """#15: additive column + backfill request_group_id = request_id where NULL."""
    if "request_group_id" not in df.columns:
        df = df.withColumn("request_group_id", F.lit(None).cast("string"))
    return df.withColumn("request_group_id", F.coalesce(F.col("request_group_id"), F.col("request_id")))


def export_view(df: DataFrame, path: str, placeholder: str = "(no rows)") -> str:
    """#16: CSV export with headers; an empty view gets one placeholder row.

    Written as parallel part files (each with a header) instead of funnelling
    the view through one task; the row count is observed on the write.
    """
    spark = df.sparkSession
    out, rows = _observed(df)
    out.write.mode("overwrite").option("header", True).csv(path)
    if rows() == 0:
        row = tuple(placeholder if i == 0 else None for i in range(len(df.columns)))
        spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in df.columns)).coalesce(1) \
            .write.mode("overwrite").option("header", True).csv(path)
    return path
