"""Run ledger: which steps of a run are done, so a run that was cut off goes on where it ended.

``iam_run_ledger`` has one row per finished step (run_id, attempt, step, the
step's counts as JSON, finished_at), appended after the step's own writes.  A
step that was cut off has no row and runs again; its writes are idempotent (see
:mod:`grantlens.sources.sinks`).  The step ``RUN`` closes an attempt: the same
run id begun after that is a new attempt, in which every step runs.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ts
from . import sinks

TABLE = "iam_run_ledger"
ENTRY = "run_id string, attempt int, step string, counts string, finished_at timestamp_ntz"
RUN = "RUN"


def begin(spark: SparkSession, root: str, run_id: str) -> tuple[int, dict[str, dict[str, int]]]:
    """(attempt, finished step -> its counts) of the attempt that is open, or of a new one."""
    if not sinks.table_exists(spark, root, TABLE):
        return 1, {}
    rows = sinks.read_current(spark, root, TABLE).where(F.col("run_id") == run_id).collect()  # a few rows a run
    attempt = 1 + sum(r.step == RUN for r in rows)
    return attempt, {r.step: json.loads(r.counts) for r in rows if r.attempt == attempt}


def finish(spark: SparkSession, root: str, run_id: str, attempt: int, step: str, counts: dict[str, int], as_of) -> None:
    row = spark.createDataFrame([(run_id, attempt, step, json.dumps(counts))], "run_id string, attempt int, step string, counts string")
    sinks.write_table(row.withColumn("finished_at", ts(as_of)).coalesce(1), root, TABLE)
