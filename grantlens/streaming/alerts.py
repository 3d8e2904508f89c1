"""Structured Streaming jobs (#93-96).

The transformations are plain DataFrame functions, so the same code runs on
a streaming DataFrame (``readStream``) and on a batch one.  The ids of audit
events are keyed state without a watermark, so none is lost for being late; the
reconcile alert is an aggregation whose state is one row per (day, issue type).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..operators.reports import request_reflection_status
from ..operators.workflow import execution_plan
from ..session import checkpoint_dir

ERROR_RESULTS = ["FAILED", "FAILED_PERMISSION"]


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def once_per_id(events: DataFrame) -> DataFrame:
    """#93: the first event of each history_id, and every event without one.

    On a stream the ids that were seen are keyed state without a watermark, so no event is too late and a re-sent
    one is known whatever its time: a micro-batch looks up its own ids and reads nothing of the stored table.  Of
    copies within one micro-batch any one is kept.  On a batch the same rule holds within it."""
    named = events.filter(F.col("history_id").isNotNull()).dropDuplicates(["history_id"])
    return named.unionByName(events.filter(F.col("history_id").isNull()))


#: Settings of a write by day: rows are rebalanced, hot days split, and small days not gathered into one task, which would write its files one by one.
BY_DAY = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """``conf`` set in ``spark`` (a stream's batches have a session of their own) and as it was afterwards."""
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stream_history_ingest(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """#93: append audit events once each to a table of day partitions, however late they come.

    The ids live in a RocksDB state store under ``checkpoint``, on the executors' disks with their changes in the
    shared folder, so the state may outgrow memory.  A micro-batch writes its own ``epoch=<n>`` folder by overwrite:
    run again after a failure, it takes the same ids from the state's version and replaces its own rows, and
    events without an id are not doubled either.  Read the table with :func:`read_history`.

    A stream plans its batches without AQE, which drops the rebalance by day, and then every state task writes a
    file for every day.  The state's plan is fixed when the batch comes in, so AQE is on for the write alone."""
    spark = stream.sparkSession
    keep = [c for c in stream.columns if c not in ("event_date", "epoch")]

    def append(batch: DataFrame, epoch_id: int) -> None:
        with _settings(batch.sparkSession, BY_DAY):
            rows = batch.withColumn("event_date", F.col("event_at").cast("date")).hint("rebalance", "event_date")
            rows.write.mode("overwrite").partitionBy("event_date").parquet(os.path.join(path, f"epoch={epoch_id}"))

    w = once_per_id(stream.select(*keep)).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, ROCKSDB)  # a query takes its own copy of the settings when it starts
    try:
        return w.start()
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)


def read_history(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """The ingested events with ``event_date`` (and ``epoch``); days outside the range are not read."""
    rows = spark.read.parquet(path)
    if first_day is not None:
        rows = rows.filter(F.col("event_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        rows = rows.filter(F.col("event_date") <= F.lit(last_day).cast("date"))
    return rows


def break_glass_alerts(requests: DataFrame, log: DataFrame, scope: DataFrame) -> DataFrame:
    """#94: emergency (break-glass) requests that the execution gate lets run, as the [BREAK-GLASS] log line carries them."""
    plan = execution_plan(requests, requests.select("request_id"), log, scope).filter("break_glass").select("request_id")
    return (requests.join(plan, "request_id", "left_semi")
            .select(F.lit(K.BREAK_GLASS_MARK).alias("marker"), "request_id", "principal_email", "role",
                    "resource_name", "reason", "requested_at"))


def stream_break_glass_alerts(stream: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame]], path: str, checkpoint: str,
                              available_now: bool = False) -> StreamingQuery:
    """#94: alerts of each micro-batch of requests; ``tables`` gives (change log, scope) as they are then.

    A batch writes its own ``epoch=<n>`` folder by overwrite, so run again it alerts once."""
    def alert(batch: DataFrame, epoch_id: int) -> None:
        break_glass_alerts(batch, *tables()).write.mode("overwrite").parquet(os.path.join(path, f"epoch={epoch_id}"))

    w = stream.writeStream.foreachBatch(alert).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def error_alerts(log: DataFrame) -> DataFrame:
    """#95: execution results at severity ERROR."""
    return (log.filter(F.col("result").isin(*ERROR_RESULTS))
            .select(F.lit("ERROR").alias("severity"), "execution_id", "request_id", "result", "error_code",
                    "error_message", "executed_at"))


def reconcile_alerts(issues: DataFrame, window: str = "1 day") -> DataFrame:
    """#95: per detection window and issue type, the number of new issues (alert when > 0)."""
    w = F.window(F.col("detected_at").cast("timestamp"), window)
    agg = issues.groupBy(w.alias("w"), "issue_type").agg(F.count(F.lit(1)).alias("issues"))
    return agg.filter(F.col("issues") > 0).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "issue_type", "issues",
        F.lit(K.RECONCILE_MARK).alias("marker"))


def stream_request_status_refresh(ids_stream: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
                                  path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """#96: for every micro-batch of edited request ids, write their reflection verdicts.

    ``tables`` returns (requests, change log, permissions) and is called for each batch, so verdicts follow the
    tables as they are then.  A batch writes its own ``epoch=<n>`` folder by overwrite: run again, it replaces
    its rows."""
    def refresh(batch: DataFrame, epoch_id: int) -> None:
        out = request_reflection_status(*tables(), batch)
        out.write.mode("overwrite").parquet(os.path.join(path, f"epoch={epoch_id}"))

    w = ids_stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="15 minutes")
    return w.start()


# --- helpers to drive a stream over a finished input (tests, registered queries) -----------

def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex[:12]}")


def stage_as_files(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Write ``df`` as parquet files a file-source stream can pick up; returns (dir, stream)."""
    spark = df.sparkSession
    src = _scratch(spark, name + "-src")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    return src, stream


def run_available_now(df: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame],
                      mode: str = "append") -> DataFrame:
    """Run ``transform`` as a streaming query over ``df`` (availableNow) and read its sink.

    ``mode='append'`` uses a parquet file sink; ``mode='complete'`` rewrites the
    full aggregate each micro-batch through ``foreachBatch``.
    """
    spark = df.sparkSession
    _, stream = stage_as_files(df, name)
    out = _scratch(spark, name + "-out")
    ckpt = _scratch(spark, name + "-ckpt")
    result = transform(stream)
    if mode == "append":
        q = (result.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
    else:
        def sink(batch: DataFrame, epoch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = (result.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
             .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(result.schema).parquet(out)
