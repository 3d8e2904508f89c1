"""Streams over several micro-batches, late events and tables that change in between."""

import datetime as dt

from pyspark.sql import functions as F

from grantlens.streaming import alerts as st


def test_late_and_repeated_events_are_all_kept_once(spark, tmp_path):
    schema = "history_id string, request_id string, event_type string, event_at timestamp_ntz"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = dt.datetime(2024, 1, 10, 12)

    def arrive(rows):
        spark.createDataFrame([(h, "r", "X", t) for h, t in rows], schema).coalesce(1).write.mode("append").parquet(source)
        st.stream_history_ingest(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "ckpt"), available_now=True).awaitTermination()
        return sorted(r.history_id for r in spark.read.parquet(out).collect())

    assert arrive([("a", at), ("a", at), ("b", at)]) == ["a", "b"]
    assert arrive([("late", at - dt.timedelta(days=90)), ("a", at)]) == ["a", "b", "late"]
    assert arrive([("late", at - dt.timedelta(days=90)), ("c", at)]) == ["a", "b", "c", "late"]


def test_events_without_id_copies_with_another_time_and_batches_run_again(spark, tmp_path):
    schema = "history_id string, request_id string, event_type string, event_at timestamp_ntz"
    source, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    at = dt.datetime(2024, 1, 10, 12)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run():
        q = st.stream_history_ingest(spark.readStream.schema(schema).parquet(source), out, ckpt, available_now=True)
        q.awaitTermination()
        return q

    def arrive(rows):
        spark.createDataFrame([(h, r, "X", t) for h, r, t in rows], schema).coalesce(1).write.mode("append").parquet(source)
        q = run()
        return sorted((r.history_id or "", r.request_id, r.event_at.day) for r in st.read_history(spark, out).collect()), q

    found, q = arrive([(None, "r1", at), (None, "r1", at), (None, "r2", None or at), ("a", "r1", at)])
    assert found == [("", "r1", 10), ("", "r1", 10), ("", "r2", 10), ("a", "r1", 10)]
    # the state holds the ids; the stored table is no part of the plan
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    explained = q._jsq.explainInternal(True)
    assert out not in explained
    found, _ = arrive([("a", "r1", at + dt.timedelta(days=40)), ("b", "r1", at - dt.timedelta(days=5)), (None, "r1", at)])
    want = [("", "r1", 10)] * 3 + [("", "r2", 10), ("a", "r1", 10), ("b", "r1", 5)]
    assert found == want
    # the last batch was written but not committed: it is run again and replaces its rows
    commits = tmp_path / "ckpt" / "commits"
    for name in ("1", ".1.crc"):
        if (commits / name).exists():
            (commits / name).unlink()
    run()
    assert sorted((r.history_id or "", r.request_id, r.event_at.day) for r in st.read_history(spark, out).collect()) == want
    day = st.read_history(spark, out, "2024-01-05", "2024-01-05")
    assert day.count() == 1 and "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_a_day_is_written_by_few_tasks(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.range(400).selectExpr("concat('h', id) as history_id", "'r' as request_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 10 as int)) as event_at")
    events.coalesce(1).write.parquet(source)
    st.stream_history_ingest(spark.readStream.schema(events.schema).parquet(source), out, str(tmp_path / "ckpt"), available_now=True).awaitTermination()
    files = spark.read.parquet(out).select("event_date", F.input_file_name().alias("f")).distinct()
    assert files.count() == 10
    assert spark.read.parquet(out).count() == 400


def test_status_refresh_follows_changing_tables(spark, tmp_path, tables):
    root, source, out = str(tmp_path / "log"), str(tmp_path / "in"), str(tmp_path / "out")
    log = tables["iam_access_change_log"]
    req = tables["iam_access_requests"].orderBy("request_id").limit(1)
    rid = req.first().request_id
    log.limit(0).write.parquet(root)

    def refresh():
        spark.createDataFrame([(rid,)], "request_id string").coalesce(1).write.mode("append").parquet(source)
        st.stream_request_status_refresh(spark.readStream.schema("request_id string").parquet(source),
                                         lambda: (req, spark.read.schema(log.schema).parquet(root), tables["iam_policy_permissions"]),
                                         out, str(tmp_path / "ckpt"), available_now=True).awaitTermination()
        return {r.epoch: r.execution_result for r in spark.read.parquet(out).collect()}

    assert refresh() == {0: "未実行"}
    row = log.limit(1).collect()[0].asDict() | {"request_id": rid, "result": "SUCCESS"}
    spark.createDataFrame([tuple(row[c] for c in log.columns)], log.schema).write.mode("append").parquet(root)
    assert refresh() == {0: "未実行", 1: "SUCCESS"}
