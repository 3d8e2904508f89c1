"""Registered streaming queries: each runs as a real availableNow stream over staged files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import alerts as st
from .reconcile_views import RECONCILE_STATE_CTE, _reconcile
from .registry import register
from .report_views import IDS_SQL, REVIEW_SQL
from .workflow_views import EXEC_PLAN_SQL, _gate_scope


@register("stream_history_ingest", """
SELECT * FROM iam_access_request_history
UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS history_id) FROM iam_access_request_history WHERE approver_email IS NULL""")
def q_stream_history_ingest(t):
    """#93: audit events in two arrivals: all once with copies, then every status change again with a later time, and events without id."""
    hist = t["iam_access_request_history"]
    nameless = hist.filter("approver_email is null").withColumn("history_id", F.lit(None).cast("string"))
    changes = hist.filter(F.col("event_type") == "STATUS_CHANGED")
    source, out, ckpt = (st._scratch(t.spark, f"history-{x}") for x in ("src", "out", "ckpt"))
    for arrival in (hist.unionByName(changes), changes.withColumn("event_at", F.col("event_at") + F.expr("INTERVAL 3 DAYS")).unionByName(nameless)):
        arrival.write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(hist.schema).parquet(source)
        st.stream_history_ingest(stream, out, ckpt, available_now=True).awaitTermination()
    return st.read_history(t.spark, out).select(*hist.columns)


@register("stream_break_glass_alerts", EXEC_PLAN_SQL.format(ids="gated_requests", req="gated_requests") + """
SELECT '[BREAK-GLASS]' AS marker, request_id, principal_email, role, resource_name, reason, requested_at
FROM gated_requests WHERE strpos(reason, '[緊急]') > 0 AND request_id IN (SELECT request_id FROM plan WHERE decision = 'EXECUTE')""")
def q_stream_break_glass_alerts(t):
    """#94: emergency requests that the gate lets run, from the request stream."""
    _, stream = st.stage_as_files(t["gated_requests"], "breakglass")
    out = st._scratch(t.spark, "breakglass-out")
    scope = t.keep(_gate_scope(t))  # resolved once a collection, not once a micro-batch
    st.stream_break_glass_alerts(stream, lambda: (t["iam_access_change_log"], scope), out, st._scratch(t.spark, "breakglass-ckpt"),
                                 available_now=True).awaitTermination()
    return t.spark.read.parquet(out).drop("epoch")


@register("stream_error_alerts", """
SELECT 'ERROR' AS severity, execution_id, request_id, result, error_code, error_message, executed_at
FROM iam_access_change_log WHERE result IN ('FAILED', 'FAILED_PERMISSION')""")
def q_stream_error_alerts(t):
    """#95: ERROR-severity execution results from the change-log stream."""
    return st.run_available_now(t["iam_access_change_log"], "errors", st.error_alerts)


@register("stream_reconcile_alerts", RECONCILE_STATE_CTE + """
SELECT CAST(date_trunc('day', detected_at) AS TIMESTAMP) AS window_start, issue_type,
  CAST(count(*) AS BIGINT) AS issues, '[RECONCILIATION_ISSUE_DETECTED]' AS marker
FROM issues GROUP BY 1, 2""")
def q_stream_reconcile_alerts(t):
    """#95: issue counts per day and type from the issue stream (complete-mode aggregate)."""
    return st.run_available_now(_reconcile(t), "reconcile", st.reconcile_alerts, mode="complete")


@register("stream_request_status_refresh", REVIEW_SQL.format(
    req=f"(SELECT * FROM iam_access_requests WHERE request_id IN {IDS_SQL})") + """
SELECT request_id, execution_result, final_reflection FROM refl""")
def q_stream_request_status_refresh(t):
    """#96: verdict refresh driven by a stream of edited request ids (foreachBatch)."""
    spark = t.spark
    _, ids_stream = st.stage_as_files(t["review_updates"].select("request_id"), "refresh-ids")
    out = st._scratch(spark, "refresh-out")
    q = st.stream_request_status_refresh(
        ids_stream, lambda: (t["iam_access_requests"], t["iam_access_change_log"], t["iam_policy_permissions"]),
        out, st._scratch(spark, "refresh-ckpt"), available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out).select("request_id", "execution_result", "final_reflection")
