"""Registered write-and-read-back queries: what the writers store is what readers get."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ingest, matrix, reports as rp, workflow as wf
from ..session import scratch_path
from ..sources import catalogue as cat, nested, sinks
from .ingest_views import INVENTORY_SQL, _inventory
from .reconcile_views import NOW
from .registry import AS_OF, RUN_ID, register
from .report_views import HISTORY_CTES, _permission_history
from .workflow_views import CHANGE_DIGEST_SQL, DIFF_SQL, EXEC_PLAN_SQL, PLAN_SELECT, _diff, _gate_scope


def _root(t) -> str:
    return scratch_path(t.spark, f"warehouse-{uuid.uuid4().hex}")


@register("replace_permissions_snapshot", "SELECT * FROM iam_policy_permissions")
def q_replace_permissions_snapshot(t):
    """#8: an earlier snapshot (service accounts only) fully replaced; readers see the new one."""
    root, perm = _root(t), t["iam_policy_permissions"]
    sinks.replace_permissions_snapshot(perm.filter("principal_type = 'SERVICE_ACCOUNT'"), root)
    sinks.replace_permissions_snapshot(perm, root)
    return sinks.read_current(t.spark, root, "iam_policy_permissions")


@register("append_resource_inventory", INVENTORY_SQL + "SELECT *, CAST(assessed_at AS DATE) AS p_date FROM inv")
def q_append_resource_inventory(t):
    """#9: the inventory appended in two parts and read back with its day partition."""
    root, inv = _root(t), _inventory(t)
    sinks.append_resource_inventory(inv.filter("resource_type = 'Folder'"), root)
    sinks.append_resource_inventory(inv.filter("resource_type <> 'Folder'"), root)
    return sinks.read_current(t.spark, root, "gcp_resource_inventory_history")


@register("append_memberships", f"""
SELECT DISTINCT group_email, member_email, CAST(NULL AS VARCHAR) AS member_display_name, membership_type,
  'cloudidentity' AS source, '{RUN_ID}' AS execution_id, {NOW} AS assessed_at, CAST({NOW} AS DATE) AS p_date
FROM google_group_membership_history""")
def q_append_memberships(t):
    """#9: a run's memberships appended and read back."""
    root = _root(t)
    rows = ingest.flatten_group_memberships(nested.group_docs(t["google_group_membership_history"]))
    sinks.append_memberships(ingest.stamp_snapshot(rows, RUN_ID, AS_OF, "assessed_at"), root)
    return sinks.read_current(t.spark, root, "google_group_membership_history")


@register("append_history_events", "SELECT *, CAST(event_at AS DATE) AS p_date FROM iam_access_request_history")
def q_append_history_events(t):
    """#11: events appended to a table that was replaced before; both are read back."""
    root, events = _root(t), t["iam_access_request_history"]
    sinks.replace_snapshot(events.filter("event_type = 'REQUESTED'"), root, "iam_access_request_history")
    sinks.append_history_events(events.filter("event_type <> 'REQUESTED'"), root)
    return sinks.read_current(t.spark, root, "iam_access_request_history")


@register("append_change_log", "SELECT *, CAST(executed_at AS DATE) AS p_date FROM iam_access_change_log")
def q_append_change_log(t):
    """#12: change-log rows appended to a table that was replaced before; both are read back."""
    root, log = _root(t), t["iam_access_change_log"]
    sinks.replace_snapshot(log.filter("result = 'SUCCESS'"), root, "iam_access_change_log")
    sinks.append_change_log(log.filter("result <> 'SUCCESS'"), root)
    return sinks.read_current(t.spark, root, "iam_access_change_log")


@register("table_layout", """
SELECT CAST(occurred_at AS DATE) AS p_date, CAST(count(*) AS BIGINT) AS n, min(job_type || result) AS first_key
FROM iam_pipeline_job_reports GROUP BY 1""")
def q_table_layout(t):
    """#17: rows and smallest clustering key of each day partition as stored."""
    root = _root(t)
    sinks.append_job_report(t["iam_pipeline_job_reports"], root)
    stored = sinks.read_current(t.spark, root, "iam_pipeline_job_reports")
    return stored.groupBy("p_date").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat("job_type", "result")).alias("first_key"))


def _snapshots(t, fixture: str, table: str) -> str:
    """The fixture's snapshots appended to a history table with a catalogue, in two runs."""
    root, rows = _root(t), t[fixture]
    first = F.substring("execution_id", -1, 1) < "5"
    cat.append_snapshot(rows.filter(first), root, table)
    cat.append_snapshot(rows.filter(~first), root, table)
    return root


@register("snapshot_catalogue", """
SELECT execution_id, assessment_timestamp AS snapshot_at, CAST(assessment_timestamp AS DATE) AS p_date, CAST(count(*) AS BIGINT) AS rows
FROM iam_policy_bindings_raw_history GROUP BY ALL""")
def q_snapshot_catalogue(t):
    """#65: the stored snapshots of the raw history, as its catalogue lists them."""
    root = _snapshots(t, "iam_policy_bindings_raw_history", "iam_policy_bindings_raw_history")
    return cat.read_catalogue(t.spark, root, "iam_policy_bindings_raw_history").drop("version")


@register("permissions_as_of_stored", """
SELECT *, CAST(assessment_timestamp AS DATE) AS p_date FROM iam_policy_bindings_raw_history
WHERE assessment_timestamp = (SELECT max(assessment_timestamp) FROM iam_policy_bindings_raw_history WHERE assessment_timestamp <= TIMESTAMP '1996-05-20 00:00:00')""")
def q_permissions_as_of_stored(t):
    """#34: who held what on 20 May 1996, from the stored history: the catalogue names the one day to read."""
    root = _snapshots(t, "iam_policy_bindings_raw_history", "iam_policy_bindings_raw_history")
    return cat.read_snapshot(t.spark, root, "iam_policy_bindings_raw_history", "1996-05-20 00:00:00")


@register("latest_memberships_stored", """
SELECT *, CAST(assessed_at AS DATE) AS p_date FROM google_group_membership_history
WHERE assessed_at = (SELECT max(assessed_at) FROM google_group_membership_history)""")
def q_latest_memberships_stored(t):
    """#48: the newest stored membership snapshot, found through the catalogue."""
    root = _snapshots(t, "google_group_membership_history", "google_group_membership_history")
    return cat.read_snapshot(t.spark, root, "google_group_membership_history")


@register("export_view", "SELECT principal_email, principal_name, principal_type, principal_status FROM principal_catalog")
def q_export_view(t):
    """#16: a view exported as CSV and read back."""
    view = rp.sheet_principal(t["principal_catalog"]).select("principal_email", "principal_name", "principal_type", "principal_status")
    return t.spark.read.option("header", True).csv(sinks.export_view(view, _root(t)))


@register("newest_history_per_cell", HISTORY_CTES + """
SELECT h.* FROM (
  SELECT arg_max(sph, struct_pack(a := recorded_at, b := status, c := resource_name, d := principal_type)) AS h
  FROM sph GROUP BY resource_id, principal, iam_role)""")
def q_newest_history_per_cell(t):
    """#64: the newest history row of each (resource, principal, role)."""
    return matrix.newest_cells(_permission_history(t))


def _execute_sql() -> str:
    ids = "(SELECT request_id FROM gated_requests WHERE status IN ('APPROVED', 'PENDING'))"
    diff = DIFF_SQL[len("WITH RECURSIVE "):].replace("FROM iam_access_requests WHERE status = 'APPROVED')",
                                                    "FROM gated_requests WHERE request_id IN (SELECT request_id FROM plan WHERE decision = 'EXECUTE'))")
    return (EXEC_PLAN_SQL.format(ids=ids, req="gated_requests") + ",\n" + diff.rstrip() + ",\n" + CHANGE_DIGEST_SQL.rstrip() + """,
gate AS (""" + PLAN_SELECT + f""")
SELECT '{RUN_ID}' AS execution_id, g.request_id, g.action, g.target,
  CASE WHEN g.decision = 'EXECUTE' THEN CASE WHEN r.changed THEN 'SUCCESS' ELSE 'SKIPPED' END ELSE g.result END AS result,
  g.error_code, CASE WHEN g.error_code IS NOT NULL THEN g.reason END AS error_message,
  h.before_hash, h.after_hash, '{wf.EXECUTOR}' AS executed_by, {NOW} AS executed_at
FROM gate g LEFT JOIN replay r ON g.request_id = r.request_id LEFT JOIN digests h ON h.request_id = g.request_id
WHERE g.decision <> 'NOT_FOUND'""")


@register("execute_approved", _execute_sql())
def q_execute_approved(t):
    """Gate, policy diff and change-log rows for every approved or pending request, run as one batch."""
    req = t["gated_requests"]
    ids = req.filter("status in ('APPROVED', 'PENDING')").select("request_id")
    rows, _ = wf.execute_approved(req, ids, t["iam_access_change_log"], _gate_scope(t), _diff(t)[1], AS_OF, RUN_ID, keep=t.keep)
    return rows



