"""Report views, lookups and audit queries (#18-35, #37, #43-47, #56).

Joins against master tables with a fixed, small size (status master, role
master) are broadcast; everything else is left to the planner (AQE picks
broadcast only when runtime sizes are small).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import TRIPLE, days, nullif_empty, role_short_name, role_type, ts, type_label_ja
from .latest import latest_execution_per_request, latest_snapshot, newest_payload
from .skew import split_join

JOB_COLLECTION_TYPES = ["RESOURCE_COLLECTION", "PRINCIPAL_COLLECTION", "IAM_POLICY_COLLECTION"]


def _col_or_null(df: DataFrame, name: str, dtype: str = "string"):
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)


# --- lookups ----------------------------------------------------------------

def requests_in_id_set(req: DataFrame, ids: DataFrame) -> DataFrame:
    """#19: requests whose id is in an id table (``IN UNNEST(@ids)`` as a semi-join)."""
    keys = ids.select(F.trim(F.col("request_id")).alias("request_id")).filter(F.col("request_id") != "")
    return req.join(keys.distinct(), "request_id", "left_semi")


def request_lookup(req: DataFrame, ids: DataFrame) -> DataFrame:
    """#18: the eight lookup columns for each requested id."""
    return requests_in_id_set(req, ids).select(
        "request_id", "request_type", "principal_email", "resource_name", "role", "status",
        "approved_at", "reason")


# --- sheet views --------------------------------------------------------------

def request_approval_history(hist: DataFrame) -> DataFrame:
    """#20: history view with reason_snapshot exposed as reason."""
    return hist.select("history_id", "request_id", "request_group_id", "event_type", "old_status",
                       "new_status", F.col("reason_snapshot").alias("reason"), "request_type",
                       "principal_email", "resource_name", "role", "requester_email", "approver_email",
                       "acted_by", "actor_source", "event_at", "details")


def sheet_principal(catalog: DataFrame) -> DataFrame:
    """#21: principal report."""
    return catalog.select("principal_email", "principal_name", "principal_type", "principal_status",
                          "deactivated_at", _col_or_null(catalog, "note"))


def sheet_status(status_master: DataFrame) -> DataFrame:
    """#22: active statuses in sort order."""
    return (status_master.filter(F.col("is_active"))
            .orderBy("sort_order")
            .select("status_ja", F.col("status_code").alias("status"), _col_or_null(status_master, "description")))


def sheet_group(groups: DataFrame) -> DataFrame:
    """#23: group master report."""
    return groups.select("group_email", "group_name", _col_or_null(groups, "description"))


def sheet_iam_role(perm: DataFrame) -> DataFrame:
    """#56: distinct (role short name, predefined/custom) with an empty description."""
    roles = perm.select(role_short_name(F.col("role")).alias("role_name"),
                        role_type(F.col("role")).alias("role_type")).distinct()
    return roles.filter(F.col("role_name").isNotNull()).select(
        "role_name", "role_type", F.lit(None).cast("string").alias("description"))


def sheet_custom_role(sheet_roles: DataFrame) -> DataFrame:
    """#24: custom subset of the role report with two typed-NULL columns."""
    return sheet_roles.filter(F.col("role_type") == K.ROLE_TYPE_CUSTOM).select(
        F.col("role_name").alias("custom_role_name"), F.lit(None).cast("string").alias("creator"),
        F.lit(None).cast("string").alias("permissions"))


def status_mapping(status_master: DataFrame) -> DataFrame:
    """#25: active label->code pairs with a non-empty code, plus code->code identities."""
    active = status_master.filter(F.col("is_active") & F.col("status_code").isNotNull() & (F.col("status_code") != ""))
    pairs = active.select(F.col("status_ja").alias("label"), F.col("status_code").alias("code"))
    ident = active.select(F.col("status_code").alias("label"), F.col("status_code").alias("code"))
    return pairs.unionByName(ident).dropDuplicates(["label"])


def open_alerts(issues: DataFrame, tz: str = "UTC", limit: int = 1000) -> DataFrame:
    """#26: newest OPEN issues (top-``limit`` report), local-time text, outside-system label."""
    local = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("detected_at")), "yyyy-MM-dd HH:mm:ss")
    top = (issues.filter(F.col("status") == K.ISSUE_OPEN)
           .orderBy(F.col("detected_at").desc(), F.col("issue_id").asc()).limit(limit))
    return top.select(local.alias("detected_at"), "severity", "issue_type", *TRIPLE,
                      F.coalesce(F.col("request_id"), F.lit(K.OUTSIDE_SYSTEM)).alias("request_id"), "status")


def principal_audit_trail(hist: DataFrame, email: str) -> DataFrame:
    """#27: full history of one principal, newest first (11 columns)."""
    return (hist.filter(F.col("principal_email") == email)
            .select("event_at", "request_id", "event_type", "old_status", "new_status", "reason_snapshot",
                    "resource_name", "role", "requester_email", "approver_email", "acted_by")
            .orderBy(F.col("event_at").desc(), F.col("request_id").desc(), F.col("event_type").desc()))


def break_glass_audit(req: DataFrame, log: DataFrame) -> DataFrame:
    """#28: emergency GRANT/CHANGE requests with every execution attempt (left join), newest request first."""
    bg = req.filter(F.col("request_type").isin(K.GRANT, K.CHANGE) & F.col("reason").contains(K.EMERGENCY_REASON_PREFIX))
    lg = log.select("request_id", F.col("result").alias("execution_result"), "executed_at")
    return (bg.select("requested_at", "request_id", "requester_email", "resource_name", "role", "reason")
            .join(lg, "request_id", "left")
            .select("requested_at", "request_id", "requester_email", "resource_name", "role", "reason",
                    "execution_result", "executed_at")
            .orderBy(F.col("requested_at").desc(), F.col("request_id").desc(), F.col("executed_at").desc()))


def recent_failed_executions(log: DataFrame, as_of: str | _dt.datetime, n_days: int = 7) -> DataFrame:
    """#30: FAILED executions of the last ``n_days`` (range filter on executed_at), newest first."""
    since = ts(as_of) - days(n_days)
    cols = ["executed_at", "request_id", "action", "target", "result", "error_code", "error_message"]
    if "details" in log.columns:
        cols.append("details")
    return (log.filter((F.col("result") == K.FAILED) & (F.col("executed_at") >= since))
            .select(*cols).orderBy(F.col("executed_at").desc(), F.col("request_id").desc()))


def recent_job_reports(reports: DataFrame, job_types: Sequence[str] = tuple(JOB_COLLECTION_TYPES),
                       n: int = 20) -> DataFrame:
    """#31: newest ``n`` reports of the given job types (top-n report)."""
    cols = ["job_type", "result", _col_or_null(reports, "error_code"), _col_or_null(reports, "error_message"),
            "occurred_at", "execution_id"]
    return (reports.filter(F.col("job_type").isin(*job_types)).select(*cols)
            .orderBy(F.col("occurred_at").desc(), F.col("execution_id").desc()).limit(n))


def retry_candidates(req: DataFrame, log: DataFrame) -> DataFrame:
    """#32: APPROVED requests whose latest result is not SUCCESS/SKIPPED (or never ran)."""
    latest = latest_execution_per_request(log).select("request_id", F.col("result").alias("latest_result"))
    appr = req.filter(F.col("status") == K.APPROVED).select("request_id")
    j = appr.join(latest, "request_id", "left")
    return j.filter(~F.coalesce(F.col("latest_result").isin(K.SUCCESS, K.SKIPPED), F.lit(False)))


def unreviewed_role_names(role_master: DataFrame) -> DataFrame:
    """#33: roles whose Japanese name is still the automatic translation."""
    return role_master.filter(F.col("is_auto_translated") == F.lit(True))


def purge_processed(df: DataFrame, ts_col: str, as_of: str | _dt.datetime, n_days: int = 30) -> DataFrame:
    """#35: keep rows processed within the last ``n_days`` (older rows are purged)."""
    return df.filter(F.col(ts_col) >= ts(as_of) - days(n_days))


# --- joined report views -----------------------------------------------------

def inventory_with_requests(perm: DataFrame, req: DataFrame, log: DataFrame) -> DataFrame:
    """#37: each binding (bag kept) + newest request of its triple + that request's latest run."""
    latest = latest_execution_per_request(log).select(
        "request_id", F.col("result").alias("latest_execution_result"),
        F.col("executed_at").alias("latest_executed_at"))
    newest = newest_payload(req, TRIPLE, ["requested_at", "request_id"],
                                 ["request_id", "request_group_id", "status", "requested_at", "approved_at",
                                  "ticket_ref"])
    ctx = newest.join(latest, "request_id", "left")
    return (split_join(perm.select("resource_type", "resource_name", "principal_type", "principal_email", "role"), ctx, TRIPLE)
            .select("resource_type", "resource_name", "principal_type", "principal_email", "role",
                    "request_id", "request_group_id", F.col("status").alias("request_status"),
                    "requested_at", "approved_at", "ticket_ref", "latest_execution_result",
                    "latest_executed_at"))


PERMISSION_HISTORY_COLUMNS = [
    "resource_name", "resource_id", "principal", "principal_type", "iam_role", "display_role_name",
    "iam_condition", "ticket_ref", "request_reason", "status", "approved_at", "next_review_at",
    "approver", "request_group_id", "request_id", "recorded_at", "expires_at", "request_status",
    "last_action", "last_result"]


def sheet_permission_history(bindings_hist: DataFrame, req: DataFrame, log: DataFrame,
                             status_master: DataFrame, role_master: DataFrame) -> DataFrame:
    """#43: latest history snapshot with request, status, role-name and latest-run context.

    Latest snapshot = newest (recorded_at, execution_id).  Bindings without a
    request (every unmanaged one) join nothing, so they are kept out of the
    join by request_id, where they would all be one key.  The others meet one
    context row a request, put together first; the masters are broadcast, since
    a shuffle by status or role would leave all rows to a handful of tasks.
    """
    snap = latest_snapshot(bindings_hist, "recorded_at")
    r = req.select("request_id", "expires_at", F.col("status").alias("request_status"))
    sm = status_master.select(F.col("status_code").alias("request_status"), F.col("status_ja").alias("_sm_status_ja"))
    rm = role_master.select(F.col("role_id").alias("iam_role"), "role_name_ja")
    lcl = latest_execution_per_request(log).select(
        "request_id", F.col("action").alias("last_action"), F.col("result").alias("last_result"))
    context = r.join(lcl, "request_id", "left").join(F.broadcast(sm), "request_status", "left")
    known = split_join(snap.filter(F.col("request_id").isNotNull()), context, ["request_id"])
    j = known.unionByName(snap.filter(F.col("request_id").isNull()), allowMissingColumns=True).join(F.broadcast(rm), "iam_role", "left")
    return j.select(
        "resource_name", "resource_id", F.col("principal_email").alias("principal"), "principal_type", "iam_role",
        F.coalesce(F.col("role_name_ja"), F.regexp_replace("iam_role", r"^roles/", "")).alias("display_role_name"),
        "iam_condition", "ticket_ref", "request_reason",
        F.coalesce(F.col("_sm_status_ja"), F.col("status_ja")).alias("status"), "approved_at", "next_review_at",
        "approver", "request_group_id", "request_id", "recorded_at", "expires_at", "request_status",
        "last_action", "last_result")


def _verdict(result, request_type, present):
    return (F.when(result.isNull(), F.lit(K.UNVERIFIED))
            .when((request_type == K.REVOKE) & ~present, F.lit(K.REFLECTED))
            .when((request_type == K.REVOKE) & present, F.lit(K.NOT_REFLECTED))
            .when((request_type != K.REVOKE) & present, F.lit(K.REFLECTED))
            .when((request_type != K.REVOKE) & ~present, F.lit(K.NOT_REFLECTED))
            .otherwise(F.lit(K.UNVERIFIED)))


def _reflection(req: DataFrame, log: DataFrame, perm: DataFrame) -> DataFrame:
    latest = latest_execution_per_request(log).select("request_id", F.col("result").alias("_res"),
                                                      F.col("executed_at").alias("_at"))
    actual = perm.select(*TRIPLE).distinct().withColumn("_present", F.lit(True))
    j = split_join(req, actual, TRIPLE).join(latest, "request_id", "left")
    present = F.coalesce(F.col("_present"), F.lit(False))
    return (j.withColumn("execution_result", F.coalesce(F.col("_res"), F.lit(K.NOT_RUN)))
             .withColumn("final_reflection", _verdict(F.col("_res"), F.col("request_type"), present)))


def sheet_requests_review(req: DataFrame, log: DataFrame, perm: DataFrame, status_master: DataFrame) -> DataFrame:
    """#44: requests with latest result and reflected / not reflected / unverified verdict.

    Bindings are de-duplicated to distinct triples first (fix 2.11-g).
    """
    sm = status_master.select(F.col("status_code").alias("status"), "status_ja")
    j = _reflection(req, log, perm).join(sm, "status", "left")
    return j.select("request_group_id", "request_id", "request_type", "principal_email", "resource_name", "role",
                    "reason", "expires_at", "requester_email", "approver_email",
                    F.coalesce(F.col("status_ja"), F.col("status")).alias("status"), "requested_at", "ticket_ref",
                    "execution_result", "final_reflection", F.col("_at").alias("last_checked_at"))


def request_reflection_status(req: DataFrame, log: DataFrame, perm: DataFrame, ids: DataFrame) -> DataFrame:
    """#45: the same verdict for an id set; log and bindings are semi-joined to the chosen requests first."""
    keys = ids.select(F.trim(F.col("request_id")).alias("request_id")).filter(F.col("request_id") != "").distinct()
    r = req.join(keys, "request_id", "left_semi")
    lg = log.join(keys, "request_id", "left_semi")
    near = perm.join(r.select(*TRIPLE).distinct(), TRIPLE, "left_semi")
    return _reflection(r, lg, near).select("request_id", "execution_result", "final_reflection")


def pending_request_pull(req: DataFrame, hist: DataFrame, existing_ids: DataFrame, tz: str = "UTC") -> DataFrame:
    """#46: PENDING requests not yet on the sheet, with the AI suggestion of the REQUESTED event."""
    def local(c):
        return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(c)), "yyyy/MM/dd HH:mm:ss")
    pending = req.filter(F.col("status") == K.PENDING)
    known = existing_ids.select(F.trim(F.col("request_id")).alias("request_id")).filter(F.col("request_id") != "")
    pending = pending.join(known.distinct(), "request_id", "left_anti")
    h = (hist.filter(F.col("event_type") == "REQUESTED")
         .select("request_id", F.get_json_object("details", "$.ai_suggestion").alias("ai_suggestion")))
    j = pending.join(h, "request_id", "left")
    return (j.select("request_group_id", "request_id", type_label_ja(F.col("request_type")).alias("request_type"),
                     "principal_email", "resource_name", "role", "reason", local("expires_at").alias("expires_at"),
                     "requester_email", "approver_email", "status", local("requested_at").alias("requested_at"),
                     "ticket_ref", "ai_suggestion")
            .orderBy(F.col("requested_at").asc(), F.col("request_id").asc()))


def unknown_roles(perm: DataFrame, role_master: DataFrame) -> DataFrame:
    """#47: distinct non-empty roles missing from the role master (anti-join, not NOT IN)."""
    known = role_master.select(F.col("role_id").alias("role"))
    return (perm.select("role").filter(F.col("role").isNotNull() & (F.col("role") != ""))
            .distinct().join(known, "role", "left_anti"))


def sheet_resource(inventory_hist: DataFrame) -> DataFrame:
    """#48: resources of the newest inventory snapshot."""
    return latest_snapshot(inventory_hist, "assessed_at").select(
        "resource_type", "resource_name", "resource_id", "parent_resource_id", _col_or_null(inventory_hist, "note"))


def sheet_group_members(membership_hist: DataFrame) -> DataFrame:
    """#48: members of the newest membership snapshot."""
    return latest_snapshot(membership_hist, "assessed_at").select(
        "group_email", "member_email", _col_or_null(membership_hist, "member_display_name"), "membership_type")


def groups_from_principals(feed: DataFrame) -> DataFrame:
    """Group master rows (group_email, group_name, description) from a principal feed."""
    g = feed.filter((F.col("principal_type") == "GROUP") & (nullif_empty(F.trim("principal_email")).isNotNull()))
    return g.groupBy(F.trim("principal_email").alias("group_email")).agg(
        F.max("principal_name").alias("group_name")).withColumn("description", F.lit(None).cast("string"))

