"""Binding snapshots and their history (#14, #29, #34, #42, #72).

The current bindings table is a bag (a triple may repeat); snapshot jobs keep
that multiplicity on the left side and join request context per triple.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import TRIPLE, regexp_extract_or_null, ts
from .latest import latest_snapshot, newest_payload
from .skew import split_join

RAW_HISTORY_COLUMNS = ["execution_id", "assessment_timestamp", "scope", "resource_type",
                       "resource_name", "principal_type", "principal_email", "role"]

BINDINGS_HISTORY_COLUMNS = ["execution_id", "recorded_at", "resource_name", "resource_id",
                            "principal_email", "principal_type", "iam_role", "iam_condition",
                            "ticket_ref", "request_reason", "status_ja", "approved_at",
                            "next_review_at", "approver", "request_id", "request_group_id", "note"]


def archive_raw_bindings(perm: DataFrame, execution_id: str, as_of: str | _dt.datetime) -> DataFrame:
    """#14: current bindings stamped as one raw-history snapshot (8 columns)."""
    return perm.select(F.lit(execution_id).alias("execution_id"), ts(as_of).alias("assessment_timestamp"),
                       "scope", "resource_type", "resource_name", "principal_type", "principal_email", "role")


def newest_request_context(req: DataFrame) -> DataFrame:
    """Newest request per triple with the columns snapshots need."""
    payload = ["request_id", "request_group_id", "status", "reason", "ticket_ref", "approved_at",
               "expires_at", "approver_email", "requested_at"]
    return newest_payload(req, TRIPLE, ["requested_at", "request_id"], payload)


def bindings_history_snapshot(perm: DataFrame, req: DataFrame, status_master: DataFrame,
                              execution_id: str, as_of: str | _dt.datetime) -> DataFrame:
    """#42: bindings + newest request context + status label + review date (17 columns).

    The request context is joined by triple with a shuffle; the status master
    is broadcast: a shuffle by its handful of codes would leave all rows to as many tasks.
    """
    ctx = newest_request_context(req)
    sm = status_master.select(F.col("status_code").alias("status"), "status_ja")
    j = split_join(perm.select("resource_name", "principal_email", "principal_type", "role"), ctx, TRIPLE).join(F.broadcast(sm), "status", "left")
    return j.select(
        F.lit(execution_id).alias("execution_id"), ts(as_of).alias("recorded_at"), "resource_name",
        regexp_extract_or_null(F.col("resource_name"), r"^projects/([^/]+)").alias("resource_id"),
        "principal_email", "principal_type", F.col("role").alias("iam_role"),
        F.lit(None).cast("string").alias("iam_condition"), "ticket_ref",
        F.col("reason").alias("request_reason"), "status_ja", "approved_at",
        F.col("expires_at").cast("date").alias("next_review_at"), F.col("approver_email").alias("approver"),
        "request_id", "request_group_id", F.lit("Snapshot from iam_policy_permissions").alias("note"))


def seed_status_label(status):
    """CASE used by the seed job (unknown -> 申請中)."""
    expr = None
    for ja, code, _desc, _order in K.STATUS_MASTER_SEED:
        if code == K.PENDING:
            continue
        expr = F.when(status == code, F.lit(ja)) if expr is None else expr.when(status == code, F.lit(ja))
    return expr.otherwise(F.lit(K.STATUS_MASTER_SEED[0][0]))


def seed_bindings_history(req: DataFrame, perm: DataFrame, run_id: str, as_of: str | _dt.datetime) -> DataFrame:
    """#72: history rows seeded from every request (fix 2.11-n: one run id per seed).

    principal_type comes from the bindings (MAX per e-mail, replacing ANY_VALUE);
    the reference also joins the change log but selects nothing from it.
    """
    ptype = perm.groupBy("principal_email").agg(F.max("principal_type").alias("principal_type"))
    r = split_join(req.filter(F.col("request_id").isNotNull()), ptype, ["principal_email"])
    return r.select(
        F.lit(run_id).alias("execution_id"), ts(as_of).alias("recorded_at"), "resource_name",
        regexp_extract_or_null(F.col("resource_name"), r"^projects/(.+)$").alias("resource_id"),
        "principal_email", F.coalesce(F.col("principal_type"), F.lit("Unknown")).alias("principal_type"),
        F.col("role").alias("iam_role"), F.lit(None).cast("string").alias("iam_condition"), "ticket_ref",
        F.col("reason").alias("request_reason"), seed_status_label(F.col("status")).alias("status_ja"),
        "approved_at", F.col("expires_at").cast("date").alias("next_review_at"),
        F.col("approver_email").alias("approver"), "request_id", "request_group_id",
        F.lit("seed from iam_access_requests").alias("note"))


def binding_first_seen(raw_hist: DataFrame) -> DataFrame:
    """#29 (bulk form): first / last snapshot time and snapshot count per triple."""
    return raw_hist.groupBy(*TRIPLE).agg(
        F.min("assessment_timestamp").alias("first_seen"),
        F.max("assessment_timestamp").alias("last_seen"),
        F.count_distinct("execution_id").alias("snapshots"))


def binding_first_seen_rows(raw_hist: DataFrame, principal_email: str, resource_name: str,
                            n: int = 10) -> DataFrame:
    """#29 (reference form): earliest raw rows of one principal on one resource (top-n)."""
    return (raw_hist.filter((F.col("principal_email") == principal_email) & (F.col("resource_name") == resource_name))
            .select("assessment_timestamp", *TRIPLE)
            .orderBy(F.col("assessment_timestamp").asc(), F.col("role").asc()).limit(n))


def permissions_as_of(raw_hist: DataFrame, t: str | _dt.datetime) -> DataFrame:
    """#34: who held what at time ``t``: rows of the newest snapshot taken at or before ``t``."""
    upto = raw_hist.filter(F.col("assessment_timestamp") <= ts(t))
    return latest_snapshot(upto, "assessment_timestamp")
