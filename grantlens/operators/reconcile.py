"""Reconciliation of intended (requests) against actual (bindings) access (#38-41, #90).

``reconcile`` is expressed as ONE aggregation over the union of both sides
instead of DISTINCT + ROW_NUMBER + FULL OUTER JOIN: requests contribute a
struct ordered by (requested_at, request_id), bindings contribute a flag, and
``groupBy(triple)`` with ``max`` / ``bool_or`` combines map-side.  A triple
that holds a third of all rows is therefore pre-aggregated per partition and
never becomes a skewed join key.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import TRIPLE, to_json_keep_nulls, ts
from .skew import split_join


def _interval_hours(h: float) -> Column:
    return F.expr(f"INTERVAL {int(round(h * 3600))} SECONDS")


def current_state(req: DataFrame, perm: DataFrame) -> DataFrame:
    """Newest request per triple FULL OUTER distinct bindings, as one aggregate.

    Output: triple, request_id, request_type, status, expires_at, approved_at,
    updated_at, requested_at, exists_now.
    """
    q_fields = ["requested_at", "request_id", "request_type", "status", "expires_at",
                "approved_at", "updated_at"]
    left = req.select(*TRIPLE, F.struct(*q_fields).alias("q"), F.lit(False).alias("b"))
    right = perm.select(*TRIPLE, F.lit(None).cast(left.schema["q"].dataType).alias("q"),
                        F.lit(True).alias("b"))
    both = left.unionByName(right)
    agg = both.groupBy(*TRIPLE).agg(F.max("q").alias("q"), F.bool_or("b").alias("exists_now"))
    return agg.select(*TRIPLE, *[F.col(f"q.{c}").alias(c) for c in q_fields], "exists_now")


def classify(state: DataFrame, as_of: str | _dt.datetime, grace_hours: float = 12.0,
             strict_break_glass: bool = False) -> DataFrame:
    """Adds issue_type / severity by the ordered rules (first match wins)."""
    now = ts(as_of)
    g = now - _interval_hours(grace_hours)
    status = F.col("status")
    exists = F.col("exists_now")
    approved_at = F.col("approved_at")
    if strict_break_glass:
        approved_at = F.coalesce(approved_at, F.col("requested_at"))
    not_revoke = F.coalesce(F.col("request_type"), F.lit(K.GRANT)) != K.REVOKE
    is_revoke = F.col("request_type") == K.REVOKE

    r_not_applied = (status == K.APPROVED) & (~exists) & (approved_at < g)
    r_rejected = status.isin(K.REJECTED, K.CANCELLED, K.REVOKED, K.REVOKED_ALREADY_GONE) & exists & (F.col("updated_at") < g)
    r_expired = (status == K.APPROVED) & F.col("expires_at").isNotNull() & (F.col("expires_at") < now) & exists
    r_unmanaged = (status.isNull() | (status == K.PENDING)) & exists
    r_revoke = (status == K.APPROVED) & exists & (approved_at < g)

    issue = (F.when(not_revoke & r_not_applied, F.lit(K.APPROVED_NOT_APPLIED))
             .when(not_revoke & r_rejected, F.lit(K.REJECTED_BUT_EXISTS))
             .when(not_revoke & r_expired, F.lit(K.EXPIRED_BUT_EXISTS))
             .when(not_revoke & r_unmanaged, F.lit(K.UNMANAGED_BINDING))
             .when(is_revoke & r_revoke, F.lit(K.REVOKE_NOT_APPLIED)))
    # fix: the reference maps REVOKED / REVOKED_ALREADY_GONE to a NULL severity
    severity = F.when(issue == K.REJECTED_BUT_EXISTS, F.lit("MEDIUM")).when(issue.isNotNull(), F.lit("HIGH"))
    return state.withColumn("issue_type", issue).withColumn("severity", severity)


def issue_id(as_of: str | _dt.datetime) -> Column:
    """``<request_id|UNMANAGED>-<type>-<yyyyMMddHHmmss>``; unmanaged ids get a triple hash."""
    stamp = F.date_format(ts(as_of), "yyyyMMddHHmmss")
    base = F.concat_ws("-", F.coalesce(F.col("request_id"), F.lit("UNMANAGED")), F.col("issue_type"), stamp)
    triple_hash = F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in TRIPLE]), 256), 1, 16)
    return F.when(F.col("request_id").isNull(), F.concat_ws("-", base, triple_hash)).otherwise(base)


ISSUE_COLUMNS = ["issue_id", "issue_type", "request_id", "principal_email", "resource_name",
                 "role", "detected_at", "severity", "status", "details"]


def reconcile(req: DataFrame, perm: DataFrame, as_of: str | _dt.datetime, grace_hours: float = 12.0,
              strict_break_glass: bool = False) -> DataFrame:
    """#38: issues between the newest request per triple and the current bindings."""
    state = classify(current_state(req, perm), as_of, grace_hours, strict_break_glass)
    return (state.filter(F.col("issue_type").isNotNull())
            .select(issue_id(as_of).alias("issue_id"), "issue_type", "request_id", *TRIPLE,
                    ts(as_of).alias("detected_at"), "severity", F.lit(K.ISSUE_OPEN).alias("status"),
                    to_json_keep_nulls(F.col("status").alias("request_status"), F.col("exists_now"),
                                       F.col("expires_at")).alias("details")))


def reconcile_outcome(req: DataFrame, perm: DataFrame, as_of: str | _dt.datetime,
                      grace_hours: float = 12.0) -> DataFrame:
    """Issue-type histogram of the reconcile state (NULL issue_type = no issue)."""
    state = classify(current_state(req, perm), as_of, grace_hours)
    return state.groupBy("issue_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("request_id").alias("with_request"))


def reconcile_simple(req: DataFrame, perm: DataFrame, as_of: str | _dt.datetime) -> DataFrame:
    """#39: older variant: every request (no newest-per-triple), 3 rules, no grace.

    The binding side is de-duplicated first (fix 2.11-g) so a repeated binding
    does not repeat the issue.
    """
    now = ts(as_of)
    actual = perm.select(*TRIPLE).distinct().withColumn("exists_now", F.lit(True))
    j = (split_join(req.select("request_id", *TRIPLE, "status", "expires_at"), actual, TRIPLE)
         .withColumn("exists_now", F.coalesce("exists_now", F.lit(False))))
    st = F.col("status")
    ex = F.col("exists_now")
    issue = (F.when((st == K.APPROVED) & ~ex, F.lit(K.APPROVED_NOT_APPLIED))
             .when(st.isin(K.REJECTED, K.CANCELLED) & ex, F.lit(K.REJECTED_BUT_EXISTS))
             .when((st == K.APPROVED) & F.col("expires_at").isNotNull() & (F.col("expires_at") < now) & ex,
                   F.lit(K.EXPIRED_BUT_EXISTS)))
    severity = F.when(issue == K.REJECTED_BUT_EXISTS, F.lit("MEDIUM")).when(issue.isNotNull(), F.lit("HIGH"))
    stamp = F.date_format(now, "yyyyMMddHHmmss")
    out = j.withColumn("issue_type", issue).withColumn("severity", severity).filter(F.col("issue_type").isNotNull())
    return out.select(F.concat_ws("-", "request_id", "issue_type", stamp).alias("issue_id"), "issue_type",
                      "request_id", *TRIPLE, now.alias("detected_at"), "severity",
                      F.lit(K.ISSUE_OPEN).alias("status"),
                      to_json_keep_nulls(F.col("status").alias("request_status"), F.col("exists_now"),
                                         F.col("expires_at")).alias("details"))


def _issue_key(df: DataFrame) -> list[Column]:
    return [F.col("issue_type")] + [F.coalesce(F.col(c), F.lit("")) for c in TRIPLE]


def reconcile_new_only(detected: DataFrame, issues: DataFrame) -> DataFrame:
    """#40: detections without an OPEN issue of the same type and triple (NULL = '')."""
    open_keys = (issues.filter(F.col("status") == K.ISSUE_OPEN)
                 .select(*[c.alias(n) for c, n in zip(_issue_key(issues), ["_t", "_p", "_r", "_o"])])
                 .distinct())
    d = detected.select("*", *[c.alias(n) for c, n in zip(_issue_key(detected), ["_t", "_p", "_r", "_o"])])
    return d.join(open_keys, ["_t", "_p", "_r", "_o"], "left_anti").drop("_t", "_p", "_r", "_o")


def resolve_stale_issues(issues: DataFrame, detected: DataFrame, as_of: str | _dt.datetime) -> DataFrame:
    """#90: OPEN issues no longer detected become CLOSED with resolved_at = as_of.

    Returns every issue row with its new status; others keep theirs.
    """
    keys = ["_t", "_p", "_r", "_o"]
    current = detected.select(*[c.alias(n) for c, n in zip(_issue_key(detected), keys)]).distinct() \
        .withColumn("_still", F.lit(True))
    j = issues.select("*", *[c.alias(n) for c, n in zip(_issue_key(issues), keys)]).join(current, keys, "left")
    closing = (F.col("status") == K.ISSUE_OPEN) & F.col("_still").isNull()
    return (j.withColumn("resolved_at", F.when(closing, ts(as_of)))
             .withColumn("status", F.when(closing, F.lit(K.ISSUE_CLOSED)).otherwise(F.col("status")))
             .drop(*keys, "_still"))


def expired_grants(req: DataFrame, perm: DataFrame, as_of: str | _dt.datetime) -> DataFrame:
    """#41: approved (or revoke-failed) non-REVOKE requests past expiry, with a binding flag.

    Bindings are de-duplicated to distinct triples before the join (fix 2.11-g).
    """
    now = ts(as_of)
    expired = req.filter(F.col("status").isin(K.APPROVED, K.REVOKE_FAILED)
                         & (F.col("request_type") != K.REVOKE)
                         & F.col("expires_at").isNotNull() & (F.col("expires_at") < now))
    active = perm.select(*TRIPLE).distinct().withColumn("_active", F.lit(True))
    return (split_join(expired, active, TRIPLE)
            .select("request_id", "request_type", *TRIPLE, "status", "approved_at", "expires_at", "reason",
                    F.coalesce(F.col("_active"), F.lit(False)).alias("is_permission_active")))
