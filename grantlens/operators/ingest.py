"""Collector flattening and request intake (#1-7, #73-77).

Nested API documents arrive as rows with array columns; flattening is
``explode`` (a narrow, per-partition generator) followed by column
expressions, so it scales with the number of documents and needs no shuffle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import (is_emergency, normalize_request_type, normalize_resource_name, nullif_empty,
                                 stable_id, to_json_keep_nulls, ts)

# --- collectors -----------------------------------------------------------------


def stamp_snapshot(df: DataFrame, execution_id: str, as_of: str | _dt.datetime, ts_col: str) -> DataFrame:
    """#7: the same execution id and timestamp on every row of a run."""
    return df.withColumn("execution_id", F.lit(execution_id)).withColumn(ts_col, ts(as_of))


def flatten_policy_bindings(policy_docs: DataFrame, execution_id: str, as_of: str | _dt.datetime,
                            scope: str) -> DataFrame:
    """#1: one row per (resource, role, member) of the policy documents."""
    b = policy_docs.select(F.col("resource"), F.col("asset_type"),
                           F.explode_outer("policy.bindings").alias("b"))
    m = b.select("resource", "asset_type", F.col("b.role").alias("role"),
                 F.explode("b.members").alias("member"))
    resource_name = F.when(F.col("resource").startswith("//"),
                           F.regexp_replace("resource", r"^//[^/]+/", "")).otherwise(F.col("resource"))
    parts = F.split(F.col("member"), ":", 2)
    has_colon = F.col("member").contains(":")
    ptype = (F.when(~has_colon, F.lit("UNKNOWN"))
             .when(F.lower(parts.getItem(0)) == "serviceaccount", F.lit("SERVICE_ACCOUNT"))
             .otherwise(F.upper(parts.getItem(0))))
    email = F.when(has_colon, parts.getItem(1)).otherwise(F.col("member"))
    return m.select(F.lit(execution_id).alias("execution_id"), ts(as_of).alias("assessment_timestamp"),
                    F.lit(scope).alias("scope"), F.col("asset_type").alias("resource_type"),
                    resource_name.alias("resource_name"), ptype.alias("principal_type"),
                    email.alias("principal_email"), "role")


def policy_collection_counts(policy_docs: DataFrame) -> DataFrame:
    """#2: policy results and bindings (members) seen by the flatten, as the collector counts them."""
    members = F.aggregate(F.coalesce(F.col("policy.bindings"), F.array()), F.lit(0).cast("long"),
                          lambda acc, b: acc + F.coalesce(F.size(b["members"]), F.lit(0)).cast("long"))
    return policy_docs.agg(F.count(F.lit(1)).alias("policies"),
                           F.coalesce(F.sum(members), F.lit(0).cast("long")).alias("bindings"))


def _strip_full_name(raw) -> "F.Column":
    """Name at the end of a full path, else the path without host and without ``projects/`` before further parts."""
    v = F.trim(F.coalesce(raw, F.lit("")))
    tail = F.regexp_extract(v, r"(organizations/\d+|folders/\d+|projects/[^/]+)$", 1)
    path = F.regexp_replace(v, r"^(//)?(cloudresourcemanager\.googleapis\.com/)?(projects/(?=[^/]*/))?", "")
    return F.coalesce(nullif_empty(tail), path)


def _after_first_slash(c):
    return F.regexp_extract(c, r"^[^/]*/(.*)$", 1)


def resource_type_short(asset_type) -> "F.Column":
    return (F.when(asset_type.endswith("/Folder"), F.lit("Folder"))
            .when(asset_type.endswith("/Project"), F.lit("Project"))
            .otherwise(F.element_at(F.split(asset_type, "/"), -1)))


def normalize_resource_inventory(asset_rows: DataFrame, execution_id: str, as_of: str | _dt.datetime,
                                 scope: str) -> DataFrame:
    """#3: asset search rows -> the 8 columns of the resource inventory history."""
    # bound in a projection of their own: the id takes them several times, and their patterns must not be copied into it
    parts = asset_rows.select(
        resource_type_short(F.col("asset_type")).alias("rtype"), _strip_full_name(F.col("name")).alias("name"),
        _strip_full_name(F.col("parent_full_resource_name")).alias("parent"), "display_name",
        F.trim(F.coalesce(F.col("additional_attributes").getItem("projectId"), F.lit(""))).alias("attr_pid"),
        F.trim(F.coalesce(F.col("project"), F.lit(""))).alias("proj_ref"))
    rtype, name, parent, attr_pid, proj_ref = (F.col(c) for c in ("rtype", "name", "parent", "attr_pid", "proj_ref"))
    fallback = F.when(name != "", name).otherwise(F.lit("unknown-resource"))
    rid = (F.when(rtype == "Folder", F.when(name != "", name).otherwise(F.lit("unknown-folder")))
           .when((rtype == "Project") & (attr_pid != ""), attr_pid)
           .when((rtype == "Project") & proj_ref.startswith("projects/"), _after_first_slash(proj_ref))
           .when((rtype == "Project") & name.startswith("projects/"), _after_first_slash(name))
           .otherwise(fallback))
    display = nullif_empty(F.coalesce(F.col("display_name"), F.lit("")))
    return parts.withColumn("rid", rid).select(
        F.lit(execution_id).alias("execution_id"), ts(as_of).alias("assessed_at"), rtype.alias("resource_type"),
        F.coalesce(display, F.col("rid")).alias("resource_name"), F.col("rid").alias("resource_id"),
        parent.alias("parent_resource_id"), name.alias("full_resource_path"),
        F.lit(f"source=cloudasset scope={scope}").alias("note"))


def resource_type_counts(inventory: DataFrame) -> DataFrame:
    """#4: rows per resource type."""
    return inventory.groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"))


def union_principal_sources(groups: DataFrame, users: DataFrame, accounts: DataFrame) -> DataFrame:
    """#5: groups, users and service accounts (columns email, name) -> principal rows.

    E-mails and names are trimmed; rows with an empty e-mail are dropped.
    """
    def one(df: DataFrame, ptype: str) -> DataFrame:
        return (df.select(F.trim(F.coalesce(F.col("email"), F.lit(""))).alias("principal_email"),
                          F.trim(F.coalesce(F.col("name"), F.lit(""))).alias("principal_name"),
                          F.lit(ptype).alias("principal_type"))
                .filter(F.col("principal_email") != ""))
    return one(groups, "GROUP").unionByName(one(users, "USER")).unionByName(one(accounts, "SERVICE_ACCOUNT"))


def principal_source_counts(principals: DataFrame) -> DataFrame:
    """#5 counts: principals per source type."""
    return principals.groupBy("principal_type").agg(F.count(F.lit(1)).alias("n"))


def flatten_group_memberships(group_docs: DataFrame) -> DataFrame:
    """#6: group documents with nested memberships -> membership rows."""
    g = group_docs.select(F.trim(F.coalesce(F.col("groupKey.id"), F.lit(""))).alias("group_email"),
                          F.explode_outer("memberships").alias("m"))
    g = g.filter(F.col("group_email") != "")
    member = F.trim(F.coalesce(F.col("m.preferredMemberKey.id"), F.lit("")))
    role0 = F.trim(F.coalesce(F.element_at(F.col("m.roles"), 1).getField("name"), F.lit("")))
    return (g.select("group_email", member.alias("member_email"),
                     F.lit(None).cast("string").alias("member_display_name"),
                     nullif_empty(role0).alias("membership_type"), F.lit("cloudidentity").alias("source"))
            .filter(F.col("member_email") != ""))


# --- intake ---------------------------------------------------------------------

REQUEST_COLUMNS = ["request_group_id", "request_id", "request_type", "principal_email", "resource_name", "role",
                   "reason", "expires_at", "requester_email", "approver_email", "status", "requested_at",
                   "ticket_ref"]


def _expires(raw):
    r = F.coalesce(raw, F.lit(""))
    permanent = (r == "") | (r == K.PERMANENT_JA) | F.upper(r).contains(K.PERMANENT_EN)
    parsed = F.try_to_timestamp(r, F.lit("yyyy-M-d")).cast("date")
    at_end = F.try_to_timestamp(F.concat(F.date_format(parsed, "yyyy-MM-dd"), F.lit(" 23:59:59")),
                                F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    expires = F.when(permanent, F.lit(None).cast("timestamp_ntz")).otherwise(at_end)
    warning = (~permanent) & expires.isNull()
    return expires, warning


def validate_requests(batch: DataFrame) -> DataFrame:
    """#77: adds ``validation_error``: required fields present, role must start with roles/."""
    role = F.trim(F.coalesce(F.col("role"), F.lit("")))
    principal = F.trim(F.coalesce(F.col("principal"), F.lit("")))
    resource = F.trim(F.coalesce(F.col("resource"), F.lit("")))
    err = (F.when((role != "") & ~role.startswith("roles/"), F.concat(F.lit("Invalid role: "), role))
           .when(principal == "", F.lit("principal is required"))
           .when(resource == "", F.lit("resource is required"))
           .when(role == "", F.lit("role is required")))
    return batch.withColumn("validation_error", err)


def intake_requests(batch: DataFrame, requester: str, as_of: str | _dt.datetime) -> tuple[DataFrame, DataFrame]:
    """#73: raw portal batch -> (normalised requests, rejected rows).

    An invalid role rejects its whole request group (the reference rejects the
    whole submitted batch, which is one group).  Emergency types are approved
    at once and get the reason prefix; an unparseable expiry date becomes NULL
    (permanent) as in the reference, flagged by ``parse_warning``.
    """
    role = F.trim(F.coalesce(F.col("role"), F.lit("")))
    bad_role = (role != "") & ~role.startswith("roles/")
    flagged = batch.withColumn("_bad", F.when(bad_role, F.concat(F.lit("Invalid role: "), role)))
    group_err = flagged.filter(F.col("_bad").isNotNull()).groupBy(F.col("request_group_id").alias("_group")).agg(F.min("_bad").alias("_group_error"))
    j = flagged.join(group_err, F.col("request_group_id").eqNullSafe(F.col("_group")), "left").drop("_group")
    rejected = j.filter(F.col("_group_error").isNotNull()).select(
        "request_group_id", "request_id", F.col("_group_error").alias("error"))
    ok = j.filter(F.col("_group_error").isNull())
    raw_type = F.coalesce(F.col("request_type_raw"), F.lit(""))
    emergency = is_emergency(raw_type)
    reason = F.trim(F.coalesce(F.col("reason"), F.lit("")))
    reason = F.when(emergency & ~reason.startswith(K.EMERGENCY_REASON_PREFIX),
                    F.concat(F.lit(K.EMERGENCY_REASON_PREFIX + " "), reason)).otherwise(reason)
    expires, warning = _expires(F.col("expires_raw"))
    requested_at = F.col("requested_at").cast("timestamp_ntz") if "requested_at" in batch.columns else ts(as_of)
    approver = F.trim(F.coalesce(F.col("approver"), F.lit(""))) if "approver" in batch.columns else F.lit("")
    ai = F.coalesce(F.col("ai_suggestion"), F.lit("")) if "ai_suggestion" in batch.columns else F.lit("")
    requests = ok.select(
        "request_group_id", "request_id", normalize_request_type(raw_type).alias("request_type"),
        F.trim(F.coalesce(F.col("principal"), F.lit(""))).alias("principal_email"),
        normalize_resource_name(F.coalesce(F.col("resource"), F.lit(""))).alias("resource_name"),
        role.alias("role"), reason.alias("reason"), expires.alias("expires_at"),
        F.lit(requester).alias("requester_email"), approver.alias("approver_email"),
        F.when(emergency, F.lit(K.APPROVED)).otherwise(F.lit(K.PENDING)).alias("status"),
        requested_at.alias("requested_at"), F.lit("").alias("ticket_ref"), warning.alias("parse_warning"),
        ai.alias("ai_suggestion"))
    return requests, rejected


def intake_history_events(requests: DataFrame) -> DataFrame:
    """#74: one REQUESTED history event per accepted intake row (deterministic history_id)."""
    return requests.select(
        stable_id(F.col("request_id"), F.lit("REQUESTED")).alias("history_id"), "request_id", "request_group_id",
        F.lit("REQUESTED").alias("event_type"), F.lit("").alias("old_status"), F.col("status").alias("new_status"),
        F.col("reason").alias("reason_snapshot"), "request_type", "principal_email", "resource_name", "role",
        "requester_email", "approver_email", F.col("requester_email").alias("acted_by"),
        F.lit("WEB_APP_BULK").alias("actor_source"), F.col("requested_at").alias("event_at"),
        to_json_keep_nulls(F.lit("web_app_bulk").alias("source"),
                           F.coalesce(F.col("ai_suggestion"), F.lit("")).alias("ai_suggestion")).alias("details"))


def emergency_request_ids(requests: DataFrame) -> DataFrame:
    """Accepted emergency rows that are executed immediately after intake."""
    return requests.filter(F.col("status") == K.APPROVED).select("request_id")
