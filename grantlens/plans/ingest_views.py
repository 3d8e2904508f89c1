"""Registered collector / intake queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import is_emergency, normalize_request_type, normalize_resource_name
from ..operators import ingest
from ..sources import nested, sinks
from .reconcile_views import NOW
from .registry import AS_OF, RUN_ID, register

SCOPE = "organizations/1"
REQUESTER = "portal@example.com"

MEMBERS_CTE = """
WITH m AS (
  SELECT DISTINCT resource_name, resource_type, role,
    CASE WHEN principal_type = 'SERVICE_ACCOUNT' THEN 'serviceAccount:' || principal_email
         ELSE 'user:' || principal_email END AS member
  FROM iam_policy_permissions
  UNION
  SELECT DISTINCT resource_name, resource_type, 'roles/viewer', v.x
  FROM iam_policy_permissions, (VALUES ('allUsers'), ('deleted:user:x@example.com')) AS v(x)
)
"""


def _policy_docs(t):
    return nested.policy_docs(t["iam_policy_permissions"])


@register("flatten_policy_bindings", MEMBERS_CTE + f"""
SELECT '{RUN_ID}' AS execution_id, {NOW} AS assessment_timestamp, '{SCOPE}' AS scope, resource_type, resource_name,
  CASE WHEN strpos(member, ':') = 0 THEN 'UNKNOWN'
       WHEN lower(split_part(member, ':', 1)) = 'serviceaccount' THEN 'SERVICE_ACCOUNT'
       ELSE upper(split_part(member, ':', 1)) END AS principal_type,
  CASE WHEN strpos(member, ':') = 0 THEN member ELSE substr(member, strpos(member, ':') + 1) END AS principal_email,
  role
FROM m""")
def q_flatten_policy_bindings(t):
    """#1: flatten policy documents into binding rows."""
    return ingest.flatten_policy_bindings(_policy_docs(t), RUN_ID, AS_OF, SCOPE)


@register("policy_collection_counts", MEMBERS_CTE + """
SELECT CAST(count(DISTINCT resource_name || substr(sha256(member), 1, 3)) AS BIGINT) AS policies, CAST(count(*) AS BIGINT) AS bindings FROM m""")
def q_policy_collection_counts(t):
    """#2: policy results and bindings counted by the flatten (a policy may come on several pages)."""
    return ingest.policy_collection_counts(_policy_docs(t))


INVENTORY_SQL = f"""
WITH a AS (SELECT resource_type AS rt, resource_id AS rid, parent_resource_id AS par,
                  CAST(regexp_extract(resource_id, '(\\d+)$', 1) AS BIGINT) AS num FROM gcp_resource_inventory),
inv AS (
  SELECT '{RUN_ID}' AS execution_id, {NOW} AS assessed_at, rt AS resource_type,
    CASE WHEN num % 2 = 0 THEN rt || ' ' || rid
         WHEN rt = 'Folder' THEN rid ELSE regexp_extract(rid, '^projects/(.*)$', 1) END AS resource_name,
    CASE WHEN rt = 'Folder' THEN rid ELSE regexp_extract(rid, '^projects/(.*)$', 1) END AS resource_id,
    COALESCE(par, '') AS parent_resource_id, rid AS full_resource_path,
    'source=cloudasset scope={SCOPE}' AS note
  FROM a)
"""


def _inventory(t):
    return ingest.normalize_resource_inventory(nested.asset_rows(t["gcp_resource_inventory"]), RUN_ID, AS_OF, SCOPE)


@register("normalize_resource_inventory", INVENTORY_SQL + "SELECT * FROM inv")
def q_normalize_resource_inventory(t):
    """#3: asset search rows -> resource inventory history rows."""
    return _inventory(t)


@register("resource_type_counts", INVENTORY_SQL +
          "SELECT resource_type, CAST(count(*) AS BIGINT) AS n FROM inv GROUP BY resource_type")
def q_resource_type_counts(t):
    """#4: resources per type."""
    return ingest.resource_type_counts(_inventory(t))


@register("stamp_snapshot", f"""
SELECT resource_type, resource_id, parent_resource_id, '{RUN_ID}' AS execution_id, {NOW} AS assessed_at
FROM gcp_resource_inventory""")
def q_stamp_snapshot(t):
    """#7: one execution id and timestamp for every row of a run."""
    return ingest.stamp_snapshot(t["gcp_resource_inventory"], RUN_ID, AS_OF, "assessed_at")


def _sources(t):
    feed = t["principal_feed"]

    def src(kind):
        return feed.filter(F.col("principal_type") == kind).select(
            F.col("principal_email").alias("email"), F.col("principal_name").alias("name"))
    return ingest.union_principal_sources(src("GROUP"), src("USER"), src("SERVICE_ACCOUNT"))


PRINCIPALS_SQL = """
WITH p AS (
  SELECT trim(COALESCE(principal_email, '')) AS principal_email, trim(COALESCE(principal_name, '')) AS principal_name,
    principal_type FROM principal_feed
  WHERE principal_type IN ('GROUP', 'USER', 'SERVICE_ACCOUNT') AND trim(COALESCE(principal_email, '')) <> '')
"""


@register("union_principal_sources", PRINCIPALS_SQL + "SELECT * FROM p")
def q_union_principal_sources(t):
    """#5: union of group, user and service-account sources."""
    return _sources(t)


@register("principal_source_counts", PRINCIPALS_SQL +
          "SELECT principal_type, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY principal_type")
def q_principal_source_counts(t):
    """#5: principals per source."""
    return ingest.principal_source_counts(_sources(t))


@register("flatten_group_memberships", """
SELECT DISTINCT group_email, member_email, CAST(NULL AS VARCHAR) AS member_display_name, membership_type,
  'cloudidentity' AS source FROM google_group_membership_history""")
def q_flatten_group_memberships(t):
    """#6: group documents -> membership rows."""
    return ingest.flatten_group_memberships(nested.group_docs(t["google_group_membership_history"]))


INTAKE_CTE = """
WITH b AS (SELECT *, trim(COALESCE(role, '')) AS r,
                  (request_type_raw LIKE '%緊急%' OR upper(request_type_raw) LIKE '%EMERGENCY%') AS emergency,
                  (COALESCE(expires_raw, '') = '' OR expires_raw = '恒久' OR upper(expires_raw) LIKE '%PERMANENT%') AS permanent
           FROM intake_batch),
bad AS (SELECT request_group_id,
          min(CASE WHEN r <> '' AND NOT starts_with(r, 'roles/') THEN 'Invalid role: ' || r END) AS err
        FROM b GROUP BY request_group_id),
j AS (SELECT b.*, bad.err FROM b JOIN bad ON b.request_group_id IS NOT DISTINCT FROM bad.request_group_id),
ok AS (
  SELECT request_group_id, request_id,
    CASE WHEN request_type_raw LIKE '%変更%' OR upper(request_type_raw) LIKE '%CHANGE%' THEN 'CHANGE'
         WHEN request_type_raw LIKE '%削除%' OR upper(request_type_raw) LIKE '%REVOKE%' THEN 'REVOKE'
         ELSE 'GRANT' END AS request_type,
    trim(principal) AS principal_email,
    CASE WHEN trim(resource) = '' OR starts_with(trim(resource), 'projects/') OR starts_with(trim(resource), 'folders/')
              OR starts_with(trim(resource), 'organizations/') THEN trim(resource)
         ELSE 'projects/' || trim(resource) END AS resource_name,
    r AS role,
    CASE WHEN emergency AND NOT starts_with(trim(reason), '[緊急]') THEN '[緊急] ' || trim(reason) ELSE trim(reason) END AS reason,
    CASE WHEN permanent THEN NULL ELSE try_strptime(expires_raw, '%Y-%m-%d') + INTERVAL 86399 SECOND END AS expires_at,
    'portal@example.com' AS requester_email, '' AS approver_email,
    CASE WHEN emergency THEN 'APPROVED' ELSE 'PENDING' END AS status, requested_at, '' AS ticket_ref,
    (NOT permanent AND try_strptime(expires_raw, '%Y-%m-%d') IS NULL) AS parse_warning, '' AS ai_suggestion
  FROM j WHERE err IS NULL)
"""


def _intake(t):
    return ingest.intake_requests(t["intake_batch"], REQUESTER, AS_OF)


@register("intake_requests", INTAKE_CTE + "SELECT * FROM ok")
def q_intake_requests(t):
    """#73: normalised requests of the accepted intake groups."""
    return _intake(t)[0]


@register("intake_rejected", INTAKE_CTE + "SELECT request_group_id, request_id, err AS error FROM j WHERE err IS NOT NULL")
def q_intake_rejected(t):
    """#73/#77: rows of intake groups rejected for an invalid role."""
    return _intake(t)[1]


@register("intake_history_events", INTAKE_CTE + """
SELECT sha256(concat_ws('|', request_id, 'REQUESTED')) AS history_id, request_id, request_group_id,
  'REQUESTED' AS event_type, '' AS old_status, status AS new_status, reason AS reason_snapshot, request_type,
  principal_email, resource_name, role, requester_email, approver_email, requester_email AS acted_by,
  'WEB_APP_BULK' AS actor_source, requested_at AS event_at,
  '{"source":"web_app_bulk","ai_suggestion":""}' AS details
FROM ok""")
def q_intake_history_events(t):
    """#74: REQUESTED events of the accepted intake rows."""
    return ingest.intake_history_events(_intake(t)[0])


@register("normalize_request_type", """
SELECT request_id, request_type_raw,
  CASE WHEN request_type_raw LIKE '%変更%' OR upper(request_type_raw) LIKE '%CHANGE%' THEN 'CHANGE'
       WHEN request_type_raw LIKE '%削除%' OR upper(request_type_raw) LIKE '%REVOKE%' THEN 'REVOKE'
       ELSE 'GRANT' END AS request_type,
  COALESCE(request_type_raw LIKE '%緊急%' OR upper(request_type_raw) LIKE '%EMERGENCY%', FALSE) AS is_emergency
FROM intake_batch""")
def q_normalize_request_type(t):
    """#75: request-type label -> code (+ emergency flag)."""
    b = t["intake_batch"]
    return b.select("request_id", "request_type_raw",
                    normalize_request_type(F.col("request_type_raw")).alias("request_type"),
                    is_emergency(F.col("request_type_raw")).alias("is_emergency"))


@register("normalize_resource_name", """
SELECT request_id, resource,
  CASE WHEN trim(resource) = '' OR starts_with(trim(resource), 'projects/') OR starts_with(trim(resource), 'folders/')
            OR starts_with(trim(resource), 'organizations/') THEN trim(resource)
       ELSE 'projects/' || trim(resource) END AS resource_name
FROM intake_batch""")
def q_normalize_resource_name(t):
    """#76: resource value -> full resource name."""
    b = t["intake_batch"]
    return b.select("request_id", "resource", normalize_resource_name(F.col("resource")).alias("resource_name"))


@register("validate_requests", """
SELECT request_id,
  CASE WHEN trim(COALESCE(role, '')) <> '' AND NOT starts_with(trim(role), 'roles/') THEN 'Invalid role: ' || trim(role)
       WHEN trim(COALESCE(principal, '')) = '' THEN 'principal is required'
       WHEN trim(COALESCE(resource, '')) = '' THEN 'resource is required'
       WHEN trim(COALESCE(role, '')) = '' THEN 'role is required' END AS validation_error
FROM intake_batch""")
def q_validate_requests(t):
    """#77: per-row validation errors."""
    return ingest.validate_requests(t["intake_batch"]).select("request_id", "validation_error")


@register("evolve_request_group_id", """
SELECT * REPLACE (COALESCE(CASE WHEN ticket_ref = '' THEN NULL ELSE request_group_id END, request_id) AS request_group_id)
FROM iam_access_requests""")
def q_evolve_request_group_id(t):
    """#15: legacy rows (no ticket) carry no group id; the backfill sets it to the request id."""
    legacy = t["iam_access_requests"].withColumn(
        "request_group_id", F.when(F.col("ticket_ref") == "", F.lit(None).cast("string"))
        .otherwise(F.col("request_group_id")))
    return sinks.evolve_request_group_id(legacy)


@register("append_requests", INTAKE_CTE + f"""
SELECT * EXCLUDE (parse_warning, ai_suggestion) REPLACE (COALESCE(request_group_id, request_id) AS request_group_id), {NOW} AS created_at, {NOW} AS updated_at FROM ok""")
def q_append_requests(t):
    """#10: accepted intake rows as they are appended to the request table."""
    req = _intake(t)[0].drop("parse_warning", "ai_suggestion")
    return sinks.prepare_requests(req, AS_OF)


@register("append_job_report", """
SELECT execution_id, job_type, result, CAST(json(counts) AS VARCHAR) AS counts, occurred_at FROM iam_pipeline_job_reports""")
def q_append_job_report(t):
    """#13: job reports with counts as JSON text (a map column is serialised)."""
    rep = t["iam_pipeline_job_reports"]
    as_map = rep.withColumn("counts", F.from_json("counts", "map<string,int>"))
    return sinks.prepare_job_report(as_map).select("execution_id", "job_type", "result", "counts", "occurred_at")
