"""Registered workflow / scope queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import member_identifier
from ..operators import ingest, scope as sc, workflow as wf
from .ingest_views import REQUESTER, _inventory
from .reconcile_views import NOW
from .registry import AS_OF, RUN_ID, register

TARGET_ORG = "1"

ANCESTORS_SQL = """WITH RECURSIVE nodes AS (
  SELECT CASE WHEN resource_type = 'Project' THEN regexp_extract(resource_id, '^projects/(.*)$', 1) ELSE resource_id END AS resource_id,
    resource_id AS node, parent_resource_id AS parent FROM gcp_resource_inventory
),
walk(node, up, hops) AS (
  SELECT node, parent, 1 FROM nodes
  UNION ALL
  SELECT w.node, n.parent, w.hops + 1
  FROM walk w JOIN nodes n ON w.up = n.node
  WHERE NOT starts_with(w.up, 'organizations/')
),
anc AS (
  SELECT n.resource_id, n.node, o.up AS organization, CAST(o.hops AS BIGINT) AS depth
  FROM nodes n LEFT JOIN (SELECT * FROM walk WHERE starts_with(up, 'organizations/')) o ON n.node = o.node
)"""


def _scope_resources(t):
    """Resources to check: every request resource plus the intake batch's normalised ones."""
    req = t["iam_access_requests"].select("resource_name")
    intake = ingest.intake_requests(t["intake_batch"], REQUESTER, AS_OF)[0].select("resource_name")
    return req.unionByName(intake)


SCOPE_SQL = ANCESTORS_SQL + f""",
res AS (
  SELECT DISTINCT resource_name FROM (
    SELECT resource_name FROM iam_access_requests
    UNION ALL
    SELECT CASE WHEN trim(resource) = '' OR starts_with(trim(resource), 'projects/')
                     OR starts_with(trim(resource), 'folders/') OR starts_with(trim(resource), 'organizations/')
                THEN trim(resource) ELSE 'projects/' || trim(resource) END
    FROM intake_batch WHERE COALESCE(request_group_id, '') NOT IN (
      SELECT request_group_id FROM intake_batch
      WHERE trim(COALESCE(role, '')) <> '' AND NOT starts_with(trim(role), 'roles/') AND request_group_id IS NOT NULL)
    AND NOT (request_group_id IS NULL AND EXISTS (SELECT 1 FROM intake_batch WHERE request_group_id IS NULL
      AND trim(COALESCE(role, '')) <> '' AND NOT starts_with(trim(role), 'roles/')))
  )
),
sc0 AS (
  SELECT r.resource_name, trim(regexp_extract(r.resource_name, '^[^/]*/(.*)$', 1)) AS pid, a.organization
  FROM res r LEFT JOIN anc a
    ON a.node = 'projects/' || trim(regexp_extract(r.resource_name, '^[^/]*/(.*)$', 1))
),
scope AS (
  SELECT resource_name, CASE
    WHEN NOT COALESCE(starts_with(resource_name, 'projects/'), FALSE)
      THEN 'resource_name must start with projects/ (folder/org IAM changes are disabled by design)'
    WHEN pid = '' THEN 'resource_name must contain project id'
    WHEN organization IS NULL THEN 'failed to resolve organization for resource: ' || resource_name
    WHEN regexp_extract(organization, '^organizations/(.*)$', 1) <> '{TARGET_ORG}'
      THEN 'resource is out of managed organization scope: expected organizations/{TARGET_ORG}, got organizations/'
           || regexp_extract(organization, '^organizations/(.*)$', 1)
    END AS scope_error
  FROM sc0
)"""


def _scope(t):
    return sc.scope_check(_scope_resources(t), _inventory(t), target_org=TARGET_ORG)


def _gate_scope(t):
    """Scope verdicts for the gate: the resources of the gated requests but for those that nobody listed."""
    listed = t["gated_requests"].select("resource_name").filter("resource_name is null or not startswith(resource_name, 'projects/unlisted-')")
    return sc.scope_check(_scope_resources(t).unionByName(listed), _inventory(t), target_org=TARGET_ORG)


GATE_SCOPE_SQL = SCOPE_SQL.replace("SELECT resource_name FROM iam_access_requests\n", """SELECT resource_name FROM iam_access_requests
    UNION ALL
    SELECT resource_name FROM gated_requests WHERE resource_name IS NULL OR NOT starts_with(resource_name, 'projects/unlisted-')
""")


@register("resolve_ancestors", ANCESTORS_SQL + " SELECT * FROM anc")
def q_resolve_ancestors(t):
    """#50: organisation and depth of every node of the normalised inventory (pointer doubling)."""
    return sc.resolve_ancestors(_inventory(t))


@register("scope_check", SCOPE_SQL + " SELECT resource_name, scope_error IS NULL AS in_scope, scope_error FROM scope")
def q_scope_check(t):
    """#49: organisation-mode scope check of request resources."""
    return _scope(t)


@register("scope_check_project_mode", """
SELECT DISTINCT resource_name,
  starts_with(resource_name, 'projects/') AND resource_name = 'projects/p3' AS in_scope,
  CASE WHEN NOT starts_with(resource_name, 'projects/')
         THEN 'resource_name must start with projects/ (folder/org IAM changes are disabled by design)'
       WHEN resource_name <> 'projects/p3'
         THEN 'resource is out of managed scope: expected projects/p3, got ' || resource_name END AS scope_error
FROM iam_access_requests""")
def q_scope_check_project_mode(t):
    """#49: project-mode scope check (only projects/p3 is managed)."""
    return sc.scope_check(t["iam_access_requests"], target_project="p3")


REVIEWS_SQL = """
n AS (
  SELECT trim(COALESCE(request_id, '')) AS request_id,
    CASE trim(COALESCE(status, '')) WHEN '申請中' THEN 'PENDING' WHEN '承認済' THEN 'APPROVED' WHEN '却下' THEN 'REJECTED'
      WHEN '取消' THEN 'CANCELLED' ELSE upper(trim(COALESCE(status, ''))) END AS status,
    trim(COALESCE(reject_reason, '')) AS reject_reason, actor_email, submission_id, seq, trim(COALESCE(status, '')) AS status_raw
  FROM review_updates),
bad AS (SELECT COALESCE(submission_id, '<none>') AS sub, min('invalid status: ' || status_raw) AS batch_error
        FROM n WHERE status NOT IN ('PENDING','APPROVED','REJECTED','CANCELLED') GROUP BY ALL),
nn AS (SELECT n.*, bad.batch_error FROM n LEFT JOIN bad ON COALESCE(n.submission_id, '<none>') = bad.sub)"""

#: Rules are tried one after the other per line; a line takes the first that applies.
REVIEW_DECISIONS_SQL = REVIEWS_SQL + """,
ok AS (SELECT * FROM nn WHERE batch_error IS NULL
       AND COALESCE(submission_id, '<none>') IN (SELECT COALESCE(submission_id, '<none>') FROM nn WHERE request_id <> '')),
j AS (SELECT ok.*, r.status AS old, trim(COALESCE(r.approver_email, '')) AS approver, r.request_id IS NOT NULL AS found
      FROM ok LEFT JOIN iam_access_requests r ON ok.request_id = r.request_id),
rule(nth, error_code) AS (VALUES (1, 'INVALID_REQUEST_ID'), (2, 'INVALID_STATUS'), (3, 'NOT_FOUND'), (4, 'NO_STATUS_CHANGE'),
  (5, 'MISSING_REJECT_REASON'), (6, 'MISSING_APPROVER'), (7, 'FORBIDDEN')),
hit AS (SELECT j.*, list_position([request_id = '', status = '', NOT found, COALESCE(old, '') = status, status = 'REJECTED' AND reject_reason = '',
          status IN ('APPROVED', 'REJECTED') AND approver = '',
          status IN ('APPROVED', 'REJECTED') AND lower(COALESCE(actor_email, '')) <> lower(approver)], TRUE) AS nth FROM j),
c AS (SELECT hit.*, rule.error_code AS code,
        CASE WHEN rule.nth IS NULL THEN row_number() OVER (PARTITION BY submission_id, request_id, rule.nth
          ORDER BY seq, status, reject_reason, COALESCE(actor_email, '')) END AS turn
      FROM hit LEFT JOIN rule ON hit.nth = rule.nth),
dec AS (
  SELECT submission_id, request_id, status, old AS old_status, reject_reason, actor_email, seq,
    CASE WHEN turn = 1 THEN 'UPDATED' WHEN turn > 1 OR code = 'NO_STATUS_CHANGE' THEN 'SKIPPED' ELSE 'ERROR' END AS outcome,
    CASE WHEN turn > 1 THEN 'DUPLICATE_IN_BATCH' ELSE code END AS error_code,
    CASE code WHEN 'INVALID_REQUEST_ID' THEN 'request_id is required' WHEN 'INVALID_STATUS' THEN 'status is required'
      WHEN 'NOT_FOUND' THEN 'request_id not found: ' || request_id
      WHEN 'MISSING_REJECT_REASON' THEN 'reject_reason is required when status is REJECTED'
      WHEN 'MISSING_APPROVER' THEN 'approver_email is empty. Cannot approve or reject without an assigned approver.'
      WHEN 'FORBIDDEN' THEN 'only approver can set APPROVED/REJECTED' END AS error_message
  FROM c),
applied AS (SELECT * FROM dec WHERE outcome = 'UPDATED'
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY seq, status, reject_reason, actor_email NULLS FIRST) = 1)"""


def _accepted(t):
    """Normalised review lines of the submissions without an unknown status."""
    n = wf.normalize_reviews(t["review_updates"], "submission_id")
    return n.filter(F.col("batch_error").isNull()).drop("batch_error", "status_raw")


def _decisions(t):
    return wf.review_decisions(_accepted(t), t["iam_access_requests"], "SHEET_BULK_REVIEW", "submission_id")


@register("review_decisions", "WITH " + REVIEW_DECISIONS_SQL.strip() + " SELECT * FROM dec")
def q_review_decisions(t):
    """#78: review cascade over the accepted submissions."""
    return _decisions(t)


@register("normalize_reviews", "WITH " + REVIEWS_SQL.strip() + " SELECT * FROM nn")
def q_normalize_reviews(t):
    """#79: label normalisation; one bad status rejects its whole submission."""
    return wf.normalize_reviews(t["review_updates"], "submission_id")


REQ_COLS = ("request_id, request_group_id, request_type, principal_email, resource_name, role, reason, expires_at, "
            "requester_email, approver_email, status, requested_at, approved_at, ticket_ref, created_at, updated_at")


@register("apply_status_updates", "WITH " + REVIEW_DECISIONS_SQL.strip() + f"""
SELECT r.request_id, r.request_group_id, r.request_type, r.principal_email, r.resource_name, r.role, r.reason,
  r.expires_at, r.requester_email, r.approver_email, COALESCE(d.status, r.status) AS status, r.requested_at,
  CASE WHEN d.status = 'APPROVED' THEN {NOW} ELSE r.approved_at END AS approved_at, r.ticket_ref, r.created_at,
  CASE WHEN d.status IS NOT NULL THEN {NOW} ELSE r.updated_at END AS updated_at
FROM iam_access_requests r LEFT JOIN applied d ON r.request_id = d.request_id""")
def q_apply_status_updates(t):
    """#80: request table after applying the review decisions."""
    return wf.apply_status_updates(t["iam_access_requests"], _decisions(t), AS_OF)


@register("status_change_events", "WITH " + REVIEW_DECISIONS_SQL.strip() + f"""
SELECT sha256(concat_ws('|', d.request_id, 'STATUS_CHANGED', d.status, CAST({NOW} AS VARCHAR))) AS history_id,
  d.request_id, r.request_group_id, 'STATUS_CHANGED' AS event_type, COALESCE(d.old_status, '') AS old_status,
  d.status AS new_status, COALESCE(r.reason, '') AS reason_snapshot, COALESCE(r.request_type, '') AS request_type,
  COALESCE(r.principal_email, '') AS principal_email, COALESCE(r.resource_name, '') AS resource_name,
  COALESCE(r.role, '') AS role, COALESCE(r.requester_email, '') AS requester_email,
  COALESCE(r.approver_email, '') AS approver_email, d.actor_email AS acted_by, 'SHEET_BULK_REVIEW' AS actor_source,
  {NOW} AS event_at,
  CASE WHEN d.reject_reason <> '' THEN '{{"note":"Bulk status update","reject_reason":"' || d.reject_reason || '"}}'
       ELSE '{{"note":"Bulk status update"}}' END AS details
FROM applied d JOIN iam_access_requests r ON d.request_id = r.request_id""".replace("{{", "{").replace("}}", "}"))
def q_status_change_events(t):
    """#81: STATUS_CHANGED audit rows of the applied updates."""
    return wf.status_change_events(t["iam_access_requests"], _decisions(t), AS_OF)


#: What is not known to be approved and in scope does not run.
EXEC_PLAN_SQL = GATE_SCOPE_SQL + """,
ids AS (SELECT DISTINCT trim(request_id) AS request_id FROM {ids} WHERE trim(request_id) <> ''),
succ AS (SELECT request_id, bool_or(COALESCE(result = 'SUCCESS', FALSE)) AS has_success
         FROM iam_access_change_log WHERE request_id IN (SELECT request_id FROM ids) GROUP BY request_id),
pj AS (
  SELECT i.request_id, r.request_id IS NOT NULL AS found, r.request_type, r.status, r.resource_name, r.reason,
    CASE WHEN s.resource_name IS NULL AND s.scope_error IS NULL THEN 'scope is not known for resource: ' || COALESCE(r.resource_name, '')
      ELSE s.scope_error END AS scope_error, COALESCE(x.has_success, FALSE) AS has_success
  FROM ids i LEFT JOIN {req} r ON i.request_id = r.request_id
  LEFT JOIN scope s ON r.resource_name IS NOT DISTINCT FROM s.resource_name
  LEFT JOIN succ x ON i.request_id = x.request_id),
plan AS (
  SELECT request_id, CASE WHEN NOT found THEN 'NOT_FOUND' WHEN status IS DISTINCT FROM 'APPROVED' THEN 'STATUS_NOT_APPROVED'
      WHEN scope_error IS NOT NULL THEN 'OUT_OF_SCOPE' WHEN has_success THEN 'IDEMPOTENT_SKIP' ELSE 'EXECUTE' END AS decision,
    resource_name, reason, status, request_type, scope_error, found
  FROM pj)"""

PLAN_SELECT = """
SELECT request_id, decision,
  CASE WHEN decision IN ('STATUS_NOT_APPROVED', 'IDEMPOTENT_SKIP') THEN 'SKIPPED' WHEN decision = 'OUT_OF_SCOPE' THEN 'FAILED' END AS result,
  CASE WHEN decision = 'OUT_OF_SCOPE' THEN 'OUT_OF_SCOPE' END AS error_code,
  CASE WHEN decision = 'STATUS_NOT_APPROVED' THEN 'status is ' || COALESCE(status, '') WHEN decision = 'IDEMPOTENT_SKIP' THEN 'already executed'
       WHEN decision = 'OUT_OF_SCOPE' THEN scope_error END AS reason,
  CASE WHEN found THEN (CASE WHEN upper(COALESCE(request_type, '')) = 'REVOKE' THEN 'REVOKE' ELSE 'GRANT' END) END AS action,
  resource_name AS target,
  COALESCE(strpos(reason, '[緊急]') > 0 AND decision = 'EXECUTE', FALSE) AS break_glass
FROM plan"""


@register("execution_plan", EXEC_PLAN_SQL.format(
    ids="(SELECT request_id FROM review_updates WHERE upper(trim(status)) IN ('APPROVED', '承認済'))",
    req="gated_requests") + PLAN_SELECT)
def q_execution_plan(t):
    """#82: execution gate for the ids approved on the review sheet."""
    ids = wf.normalize_reviews(t["review_updates"], "submission_id").filter(F.col("status") == "APPROVED").select("request_id")
    return wf.execution_plan(t["gated_requests"], ids, t["iam_access_change_log"], _gate_scope(t))


BINDINGS_SQL = """
b AS (SELECT DISTINCT resource_name, role, member, CASE WHEN length(member) % 9 = 0 THEN 'expiring' END AS condition FROM (
  SELECT resource_name, role, CASE WHEN principal_type = 'SERVICE_ACCOUNT' THEN 'serviceAccount:' || principal_email
    WHEN principal_type IN ('USER', 'UNKNOWN') OR principal_type IS NULL THEN
      (CASE WHEN strpos(principal_email, ':') > 0 THEN principal_email
            WHEN suffix(principal_email, 'gserviceaccount.com') THEN 'serviceAccount:' || principal_email
            ELSE 'user:' || principal_email END)
    ELSE lower(principal_type) || ':' || principal_email END AS member
  FROM iam_policy_permissions))"""

#: The changes of a key are replayed one by one: each step sees what the step before it left.
DIFF_SQL = "WITH RECURSIVE " + BINDINGS_SQL.strip() + """,
ch AS (SELECT request_id, CASE WHEN upper(COALESCE(request_type, '')) = 'REVOKE' THEN 'REVOKE' ELSE 'GRANT' END AS action,
         resource_name, role,
         CASE WHEN strpos(principal_email, ':') > 0 THEN principal_email
              WHEN suffix(principal_email, 'gserviceaccount.com') THEN 'serviceAccount:' || principal_email
              ELSE 'user:' || principal_email END AS member, approved_at
       FROM iam_access_requests WHERE status = 'APPROVED'),
turn AS (SELECT *, row_number() OVER (PARTITION BY resource_name, role, member ORDER BY approved_at NULLS FIRST, request_id) AS n FROM ch),
start AS (SELECT t.*, COALESCE(bool_or(b.condition IS NULL) FILTER (WHERE b.member IS NOT NULL), FALSE) AS plain, count(b.member) > 0 AS has_any
          FROM turn t LEFT JOIN b ON t.resource_name = b.resource_name AND t.role = b.role AND t.member = b.member
          WHERE t.n = 1 GROUP BY ALL),
replay AS (
  SELECT request_id, action, resource_name, role, member, n, plain, has_any,
    CASE WHEN action = 'GRANT' THEN NOT plain ELSE has_any END AS changed, action = 'GRANT' AS left_plain, action = 'REVOKE' AS cleared FROM start
  UNION ALL
  SELECT t.request_id, t.action, t.resource_name, t.role, t.member, t.n, r.left_plain, r.left_plain,
    CASE WHEN t.action = 'GRANT' THEN NOT r.left_plain ELSE r.left_plain END, t.action = 'GRANT', r.cleared OR t.action = 'REVOKE'
  FROM replay r JOIN turn t ON t.resource_name = r.resource_name AND t.role = r.role AND t.member = r.member AND t.n = r.n + 1
),
final AS (SELECT * FROM replay QUALIFY row_number() OVER (PARTITION BY resource_name, role, member ORDER BY n DESC) = 1)
"""


def _diff_inputs(t):
    bindings = wf.binding_rows(t["iam_policy_permissions"]).withColumn(
        "condition", F.when(F.length("member") % 9 == 0, F.lit("expiring"))).distinct()
    changes = t["iam_access_requests"].filter(F.col("status") == "APPROVED").select(
        "request_id", F.col("request_type").alias("action"), "resource_name", "role", "principal_email", "approved_at")
    return bindings, changes


def _diff(t):
    bindings, changes = _diff_inputs(t)
    return wf.policy_diff(bindings, changes), bindings


@register("policy_diff_results", DIFF_SQL + """
SELECT request_id, action, resource_name AS target, role, member, CASE WHEN changed THEN 'SUCCESS' ELSE 'SKIPPED' END AS result, changed
FROM replay""")
def q_policy_diff_results(t):
    """#83: per approved request, in order of approval: SUCCESS (policy changed) or SKIPPED (no diff)."""
    return _diff(t)[0][1]


@register("policy_diff_bindings", DIFF_SQL + """
SELECT resource_name, role, member, condition FROM b
WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.cleared AND f.resource_name = b.resource_name AND f.role = b.role AND f.member = b.member)
UNION ALL
SELECT resource_name, role, member, CAST(NULL AS VARCHAR) FROM final f WHERE left_plain AND (cleared OR NOT EXISTS (
  SELECT 1 FROM b WHERE b.condition IS NULL AND f.resource_name = b.resource_name AND f.role = b.role AND f.member = b.member))""")
def q_policy_diff_bindings(t):
    """#83: binding set after applying every approved change in order."""
    return _diff(t)[0][0]


#: Each binding as 16 numbers; a policy's hash is that of their sums.
LANE_SQL = """(SELECT * EXCLUDE (hex), CAST('0x' || substr(hex, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT) AS v
  FROM (SELECT * EXCLUDE (text), sha256('0' || text) || sha256('1' || text) AS hex
        FROM (SELECT *, CAST(to_json([role, member, COALESCE('=' || condition, '')]) AS VARCHAR) AS text FROM {rows})), range(16) r(i))"""
STATE_SQL = "state AS (SELECT resource_name, i, sum(v) AS v FROM " + LANE_SQL.format(rows="b") + " GROUP BY ALL)"

#: Per change, lane by lane: the state of its resource before it and what it adds.
CHANGE_DIGEST_SQL = STATE_SQL + """,
moves AS (
  SELECT request_id, role, member, CAST(NULL AS VARCHAR) AS condition, CASE WHEN action = 'GRANT' THEN 1 ELSE -1 END AS sgn
  FROM replay WHERE changed AND (action = 'GRANT' OR plain)
  UNION ALL
  SELECT r.request_id, r.role, r.member, b.condition, -1
  FROM replay r JOIN b ON r.resource_name = b.resource_name AND r.role = b.role AND r.member = b.member
  WHERE b.condition IS NOT NULL AND r.action = 'REVOKE'
  QUALIFY dense_rank() OVER (PARTITION BY r.resource_name, r.role, r.member ORDER BY r.n) = 1),
added AS (SELECT request_id, i, sum(sgn * v) AS v FROM """ + LANE_SQL.format(rows="moves") + """ GROUP BY ALL),
steps AS (SELECT c.request_id, c.resource_name, c.approved_at, CAST(l.i AS BIGINT) AS i, COALESCE(a.v, 0) AS v
  FROM ch c CROSS JOIN range(16) l(i) LEFT JOIN added a ON a.request_id = c.request_id AND a.i = l.i),
running AS (SELECT s.request_id, s.i, s.v, COALESCE(t.v, 0) + COALESCE(sum(s.v) OVER (
    PARTITION BY s.resource_name, s.i ORDER BY s.approved_at NULLS FIRST, s.request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS found
  FROM steps s LEFT JOIN state t ON t.resource_name = s.resource_name AND t.i = s.i),
digests AS (SELECT request_id,
    sha256(string_agg(CAST((found % 4294967296 + 4294967296) % 4294967296 AS VARCHAR), ',' ORDER BY i)) AS before_hash,
    sha256(string_agg(CAST(((found + v) % 4294967296 + 4294967296) % 4294967296 AS VARCHAR), ',' ORDER BY i)) AS after_hash
  FROM running GROUP BY request_id)
"""


@register("policy_fingerprint", "WITH " + BINDINGS_SQL.strip() + ",\n" + STATE_SQL + """
SELECT resource_name, sha256(string_agg(CAST(v % 4294967296 AS VARCHAR), ',' ORDER BY i)) AS policy_hash FROM state GROUP BY resource_name""")
def q_policy_fingerprint(t):
    """#84: order-independent digest of each resource's policy."""
    return wf.policy_fingerprint(_diff(t)[1])


@register("change_digests", DIFF_SQL.rstrip() + ",\n" + CHANGE_DIGEST_SQL + "SELECT * FROM digests")
def q_change_digests(t):
    """#84: digests of the resource's policy before and after every approved change."""
    bindings, changes = _diff_inputs(t)
    return wf.change_digests(bindings, changes)


@register("member_identifier", """
SELECT request_id, principal_email,
  CASE WHEN strpos(principal_email, ':') > 0 THEN principal_email
       WHEN suffix(principal_email, 'gserviceaccount.com') THEN 'serviceAccount:' || principal_email
       ELSE 'user:' || principal_email END AS member
FROM iam_access_requests""")
def q_member_identifier(t):
    """#85: e-mail -> IAM member string."""
    r = t["iam_access_requests"]
    return r.select("request_id", "principal_email", member_identifier(F.col("principal_email")).alias("member"))


REVOKE_SQL = """
WITH actual AS (SELECT DISTINCT principal_email, resource_name, role FROM iam_policy_permissions),
exp AS (
  SELECT r.request_id, r.principal_email, r.resource_name, r.role, r.status,
    (a.principal_email IS NOT NULL) AS active
  FROM iam_access_requests r LEFT JOIN actual a
    ON r.principal_email = a.principal_email AND r.role = a.role AND r.resource_name = a.resource_name
  WHERE r.status IN ('APPROVED', 'REVOKE_FAILED') AND r.request_type != 'REVOKE'
    AND r.expires_at IS NOT NULL AND r.expires_at < {now}),
bm AS (SELECT DISTINCT resource_name, role, CASE WHEN principal_type = 'SERVICE_ACCOUNT' THEN 'serviceAccount:' || principal_email
    WHEN principal_type IN ('USER', 'UNKNOWN') OR principal_type IS NULL THEN
      (CASE WHEN strpos(principal_email, ':') > 0 THEN principal_email
            WHEN suffix(principal_email, 'gserviceaccount.com') THEN 'serviceAccount:' || principal_email
            ELSE 'user:' || principal_email END)
    ELSE lower(principal_type) || ':' || principal_email END AS member FROM iam_policy_permissions),
act AS (
  SELECT e.request_id,
    EXISTS (SELECT 1 FROM bm WHERE bm.resource_name = e.resource_name AND bm.role = e.role AND bm.member =
      (CASE WHEN strpos(e.principal_email, ':') > 0 THEN e.principal_email
            WHEN suffix(e.principal_email, 'gserviceaccount.com') THEN 'serviceAccount:' || e.principal_email
            ELSE 'user:' || e.principal_email END))
    AND ROW_NUMBER() OVER (PARTITION BY e.resource_name, e.role,
      (CASE WHEN strpos(e.principal_email, ':') > 0 THEN e.principal_email
            WHEN suffix(e.principal_email, 'gserviceaccount.com') THEN 'serviceAccount:' || e.principal_email
            ELSE 'user:' || e.principal_email END) ORDER BY e.request_id) = 1 AS changed
  FROM exp e WHERE e.active),
d AS (
  SELECT e.*, CASE WHEN NOT e.active THEN 'SKIPPED' WHEN a.changed THEN 'SUCCESS' ELSE 'SKIPPED' END AS result,
    CASE WHEN NOT e.active THEN 'REVOKED_ALREADY_GONE' WHEN a.changed THEN 'REVOKED' ELSE 'REVOKED_ALREADY_GONE' END AS new_status
  FROM exp e LEFT JOIN act a ON e.request_id = a.request_id)
""".replace("{now}", NOW)


def _revoke(t):
    perm = t.keep(t["iam_policy_permissions"].select("resource_name", "principal_email", "principal_type", "role"))
    return wf.revoke_expired(t["iam_access_requests"], perm, wf.binding_rows(perm), AS_OF, RUN_ID, keep=t.keep)


@register("revoke_expired_log", REVOKE_SQL + f"""
SELECT '{RUN_ID}' AS execution_id, request_id, 'REVOKE' AS action, resource_name AS target, result,
  CASE WHEN NOT active THEN '{{"reason":"Already gone"}}' END AS details, {NOW} AS executed_at FROM d""".replace("{{", "{").replace("}}", "}"))
def q_revoke_expired_log(t):
    """#86: change-log rows of the expiry revocation run."""
    return _revoke(t)["log"]


@register("revoke_expired_decisions", REVOKE_SQL + """
SELECT request_id, new_status AS status, status AS old_status, '' AS reject_reason, 'SYSTEM_AUTO_REVOKE' AS actor_email,
  CASE WHEN status = new_status THEN 'SKIPPED' ELSE 'UPDATED' END AS outcome FROM d""")
def q_revoke_expired_decisions(t):
    """#86: status decisions of the expiry revocation run."""
    return _revoke(t)["decisions"]


@register("job_outcome_summary", REVOKE_SQL + """
SELECT CAST(count(*) FILTER (WHERE new_status = 'REVOKED') AS BIGINT) AS revoked,
  CAST(count(*) FILTER (WHERE new_status = 'REVOKED_ALREADY_GONE') AS BIGINT) AS skipped,
  CAST(count(*) FILTER (WHERE new_status = 'REVOKE_FAILED') AS BIGINT) AS failed,
  CASE WHEN count(*) FILTER (WHERE new_status = 'REVOKE_FAILED') > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS result FROM d""")
def q_job_outcome_summary(t):
    """#60: revoked / skipped / failed counts of the revocation run."""
    return _revoke(t)["summary"]


BULK_HEAD = REVIEW_DECISIONS_SQL.strip().replace("FROM ok LEFT JOIN iam_access_requests r", "FROM ok LEFT JOIN gated_requests r") + """,
req_after AS (SELECT r.* REPLACE (COALESCE(d.status, r.status) AS status, CASE WHEN d.status = 'APPROVED' THEN """ + NOW + """ ELSE r.approved_at END AS approved_at) FROM gated_requests r
              LEFT JOIN applied d ON r.request_id = d.request_id)"""


def _bulk_sql() -> str:
    scope_part = GATE_SCOPE_SQL[len("WITH RECURSIVE "):]
    plan_part = EXEC_PLAN_SQL.format(
        ids="(SELECT request_id FROM dec WHERE outcome = 'UPDATED' AND status = 'APPROVED')",
        req="req_after")[len(GATE_SCOPE_SQL):]
    return ("WITH RECURSIVE " + BULK_HEAD.strip() + ",\n" + scope_part + plan_part + """
SELECT request_id, status, FALSE AS succeeded, 'BATCH_REJECTED' AS error_code, batch_error AS error_message,
  CAST(NULL AS VARCHAR) AS execution_decision FROM nn WHERE batch_error IS NOT NULL
UNION ALL
SELECT d.request_id, d.status,
  (d.outcome = 'UPDATED' AND NOT COALESCE(p.decision = 'OUT_OF_SCOPE', FALSE)) AS succeeded,
  CASE WHEN d.outcome = 'SKIPPED' THEN 'SKIPPED' WHEN d.outcome = 'ERROR' THEN d.error_code
       WHEN p.decision = 'OUT_OF_SCOPE' THEN 'OUT_OF_SCOPE' END AS error_code,
  CASE WHEN d.outcome = 'SKIPPED' THEN COALESCE(d.error_code, 'skipped') WHEN d.outcome = 'ERROR' THEN d.error_message
       WHEN p.decision = 'OUT_OF_SCOPE' THEN p.scope_error END AS error_message,
  p.decision AS execution_decision
FROM dec d LEFT JOIN plan p ON d.request_id = p.request_id""")


def _bulk(t):
    return wf.bulk_review(t["review_updates"], t["gated_requests"], t["iam_access_change_log"], _gate_scope(t), AS_OF, keep=t.keep)


@register("bulk_review", _bulk_sql())
def q_bulk_review(t):
    """#87: bulk review of whole submissions: normalise, decide, gate execution."""
    return _bulk(t)


#: Approved lines run against the bindings; their outcome is that of the gate or of the replay.
def _executed_sql(select: str) -> str:
    head, lines = _bulk_sql().split("\nSELECT request_id, status, FALSE AS succeeded", 1)
    diff = DIFF_SQL[len("WITH RECURSIVE "):].replace("FROM iam_access_requests WHERE status = 'APPROVED')",
                                                    "FROM req_after WHERE request_id IN (SELECT request_id FROM plan WHERE decision = 'EXECUTE'))")
    return (head + ",\nlines AS (SELECT request_id, status, FALSE AS succeeded" + lines + "),\n" + diff.rstrip() + ",\n" + CHANGE_DIGEST_SQL.rstrip() + ",\ngate AS ("
            + PLAN_SELECT + """),
ran AS (SELECT g.*, CASE WHEN g.decision = 'EXECUTE' THEN CASE WHEN r.changed THEN 'SUCCESS' ELSE 'SKIPPED' END ELSE g.result END AS outcome
  FROM gate g LEFT JOIN replay r ON g.request_id = r.request_id WHERE g.decision <> 'NOT_FOUND')
""" + select)


def _executed(t):
    return wf.review_and_execute(t["review_updates"], t["gated_requests"], t["iam_access_change_log"], _gate_scope(t), _diff_inputs(t)[0], AS_OF, RUN_ID, keep=t.keep)


@register("bulk_review_executed", _executed_sql(f"""SELECT l.*, CASE WHEN l.execution_decision IS NOT NULL THEN x.outcome END AS execution_result,
  CASE WHEN l.execution_decision IS NOT NULL AND x.request_id IS NOT NULL THEN '{RUN_ID}' END AS execution_id
FROM lines l LEFT JOIN ran x ON l.request_id = x.request_id"""))
def q_bulk_review_executed(t):
    """#87: review lines with the outcome of their execution."""
    return _executed(t)["lines"]


@register("bulk_review_log", _executed_sql(f"""SELECT '{RUN_ID}' AS execution_id, x.request_id, x.action, x.target, x.outcome AS result, x.error_code,
  CASE WHEN x.error_code IS NOT NULL THEN x.reason END AS error_message, h.before_hash, h.after_hash, '{wf.EXECUTOR}' AS executed_by, {NOW} AS executed_at
FROM ran x LEFT JOIN digests h ON x.request_id = h.request_id"""))
def q_bulk_review_log(t):
    """#87: change-log rows of a bulk review's approved lines."""
    return _executed(t)["log"]


@register("review_outcome_summary", _bulk_sql().replace("\nSELECT request_id, status, FALSE AS succeeded", "\n, lines AS (SELECT request_id, status, FALSE AS succeeded", 1)
          + """)
SELECT CAST(count(*) FILTER (WHERE succeeded) AS BIGINT) AS succeeded,
  CAST(count(*) FILTER (WHERE NOT succeeded) AS BIGINT) AS failed,
  CASE WHEN count(*) FILTER (WHERE NOT succeeded) > 0 AND count(*) FILTER (WHERE succeeded) > 0 THEN 'PARTIAL_SUCCESS'
       WHEN count(*) FILTER (WHERE NOT succeeded) > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS result FROM lines""")
def q_review_outcome_summary(t):
    """#61: SUCCESS / PARTIAL_SUCCESS / FAILED over the bulk review lines."""
    return wf.review_outcome_summary(_bulk(t))


@register("principal_collection_outcome", """
WITH runs AS (SELECT DISTINCT CAST(occurred_at AS DATE) AS run_date FROM iam_pipeline_job_reports
              WHERE job_type = 'PRINCIPAL_COLLECTION'),
w AS (SELECT CAST(occurred_at AS DATE) AS run_date, count(*) AS n FROM iam_pipeline_job_reports
      WHERE job_type = 'PRINCIPAL_COLLECTION' AND result <> 'SUCCESS' GROUP BY 1)
SELECT r.run_date, CAST(COALESCE(w.n, 0) AS BIGINT) AS warnings,
  CASE WHEN COALESCE(w.n, 0) > 0 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS result,
  CASE WHEN COALESCE(w.n, 0) > 0 THEN 'PARTIAL_COLLECTION' END AS error_code,
  CASE WHEN COALESCE(w.n, 0) > 0 THEN 'One or more principal sources could not be collected. See details.warnings for source-level errors.' END AS error_message,
  CASE WHEN COALESCE(w.n, 0) > 0 THEN 'Verify Admin SDK / Cloud Identity / IAM permissions and enabled APIs.' END AS hint
FROM runs r LEFT JOIN w ON r.run_date = w.run_date""")
def q_principal_collection_outcome(t):
    """#62: per daily principal collection: warnings -> PARTIAL_SUCCESS."""
    rep = t["iam_pipeline_job_reports"].filter(F.col("job_type") == "PRINCIPAL_COLLECTION") \
        .withColumn("run_date", F.col("occurred_at").cast("date"))
    return wf.principal_collection_outcome(rep, rep.filter(F.col("result") != "SUCCESS"), "run_date")


@register("classify_job_failure", """
WITH e AS (
  SELECT execution_id, job_type, CAST(json_extract_string(counts, '$.k') AS INTEGER) AS k
  FROM iam_pipeline_job_reports WHERE result IN ('FAILED', 'FAILED_PERMISSION')),
x AS (SELECT execution_id, job_type,
        CASE k % 3 WHEN 0 THEN 'GcpPermissionDenied' WHEN 1 THEN 'HttpError' ELSE 'RuntimeError' END AS error_class,
        CASE WHEN k % 3 = 1 THEN 401 + k % 4 END AS http_status FROM e),
y AS (SELECT *, (error_class = 'GcpPermissionDenied' OR (error_class = 'HttpError' AND http_status IN (401, 403))) AS p FROM x)
SELECT execution_id, job_type, error_class, CASE WHEN p THEN 'FAILED_PERMISSION' ELSE 'FAILED' END AS result,
  CASE WHEN NOT p THEN 'Check Cloud Run logs for details.'
       WHEN job_type = 'RESOURCE_COLLECTION' THEN 'Grant roles/cloudasset.viewer to executor SA on managed scope and verify Cloud Asset API is enabled.'
       WHEN job_type = 'PRINCIPAL_COLLECTION' THEN 'Grant Cloud Identity / Admin SDK / IAM read permissions to executor SA and verify related APIs are enabled.'
       ELSE 'Verify IAM permissions for this collection job.' END AS hint,
  CASE WHEN p THEN 200 ELSE 500 END AS http_status
FROM y""")
def q_classify_job_failure(t):
    """#91: classify failed job runs (error class taken from the run's counters)."""
    rep = t["iam_pipeline_job_reports"].filter(F.col("result").isin("FAILED", "FAILED_PERMISSION"))
    k = F.get_json_object("counts", "$.k").cast("int")
    errors = rep.select("execution_id", "job_type",
                        F.when(k % 3 == 0, F.lit("GcpPermissionDenied")).when(k % 3 == 1, F.lit("HttpError"))
                        .otherwise(F.lit("RuntimeError")).alias("error_class"),
                        F.when(k % 3 == 1, F.lit(401) + k % 4).alias("http_status"))
    return wf.classify_job_failure(errors)

