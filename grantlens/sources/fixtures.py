"""Derived governance tables built from the TPC-H-style test tables.

Each fixture is one SQL template that runs unchanged in Spark and DuckDB, so
the Spark jobs and the DuckDB oracle read identical inputs.  Templates use
``{name}`` for table references (a DataFrame in Spark, a view or CTE name in
DuckDB), ``{{``/``}}`` for literal braces and ``$TS`` for the timestamp type
(``TIMESTAMP_NTZ`` in Spark, ``TIMESTAMP`` in DuckDB).

These builders only shape rows into the governance schemas; none of the jobs'
work happens here.
"""

from __future__ import annotations

import os
import string
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from .sinks import path_exists

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events"]

_EMAIL = ("CASE WHEN o_custkey % 5 = 0 THEN concat('sa', CAST(o_custkey AS STRING), "
          "'@p.iam.gserviceaccount.com') ELSE concat('user', CAST(o_custkey AS STRING), "
          "'@example.com') END")
_ROLE = ("CASE o_orderkey % 5 WHEN 0 THEN 'roles/viewer' WHEN 1 THEN 'roles/editor' "
         "WHEN 2 THEN 'roles/storage.admin' WHEN 3 THEN 'roles/bigquery.dataViewer' "
         "ELSE 'organizations/1/roles/opsCustom' END")

FIXTURES: dict[str, str] = {
    "iam_access_requests": f"""
SELECT concat('req-', CAST(o_orderkey AS STRING)) AS request_id,
 concat('grp-', CAST(CAST(floor(o_orderkey/4) AS BIGINT) AS STRING)) AS request_group_id,
 CASE CAST(floor(o_orderkey/5) AS BIGINT) % 6 WHEN 0 THEN 'REVOKE' WHEN 1 THEN 'CHANGE' ELSE 'GRANT' END AS request_type,
 {_EMAIL} AS principal_email,
 concat('projects/p', CAST(o_custkey % 20 AS STRING)) AS resource_name,
 {_ROLE} AS role,
 CASE WHEN o_orderpriority='1-URGENT' THEN '[緊急] incident' ELSE 'routine' END AS reason,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' DAY * CAST(200 + o_orderkey % 2000 AS INT) END AS expires_at,
 concat('req', CAST(o_custkey % 97 AS STRING), '@example.com') AS requester_email,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('boss', CAST(o_custkey % 11 AS STRING), '@example.com') END AS approver_email,
 CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'APPROVED'
  WHEN o_orderpriority='3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'REJECTED' WHEN 'O' THEN 'CANCELLED' ELSE 'REVOKED' END
  WHEN o_orderpriority='4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'PENDING' WHEN 'O' THEN 'REVOKED_ALREADY_GONE' ELSE 'REVOKE_FAILED' END
  ELSE CASE o_orderstatus WHEN 'F' THEN 'APPROVED' ELSE 'PENDING' END END AS status,
 o_orderdate AS requested_at,
 CASE WHEN o_orderpriority='2-HIGH' OR (o_orderpriority='5-LOW' AND o_orderstatus='F') THEN o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 48 AS INT) END AS approved_at,
 CASE WHEN o_orderkey % 4 = 0 THEN concat('T-', CAST(o_orderkey AS STRING)) ELSE '' END AS ticket_ref,
 o_orderdate AS created_at,
 o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 48 AS INT) AS updated_at
FROM {{orders}}""",

    "gated_requests": """
SELECT request_id, request_group_id, request_type, principal_email,
 CASE CAST(substr(request_id, 5) AS BIGINT) % 29 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'folders/7' WHEN 3 THEN 'projects/ '
  WHEN 4 THEN concat('projects/unlisted-', substr(request_id, 5)) WHEN 5 THEN 'organizations/1' ELSE resource_name END AS resource_name,
 role, reason, expires_at, requester_email, approver_email,
 CASE WHEN CAST(substr(request_id, 5) AS BIGINT) % 31 = 30 THEN NULL ELSE status END AS status,
 requested_at, approved_at, ticket_ref, created_at, updated_at
FROM {iam_access_requests}""",

    "iam_policy_permissions": f"""
SELECT 'organizations/1' AS scope, 'cloudresourcemanager.googleapis.com/Project' AS resource_type,
 concat('projects/p', CAST(o_custkey % 20 AS STRING)) AS resource_name,
 CASE WHEN o_custkey % 5 = 0 THEN 'SERVICE_ACCOUNT' ELSE 'USER' END AS principal_type,
 CASE WHEN o_orderkey % 3 = 1 THEN concat('moved', CAST(o_custkey AS STRING), '@example.com') ELSE {_EMAIL} END AS principal_email,
 {_ROLE} AS role
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
UNION ALL
SELECT 'organizations/1', 'cloudresourcemanager.googleapis.com/Project', concat('projects/p', CAST(l_partkey % 20 AS STRING)), 'USER',
 concat('ext', CAST(l_suppkey AS STRING), '@partner.example'), 'roles/owner'
FROM {{lineitem}}""",

    "iam_access_change_log": """
SELECT concat('exec-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS execution_id,
 CASE WHEN l_orderkey % 4 = 0 THEN concat('batch-', CAST(l_orderkey AS STRING)) ELSE concat('req-', CAST(l_orderkey AS STRING)) END AS request_id,
 CASE WHEN l_linestatus = 'O' THEN 'GRANT' ELSE 'REVOKE' END AS action,
 concat('projects/p', CAST(l_partkey % 20 AS STRING)) AS target,
 CASE l_returnflag WHEN 'A' THEN 'SUCCESS' WHEN 'N' THEN 'FAILED' ELSE 'SKIPPED' END AS result,
 CASE WHEN l_returnflag = 'N' THEN 'HttpError' END AS error_code,
 CASE WHEN l_returnflag = 'N' THEN 'denied' END AS error_message,
 l_shipdate AS executed_at
FROM {lineitem}""",

    "iam_access_request_history": """
SELECT concat('h0-', request_id) AS history_id, request_id, request_group_id, 'REQUESTED' AS event_type, '' AS old_status,
 CASE WHEN reason LIKE '[緊急]%' THEN 'APPROVED' ELSE 'PENDING' END AS new_status, reason AS reason_snapshot, request_type, principal_email, resource_name, role,
 requester_email, approver_email, requester_email AS acted_by, 'WEB_APP_BULK' AS actor_source, requested_at AS event_at,
 concat('{{"source":"web_app_bulk","ai_suggestion":"', role, '"}}') AS details
FROM {iam_access_requests}
UNION ALL
SELECT concat('h1-', request_id), request_id, request_group_id, 'STATUS_CHANGED', 'PENDING', status, reason, request_type, principal_email, resource_name, role,
 requester_email, approver_email, approver_email, 'SHEET_BULK_REVIEW', updated_at, '{{"note":"Bulk status update"}}'
FROM {iam_access_requests} WHERE status <> 'PENDING' AND reason NOT LIKE '[緊急]%'""",

    "iam_policy_bindings_raw_history": f"""
SELECT DISTINCT concat('snap-', CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS STRING)) AS execution_id,
 CAST(date_trunc('month', l_shipdate) AS $TS) AS assessment_timestamp, 'organizations/1' AS scope, 'cloudresourcemanager.googleapis.com/Project' AS resource_type,
 concat('projects/p', CAST(o_custkey % 20 AS STRING)) AS resource_name, CASE WHEN o_custkey % 5 = 0 THEN 'SERVICE_ACCOUNT' ELSE 'USER' END AS principal_type,
 {_EMAIL} AS principal_email, {_ROLE} AS role
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",

    "google_group_membership_history": """
SELECT DISTINCT concat('mem-', CAST(CAST(ts AS DATE) AS STRING)) AS execution_id, CAST(date_trunc('day', ts) AS $TS) AS assessed_at,
 concat(event_type, '@groups.example') AS group_email, concat('user', CAST(user_id AS STRING), '@example.com') AS member_email,
 CASE WHEN user_id % 10 = 0 THEN 'OWNER' ELSE 'MEMBER' END AS membership_type, 'cloudidentity' AS source
FROM {events}""",

    "gcp_resource_inventory": """
SELECT 'Folder' AS resource_type, concat('folders/', CAST(100 + r_regionkey AS STRING)) AS resource_id,
 CASE WHEN r_regionkey = 4 THEN 'organizations/2' ELSE 'organizations/1' END AS parent_resource_id
FROM {region}
UNION ALL
SELECT 'Folder', concat('folders/', CAST(1000 + n_nationkey AS STRING)),
 CASE WHEN n_nationkey % 11 = 10 THEN NULL ELSE concat('folders/', CAST(100 + n_regionkey AS STRING)) END
FROM {nation}
UNION ALL
SELECT 'Project', concat('projects/p', CAST(s_suppkey AS STRING)), concat('folders/', CAST(1000 + s_nationkey AS STRING)) FROM {supplier}""",

    "iam_pipeline_job_reports": """
SELECT concat('job-', CAST(event_id AS STRING)) AS execution_id,
 CASE event_type WHEN 'click' THEN 'RESOURCE_COLLECTION' WHEN 'view' THEN 'PRINCIPAL_COLLECTION' WHEN 'signup' THEN 'IAM_POLICY_COLLECTION' WHEN 'purchase' THEN 'IAM_RECONCILIATION' ELSE 'EXPIRED_PERMISSION_REVOCATION' END AS job_type,
 CASE event_id % 20 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'FAILED_PERMISSION' WHEN 2 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS result,
 props AS counts, ts AS occurred_at
FROM {events}""",

    "principal_feed": """
SELECT concat('user', CAST(c_custkey AS STRING), '@example.com') AS principal_email, c_name AS principal_name, 'USER' AS principal_type FROM {customer}
UNION ALL SELECT concat('user', CAST(c_custkey AS STRING), '@example.com'), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {customer} WHERE c_custkey % 7 = 0
UNION ALL SELECT concat('user', CAST(c_custkey AS STRING), '@example.com'), concat(c_name, ' (robot)'), 'SERVICE_ACCOUNT' FROM {customer} WHERE c_custkey % 11 = 0
UNION ALL SELECT concat('grp', CAST(s_suppkey AS STRING), '@groups.example'), s_name, 'GROUP' FROM {supplier}
UNION ALL SELECT '', 'blank', 'USER' FROM {region}""",

    "principal_catalog": """
SELECT concat('user', CAST(c_custkey AS STRING), '@example.com') AS principal_email, 'old name' AS principal_name, 'USER' AS principal_type,
 CASE WHEN c_custkey % 2 = 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS principal_status,
 CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST('2000-01-01 00:00:00' AS $TS) END AS deactivated_at
FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT concat('gone', CAST(s_suppkey AS STRING), '@example.com'), 'left', 'USER', CASE WHEN s_suppkey % 4 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END,
 CASE WHEN s_suppkey % 4 = 0 THEN CAST('2000-01-01 00:00:00' AS $TS) END
FROM {supplier}""",

    "iam_role_master": """
SELECT role AS role_id, max(CASE role WHEN 'roles/viewer' THEN '閲覧者' WHEN 'roles/editor' THEN '編集者' END) AS role_name_ja,
 max(CASE WHEN role = 'roles/viewer' THEN TRUE ELSE FALSE END) AS is_auto_translated
FROM {iam_access_requests} WHERE role IN ('roles/viewer', 'roles/editor', 'roles/storage.admin') GROUP BY role""",

    "iam_status_master": """
SELECT CASE status WHEN 'PENDING' THEN '申請中' WHEN 'APPROVED' THEN '承認済' WHEN 'REJECTED' THEN '却下' WHEN 'CANCELLED' THEN '取消'
  WHEN 'REVOKED' THEN '削除済' WHEN 'REVOKED_ALREADY_GONE' THEN '削除済(手動)' ELSE '剥奪失敗' END AS status_ja, status AS status_code,
 CASE status WHEN 'PENDING' THEN 10 WHEN 'APPROVED' THEN 20 WHEN 'REJECTED' THEN 30 WHEN 'CANCELLED' THEN 40
  WHEN 'REVOKED' THEN 50 WHEN 'REVOKED_ALREADY_GONE' THEN 60 ELSE 70 END AS sort_order, TRUE AS is_active
FROM {iam_access_requests} GROUP BY status""",

    "open_issues": """
SELECT DISTINCT 'UNMANAGED_BINDING' AS issue_type, principal_email, resource_name, role, CASE WHEN length(principal_email) % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status
FROM {iam_policy_permissions} WHERE role = 'roles/owner'""",

    "review_updates": """
SELECT concat('req-', CAST(o_orderkey AS STRING)) AS request_id,
 CASE WHEN o_orderkey % 401 = 0 THEN '' WHEN o_orderkey % 907 = 0 THEN 'HOLD' ELSE
  CASE (o_orderkey + o_custkey) % 8 WHEN 0 THEN 'APPROVED' WHEN 1 THEN '承認済' WHEN 2 THEN 'REJECTED' WHEN 3 THEN '却下'
   WHEN 4 THEN 'cancelled' WHEN 5 THEN 'PENDING' WHEN 6 THEN '取消' ELSE 'APPROVED' END END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN 'policy' ELSE '' END AS reject_reason,
 CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE concat('BOSS', CAST(o_custkey % 11 % 9 AS STRING), '@example.com') END AS actor_email,
 CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE concat('sub-', CAST(CAST(floor(o_orderkey/32) AS BIGINT) AS STRING)) END AS submission_id,
 CAST(1 AS BIGINT) AS seq
FROM {orders}
UNION ALL
SELECT concat('req-', CAST(o_orderkey AS STRING)), 'CANCELLED', '', concat('boss', CAST(o_custkey % 11 AS STRING), '@example.com'),
 CASE WHEN o_orderkey % 5 = 0 THEN 'late' ELSE concat('sub-', CAST(CAST(floor(o_orderkey/32) AS BIGINT) AS STRING)) END, CAST(2 AS BIGINT)
FROM {orders} WHERE o_orderstatus = 'F'
UNION ALL SELECT concat('missing-', CAST(s_suppkey AS STRING)), 'APPROVED', '', 'BOSS1@example.com', 'sub-missing', CAST(s_suppkey AS BIGINT) FROM {supplier}
UNION ALL SELECT '', 'APPROVED', '', 'BOSS1@example.com', CASE WHEN r_regionkey > 2 THEN 'sub-missing' ELSE 'sub-blank' END, CAST(r_regionkey AS BIGINT) FROM {region}""",

    "intake_batch": """
SELECT CASE WHEN o_orderkey % 331 = 0 THEN NULL ELSE concat('grp-in-', CAST(CAST(floor(o_orderkey/8) AS BIGINT) AS STRING)) END AS request_group_id,
 concat('in-', CAST(o_orderkey AS STRING)) AS request_id,
 CASE (o_orderkey + o_custkey) % 4 WHEN 0 THEN '新規付与' WHEN 1 THEN '変更' WHEN 2 THEN '削除' ELSE '緊急付与' END AS request_type_raw,
 concat(' user', CAST(o_custkey AS STRING), '@example.com ') AS principal,
 CASE WHEN o_custkey % 2 = 0 THEN concat('p', CAST(o_custkey % 20 AS STRING)) ELSE concat('folders/', CAST(o_custkey AS STRING)) END AS resource,
 CASE WHEN o_custkey % 97 = 0 THEN 'Viewer' ELSE 'roles/viewer' END AS role,
 CASE (o_orderkey + o_custkey) % 5 WHEN 0 THEN '恒久' WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 2 THEN '31/12/2001'
  WHEN 3 THEN concat(CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING), '-', CAST(day(o_orderdate) AS STRING)) ELSE 'permanent' END AS expires_raw,
 'need access' AS reason, o_orderdate AS requested_at
FROM {orders}""",
}


def _deps(template: str) -> list[str]:
    return [f[1] for f in string.Formatter().parse(template) if f[1]]


def dependencies(name: str) -> list[str]:
    """Direct table references of a fixture template."""
    return _deps(FIXTURES[name])


def _dialect(template: str, spark: bool) -> str:
    return template.replace("$TS", "TIMESTAMP_NTZ" if spark else "TIMESTAMP")


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class TableSet:
    """Lazily builds fixture DataFrames for one scale-factor directory.

    With ``stored`` set, fixtures are read from parquet folders written by
    :func:`materialize` (the layout a deployment would keep) instead of being
    derived on the fly.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.stored = stored
        self._cache: dict[str, DataFrame] = {}
        self.stored_once: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._build(name)
        return self._cache[name]

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written to the shared folder and read back: a step that several parts of a query take is run once."""
        path = scratch_path(self.spark, f"kept-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return base_table(self.spark, self.sf_dir, name)
        if self.stored is not None and path_exists(self.spark, os.path.join(self.stored, name)):
            return self.spark.read.parquet(os.path.join(self.stored, name))
        template = FIXTURES[name]
        refs = {dep: self[dep] for dep in _deps(template)}
        return self.spark.sql(_dialect(template, spark=True), **refs)


def materialize(spark: SparkSession, sf_dir: str, out_dir: str,
                names: list[str] | None = None) -> str:
    """Write the derived tables once as parquet, as a deployment would store them."""
    tables = TableSet(spark, sf_dir)
    for name in names or list(FIXTURES):
        tables[name].write.mode("overwrite").parquet(os.path.join(out_dir, name))
    return out_dir


def duckdb_ctes(names: list[str]) -> str:
    """``WITH`` clause defining the named fixtures (and their dependencies) for DuckDB."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in ordered:
            return
        for d in _deps(FIXTURES[n]):
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in ordered:
        body = _dialect(FIXTURES[n], spark=False)
        body = body.format(**{d: d for d in _deps(FIXTURES[n])})
        parts.append(f"{n} AS ({body.strip()}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
