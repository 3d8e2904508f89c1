"""Registered master-maintenance queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masters as ms
from ..operators import reports as rp
from .reconcile_views import NOW
from .registry import AS_OF, register

DEDUPE_SQL = """
ded AS (
  SELECT principal_email,
    arg_max(NULLIF(principal_name, ''), (length(NULLIF(principal_name, '')), NULLIF(principal_name, '')))
      FILTER (WHERE NULLIF(principal_name, '') IS NOT NULL) AS principal_name,
    arg_min(principal_type, (CASE principal_type WHEN 'SERVICE_ACCOUNT' THEN 1 WHEN 'USER' THEN 2
                                                 WHEN 'GROUP' THEN 3 ELSE 9 END, principal_type))
      FILTER (WHERE principal_type IS NOT NULL) AS principal_type
  FROM principal_feed WHERE principal_email IS NOT NULL AND principal_email <> ''
  GROUP BY principal_email
)"""


def _merge_sql(source: str, complete: bool) -> str:
    deact = "TRUE" if complete else "FALSE"
    return f"""
j AS (
  SELECT COALESCE(c.principal_email, s.principal_email) AS principal_email,
    c.principal_name AS c_name, c.principal_type AS c_type, c.principal_status AS c_status,
    c.deactivated_at AS c_deact, CAST(NULL AS TIMESTAMP) AS c_upd, c.principal_email IS NOT NULL AS in_cat,
    s.principal_name AS s_name, s.principal_type AS s_type, s.principal_email IS NOT NULL AS in_src
  FROM principal_catalog c FULL OUTER JOIN {source} s ON c.principal_email = s.principal_email
), k AS (SELECT *, (in_cat AND NOT in_src AND c_status = 'ACTIVE' AND {deact}) AS gone FROM j)
SELECT principal_email,
  CASE WHEN in_src THEN COALESCE(s_name, c_name) ELSE c_name END AS principal_name,
  CASE WHEN in_src THEN COALESCE(s_type, c_type) ELSE c_type END AS principal_type,
  CASE WHEN in_src THEN 'ACTIVE' WHEN gone THEN 'INACTIVE' ELSE c_status END AS principal_status,
  CASE WHEN in_src THEN NULL WHEN gone THEN COALESCE(c_deact, {NOW}) ELSE c_deact END AS deactivated_at,
  CASE WHEN in_src OR gone THEN {NOW} ELSE c_upd END AS updated_at,
  (in_src OR gone) AS affected
FROM k"""


@register("principal_types_from_permissions", """
SELECT principal_email, max(principal_type) AS principal_type FROM iam_policy_permissions
WHERE principal_email IS NOT NULL AND principal_email <> '' GROUP BY principal_email""")
def q_principal_types_from_permissions(t):
    """#53: MAX(principal_type) per e-mail."""
    return ms.principal_types_from_permissions(t["iam_policy_permissions"])


@register("principal_type_any", """
SELECT principal_email, max(principal_type) AS principal_type FROM iam_policy_permissions GROUP BY principal_email""")
def q_principal_type_any(t):
    """#54: one type per e-mail."""
    return ms.principal_type_any(t["iam_policy_permissions"])


@register("dedupe_principals", "WITH " + DEDUPE_SQL.strip() + " SELECT * FROM ded")
def q_dedupe_principals(t):
    """#55: longest name and highest-priority type per e-mail."""
    return ms.dedupe_principals(t["principal_feed"])


@register("merge_principals", "WITH " + DEDUPE_SQL.strip() + "," + _merge_sql("ded", True))
def q_merge_principals(t):
    """#70 + #71: MERGE the collected principals; complete collection deactivates the missing."""
    return ms.merge_principals(t["principal_catalog"], ms.dedupe_principals(t["principal_feed"]), AS_OF,
                               complete=True)


@register("merge_principals_partial", "WITH " + DEDUPE_SQL.strip() + "," + _merge_sql("ded", False))
def q_merge_principals_partial(t):
    """#71 guard: a partial collection merges but never deactivates."""
    return ms.merge_principals(t["principal_catalog"], ms.dedupe_principals(t["principal_feed"]), AS_OF,
                               complete=False)


@register("merge_principals_from_permissions", """
WITH src AS (SELECT principal_email, CAST(NULL AS VARCHAR) AS principal_name, max(principal_type) AS principal_type
             FROM iam_policy_permissions WHERE principal_email IS NOT NULL AND principal_email <> ''
             GROUP BY principal_email),""" + _merge_sql("src", False))
def q_merge_principals_from_permissions(t):
    """#69: seed the catalog from the e-mails seen in bindings."""
    return ms.merge_principals(t["principal_catalog"], ms.principal_types_from_permissions(t["iam_policy_permissions"]),
                               AS_OF, complete=False)


SEED_VALUES = """(VALUES ('申請中','PENDING','申請直後の承認待ち状態',10),('承認済','APPROVED','承認され権限が付与された状態',20),
('却下','REJECTED','承認者により拒否された状態',30),('取消','CANCELLED','申請者により取り消された状態',40),
('削除済','REVOKED','期間満了等で自動剥奪された状態',50),('削除済(手動)','REVOKED_ALREADY_GONE','剥奪前にGCPから手動削除されていた状態',60),
('剥奪失敗','REVOKE_FAILED','自動剥奪に失敗した状態',70)) AS s(status_ja, status_code, description, sort_order)"""


@register("merge_status_master", f"""
SELECT COALESCE(m.status_ja, s.status_ja) AS status_ja,
  CASE WHEN s.status_ja IS NOT NULL THEN s.status_code ELSE m.status_code END AS status_code,
  CASE WHEN s.status_ja IS NOT NULL THEN s.description ELSE CAST(NULL AS VARCHAR) END AS description,
  CASE WHEN s.status_ja IS NOT NULL THEN s.sort_order ELSE m.sort_order END AS sort_order,
  CASE WHEN s.status_ja IS NOT NULL THEN TRUE ELSE m.is_active END AS is_active,
  CASE WHEN s.status_ja IS NOT NULL THEN {NOW} END AS updated_at
FROM iam_status_master m FULL OUTER JOIN {SEED_VALUES} ON m.status_ja = s.status_ja""")
def q_merge_status_master(t):
    """#67 + #68: MERGE the seed into the status master."""
    spark = t.spark
    return ms.merge_status_master(t["iam_status_master"], ms.status_master_seed(spark), AS_OF)


def _translations(t):
    """Stand-in for the translator's output: predefined roles get a name, custom roles none."""
    perm = t["iam_policy_permissions"]
    return (perm.select("role").filter(F.col("role").startswith("roles/")).distinct()
            .select(F.col("role").alias("role_id"),
                    F.concat(F.lit("ロール:"), F.regexp_replace("role", "^roles/", "")).alias("role_name_ja")))


@register("register_roles", f"""
WITH unknown AS (SELECT DISTINCT role FROM iam_policy_permissions p
                 WHERE role IS NOT NULL AND role <> ''
                   AND NOT EXISTS (SELECT 1 FROM iam_role_master m WHERE m.role_id = p.role)),
tr AS (SELECT DISTINCT role AS role_id, 'ロール:' || regexp_replace(role, '^roles/', '') AS role_name_ja
       FROM iam_policy_permissions WHERE starts_with(role, 'roles/'))
SELECT u.role AS role_id, tr.role_name_ja, tr.role_name_ja IS NOT NULL AS is_auto_translated, {NOW} AS updated_at
FROM unknown u LEFT JOIN tr ON u.role = tr.role_id""")
def q_register_roles(t):
    """#88: register unknown roles with their translations."""
    return ms.register_roles(rp.unknown_roles(t["iam_policy_permissions"], t["iam_role_master"]),
                             _translations(t), AS_OF)


@register("correct_role_name", f"""
SELECT m.role_id,
  CASE WHEN c.role_id IS NOT NULL THEN c.fix ELSE m.role_name_ja END AS role_name_ja,
  CASE WHEN c.role_id IS NOT NULL THEN FALSE ELSE m.is_auto_translated END AS is_auto_translated,
  CASE WHEN c.role_id IS NOT NULL THEN {NOW} END AS updated_at
FROM iam_role_master m
LEFT JOIN (SELECT role_id, role_name_ja || '（確認済）' AS fix FROM iam_role_master WHERE is_auto_translated) c
  ON m.role_id = c.role_id""")
def q_correct_role_name(t):
    """#89: reviewed names replace auto translations."""
    rm = t["iam_role_master"]
    fixes = rm.filter(F.col("is_auto_translated")).select(
        "role_id", F.concat(F.col("role_name_ja"), F.lit("（確認済）")).alias("role_name_ja"))
    return ms.correct_role_name(rm, fixes, AS_OF)
