"""Fixed values that must equal the reference's for identical results.

FIXED VALUES (taken as they are; do not reorder or re-encode):

Request states: PENDING, APPROVED, REJECTED, CANCELLED, REVOKED,
REVOKED_ALREADY_GONE, REVOKE_FAILED.
Execution results: SUCCESS, FAILED, SKIPPED, FAILED_PERMISSION.
Request types: GRANT, CHANGE, REVOKE.
Issue types: APPROVED_NOT_APPLIED, REJECTED_BUT_EXISTS, EXPIRED_BUT_EXISTS,
UNMANAGED_BINDING, REVOKE_NOT_APPLIED.
Status master (status_ja, status_code, description, sort_order):
  申請中 PENDING 申請直後の承認待ち状態 10
  承認済 APPROVED 承認され権限が付与された状態 20
  却下 REJECTED 承認者により拒否された状態 30
  取消 CANCELLED 申請者により取り消された状態 40
  削除済 REVOKED 期間満了等で自動剥奪された状態 50
  削除済(手動) REVOKED_ALREADY_GONE 剥奪前にGCPから手動削除されていた状態 60
  剥奪失敗 REVOKE_FAILED 自動剥奪に失敗した状態 70
Review labels accepted by bulk review: 申請中 PENDING, 承認済 APPROVED,
  却下 REJECTED, 取消 CANCELLED.
Request-type labels: 新規付与 GRANT, 変更 CHANGE, 削除 REVOKE, 緊急付与 (emergency GRANT).
Emergency markers: 緊急, EMERGENCY; reason prefix "[緊急] ".
Permanent markers: 恒久, PERMANENT.
Reflection verdicts: 未実行 (no run), 未確認 (unverified), 反映済み (reflected),
  未反映 (not reflected).
Outside-system label for issues without a request: （システム管理外）.
Role types: 事前定義 (predefined), カスタム (custom).
Known resource prefixes: projects/, folders/, organizations/.
Principal type priority: SERVICE_ACCOUNT 1, USER 2, GROUP 3, other 9.
Log markers: [BREAK-GLASS], [RECONCILIATION_ISSUE_DETECTED].
Permission hints:
  RESOURCE_COLLECTION: Grant roles/cloudasset.viewer to executor SA on managed
    scope and verify Cloud Asset API is enabled.
  PRINCIPAL_COLLECTION: Grant Cloud Identity / Admin SDK / IAM read permissions
    to executor SA and verify related APIs are enabled.
  other: Verify IAM permissions for this collection job.
  non-permission failure: Check Cloud Run logs for details.
"""

# --- fixed values -----------------------------------------------------------
PENDING = "PENDING"
APPROVED = "APPROVED"
REJECTED = "REJECTED"
CANCELLED = "CANCELLED"
REVOKED = "REVOKED"
REVOKED_ALREADY_GONE = "REVOKED_ALREADY_GONE"
REVOKE_FAILED = "REVOKE_FAILED"

SUCCESS = "SUCCESS"
FAILED = "FAILED"
SKIPPED = "SKIPPED"
FAILED_PERMISSION = "FAILED_PERMISSION"
PARTIAL_SUCCESS = "PARTIAL_SUCCESS"

GRANT = "GRANT"
CHANGE = "CHANGE"
REVOKE = "REVOKE"

APPROVED_NOT_APPLIED = "APPROVED_NOT_APPLIED"
REJECTED_BUT_EXISTS = "REJECTED_BUT_EXISTS"
EXPIRED_BUT_EXISTS = "EXPIRED_BUT_EXISTS"
UNMANAGED_BINDING = "UNMANAGED_BINDING"
REVOKE_NOT_APPLIED = "REVOKE_NOT_APPLIED"

STATUS_MASTER_SEED = [
    ("申請中", "PENDING", "申請直後の承認待ち状態", 10),
    ("承認済", "APPROVED", "承認され権限が付与された状態", 20),
    ("却下", "REJECTED", "承認者により拒否された状態", 30),
    ("取消", "CANCELLED", "申請者により取り消された状態", 40),
    ("削除済", "REVOKED", "期間満了等で自動剥奪された状態", 50),
    ("削除済(手動)", "REVOKED_ALREADY_GONE", "剥奪前にGCPから手動削除されていた状態", 60),
    ("剥奪失敗", "REVOKE_FAILED", "自動剥奪に失敗した状態", 70),
]

REVIEW_LABELS = [("申請中", "PENDING"), ("承認済", "APPROVED"), ("却下", "REJECTED"), ("取消", "CANCELLED")]
REVIEWABLE_STATUSES = ["PENDING", "APPROVED", "REJECTED", "CANCELLED"]

TYPE_LABEL_GRANT = "新規付与"
TYPE_LABEL_CHANGE = "変更"
TYPE_LABEL_REVOKE = "削除"
EMERGENCY_MARK_JA = "緊急"
EMERGENCY_MARK_EN = "EMERGENCY"
EMERGENCY_REASON_PREFIX = "[緊急]"
PERMANENT_JA = "恒久"
PERMANENT_EN = "PERMANENT"

NOT_RUN = "未実行"
UNVERIFIED = "未確認"
REFLECTED = "反映済み"
NOT_REFLECTED = "未反映"
OUTSIDE_SYSTEM = "（システム管理外）"

ROLE_TYPE_PREDEFINED = "事前定義"
ROLE_TYPE_CUSTOM = "カスタム"

RESOURCE_PREFIXES = ["projects/", "folders/", "organizations/"]
PRINCIPAL_TYPE_PRIORITY = [("SERVICE_ACCOUNT", 1), ("USER", 2), ("GROUP", 3)]
PRINCIPAL_TYPE_OTHER = 9

BREAK_GLASS_MARK = "[BREAK-GLASS]"
RECONCILE_MARK = "[RECONCILIATION_ISSUE_DETECTED]"

HINT_RESOURCE = ("Grant roles/cloudasset.viewer to executor SA on managed scope "
                 "and verify Cloud Asset API is enabled.")
HINT_PRINCIPAL = ("Grant Cloud Identity / Admin SDK / IAM read permissions to "
                  "executor SA and verify related APIs are enabled.")
HINT_OTHER = "Verify IAM permissions for this collection job."
HINT_GENERIC = "Check Cloud Run logs for details."
# --- end of fixed values ----------------------------------------------------

ISSUE_OPEN = "OPEN"
ISSUE_CLOSED = "CLOSED"
PARTIAL_COLLECTION_MESSAGE = ("One or more principal sources could not be collected. "
                              "See details.warnings for source-level errors.")
PARTIAL_COLLECTION_HINT = "Verify Admin SDK / Cloud Identity / IAM permissions and enabled APIs."

#: Reason of a refusal where the scope table says nothing about the resource.
SCOPE_UNKNOWN = "scope is not known for resource: "
