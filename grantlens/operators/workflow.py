"""Bulk workflow decisions (#60-62, #78-87, #91).

Where the reference loops over rows in Python (review cascade, execution
gating, policy edits), each step here is a join plus an ordered ``when``
cascade over the whole batch: first matching rule wins, exactly as the loop's
``continue`` chain.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import member_identifier, normalize_action, stable_id, ts
from .digests import LANES, lane_hash, lane_sums, policy_fingerprint, policy_states, with_lanes  # noqa: F401
from .latest import has_success_execution
from .prefix import before
from .reconcile import expired_grants
from .skew import SMALL_BYTES, split_join

SYSTEM_BATCH = "SYSTEM_BATCH"


# --- review --------------------------------------------------------------------

def normalize_reviews(raw: DataFrame, batch_col: str | None = None) -> DataFrame:
    """#79: sheet labels / codes -> status code; an unknown status rejects its whole batch.

    Adds ``status`` (normalised), ``batch_error`` (NULL when the batch is valid).
    """
    label = F.trim(F.coalesce(F.col("status"), F.lit("")))
    mapped = None
    for ja, code in K.REVIEW_LABELS:
        mapped = F.when(label == ja, F.lit(code)) if mapped is None else mapped.when(label == ja, F.lit(code))
    status = mapped.otherwise(F.upper(label))
    df = raw.withColumn("status_raw", label).withColumn("status", status) \
        .withColumn("request_id", F.trim(F.coalesce(F.col("request_id"), F.lit("")))) \
        .withColumn("reject_reason", F.trim(F.coalesce(F.col("reject_reason"), F.lit(""))))
    bad = F.when(~F.col("status").isin(*K.REVIEWABLE_STATUSES), F.concat(F.lit("invalid status: "), F.col("status_raw")))
    df = df.withColumn("_bad", bad)
    if batch_col is None:
        # one batch: a one-row global aggregate (partial, map-side), broadcast back
        errs = df.agg(F.min("_bad").alias("batch_error")).withColumn("_b", F.lit(0))
        return df.withColumn("_b", F.lit(0)).join(F.broadcast(errs), "_b", "left").drop("_bad", "_b")
    df = df.withColumn("_batch", _batch_key(batch_col))
    errs = df.filter(F.col("_bad").isNotNull()).groupBy("_batch").agg(F.min("_bad").alias("batch_error"))
    return split_join(df, errs, ["_batch"]).drop("_bad", "_batch")


def _batch_key(batch_col: str) -> Column:
    """A batch as a key that joins: null is a batch like any other.  One batch may hold a large share of all lines."""
    return F.concat(F.lit("b"), F.coalesce(F.concat(F.lit("="), F.col(batch_col).cast("string")), F.lit("")))


def review_decisions(updates: DataFrame, req: DataFrame, actor_source: str = "SHEET_BULK_REVIEW",
                     batch_col: str | None = None) -> DataFrame:
    """#78: each update -> UPDATED / SKIPPED / ERROR with the reference's error codes.

    ``updates``: request_id, status, reject_reason, actor_email[, seq][, batch_col].
    Rule order: missing id, missing status, NOT_FOUND, NO_STATUS_CHANGE,
    MISSING_REJECT_REASON, MISSING_APPROVER, FORBIDDEN, update.  A batch
    without any request id yields no rows.  Duplicate ids: only the first
    (smallest ``seq``) update applies; later ones are SKIPPED as DUPLICATE.
    """
    u = updates.select(
        "*",
        F.trim(F.coalesce(F.col("request_id"), F.lit(""))).alias("_id"),
        F.upper(F.trim(F.coalesce(F.col("status"), F.lit("")))).alias("_new"),
        F.trim(F.coalesce(F.col("reject_reason"), F.lit(""))).alias("_rr"))
    if "seq" not in u.columns:
        u = u.withColumn("seq", F.lit(0).cast("long"))
    batch_key = [batch_col] if batch_col else []
    if batch_col:
        u = u.withColumn("_batch", _batch_key(batch_col))
        has_id = u.filter(F.col("_id") != "").select("_batch").distinct()
        u = split_join(u, has_id, ["_batch"], "inner").drop("_batch")
    snap = req.select(F.col("request_id").alias("_id"), F.col("status").alias("_old"),
                      F.col("approver_email").alias("_approver"), F.lit(True).alias("_found"))
    j = u.join(snap, "_id", "left")
    approver = F.trim(F.coalesce(F.col("_approver"), F.lit("")))
    actor = F.coalesce(F.col("actor_email"), F.lit(""))
    gated = F.col("_new").isin(K.APPROVED, K.REJECTED) & F.lit(actor_source != SYSTEM_BATCH)
    code = (F.when(F.col("_id") == "", F.lit("INVALID_REQUEST_ID"))
            .when(F.col("_new") == "", F.lit("INVALID_STATUS"))
            .when(F.col("_found").isNull(), F.lit("NOT_FOUND"))
            .when(F.coalesce(F.col("_old"), F.lit("")) == F.col("_new"), F.lit("NO_STATUS_CHANGE"))
            .when((F.col("_new") == K.REJECTED) & (F.col("_rr") == ""), F.lit("MISSING_REJECT_REASON"))
            .when(gated & (approver == ""), F.lit("MISSING_APPROVER"))
            .when(gated & (F.lower(actor) != F.lower(approver)), F.lit("FORBIDDEN")))
    message = (F.when(code == "INVALID_REQUEST_ID", F.lit("request_id is required"))
               .when(code == "INVALID_STATUS", F.lit("status is required"))
               .when(code == "NOT_FOUND", F.concat(F.lit("request_id not found: "), F.col("_id")))
               .when(code == "MISSING_REJECT_REASON", F.lit("reject_reason is required when status is REJECTED"))
               .when(code == "MISSING_APPROVER",
                     F.lit("approver_email is empty. Cannot approve or reject without an assigned approver."))
               .when(code == "FORBIDDEN", F.lit("only approver can set APPROVED/REJECTED")))
    d = j.withColumn("error_code", code).withColumn("error_message", message)
    d = d.withColumn("outcome", F.when(F.col("error_code").isNull(), F.lit("UPDATED"))
                     .when(F.col("error_code") == "NO_STATUS_CHANGE", F.lit("SKIPPED"))
                     .otherwise(F.lit("ERROR")))
    # keep-first for duplicate ids among the updates of one batch; other outcomes need no window
    first = Window.partitionBy(*batch_key, "_id").orderBy(F.col("seq").asc(), F.col("_new").asc(), F.col("_rr").asc(), actor.asc())
    updated = d.filter(F.col("outcome") == "UPDATED").withColumn("_rank", F.row_number().over(first))
    dup = F.col("_rank") > 1
    updated = (updated.withColumn("outcome", F.when(dup, F.lit("SKIPPED")).otherwise(F.col("outcome")))
               .withColumn("error_code", F.when(dup, F.lit("DUPLICATE_IN_BATCH")).otherwise(F.col("error_code"))).drop("_rank"))
    d = updated.unionByName(d.filter(F.col("outcome") != "UPDATED"))
    own = {"request_id", "status", "old_status", "reject_reason", "actor_email", "outcome", "error_code", "error_message", "seq"}
    keep = [batch_col] if batch_col and batch_col not in own else []
    return d.select(*keep, F.col("_id").alias("request_id"), F.col("_new").alias("status"),
                    F.col("_old").alias("old_status"), F.col("_rr").alias("reject_reason"),
                    F.col("actor_email"), "seq", "outcome", "error_code", "error_message")


def applied_updates(decisions: DataFrame) -> DataFrame:
    """The one update per request that counts: of several batches the first by (seq, status, reason, actor).

    Both #80 and #81 use it, so the stored status and the logged event always agree."""
    upd = decisions.filter(F.col("outcome") == "UPDATED")
    order = [F.col("seq")] if "seq" in decisions.columns else []
    first = Window.partitionBy("request_id").orderBy(*order, "status", "reject_reason", "actor_email")
    return upd.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") == 1).drop("_nth")


def apply_status_updates(req: DataFrame, decisions: DataFrame, as_of: str | _dt.datetime) -> DataFrame:
    """#80: new request table: status, updated_at and (for APPROVED) approved_at = as_of."""
    delta = applied_updates(decisions).select("request_id", F.col("status").alias("_new"))
    j = req.join(delta, "request_id", "left")
    hit = F.col("_new").isNotNull()
    now = ts(as_of)
    cols = []
    for c in req.columns:
        if c == "status":
            cols.append(F.when(hit, F.col("_new")).otherwise(F.col("status")).alias("status"))
        elif c == "updated_at":
            cols.append(F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"))
        elif c == "approved_at":
            cols.append(F.when(hit & (F.col("_new") == K.APPROVED), now).otherwise(F.col("approved_at"))
                        .alias("approved_at"))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def status_change_events(req: DataFrame, decisions: DataFrame, as_of: str | _dt.datetime,
                         actor_source: str = "SHEET_BULK_REVIEW") -> DataFrame:
    """#81: one STATUS_CHANGED history row per applied update (deterministic history_id)."""
    upd = applied_updates(decisions).select(
        "request_id", F.col("status").alias("new_status"), "old_status", "reject_reason", "actor_email")
    r = req.select("request_id", "request_group_id", "reason", "request_type", "principal_email", "resource_name",
                   "role", "requester_email", "approver_email")
    j = upd.join(r, "request_id", "inner")
    details = F.to_json(F.struct(F.lit("Bulk status update").alias("note"),
                                 F.when(F.col("reject_reason") != "", F.col("reject_reason")).alias("reject_reason")))
    return j.select(
        stable_id(F.col("request_id"), F.lit("STATUS_CHANGED"), F.col("new_status"), ts(as_of)).alias("history_id"),
        "request_id", "request_group_id", F.lit("STATUS_CHANGED").alias("event_type"),
        F.coalesce(F.col("old_status"), F.lit("")).alias("old_status"), "new_status",
        F.coalesce(F.col("reason"), F.lit("")).alias("reason_snapshot"),
        F.coalesce(F.col("request_type"), F.lit("")).alias("request_type"),
        F.coalesce(F.col("principal_email"), F.lit("")).alias("principal_email"),
        F.coalesce(F.col("resource_name"), F.lit("")).alias("resource_name"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("requester_email"), F.lit("")).alias("requester_email"),
        F.coalesce(F.col("approver_email"), F.lit("")).alias("approver_email"),
        F.col("actor_email").alias("acted_by"), F.lit(actor_source).alias("actor_source"),
        ts(as_of).alias("event_at"), details.alias("details"))


# --- execution ------------------------------------------------------------------

def execution_plan(req: DataFrame, ids: DataFrame, log: DataFrame, scope: DataFrame) -> DataFrame:
    """#82: gate each id: NOT_FOUND -> not approved (SKIPPED) -> out of scope (FAILED)
    -> already executed (SKIPPED) -> EXECUTE.

    ``scope`` is the output of :func:`grantlens.operators.scope.scope_check`.
    The gate fails closed: a request runs only where its status is APPROVED
    and its resource is listed as in scope.  A null status is not approved; a
    resource that is null, blank or not listed is out of scope.
    """
    keys = ids.select(F.trim(F.col("request_id")).alias("request_id")).filter(F.col("request_id") != "").distinct()
    r = req.select("request_id", "request_type", "status", "resource_name", "reason", "principal_email", "role",
                   F.lit(True).alias("_found"))
    ok = log.join(keys, "request_id", "left_semi")
    done = has_success_execution(ok)
    # of several verdicts on one resource the refusal counts
    sc = scope.groupBy(F.col("resource_name").alias("_scoped")).agg(F.bool_and(F.coalesce("in_scope", F.lit(False))).alias("in_scope"),
                                                                   F.max("scope_error").alias("scope_error"))
    j = (keys.join(r, "request_id", "left").join(sc, F.col("resource_name").eqNullSafe(F.col("_scoped")), "left")
         .join(done, "request_id", "left"))
    unlisted = F.concat(F.lit(K.SCOPE_UNKNOWN), F.coalesce(F.col("resource_name"), F.lit("")))
    decision = (F.when(F.col("_found").isNull(), F.lit("NOT_FOUND"))
                .when(F.coalesce(F.col("status"), F.lit("")) != K.APPROVED, F.lit("STATUS_NOT_APPROVED"))
                .when(~F.coalesce(F.col("in_scope"), F.lit(False)), F.lit("OUT_OF_SCOPE"))
                .when(F.coalesce(F.col("has_success"), F.lit(False)), F.lit("IDEMPOTENT_SKIP"))
                .otherwise(F.lit("EXECUTE")))
    result = (F.when(decision.isin("STATUS_NOT_APPROVED", "IDEMPOTENT_SKIP"), F.lit(K.SKIPPED))
              .when(decision == "OUT_OF_SCOPE", F.lit(K.FAILED)))
    reason = (F.when(decision == "STATUS_NOT_APPROVED", F.concat(F.lit("status is "), F.coalesce(F.col("status"), F.lit(""))))
              .when(decision == "IDEMPOTENT_SKIP", F.lit("already executed"))
              .when(decision == "OUT_OF_SCOPE", F.coalesce(F.col("scope_error"), unlisted)))
    return j.select("request_id", decision.alias("decision"), result.alias("result"),
                    F.when(decision == "OUT_OF_SCOPE", F.lit("OUT_OF_SCOPE")).alias("error_code"),
                    reason.alias("reason"),
                    F.when(F.col("_found").isNotNull(), normalize_action(F.coalesce(F.col("request_type"), F.lit(""))))
                    .alias("action"),
                    F.col("resource_name").alias("target"),
                    F.coalesce(F.col("reason").contains(K.EMERGENCY_REASON_PREFIX) & (decision == "EXECUTE"),
                               F.lit(False)).alias("break_glass"))


POLICY_KEY = ["resource_name", "role", "member"]
CHANGE_ORDER = ["_at", "request_id", "action"]


def _changes(changes: DataFrame) -> DataFrame:
    at = F.col("approved_at") if "approved_at" in changes.columns else F.lit(None).cast("timestamp_ntz")
    return changes.select("request_id", at.alias("_at"), normalize_action(F.coalesce(F.col("action"), F.lit(""))).alias("action"),
                          "resource_name", "role", member_identifier(F.col("principal_email")).alias("member"))


def policy_replay(bindings: DataFrame, changes: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Each change with what it finds: ``plain`` (the unconditioned binding is there), ``first_revoke`` (no change
    before it has removed the snapshot's conditioned bindings) and ``changed``.

    A change is a function on (plain, conditioned): GRANT sets plain, REVOKE
    clears both.  Such functions compose, and of any stretch only the last
    action and whether it revokes count, so a key with many changes is cut
    into segments (:func:`grantlens.operators.prefix.before`)."""
    state = bindings.groupBy(*POLICY_KEY).agg(F.bool_or(F.col("condition").isNull()).alias("_plain"), F.lit(True).alias("_any"))
    ch = _changes(changes).withColumn("_revokes", (F.col("action") == K.REVOKE).cast("long"))
    j = split_join(before(ch, POLICY_KEY, CHANGE_ORDER, last=["action"], sums=["_revokes"], small_bytes=small_bytes), state, POLICY_KEY, small_bytes=small_bytes)
    first = F.col("action_before").isNull()
    after_grant = F.col("action_before") == K.GRANT
    plain = F.when(first, F.coalesce("_plain", F.lit(False))).otherwise(after_grant)
    some = F.when(first, F.coalesce("_any", F.lit(False))).otherwise(after_grant)
    return j.select("request_id", "_at", "action", *POLICY_KEY, plain.alias("plain"),
                    ((F.col("action") == K.REVOKE) & (F.col("_revokes_before") == 0)).alias("first_revoke"),
                    F.when(F.col("action") == K.GRANT, ~plain).otherwise(some).alias("changed"))


def policy_diff(bindings: DataFrame, changes: DataFrame, small_bytes: int = SMALL_BYTES) -> tuple[DataFrame, DataFrame]:
    """#83: apply GRANT/REVOKE changes one after the other, per change -> SUCCESS / SKIPPED.

    ``bindings``: resource_name, role, member, condition (NULL = unconditioned).
    ``changes``: request_id, action, resource_name, role, principal_email and
    optionally approved_at; they run in the order (approved_at, request_id).
    GRANT only looks at the unconditioned binding; REVOKE removes the member
    from every binding of the role, conditioned or not.  What a change finds
    is what the changes before it on the same (resource, role, member) left
    (:func:`policy_replay`).  Returns (new_bindings, results).
    """
    j = policy_replay(bindings, changes, small_bytes)
    results = j.select("request_id", "action", F.col("resource_name").alias("target"), "role", "member",
                       F.when(F.col("changed"), F.lit(K.SUCCESS)).otherwise(F.lit(K.SKIPPED)).alias("result"), "changed")
    # per key: a revocation clears the snapshot's bindings, and the last action says whether the plain one is there
    end = _changes(changes).groupBy(*POLICY_KEY).agg(F.bool_or(F.col("action") == K.REVOKE).alias("_cleared"),
                                                     F.max_by("action", F.struct(*CHANGE_ORDER)).alias("_last"))
    kept = bindings.select(*POLICY_KEY, "condition").join(end.filter("_cleared"), POLICY_KEY, "left_anti")
    had = bindings.filter(F.col("condition").isNull()).select(*POLICY_KEY).distinct().withColumn("_had", F.lit(True))
    granted = end.filter(F.col("_last") == K.GRANT).join(had, POLICY_KEY, "left").filter(F.col("_cleared") | F.col("_had").isNull()) \
        .select(*POLICY_KEY, F.lit(None).cast("string").alias("condition"))
    return kept.unionByName(granted), results


def change_lanes(bindings: DataFrame, replay: DataFrame) -> DataFrame:
    """What each change that does something adds to its resource's digest state: (resource_name, _at, request_id,
    action, lanes).  ``replay`` is the outcome of :func:`policy_replay`."""
    moves = replay.filter("changed and (action = 'GRANT' or plain)").withColumn("condition", F.lit(None).cast("string"))
    plain = with_lanes(moves, F.when(F.col("action") == K.GRANT, F.lit(1)).otherwise(F.lit(-1)))
    # conditioned bindings go with the first revocation of their key, one row a key
    held = bindings.filter(F.col("condition").isNotNull()).select(*POLICY_KEY, "condition").distinct()
    gone = with_lanes(replay.filter("first_revoke and changed").join(held, POLICY_KEY), F.lit(-1))
    cols = ["resource_name", "_at", "request_id", "action"]
    return lane_sums(plain.select(*cols, *LANES).unionByName(gone.select(*cols, *LANES)), *cols)


def change_digests(bindings: DataFrame, changes: DataFrame, replay: DataFrame | None = None, states: DataFrame | None = None,
                   small_bytes: int = SMALL_BYTES) -> DataFrame:
    """#84: (request_id, before_hash, after_hash) of every change, in the order in which they run.

    The hashes of a resource chain: what one change leaves is what the next one
    finds, and a change that does nothing has two equal hashes.  ``states`` are
    stored digest states (:func:`grantlens.operators.digests.policy_states`);
    without them those of ``bindings`` are taken.  request_id is unique."""
    replay = policy_replay(bindings, changes, small_bytes) if replay is None else replay
    states = policy_states(bindings) if states is None else states
    cols = ["resource_name", "_at", "request_id", "action"]
    zero = F.lit(0).cast("long")
    still = replay.select(*cols, *(zero.alias(c) for c in LANES))
    steps = lane_sums(still.unionByName(change_lanes(bindings, replay)), *cols)
    run = before(steps, ["resource_name"], CHANGE_ORDER, sums=LANES, small_bytes=small_bytes)
    base = states.select("resource_name", *(F.col(c).alias(f"_base_{c}") for c in LANES))
    j = split_join(run, base, ["resource_name"], small_bytes=small_bytes)
    start = {c: F.coalesce(F.col(f"_base_{c}"), zero) + F.col(f"{c}_before") for c in LANES}
    return j.select("request_id", lane_hash(list(start.values())).alias("before_hash"),
                    lane_hash([start[c] + F.col(c) for c in LANES]).alias("after_hash"))


EXECUTOR = "iam-executor"


def execute_approved(req: DataFrame, ids: DataFrame, log: DataFrame, scope: DataFrame, bindings: DataFrame,
                     as_of: str | _dt.datetime, execution_id: str, executed_by: str = EXECUTOR,
                     keep: Callable[[DataFrame], DataFrame] = lambda df: df, states: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Gate -> policy diff -> change log: the rows that executing ``ids`` adds to the change log, and the new bindings.

    NOT_FOUND ids leave no row; gated ids leave a SKIPPED or FAILED row; the
    others run in order of approval, SUCCESS where they change the policy and
    SKIPPED where it is as wanted already.  ``before_hash`` and ``after_hash``
    are the digests (#84) of the resource's bindings before and after the
    change itself, so they chain; gated rows have none.  Only the policies of
    resources that the batch changes are read, and with stored ``states`` only
    the changed bindings are digested.  ``keep`` may store a step that several
    others take.
    """
    plan = keep(execution_plan(req, ids, log, scope).filter(F.col("decision") != "NOT_FOUND"))
    return _execute(plan, req, bindings, as_of, execution_id, executed_by, keep, states)


def _execute(plan: DataFrame, req: DataFrame, bindings: DataFrame, as_of: str | _dt.datetime, execution_id: str, executed_by: str,
             keep: Callable[[DataFrame], DataFrame], states: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    run = plan.filter(F.col("decision") == "EXECUTE").select("request_id", "action")
    changes = keep(run.join(req.select("request_id", "resource_name", "role", "principal_email", "approved_at"), "request_id"))
    touched = changes.select("resource_name").distinct()
    mine = keep(bindings.join(touched, "resource_name", "left_semi"))
    left, diff = policy_diff(mine, changes)
    after = bindings.join(touched, "resource_name", "left_anti").select(*left.columns).unionByName(left)
    j = (plan.join(diff.select("request_id", F.col("result").alias("_diff")), "request_id", "left")
         .join(change_digests(mine, changes, states=states), "request_id", "left"))
    ran = F.col("decision") == "EXECUTE"
    rows = j.select(
        F.lit(execution_id).alias("execution_id"), "request_id", "action", "target",
        F.when(ran, F.col("_diff")).otherwise(F.col("result")).alias("result"), "error_code",
        F.when(F.col("error_code").isNotNull(), F.col("reason")).alias("error_message"),
        "before_hash", "after_hash", F.lit(executed_by).alias("executed_by"), ts(as_of).alias("executed_at"))
    return rows, after


def binding_rows(perm: DataFrame) -> DataFrame:
    """Current bindings as policy rows (member strings, no condition)."""
    member = F.when(F.col("principal_type") == "SERVICE_ACCOUNT", F.concat(F.lit("serviceAccount:"), F.col("principal_email"))) \
        .when(F.col("principal_type").isin("USER", "UNKNOWN") | F.col("principal_type").isNull(),
              member_identifier(F.col("principal_email"))) \
        .otherwise(F.concat(F.lower(F.col("principal_type")), F.lit(":"), F.col("principal_email")))
    return perm.select("resource_name", "role", member.alias("member"), F.lit(None).cast("string").alias("condition"))


def revoke_expired(req: DataFrame, perm: DataFrame, bindings: DataFrame, as_of: str | _dt.datetime,
                   execution_id: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """#86: expired grants -> change-log rows, status decisions, history, remaining bindings and the job summary.

    ``keep`` may store a step that several others take (write and read back):
    the expired grants, which the diff reads more than once, and the decided rows.

    Not active -> SKIPPED, REVOKED_ALREADY_GONE.  Active -> REVOKE diff:
    SUCCESS -> REVOKED, SKIPPED -> REVOKED_ALREADY_GONE, otherwise REVOKE_FAILED.
    """
    exp = keep(expired_grants(req, perm, as_of))
    active = exp.filter(F.col("is_permission_active"))
    left, diff = policy_diff(bindings, active.select("request_id", F.lit(K.REVOKE).alias("action"), "resource_name",
                                                  "role", "principal_email"))
    d = exp.join(diff.select("request_id", F.col("result").alias("_diff")), "request_id", "left")
    result = F.when(~F.col("is_permission_active"), F.lit(K.SKIPPED)).otherwise(F.coalesce(F.col("_diff"), F.lit(K.FAILED)))
    new_status = (F.when(~F.col("is_permission_active"), F.lit(K.REVOKED_ALREADY_GONE))
                  .when(F.col("_diff") == K.SUCCESS, F.lit(K.REVOKED))
                  .when(F.col("_diff") == K.SKIPPED, F.lit(K.REVOKED_ALREADY_GONE))
                  .otherwise(F.lit(K.REVOKE_FAILED)))
    d = keep(d.withColumn("result", result).withColumn("new_status", new_status))
    log = d.select(F.lit(execution_id).alias("execution_id"), "request_id", F.lit(K.REVOKE).alias("action"),
                   F.col("resource_name").alias("target"), "result",
                   F.when(~F.col("is_permission_active"), F.lit('{"reason":"Already gone"}')).alias("details"),
                   ts(as_of).alias("executed_at"))
    decisions = d.select("request_id", F.col("new_status").alias("status"), F.col("status").alias("old_status"),
                         F.lit("").alias("reject_reason"), F.lit("SYSTEM_AUTO_REVOKE").alias("actor_email"),
                         F.when(F.col("status") == F.col("new_status"), F.lit("SKIPPED"))
                         .otherwise(F.lit("UPDATED")).alias("outcome"))
    return {"log": log, "decisions": decisions, "bindings": left,
            "requests": apply_status_updates(req, decisions, as_of),
            "history": status_change_events(req, decisions, as_of, SYSTEM_BATCH),
            "summary": job_outcome_summary(d)}


# --- summaries ------------------------------------------------------------------

def job_outcome_summary(results: DataFrame, result_col: str = "result", status_col: str = "new_status") -> DataFrame:
    """#60: revoked / skipped / failed counts; FAILED if anything failed."""
    s = F.col(status_col)
    agg = results.agg(F.count(F.when(s == K.REVOKED, 1)).alias("revoked"),
                      F.count(F.when(s == K.REVOKED_ALREADY_GONE, 1)).alias("skipped"),
                      F.count(F.when(s == K.REVOKE_FAILED, 1)).alias("failed"))
    return agg.withColumn("result", F.when(F.col("failed") > 0, F.lit(K.FAILED)).otherwise(F.lit(K.SUCCESS)))


def outcome_label(n_ok: Column, n_failed: Column) -> Column:
    return (F.when((n_failed > 0) & (n_ok > 0), F.lit(K.PARTIAL_SUCCESS))
            .when(n_failed > 0, F.lit(K.FAILED)).otherwise(F.lit(K.SUCCESS)))


def review_outcome_summary(rows: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """#61: per submission: succeeded / failed counts and SUCCESS / PARTIAL_SUCCESS / FAILED.

    ``rows`` carries a boolean ``succeeded`` column (one row per review line).
    """
    g = rows.groupBy(*(group_cols or []))
    agg = g.agg(F.count(F.when(F.col("succeeded"), 1)).alias("succeeded"),
                F.count(F.when(~F.col("succeeded"), 1)).alias("failed"))
    return agg.withColumn("result", outcome_label(F.col("succeeded"), F.col("failed")))


def principal_collection_outcome(runs: DataFrame, warnings: DataFrame, run_col: str) -> DataFrame:
    """#62: per collection run: warnings present -> PARTIAL_SUCCESS / PARTIAL_COLLECTION."""
    w = warnings.groupBy(run_col).agg(F.count(F.lit(1)).alias("warnings"))
    j = runs.select(run_col).distinct().join(w, run_col, "left").fillna(0, ["warnings"])
    return j.select(run_col, "warnings",
                    F.when(F.col("warnings") > 0, F.lit(K.PARTIAL_SUCCESS)).otherwise(F.lit(K.SUCCESS)).alias("result"),
                    F.when(F.col("warnings") > 0, F.lit("PARTIAL_COLLECTION")).alias("error_code"),
                    F.when(F.col("warnings") > 0, F.lit(K.PARTIAL_COLLECTION_MESSAGE)).alias("error_message"),
                    F.when(F.col("warnings") > 0, F.lit(K.PARTIAL_COLLECTION_HINT)).alias("hint"))


def classify_job_failure(errors: DataFrame) -> DataFrame:
    """#91: permission errors -> FAILED_PERMISSION with a job-specific hint, others FAILED.

    ``errors``: execution_id, job_type, error_class, http_status.
    """
    perm_err = (F.col("error_class") == "GcpPermissionDenied") | \
        ((F.col("error_class") == "HttpError") & F.col("http_status").isin(401, 403))
    hint = (F.when(~perm_err, F.lit(K.HINT_GENERIC))
            .when(F.col("job_type") == "RESOURCE_COLLECTION", F.lit(K.HINT_RESOURCE))
            .when(F.col("job_type") == "PRINCIPAL_COLLECTION", F.lit(K.HINT_PRINCIPAL))
            .otherwise(F.lit(K.HINT_OTHER)))
    return errors.select("execution_id", "job_type", "error_class",
                         F.when(perm_err, F.lit(K.FAILED_PERMISSION)).otherwise(F.lit(K.FAILED)).alias("result"),
                         hint.alias("hint"),
                         F.when(perm_err, F.lit(200)).otherwise(F.lit(500)).alias("http_status"))


# --- composition --------------------------------------------------------------------

def bulk_review(raw: DataFrame, req: DataFrame, log: DataFrame, scope: DataFrame,
                as_of: str | _dt.datetime, batch_col: str = "submission_id", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """#87: normalise -> decide -> gate approved ids; one output row per review line.

    A submission with an unknown status is rejected whole (``BATCH_REJECTED``).
    Accepted lines: ERROR/SKIPPED decisions fail; UPDATED non-APPROVED lines
    succeed; UPDATED APPROVED lines succeed unless the execution gate fails
    (OUT_OF_SCOPE) - lines that pass the gate are marked for execution.
    ``keep`` may store a step (write and read back) that several others take.
    """
    rejected, dec = _decided(raw, req, batch_col, keep)
    return _review_lines(rejected, dec, execution_plan(_reviewed_requests(req, dec, as_of), _approved_ids(dec), log, scope))


def review_and_execute(raw: DataFrame, req: DataFrame, log: DataFrame, scope: DataFrame, bindings: DataFrame, as_of: str | _dt.datetime,
                       execution_id: str, batch_col: str = "submission_id", executed_by: str = EXECUTOR,
                       keep: Callable[[DataFrame], DataFrame] = lambda df: df, states: DataFrame | None = None) -> dict[str, DataFrame]:
    """#87 as a whole: review lines are decided, approved ones executed, and each line tells its own outcome.

    ``lines``: the rows of :func:`bulk_review` with the outcome of the
    execution (``execution_result``, ``execution_id``; null where nothing was
    executed).  ``log``: the change-log rows, ``bindings``: the policies after
    it, ``requests`` and ``history``: the status updates (#80, #81).  Requests
    approved here run in order of request_id, since all are approved at
    ``as_of``.
    """
    rejected, dec = _decided(raw, req, batch_col, keep)
    after = _reviewed_requests(req, dec, as_of)
    plan = keep(execution_plan(after, _approved_ids(dec), log, scope))
    rows, new_bindings = _execute(plan.filter(F.col("decision") != "NOT_FOUND"), after, bindings, as_of, execution_id, executed_by, keep, states)
    rows = keep(rows)
    outcome = rows.select("request_id", F.col("result").alias("_result"), F.col("execution_id").alias("_execution_id"))
    lines = _review_lines(rejected, dec, plan).join(outcome, "request_id", "left")
    ran = F.col("execution_decision").isNotNull()
    lines = lines.select(*[c for c in lines.columns if not c.startswith("_")], F.when(ran, F.col("_result")).alias("execution_result"),
                         F.when(ran, F.col("_execution_id")).alias("execution_id"))
    return {"lines": lines, "log": rows, "bindings": new_bindings,
            "requests": apply_status_updates(req, dec, as_of), "history": status_change_events(req, dec, as_of)}


def _decided(raw: DataFrame, req: DataFrame, batch_col: str, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    n = keep(normalize_reviews(raw, batch_col))
    rejected = n.filter(F.col("batch_error").isNotNull()).select(
        "request_id", "status", F.lit(False).alias("succeeded"), F.lit("BATCH_REJECTED").alias("error_code"),
        F.col("batch_error").alias("error_message"), F.lit(None).cast("string").alias("execution_decision"))
    ok = n.filter(F.col("batch_error").isNull()).drop("batch_error", "status_raw")
    return rejected, keep(review_decisions(ok, req, "SHEET_BULK_REVIEW", batch_col))


def _approved_ids(dec: DataFrame) -> DataFrame:
    return dec.filter((F.col("outcome") == "UPDATED") & (F.col("status") == K.APPROVED)).select("request_id")


def _reviewed_requests(req: DataFrame, dec: DataFrame, as_of: str | _dt.datetime) -> DataFrame:
    """The requests that reviews change, with the status and the time of approval that the review gives them."""
    final = applied_updates(dec).select("request_id", F.col("status").alias("_final"))
    approved_at = F.when(F.col("_final") == K.APPROVED, ts(as_of)).otherwise(F.col("approved_at"))
    return req.join(final, "request_id").withColumn("approved_at", approved_at).withColumn("status", F.col("_final")).drop("_final")


def _review_lines(rejected: DataFrame, dec: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.select(
        "request_id", F.col("decision").alias("execution_decision"), F.col("result").alias("_exec_result"),
        F.col("error_code").alias("_exec_code"), F.col("reason").alias("_exec_reason"))
    j = dec.join(plan, "request_id", "left")
    failed_exec = F.coalesce(F.col("_exec_result") == K.FAILED, F.lit(False))
    succeeded = (F.col("outcome") == "UPDATED") & ~failed_exec
    code = (F.when(F.col("outcome") == "SKIPPED", F.lit("SKIPPED"))
            .when(F.col("outcome") == "ERROR", F.col("error_code"))
            .when(failed_exec, F.col("_exec_code")))
    msg = (F.when(F.col("outcome") == "SKIPPED", F.coalesce(F.col("error_code"), F.lit("skipped")))
           .when(F.col("outcome") == "ERROR", F.col("error_message"))
           .when(failed_exec, F.col("_exec_reason")))
    lines = j.select("request_id", "status", succeeded.alias("succeeded"), code.alias("error_code"),
                     msg.alias("error_message"), "execution_decision")
    return rejected.unionByName(lines)

