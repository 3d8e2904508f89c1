"""Hand-made truth tables for the rule cascades (reconcile, review, gate, diff, scope)."""

import datetime as dt

from pyspark.sql import Row

from grantlens.operators import reconcile as rc
from grantlens.operators import scope as sc
from grantlens.operators import workflow as wf

AS_OF = "2024-01-10 00:00:00"
REQ_SCHEMA = ("request_id string, request_type string, principal_email string, resource_name string, role string, "
              "status string, requested_at timestamp_ntz, approved_at timestamp_ntz, updated_at timestamp_ntz, "
              "expires_at timestamp_ntz, approver_email string, reason string, request_group_id string, "
              "requester_email string")
PERM_SCHEMA = "principal_email string, resource_name string, role string"


def d(s):
    return dt.datetime.fromisoformat(s)


def _req(spark, rows):
    full = []
    for r in rows:
        base = dict(request_type="GRANT", resource_name="projects/p1", role="roles/viewer",
                    requested_at=d("2024-01-01"), approved_at=None, updated_at=d("2024-01-01"), expires_at=None,
                    approver_email="boss@example.com", reason="x", request_group_id="g", requester_email="r@x")
        base.update(r)
        full.append(base)
    cols = [c.split()[0] for c in REQ_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(x.get(c) for c in cols) for x in full], REQ_SCHEMA)


def test_reconcile_rules(spark):
    req = _req(spark, [
        dict(request_id="a", principal_email="a@x", status="APPROVED", approved_at=d("2024-01-02")),   # not applied
        dict(request_id="b", principal_email="b@x", status="REJECTED"),                                # rejected exists
        dict(request_id="c", principal_email="c@x", status="APPROVED", approved_at=d("2024-01-02"),
             expires_at=d("2024-01-05")),                                                              # expired exists
        dict(request_id="e", principal_email="e@x", status="PENDING"),                                 # unmanaged
        dict(request_id="f", principal_email="f@x", status="APPROVED", request_type="REVOKE",
             approved_at=d("2024-01-02")),                                                             # revoke missed
        dict(request_id="g", principal_email="g@x", status="APPROVED", approved_at=d("2024-01-09 18:00:00")),  # grace
        dict(request_id="h", principal_email="h@x", status="REVOKE_FAILED"),                           # no rule
        dict(request_id="i", principal_email="i@x", status="REVOKED"),                                 # MEDIUM (fix)
        dict(request_id="old", principal_email="j@x", status="APPROVED", approved_at=d("2023-01-02"),
             requested_at=d("2023-01-01")),                                                            # superseded
        dict(request_id="new", principal_email="j@x", status="CANCELLED", requested_at=d("2024-01-02"),
             updated_at=d("2024-01-02")),
    ])
    perm = spark.createDataFrame([("b@x", "projects/p1", "roles/viewer"), ("c@x", "projects/p1", "roles/viewer"),
                                  ("e@x", "projects/p1", "roles/viewer"), ("f@x", "projects/p1", "roles/viewer"),
                                  ("h@x", "projects/p1", "roles/viewer"), ("i@x", "projects/p1", "roles/viewer"),
                                  ("j@x", "projects/p1", "roles/viewer"), ("z@x", "projects/p1", "roles/owner"),
                                  ("z@x", "projects/p1", "roles/owner")], PERM_SCHEMA)
    out = {r.principal_email: (r.issue_type, r.severity, r.request_id)
           for r in rc.reconcile(req, perm, AS_OF).collect()}
    assert out == {
        "a@x": ("APPROVED_NOT_APPLIED", "HIGH", "a"),
        "b@x": ("REJECTED_BUT_EXISTS", "MEDIUM", "b"),
        "c@x": ("EXPIRED_BUT_EXISTS", "HIGH", "c"),
        "e@x": ("UNMANAGED_BINDING", "HIGH", "e"),
        "f@x": ("REVOKE_NOT_APPLIED", "HIGH", "f"),
        "i@x": ("REJECTED_BUT_EXISTS", "MEDIUM", "i"),
        "j@x": ("REJECTED_BUT_EXISTS", "MEDIUM", "new"),
        "z@x": ("UNMANAGED_BINDING", "HIGH", None),
    }


def test_strict_break_glass(spark):
    req = _req(spark, [dict(request_id="bg", principal_email="bg@x", status="APPROVED", approved_at=None,
                            reason="[緊急] fire")])
    perm = spark.createDataFrame([], PERM_SCHEMA)
    assert rc.reconcile(req, perm, AS_OF).count() == 0
    strict = rc.reconcile(req, perm, AS_OF, strict_break_glass=True).collect()
    assert [r.issue_type for r in strict] == ["APPROVED_NOT_APPLIED"]


def test_review_cascade(spark):
    req = _req(spark, [dict(request_id="r1", principal_email="a@x", status="PENDING"),
                       dict(request_id="r2", principal_email="b@x", status="PENDING", approver_email=""),
                       dict(request_id="r3", principal_email="c@x", status="APPROVED")])
    ups = spark.createDataFrame([
        ("", "APPROVED", "", "boss@example.com", 1), ("r1", "", "", "boss@example.com", 2),
        ("nope", "APPROVED", "", "boss@example.com", 3), ("r3", "approved", "", "boss@example.com", 4),
        ("r1", "REJECTED", "", "boss@example.com", 5), ("r2", "APPROVED", "", "boss@example.com", 6),
        ("r1", "APPROVED", "", "other@example.com", 7), ("r1", "APPROVED", "", "BOSS@example.com", 8),
        ("r1", "CANCELLED", "", "x", 9)],
        "request_id string, status string, reject_reason string, actor_email string, seq long")
    got = [(r.request_id, r.outcome, r.error_code)
           for r in wf.review_decisions(ups, req).orderBy("request_id", "status", "actor_email").collect()]
    assert sorted(got, key=str) == sorted([
        ("", "ERROR", "INVALID_REQUEST_ID"), ("r1", "ERROR", "INVALID_STATUS"), ("nope", "ERROR", "NOT_FOUND"),
        ("r3", "SKIPPED", "NO_STATUS_CHANGE"), ("r1", "ERROR", "MISSING_REJECT_REASON"),
        ("r2", "ERROR", "MISSING_APPROVER"), ("r1", "ERROR", "FORBIDDEN"), ("r1", "UPDATED", None),
        ("r1", "SKIPPED", "DUPLICATE_IN_BATCH")], key=str)


def test_review_without_ids_is_empty(spark):
    req = _req(spark, [dict(request_id="r1", principal_email="a@x", status="PENDING")])
    ups = spark.createDataFrame([("", "APPROVED", "", "a", "b1")],
                                "request_id string, status string, reject_reason string, actor_email string, b string")
    assert wf.review_decisions(ups, req, batch_col="b").count() == 0


def test_execution_gate(spark):
    req = _req(spark, [dict(request_id="ok", principal_email="a@x", status="APPROVED", reason="[緊急] x"),
                       dict(request_id="pend", principal_email="b@x", status="PENDING"),
                       dict(request_id="out", principal_email="c@x", status="APPROVED", resource_name="folders/9"),
                       dict(request_id="done", principal_email="d@x", status="APPROVED")])
    ids = spark.createDataFrame([("ok",), ("pend",), ("out",), ("done",), ("missing",)], "request_id string")
    log = spark.createDataFrame([("done", "SUCCESS"), ("ok", "SKIPPED")], "request_id string, result string")
    scope = sc.scope_check(req, target_project="p1")
    got = {r.request_id: (r.decision, r.result, r.break_glass)
           for r in wf.execution_plan(req, ids, log, scope).collect()}
    assert got == {"ok": ("EXECUTE", None, True), "pend": ("STATUS_NOT_APPROVED", "SKIPPED", False),
                   "out": ("OUT_OF_SCOPE", "FAILED", False), "done": ("IDEMPOTENT_SKIP", "SKIPPED", False),
                   "missing": ("NOT_FOUND", None, False)}


def test_the_gate_opens_for_known_resources_only(spark):
    cols = "request_id string, request_type string, status string, resource_name string, reason string, principal_email string, role string"
    names = {"in": "projects/p1", "null": None, "blank": "", "folder": "folders/1", "org": "organizations/1", "bare": "projects/",
             "unlisted": "projects/p9", "twice": "projects/p2"}
    rows = [(k, "GRANT", "APPROVED", v, "[緊急] x", "a@x", "roles/viewer") for k, v in names.items()]
    req = spark.createDataFrame(rows + [("nostatus", "GRANT", None, "projects/p1", "x", "a@x", "roles/viewer")], cols)
    log = spark.createDataFrame([], "request_id string, result string")
    listed = sc.scope_check(req.filter("request_id not in ('unlisted', 'twice')"), target_project="p1")
    listed = listed.unionByName(spark.createDataFrame([("projects/p2", True, None), ("projects/p2", False, "no"), ("projects/p8", True, None)], listed.schema))
    got = {r.request_id: r for r in wf.execution_plan(req, req.select("request_id"), log, listed).collect()}
    assert {k for k, r in got.items() if r.decision == "EXECUTE"} == {"in"}
    assert got["nostatus"].decision == "STATUS_NOT_APPROVED" and got["nostatus"].reason == "status is "
    refused = [k for k in names if k != "in"]
    assert {(got[k].decision, got[k].result, got[k].error_code, got[k].break_glass) for k in refused} == {("OUT_OF_SCOPE", "FAILED", "OUT_OF_SCOPE", False)}
    assert all(got[k].reason for k in refused) and got["unlisted"].reason.endswith("projects/p9") and got["twice"].reason == "no"
    nothing = wf.execution_plan(req, req.select("request_id"), log, listed.limit(0))
    assert nothing.filter("decision = 'EXECUTE'").isEmpty()


def test_policy_diff_replays_changes_in_order(spark):
    b = spark.createDataFrame([("projects/p1", "roles/viewer", "user:a@x", None),
                               ("projects/p1", "roles/viewer", "user:c@x", "cond"),
                               ("projects/p1", "roles/editor", "user:c@x", None),
                               ("projects/p1", "roles/owner", "user:k@x", None)],
                              "resource_name string, role string, member string, condition string")
    at = [d(f"2024-01-{n:02d}") for n in range(1, 20)]
    ch = spark.createDataFrame([("1", "GRANT", "roles/viewer", "a@x", at[0]),    # present -> SKIPPED
                                ("2", "GRANT", "roles/viewer", "c@x", at[1]),    # only conditioned -> add
                                ("3", "REVOKE", "roles/viewer", "c@x", at[2]),   # removes both
                                ("4", "REVOKE", "roles/owner", "a@x", at[3]),    # absent -> SKIPPED
                                ("5", "grant", "roles/editor", "n@x", at[4]),
                                ("6", "GRANT", "roles/editor", "n@x", at[5]),    # GRANT twice -> SKIPPED
                                ("8", "GRANT", "roles/editor", "z@x", at[6]),    # granted, then revoked: absent in the end
                                ("7", "REVOKE", "roles/editor", "z@x", at[7]),
                                ("9", "GRANT", "roles/owner", "k@x", at[9]),     # revoked, then granted: there in the end
                                ("10", "REVOKE", "roles/owner", "k@x", at[8])],
                               "request_id string, action string, role string, principal_email string, approved_at timestamp_ntz")
    from pyspark.sql import functions as F
    new, res = wf.policy_diff(b, ch.withColumn("resource_name", F.lit("projects/p1")))
    assert {r.request_id: r.result for r in res.collect()} == {
        "1": "SKIPPED", "2": "SUCCESS", "3": "SUCCESS", "4": "SKIPPED", "5": "SUCCESS", "6": "SKIPPED",
        "7": "SUCCESS", "8": "SUCCESS", "9": "SUCCESS", "10": "SUCCESS"}
    assert sorted((r.role, r.member, r.condition) for r in new.collect()) == sorted([
        ("roles/viewer", "user:a@x", None), ("roles/editor", "user:c@x", None),
        ("roles/editor", "user:n@x", None), ("roles/owner", "user:k@x", None)])


def test_policy_fingerprint_properties(spark):
    from pyspark.sql import functions as F
    schema = "resource_name string, role string, member string, condition string"
    rows = [("p", f"roles/{i % 7}", f"user:{i}@x", None if i % 3 else "c") for i in range(300)]
    of = lambda x: wf.policy_fingerprint(spark.createDataFrame(x, schema)).first().policy_hash
    base = of(rows)
    assert base == of(rows[::-1]) == of(rows + rows[:5]) and len(base) == 64
    edits = [rows[1:], rows + [("p", "roles/0", "user:new@x", None)], [("p", "roles/0", "user:0@x", None)] + rows[1:],
             [("p", "roles/0", "user:0@x", "")] + rows[1:], [("p", "roles/0,user:0@x", "", "c")] + rows[1:]]
    assert len({base, *map(of, edits)}) == 6
    assert F is not None


def test_execute_approved_scenarios(spark):
    req = _req(spark, [dict(request_id="new", principal_email="a@x", status="APPROVED", approved_at=d("2024-01-02")),
                       dict(request_id="same", principal_email="b@x", status="APPROVED", approved_at=d("2024-01-03")),
                       dict(request_id="pend", principal_email="c@x", status="PENDING"),
                       dict(request_id="out", principal_email="d@x", status="APPROVED", resource_name="projects/other"),
                       dict(request_id="done", principal_email="e@x", status="APPROVED"),
                       dict(request_id="gone", principal_email="b@x", role="roles/editor", status="APPROVED", request_type="REVOKE")])
    ids = spark.createDataFrame([(x,) for x in ("new", "same", "pend", "out", "done", "gone", "missing")], "request_id string")
    log = spark.createDataFrame([("done", "SUCCESS")], "request_id string, result string")
    b = spark.createDataFrame([("projects/p1", "roles/viewer", "user:b@x", None)], "resource_name string, role string, member string, condition string")
    rows, after = wf.execute_approved(req, ids, log, sc.scope_check(req, target_project="p1"), b, AS_OF, "run")
    got = {r.request_id: r for r in rows.collect()}
    assert {k: (r.result, r.error_code) for k, r in got.items()} == {
        "new": ("SUCCESS", None), "same": ("SKIPPED", None), "pend": ("SKIPPED", None), "out": ("FAILED", "OUT_OF_SCOPE"),
        "done": ("SKIPPED", None), "gone": ("SKIPPED", None)}
    digest = lambda x: wf.policy_fingerprint(x).first().policy_hash
    assert (got["new"].before_hash, got["new"].after_hash) == (digest(b), digest(after)) and digest(b) != digest(after)
    assert got["new"].executed_by == wf.EXECUTOR and got["out"].before_hash is None
    assert sorted(r.member for r in after.collect()) == ["user:a@x", "user:b@x"]


def test_review_executes_approved_lines(spark):
    mine = dict(approver_email="boss@x", status="PENDING")
    req = _req(spark, [dict(mine, request_id="add", principal_email="a@x"), dict(mine, request_id="same", principal_email="b@x"),
                       dict(mine, request_id="out", principal_email="c@x", resource_name="projects/other"),
                       dict(mine, request_id="no", principal_email="d@x"), dict(mine, request_id="foreign", principal_email="e@x", approver_email="z@x")])
    raw = spark.createDataFrame([(i, s, "why", "boss@x", "s1", n) for n, (i, s) in enumerate(
        [("add", "APPROVED"), ("same", "APPROVED"), ("out", "APPROVED"), ("no", "REJECTED"), ("foreign", "APPROVED"), ("lost", "APPROVED")])],
        "request_id string, status string, reject_reason string, actor_email string, submission_id string, seq int")
    log = spark.createDataFrame([], "request_id string, result string")
    b = spark.createDataFrame([("projects/p1", "roles/viewer", "user:b@x", None)], "resource_name string, role string, member string, condition string")
    out = wf.review_and_execute(raw, req, log, sc.scope_check(req, target_project="p1"), b, AS_OF, "run")
    lines = {r.request_id: (r.succeeded, r.error_code, r.execution_result, r.execution_id) for r in out["lines"].collect()}
    assert lines == {"add": (True, None, "SUCCESS", "run"), "same": (True, None, "SKIPPED", "run"), "out": (False, "OUT_OF_SCOPE", "FAILED", "run"),
                     "no": (True, None, None, None), "foreign": (False, "FORBIDDEN", None, None), "lost": (False, "NOT_FOUND", None, None)}
    rows = {r.request_id: r for r in out["log"].collect()}
    assert set(rows) == {"add", "same", "out"} and rows["add"].after_hash == rows["same"].before_hash == rows["same"].after_hash != rows["add"].before_hash
    assert sorted(r.member for r in out["bindings"].collect()) == ["user:a@x", "user:b@x"]
    assert {r.request_id: r.status for r in out["requests"].collect()} == {"add": "APPROVED", "same": "APPROVED", "out": "APPROVED", "no": "REJECTED", "foreign": "PENDING"}


def test_null_batch_keys(spark):
    from grantlens.operators import ingest
    req = _req(spark, [dict(request_id="r1", principal_email="a@x", status="PENDING")])
    ups = spark.createDataFrame([("r1", "却下", "no", "boss@example.com", None, 1), ("r1", "取消", "", "boss@example.com", "s2", 2),
                                 ("r1", "bogus", "", "x", "s3", 1), ("r1", "承認済", "", "x", "s3", 2)],
                                "request_id string, status string, reject_reason string, actor_email string, submission_id string, seq int")
    n = wf.normalize_reviews(ups, "submission_id")
    assert {(r.submission_id, r.status): r.batch_error for r in n.collect()} == {
        (None, "REJECTED"): None, ("s2", "CANCELLED"): None, ("s3", "BOGUS"): "invalid status: bogus", ("s3", "APPROVED"): "invalid status: bogus"}
    dec = wf.review_decisions(n.filter("batch_error is null"), req, batch_col="submission_id")
    assert {(r.submission_id, r.outcome) for r in dec.collect()} == {(None, "UPDATED"), ("s2", "UPDATED")}
    # two submissions touch one request: the first counts, in the table and in the log alike
    assert [r.status for r in wf.apply_status_updates(req, dec, AS_OF).collect()] == ["REJECTED"]
    assert [r.new_status for r in wf.status_change_events(req, dec, AS_OF).collect()] == ["REJECTED"]
    null_reviewer = spark.createDataFrame([("r1", "bogus", "", None)], "request_id string, status string, reject_reason string, actor_email string")
    assert wf.normalize_reviews(null_reviewer, "actor_email").first().batch_error == "invalid status: bogus"
    batch = spark.createDataFrame([(None, "1", "新規付与", "a@x", "p1", "Owner", "2024-1-5", "r"), ("g", "2", "新規付与", "a@x", "p1", "roles/viewer", "2024-1-5", "r")],
                                  "request_group_id string, request_id string, request_type_raw string, principal string, resource string, "
                                  "role string, expires_raw string, reason string")
    ok, bad = ingest.intake_requests(batch, "me@x", AS_OF)
    assert [r.request_id for r in bad.collect()] == ["1"]
    assert [(r.request_id, r.expires_at, r.parse_warning) for r in ok.collect()] == [("2", d("2024-01-05 23:59:59"), False)]


def test_ancestors_of_any_depth(spark):
    chain = [(f"folders/{i}", f"folders/{i + 1}") for i in range(40)] + [("folders/40", "organizations/7"), ("projects/deep", "folders/0"),
             ("folders/x", "folders/y"), ("folders/y", "folders/z"), ("folders/z", "folders/x"), ("projects/loop", "folders/x"), ("projects/none", None),
             ("projects/lost", "folders/missing")]
    inv = spark.createDataFrame(chain, "resource_id string, parent_resource_id string")
    got = {r.node: (r.organization, r.depth) for r in sc.resolve_ancestors(inv).collect()}
    assert len(got) == len(chain) and got["projects/deep"] == ("organizations/7", 42) and got["folders/40"] == ("organizations/7", 1)
    assert all(got[n] == (None, None) for n in ("projects/loop", "folders/x", "projects/none", "projects/lost"))


def test_scope_over_normalised_inventory_and_snapshots(spark):
    schema = "resource_type string, resource_id string, parent_resource_id string, assessed_at timestamp_ntz"
    inv = spark.createDataFrame([("Project", "a", "folders/1", d("2024-01-01")), ("Project", "a", "organizations/9", d("2024-01-02")),
                                 ("Folder", "folders/1", "organizations/1", d("2024-01-01"))], schema)
    res = spark.createDataFrame([("projects/a",)], "resource_name string")
    assert sc.scope_check(res, inv, target_org="9").first().in_scope  # the newest snapshot's parent
    assert not sc.scope_check(res, inv, target_org="1").first().in_scope


def test_matrix_with_more_roles_than_a_pivot_allows(spark):
    from grantlens.operators import matrix
    rows = [("projects/p", "p", "a@x", "USER", f"roles/r{i:05d}", "ok", d("2024-01-01")) for i in range(2100)]
    hist = spark.createDataFrame(rows, "resource_name string, resource_id string, principal string, principal_type string, iam_role string, status string, recorded_at timestamp_ntz")
    assert len(matrix.permission_matrix_status(hist).columns) == 2104
    assert matrix.permission_matrix_long(hist).count() == 2100


def test_scope_modes(spark):
    inv = spark.createDataFrame([("projects/proj-in-org", "folders/1"), ("folders/1", "organizations/123"),
                                 ("projects/proj-out", "organizations/999"), ("projects/loop", "folders/a"),
                                 ("folders/a", "folders/b"), ("folders/b", "folders/a")],
                                "resource_id string, parent_resource_id string")
    res = spark.createDataFrame([("projects/proj-in-org",), ("projects/proj-out",), ("projects/unknown",),
                                 ("folders/1",), ("projects/loop",)], "resource_name string")
    org = {r.resource_name: r.scope_error for r in sc.scope_check(res, inv, target_org="123").collect()}
    assert org["projects/proj-in-org"] is None
    assert org["projects/proj-out"].endswith("got organizations/999")
    assert org["projects/unknown"].startswith("failed to resolve organization")
    assert org["folders/1"].startswith("resource_name must start with projects/")
    assert org["projects/loop"].startswith("failed to resolve organization")
    proj = {r.resource_name: r.in_scope for r in sc.scope_check(res, target_project="proj-in-org").collect()}
    assert proj == {"projects/proj-in-org": True, "projects/proj-out": False, "projects/unknown": False,
                    "folders/1": False, "projects/loop": False}
    anc = {r.resource_id: (r.organization, r.depth) for r in sc.resolve_ancestors(inv).collect()}
    assert anc["projects/proj-in-org"] == ("organizations/123", 2)
    assert anc["folders/a"] == (None, None)


def test_intake_rules(spark):
    from grantlens.operators import ingest
    b = spark.createDataFrame([
        ("g1", "1", "緊急付与", " a@x ", "p1", "roles/viewer", "2024-02-01", "need"),
        ("g1", "2", "変更 / REVOKE", "b@x", "folders/9", "roles/viewer", "恒久", "[緊急] already"),
        ("g1", "3", "削除", "c@x", "organizations/1", "", "31/12/2001", "r"),
        ("g2", "4", "新規付与", "d@x", "p2", "Viewer", "", "r")],
        "request_group_id string, request_id string, request_type_raw string, principal string, resource string, "
        "role string, expires_raw string, reason string")
    ok, rej = ingest.intake_requests(b, "me@x", AS_OF)
    got = {r.request_id: r for r in ok.collect()}
    assert set(got) == {"1", "2", "3"} and [r.request_id for r in rej.collect()] == ["4"]
    assert got["1"].status == "APPROVED" and got["1"].reason == "[緊急] need"
    assert got["1"].expires_at == d("2024-02-01 23:59:59") and got["1"].resource_name == "projects/p1"
    assert got["2"].request_type == "CHANGE" and got["2"].reason == "[緊急] already" and got["2"].expires_at is None
    assert got["3"].request_type == "REVOKE" and got["3"].parse_warning and got["3"].expires_at is None
    _ = Row
