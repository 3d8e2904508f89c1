"""Properties over the fixture: uniqueness, idempotence, absorbing operations."""

from pyspark.sql import functions as F

from grantlens.operators import masters as ms
from grantlens.operators import reconcile as rc
from grantlens.operators import workflow as wf

AS_OF = "2001-08-02 00:00:00"


def test_at_most_one_issue_per_triple_and_unique_ids(tables):
    issues = rc.reconcile(tables["iam_access_requests"], tables["iam_policy_permissions"], AS_OF)
    n = issues.count()
    assert n > 0
    assert issues.select("principal_email", "resource_name", "role").distinct().count() == n
    assert issues.select("issue_id").distinct().count() == n


def test_new_only_twice_is_empty(tables):
    detected = rc.reconcile(tables["iam_access_requests"], tables["iam_policy_permissions"], AS_OF)
    assert rc.reconcile_new_only(detected, detected).count() == 0


def test_merge_principals_idempotent(tables):
    src = ms.dedupe_principals(tables["principal_feed"])
    once = ms.merge_principals(tables["principal_catalog"], src, AS_OF, complete=True).drop("affected")
    twice = ms.merge_principals(once, src, AS_OF, complete=True).drop("affected")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_partial_collection_never_deactivates(tables):
    src = ms.dedupe_principals(tables["principal_feed"])
    out = ms.merge_principals(tables["principal_catalog"], src, AS_OF, complete=False)
    before = tables["principal_catalog"].filter(F.col("principal_status") == "ACTIVE").select("principal_email")
    after = out.filter(F.col("principal_status") == "INACTIVE").select("principal_email")
    assert before.intersect(after).count() == 0


def test_grant_twice_is_skipped(tables):
    b = wf.binding_rows(tables["iam_policy_permissions"]).distinct()
    ch = tables["iam_access_requests"].filter(F.col("request_type") == "GRANT").select(
        "request_id", F.lit("GRANT").alias("action"), "resource_name", "role", "principal_email")
    new, _ = wf.policy_diff(b, ch)
    _, again = wf.policy_diff(new, ch)
    assert again.filter(F.col("result") == "SUCCESS").count() == 0
