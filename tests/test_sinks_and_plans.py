"""Writers, the daily run, and physical-plan shape."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grantlens.functions.columns import TRIPLE

from grantlens.operators import reconcile as rc
from grantlens.operators import reports
from grantlens.plans import daily
from grantlens.sources import catalogue, sinks
from grantlens.sources.nested import asset_rows as daily_assets, policy_docs as daily_docs

from .conftest import SF_SMALL

AS_OF = "2001-08-02 00:00:00"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replace_snapshot_truncates_on_empty(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("a", "p", "r")], "principal_email string, resource_name string, role string")
    assert sinks.replace_snapshot(df, root, "t") == 1
    assert sinks.replace_snapshot(df.limit(0), root, "t") == 0
    assert sinks.read_current(spark, root, "t").count() == 0


def test_replace_then_append_keeps_rows_and_layout(spark, tables, tmp_path):
    root, log = str(tmp_path), tables["iam_access_change_log"].filter("executed_at between '1995-01-01' and '1995-01-31'").cache()
    first, rest = log.filter("result = 'SUCCESS'"), log.filter("result <> 'SUCCESS'")
    assert sinks.replace_snapshot(first, root, "iam_access_change_log") == first.count()
    assert sinks.append_change_log(rest, root) == rest.count()
    back = sinks.read_current(spark, root, "iam_access_change_log")
    assert back.count() == log.count() and back.drop("p_date").exceptAll(log).isEmpty()
    folder = tmp_path / "iam_access_change_log" / "data"
    days = {p.name for p in folder.glob("batch=*/p_date=*")}
    assert len(days) == log.select(F.to_date("executed_at")).distinct().count()
    assert max(len(list(folder.glob(f"batch=*/{d}/*.parquet"))) for d in days) <= 2  # one file a write, not one a task
    pruned = back.filter(F.col("p_date") == "1995-01-03")
    assert "PartitionFilters: [isnotnull(p_date" in _plan(pruned)
    # a replace is seen whole, and older versions stay readable until they are cleaned up
    sinks.replace_snapshot(first, root, "iam_access_change_log")
    assert sinks.read_current(spark, root, "iam_access_change_log").count() == first.count()
    assert back.count() == log.count()


def test_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, str(tmp_path), "iam_access_requests")


def test_append_new_is_safe_to_repeat(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("e1", "a"), ("e1", None)], "execution_id string, request_id string")
    assert sinks.append_new(df, root, "t", ["request_id"], execution_id="e1") == 2
    assert sinks.append_new(df, root, "t", ["request_id"], execution_id="e1") == 0
    assert sinks.append_new(df.withColumn("execution_id", F.lit("e2")), root, "t", ["request_id"], execution_id="e2") == 2


def _race(monkeypatch, other):
    """Let another writer commit between a writer's look at the table and its first commit."""
    commit, raced = sinks.commit, []

    def slow(*args):
        if not raced:
            raced.append(True)
            other()
        commit(*args)

    monkeypatch.setattr(sinks, "commit", slow)
    return raced


def test_racing_writers_lose_nothing(spark, tmp_path, monkeypatch):
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "k string, v int").coalesce(1)

    def stored(root):
        return sorted((r.k or "", r.v) for r in sinks.read_current(spark, root, "t").collect())

    def case(name, write, other):
        root = str(tmp_path / name)
        sinks.replace_snapshot(rows(("a", 1), ("b", 2)), root, "t")
        with monkeypatch.context() as m:
            raced = _race(m, lambda: other(root))
            result = write(root)
        assert raced
        return result, stored(root)

    # an append beside a replace: committed after it, on top of it
    assert case("append", lambda r: sinks.write_table(rows(("c", 3)), r, "t"),
                lambda r: sinks.replace_snapshot(rows(("z", 9)), r, "t")) == (1, [("c", 3), ("z", 9)])
    # two appends of the same new keys: the second one looks again
    assert case("new", lambda r: sinks.append_new(rows(("c", 3), ("d", 4)), r, "t", ["k"]),
                lambda r: sinks.append_new(rows(("c", 3)), r, "t", ["k"])) == (1, [("a", 1), ("b", 2), ("c", 3), ("d", 4)])
    # changes that are made from the rows are made again from the newer rows
    more = lambda now: now.withColumn("v", (F.col("v") + 10).cast("int"))
    assert case("upsert", lambda r: sinks.upsert(spark, r, "t", ["k"], more),
                lambda r: sinks.write_table(rows((None, 3)), r, "t")) == (3, [("", 13), ("a", 11), ("b", 12)])
    # a replace that was made from the rows fails, one that was not wins; a compaction gives way
    with pytest.raises(sinks.CommitClash):
        case("based", lambda r: sinks.replace_snapshot(rows(("y", 8)), r, "t", base=sinks.read_head(spark, r, "t")),
             lambda r: sinks.write_table(rows(("c", 3)), r, "t"))
    assert case("blind", lambda r: sinks.replace_snapshot(rows(("y", 8)), r, "t"),
                lambda r: sinks.write_table(rows(("c", 3)), r, "t")) == (1, [("y", 8)])
    assert case("compact", lambda r: sinks.compact(spark, r, "t", max_batches=0),
                lambda r: sinks.write_table(rows(("c", 3)), r, "t")) == (False, [("a", 1), ("b", 2), ("c", 3)])


def test_changes_merge_on_read_and_compact(spark, tmp_path):
    root, table = str(tmp_path), "iam_access_change_log"
    base = spark.range(200).selectExpr("cast(id as string) as request_id", "'SUCCESS' as result",
                                       "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 3 as int)) as executed_at")
    sinks.replace_snapshot(base, root, table)
    version = sinks.current_version(spark, root, table)
    change = lambda ids, result: lambda now: now.where(F.col("request_id").isin(ids)).withColumn("result", F.lit(result))
    assert sinks.upsert(spark, root, table, ["request_id"], change(["1", "2"], "FAILED")) == 2
    assert sinks.write_table(base.where("request_id = '2'"), root, table) == 1  # a later append is not hidden
    assert sinks.upsert(spark, root, table, ["request_id"], change(["1"], "SKIPPED")) == 1
    assert sinks.upsert(spark, root, table, ["request_id"], change(["none"], "FAILED")) == 0
    head = sinks.read_head(spark, root, table)
    assert [(n, c) for _, n, c in head.batches] == [(200, False), (2, True), (1, False), (1, True)]
    now = sinks.read_current(spark, root, table)
    want = sorted([("1", "SKIPPED"), ("2", "FAILED"), ("2", "SUCCESS")])
    assert sorted((r.request_id, r.result) for r in now.where("request_id in ('1', '2')").collect()) == want and now.count() == 201
    assert now.where("p_date = '2024-01-02'").count() == 67 and "p_date" in _plan(now.where("p_date = '2024-01-02'")).split("PartitionFilters: [")[1]
    assert not sinks.compact(spark, root, table) and sinks.compact(spark, root, table, max_batches=3)
    after = sinks.read_current(spark, root, table)
    assert after.exceptAll(now).isEmpty() and after.count() == 201 and sinks.current_version(spark, root, table) == version
    # folded batches go once they are old enough; what is named stays
    assert sinks.clean_up(spark, root, table, dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)) == []
    gone = sinks.clean_up(spark, root, table, dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=1))
    assert {b for b, _, _ in head.batches} <= set(gone) and sinks.read_current(spark, root, table).count() == 201


def test_export_placeholder(spark, tmp_path):
    df = spark.createDataFrame([], "a string, b string")
    path = sinks.export_view(df, str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(path).collect()[0]["a"] == "(no rows)"


def test_run_daily(spark, tables, tmp_path, monkeypatch):
    root = str(tmp_path)
    recent = {"iam_access_requests": "requested_at >= '1998-06-20'", "iam_access_change_log": "executed_at >= '1998-11-01'",
              "iam_access_request_history": "event_at >= '1998-07-25'"}
    for table, fixture in daily.SEED_TABLES.items():  # a few weeks: a folder a day is slow to write in a test
        sinks.replace_snapshot(tables[fixture].filter(recent.get(table, "true")), root, table)
    before = sinks.read_current(spark, root, "iam_access_change_log").count()
    counts = daily.run_daily(spark, root, AS_OF, "run1", **daily.demo_inputs(spark, SF_SMALL))
    assert counts["permissions"] > 0 and counts["raw_history"] == counts["permissions"]
    assert counts["revoke_log"] > 0 and counts["memberships"] > 0
    assert sinks.read_current(spark, root, "iam_access_change_log").count() == before + counts["revoke_log"]
    # run again after a failure: nothing is logged twice, everything detected is already OPEN
    again = daily.run_daily(spark, root, AS_OF, "run1", **daily.demo_inputs(spark, SF_SMALL))
    assert [again[k] for k in ("revoke_log", "revoke_history", "inventory", "memberships", "raw_history", "bindings_history", "issues")] == [0] * 7
    assert again["roles_added"] == 0 and again["issues_detected"] == counts["issues"]
    jobs = sinks.read_current(spark, root, "iam_pipeline_job_reports")
    assert jobs.count() == 7 and jobs.filter("result <> 'SUCCESS'").isEmpty()
    assert counts["intervals_open"] == sinks.read_current(spark, root, "iam_policy_permissions").select(*TRIPLE).distinct().count()
    assert catalogue.read_snapshot(spark, root, "iam_policy_bindings_raw_history").count() == counts["permissions"]

    # a job that fails leaves a report with a hint, and the run ends there
    class GcpPermissionDenied(Exception):
        pass

    def refuse(*args, **kwargs):
        raise GcpPermissionDenied("403")

    monkeypatch.setattr(daily.workflow, "revoke_expired", refuse)
    with pytest.raises(GcpPermissionDenied):
        daily.run_daily(spark, root, "2001-08-03 00:00:00", "run2", **daily.demo_inputs(spark, SF_SMALL))
    failed = sinks.read_current(spark, root, "iam_pipeline_job_reports").filter("result <> 'SUCCESS'").collect()
    assert [(r.execution_id, r.job_type, r.result) for r in failed] == [("run2-EXPIRED_PERMISSION_REVOCATION", "EXPIRED_PERMISSION_REVOCATION", "FAILED_PERMISSION")]


def test_run_daily_resumes_and_writes_changes_only(spark, tables, tmp_path, monkeypatch):
    """A run that is cut off in a step, and one that is not, leave the same tables; a quiet day changes no row."""
    def small(name, n, condition="true"):  # a folder a day is slow to write in a test
        path = str(tmp_path / "small" / f"{name}-{n}")
        tables[name].filter(condition).orderBy(*tables[name].columns[:3]).limit(n).coalesce(1).write.parquet(path)
        return spark.read.parquet(path)

    expired = small("iam_access_requests", 12, "status = 'APPROVED' and request_type <> 'REVOKE' and expires_at < '2001-01-01'")
    seed = {"iam_access_requests": expired.unionByName(small("iam_access_requests", 8, "status <> 'APPROVED'")),
            "iam_policy_permissions": small("iam_policy_permissions", 40), "iam_access_change_log": small("iam_access_change_log", 3),
            "iam_access_request_history": small("iam_access_request_history", 3), "principal_catalog": small("principal_catalog", 20),
            "iam_role_master": small("iam_role_master", 2), "iam_status_master": small("iam_status_master", 50)}
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    for table in daily.SEED_TABLES:
        for root in (whole, cut):
            sinks.replace_snapshot(seed[table], root, table)
    perm = seed["iam_policy_permissions"]
    inputs = {"policy_docs": daily_docs(perm), "asset_rows": daily_assets(small("gcp_resource_inventory", 20)), "principals": small("principal_feed", 15),
              "translations": perm.selectExpr("role as role_id", "concat('x ', role) as role_name_ja").distinct()}
    counts = daily.run_daily(spark, whole, AS_OF, "run1", **inputs)
    assert counts["requests_changed"] > 0 and counts["issues"] > 0

    class Killed(BaseException):  # as a lost driver: no report of the failure
        pass

    def killed(*args, **kwargs):
        raise Killed

    calls = []
    for target, name in ((daily.masters, "dedupe_principals"), (daily.intervals, "store_snapshot")):
        with monkeypatch.context() as m:
            m.setattr(target, name, killed)
            m.setattr(daily.workflow, "revoke_expired", lambda *a, f=daily.workflow.revoke_expired, **k: (calls.append(1), f(*a, **k))[1])
            with pytest.raises(Killed):
                daily.run_daily(spark, cut, AS_OF, "run1", **inputs)
    resumed = daily.run_daily(spark, cut, AS_OF, "run1", **inputs)
    assert len(calls) == 1  # the first step was not done again
    assert {k: resumed[k] for k in ("revoke_log", "requests_changed", "issues")} == {k: counts[k] for k in ("revoke_log", "requests_changed", "issues")}
    for table in ("iam_access_requests", "iam_access_change_log", "iam_reconciliation_issues", "principal_catalog", "iam_role_master",
                  "iam_policy_bindings_raw_history", "iam_permission_bindings_history", "iam_binding_intervals_open"):
        a, b = (sinks.read_current(spark, root, table) for root in (whole, cut))
        assert a.count() == b.count() and a.exceptAll(b).isEmpty(), table

    # the next day collects the same documents, so it changes nothing but one thing: bindings revoked the day
    # before are still there, which reconciliation reports once its grace time is over
    again = sinks.read_current(spark, cut, "iam_access_change_log").filter("execution_id = 'run1-revoke' and result = 'SUCCESS'").count()
    size = {t: sinks.read_head(spark, cut, t).batches for t in daily.CHANGED_TABLES}
    quiet = daily.run_daily(spark, cut, "2001-08-03 00:00:00", "run2", **inputs)
    assert [quiet[k] for k in ("requests_changed", "principals_changed", "issues", "issues_closed", "roles_added")] == [0, 0, again, 0, 0]
    after = {t: sinks.read_head(spark, cut, t).batches for t in daily.CHANGED_TABLES}
    issues = after.pop("iam_reconciliation_issues")
    assert issues[:-1] == size.pop("iam_reconciliation_issues") and issues[-1][1:] == (again, True) and after == size


def test_reconcile_plan_has_no_join(spark, tmp_path):
    from grantlens.sources.fixtures import TableSet, materialize
    stored = materialize(spark, SF_SMALL, str(tmp_path), ["iam_access_requests", "iam_policy_permissions"])
    t = TableSet(spark, SF_SMALL, stored=stored)
    df = rc.reconcile(t["iam_access_requests"], t["iam_policy_permissions"], AS_OF)
    plan = _plan(df)
    assert "Join" not in plan
    assert "Exchange hashpartitioning(principal_email" in plan or "hashpartitioning(principal_email" in plan


def test_stored_scan_prunes_columns_and_pushes_filters(spark, tables, tmp_path):
    sinks.append_change_log(tables["iam_access_change_log"].limit(50), str(tmp_path))
    plan = _plan(reports.recent_failed_executions(sinks.read_current(spark, str(tmp_path), "iam_access_change_log"), AS_OF))
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(result,FAILED)" in pushed and "GreaterThanOrEqual(executed_a" in pushed
    assert "execution_id" not in plan.split("ReadSchema: ")[1].splitlines()[0]
