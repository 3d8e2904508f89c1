"""#92: the daily batch in the reference's order: revoke -> collect -> reconcile
-> history -> role discovery.

Each step reads the current rows of its tables from the warehouse root and
commits through :mod:`grantlens.sources.sinks`; requests, issues, principals and
roles get change rows, in proportion to what the day changed, and are compacted
when these have grown.  The run ledger names the steps that are done, so a run
that was cut off goes on with the step that was not.
Inputs that would come from cloud APIs (policy documents, asset rows,
principal sources) are passed in as DataFrames.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ts
from ..operators import ingest, intervals, masters, reconcile, reports, snapshots, workflow
from ..session import scratch_path
from ..sources import catalogue, ledger, sinks
from ..sources.fixtures import TableSet

SEED_TABLES = {
    "iam_access_requests": "iam_access_requests",
    "iam_policy_permissions": "iam_policy_permissions",
    "iam_access_change_log": "iam_access_change_log",
    "iam_access_request_history": "iam_access_request_history",
    "principal_catalog": "principal_catalog",
    "iam_role_master": "iam_role_master",
    "iam_status_master": "iam_status_master",
}


# tables that a day changes row by row
CHANGED_TABLES = ("iam_access_requests", "principal_catalog", "iam_reconciliation_issues", "iam_role_master")


def seed_warehouse(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Write the fixture tables as the warehouse's first table versions."""
    t = TableSet(spark, sf_dir)
    for table, fixture in SEED_TABLES.items():
        sinks.replace_snapshot(t[fixture], root, table)
    return root


def run_daily(spark: SparkSession, root: str, as_of: str | _dt.datetime, run_id: str,
              policy_docs: DataFrame, asset_rows: DataFrame, principals: DataFrame,
              translations: DataFrame, group_docs: DataFrame | None = None, collection_complete: bool = True,
              scope: str = "organizations/1") -> dict:
    """Run one day; returns per-step row counts.

    Run again with the same ``run_id`` after a failure it skips the steps that
    the ledger names (their counts are the ledger's) and repeats the one that
    failed: appends leave out rows whose keys the table has (of the run's day
    only: every row that a run appends has its time), changes that were applied
    are none the second time.  After a run that ended, all steps run anew, to
    the same tables.  Each job writes one report: SUCCESS with its counts, or
    FAILED / FAILED_PERMISSION with a hint (#91) before the error is raised.
    """
    day = {"p_date": str(as_of)[:10]}

    def cur(name: str) -> DataFrame:
        return sinks.read_current(spark, root, name)

    def keep(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, f"daily-{run_id}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def report(job: str, **numbers: int) -> None:
        """One job report per step (#13)."""
        row = spark.createDataFrame([(f"{run_id}-{job}", job, "SUCCESS", numbers)], "execution_id string, job_type string, result string, counts map<string,long>")
        row = sinks.prepare_job_report(row.withColumn("occurred_at", ts(as_of)))
        sinks.append_new(row, root, "iam_pipeline_job_reports", ["execution_id", "job_type", "result"], **day)

    @contextmanager
    def job(name: str) -> Iterator[None]:
        """Report the failure of a job, then let it end the run."""
        try:
            yield
        except Exception as e:
            status = getattr(e, "http_status", None)
            error = spark.createDataFrame([(f"{run_id}-{name}", name, type(e).__name__, status)], "execution_id string, job_type string, error_class string, http_status int")
            row = workflow.classify_job_failure(error).select(
                "execution_id", "job_type", "result", F.lit("{}").alias("counts"), F.col("error_class").alias("error_code"), "hint", ts(as_of).alias("occurred_at"))
            sinks.write_table(row, root, "iam_pipeline_job_reports")
            raise

    def revoke() -> dict[str, int]:
        """Expired grants: decided once, then logged, then applied."""
        req, perm = cur("iam_access_requests").drop("p_date"), cur("iam_policy_permissions")
        rev = workflow.revoke_expired(req, perm, workflow.binding_rows(perm), as_of, f"{run_id}-revoke", keep)
        logged = sinks.append_new(rev["log"], root, "iam_access_change_log", ["request_id"], execution_id=f"{run_id}-revoke", **day)
        events = sinks.append_new(sinks.prepare_history_events(rev["history"]), root, "iam_access_request_history", ["history_id"], **day)
        updated = workflow.applied_updates(rev["decisions"]).select("request_id").distinct()
        changed = sinks.upsert(spark, root, "iam_access_requests", ["request_id"], lambda now: workflow.apply_status_updates(
            now.join(updated, "request_id", "left_semi"), rev["decisions"], as_of))
        report("EXPIRED_PERMISSION_REVOCATION", logged=logged)
        return {"revoke_log": logged, "revoke_history": events, "requests_changed": changed}

    def collect_policies() -> dict[str, int]:
        flat = ingest.flatten_policy_bindings(policy_docs, f"{run_id}-iam", as_of, scope)
        n = sinks.replace_permissions_snapshot(flat.drop("execution_id"), root)
        report("IAM_POLICY_COLLECTION", bindings=n)
        return {"permissions": n}

    def collect_resources() -> dict[str, int]:
        inv = ingest.normalize_resource_inventory(asset_rows, f"{run_id}-res", as_of, scope)
        n = catalogue.append_snapshot(inv, root, "gcp_resource_inventory_history", ["resource_id"], execution_id=f"{run_id}-res", **day)
        report("RESOURCE_COLLECTION", resources=n)
        return {"inventory": n}

    def collect_principals() -> dict[str, int]:
        done = {}
        if group_docs is not None:
            members = ingest.stamp_snapshot(ingest.flatten_group_memberships(group_docs), f"{run_id}-grp", as_of, "assessed_at")
            done["memberships"] = catalogue.append_snapshot(members, root, "google_group_membership_history", ["group_email", "member_email"], execution_id=f"{run_id}-grp", **day)
        source = masters.dedupe_principals(principals)

        def merged(now: DataFrame) -> DataFrame:
            """Rows that the merge makes different in more than the time of the update, and new ones."""
            after = masters.merge_principals(now, source, as_of, complete=collection_complete).filter("affected").drop("affected")
            same = [c for c in after.columns if c != "updated_at"]
            before = now.select(*(F.col(c).alias(f"_{c}") for c in same))
            match = F.lit(True)
            for c in same:
                match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
            return after.join(before, match, "left_anti")

        done["principals_changed"] = sinks.upsert(spark, root, "principal_catalog", ["principal_email"], merged)
        report("PRINCIPAL_COLLECTION", principals=done["principals_changed"])
        return done

    def reconcile_issues() -> dict[str, int]:
        """Against the fresh snapshot: close what is gone, add what is not already OPEN."""
        detected = keep(reconcile.reconcile(cur("iam_access_requests").drop("p_date"), cur("iam_policy_permissions"), as_of))
        none = detected.limit(0).withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
        if not sinks.table_exists(spark, root, "iam_reconciliation_issues"):
            sinks.replace_snapshot(none, root, "iam_reconciliation_issues")
        deltas = []

        def delta(now: DataFrame) -> DataFrame:
            still = now.select(*none.columns)
            closed = reconcile.resolve_stale_issues(still.drop("resolved_at"), detected, as_of).filter(F.col("resolved_at").isNotNull())
            # what is closed here was not detected, so it cannot hide a detection
            new = reconcile.reconcile_new_only(detected, still).withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
            deltas.append(keep(closed.select(*none.columns).unionByName(new)))
            return deltas[-1]

        n = sinks.upsert(spark, root, "iam_reconciliation_issues", ["issue_id"], delta)
        closed = deltas[-1].filter(F.col("resolved_at").isNotNull()).count()
        done = {"issues_detected": detected.count(), "issues_closed": closed, "issues": n - closed}
        report("IAM_RECONCILIATION", detected=done["issues_detected"], appended=done["issues"], closed=closed)
        return done

    def update_history() -> dict[str, int]:
        """Raw archive, enriched snapshot and intervals."""
        req, perm = cur("iam_access_requests").drop("p_date"), cur("iam_policy_permissions")
        triple = ["principal_email", "resource_name"]
        raw = catalogue.append_snapshot(snapshots.archive_raw_bindings(perm, f"{run_id}-raw", as_of), root,
                                        "iam_policy_bindings_raw_history", [*triple, "role"], execution_id=f"{run_id}-raw", **day)
        snap = snapshots.bindings_history_snapshot(perm, req, cur("iam_status_master"), f"{run_id}-hist", as_of)
        enriched = catalogue.append_snapshot(snap, root, "iam_permission_bindings_history", [*triple, "iam_role"], execution_id=f"{run_id}-hist", **day)
        folded = intervals.store_snapshot(spark, root, perm, as_of)
        report("IAM_BINDINGS_HISTORY_UPDATE", raw=raw, enriched=enriched)
        return {"raw_history": raw, "bindings_history": enriched, "intervals_closed": folded["closed"], "intervals_open": folded["open"]}

    def discover_roles() -> dict[str, int]:
        perm = cur("iam_policy_permissions")

        def unknown(now: DataFrame) -> DataFrame:
            new = masters.register_roles(reports.unknown_roles(perm, now), translations, as_of)
            return now.limit(0).unionByName(new, allowMissingColumns=True)

        n = sinks.upsert(spark, root, "iam_role_master", ["role_id"], unknown)
        report("IAM_ROLE_DISCOVERY", added=n)
        return {"roles_added": n}

    steps = {"EXPIRED_PERMISSION_REVOCATION": revoke, "IAM_POLICY_COLLECTION": collect_policies, "RESOURCE_COLLECTION": collect_resources,
             "PRINCIPAL_COLLECTION": collect_principals, "IAM_RECONCILIATION": reconcile_issues,
             "IAM_BINDINGS_HISTORY_UPDATE": update_history, "IAM_ROLE_DISCOVERY": discover_roles}
    attempt, done = ledger.begin(spark, root, run_id)
    counts: dict[str, int] = {}
    for name, step in steps.items():
        if name not in done:
            with job(name):
                done[name] = step()
            ledger.finish(spark, root, run_id, attempt, name, done[name], as_of)
        counts.update(done[name])
    for table in CHANGED_TABLES:
        sinks.compact(spark, root, table)
    ledger.finish(spark, root, run_id, attempt, ledger.RUN, counts, as_of)
    return counts


def demo_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """API stand-ins derived from the fixture tables (see :mod:`grantlens.sources.nested`)."""
    from ..sources import nested
    t = TableSet(spark, sf_dir)
    feed = t["principal_feed"]
    translations = (t["iam_policy_permissions"].select("role").filter(F.col("role").startswith("roles/")).distinct()
                    .select(F.col("role").alias("role_id"),
                            F.regexp_replace("role", "^roles/", "").alias("role_name_ja")))
    return {"policy_docs": nested.policy_docs(t["iam_policy_permissions"]),
            "asset_rows": nested.asset_rows(t["gcp_resource_inventory"]),
            "group_docs": nested.group_docs(t["google_group_membership_history"]),
            "principals": feed, "translations": translations}
