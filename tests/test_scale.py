"""Plans and layouts that must hold at any size: heavy keys, pruned lookups, code generation, the checkpoint folder."""

import datetime as dt
import os
import subprocess
import sys
from statistics import median

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from grantlens.functions.columns import TRIPLE
from grantlens.operators import intervals as iv
from grantlens.operators import matrix
from grantlens.operators import reports as rp
from grantlens.operators import snapshots as sn
from grantlens.operators import workflow as wf
from grantlens.operators.prefix import before
from grantlens.operators.skew import heavy_keys, split_join
from grantlens.sources import catalogue as cat
from grantlens.sources import sinks

from .conftest import SF_SMALL

RAW = "iam_policy_bindings_raw_history"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Set session values for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def bag_and_context(spark, hot_share=3):
    """12,000 rows over 64 map partitions, one in three on one triple, and one context row a triple."""
    n = F.col("id")
    hot = n % hot_share == 0
    bag = spark.range(0, 12_000, numPartitions=64).select(
        F.when(n % 500 == 1, F.lit(None)).when(hot, F.lit("hot@x")).otherwise(F.concat(F.lit("u"), (n % 997).cast("string"))).alias("principal_email"),
        F.lit("projects/p").alias("resource_name"), F.lit("roles/r").alias("role"), n.alias("row"))
    context = bag.select(*TRIPLE).distinct().filter("principal_email is null or principal_email <> 'u5'").withColumn("label", F.concat_ws("/", *TRIPLE))
    return bag, context


def test_heavy_key_is_split(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    bag, context = bag_and_context(spark)
    split = split_join(bag, context, TRIPLE, small_bytes=0)
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    spread, plain = sizes(split), sizes(bag.join(context, TRIPLE, "left"))
    assert max(plain) > 3 * median(plain)
    assert max(spread) <= 3 * median(spread)
    for how in ("left", "inner"):
        want, got = bag.join(context, TRIPLE, how), split_join(bag, context, TRIPLE, how, small_bytes=0)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_light_keys_and_small_bags_are_joined_plainly(spark):
    bag, context = bag_and_context(spark, hot_share=10**9)
    assert heavy_keys(bag, TRIPLE, 8) == []
    assert "_salt" not in plan(split_join(bag, context, TRIPLE, small_bytes=0))
    assert "_salt" not in plan(split_join(*bag_and_context(spark), TRIPLE))
    with pytest.raises(ValueError):
        split_join(bag, context, TRIPLE, "full")
    empty = split_join(bag.limit(0), context, TRIPLE, small_bytes=0)
    assert empty.count() == 0


@pytest.fixture(scope="module")
def history(spark):
    """Five daily snapshots: a lasting binding, one that goes and comes back, a repeated row and a null principal."""
    days = {"a": [1, 2, 3, 4, 5], "b": [1, 2, 4], "c": [5], None: [2, 3]}
    rows = [(f"run-{d}", dt.datetime(2024, 1, d, 4), "s", "t", "projects/p", "USER", who, "roles/r") for who, ds in days.items() for d in ds]
    return spark.createDataFrame(rows + rows[:1], "execution_id string, assessment_timestamp timestamp_ntz, scope string, resource_type string, "
                                                  "resource_name string, principal_type string, principal_email string, role string")


def test_snapshot_catalogue(spark, history, tmp_path):
    root = str(tmp_path)
    for d in range(1, 6):
        assert cat.append_snapshot(history.filter(F.col("execution_id") == f"run-{d}"), root, RAW) > 0
    listed = {(r.execution_id, str(r.p_date)): r.rows for r in cat.read_catalogue(spark, root, RAW).collect()}
    assert listed == {("run-1", "2024-01-01"): 3, ("run-2", "2024-01-02"): 3, ("run-3", "2024-01-03"): 2, ("run-4", "2024-01-04"): 2, ("run-5", "2024-01-05"): 2}
    keys = [*TRIPLE]
    again = history.filter("execution_id = 'run-5'")
    assert cat.append_snapshot(again, root, RAW, keys, execution_id="run-5", p_date="2024-01-05") == 0
    assert sum(r.rows for r in cat.read_catalogue(spark, root, RAW).collect()) == 12
    at = cat.read_snapshot(spark, root, RAW, "2024-01-03 12:00:00")
    assert "PartitionFilters: [isnotnull(p_date" in plan(at) and "PartitionFilters: []" not in plan(at)
    assert sorted(map(str, at.drop("p_date").collect())) == sorted(map(str, sn.permissions_as_of(history, "2024-01-03 12:00:00").collect()))
    assert cat.read_snapshot(spark, root, RAW).count() == 2
    assert cat.read_snapshot(spark, root, RAW, "2023-12-31 00:00:00").count() == 0
    assert cat.rebuild(spark, root, RAW) == 5
    assert cat.latest_entry(spark, root, RAW).execution_id == "run-5"
    assert cat.latest_entry(spark, root, "google_group_membership_history") is None


def test_repeated_append_reads_only_its_day(spark, history, tmp_path, monkeypatch):
    root = str(tmp_path)
    sinks.write_table(history, root, RAW)
    seen = []
    real = sinks.write_table
    monkeypatch.setattr(sinks, "write_table", lambda df, *a: (seen.append(plan(df)), real(df, *a))[1])
    assert sinks.append_new(history.filter("execution_id = 'run-5'"), root, RAW, TRIPLE, execution_id="run-5", p_date="2024-01-05") == 0
    assert "PartitionFilters: [isnotnull(p_date" in seen[0]


def triples(df, *more):
    return sorted(map(str, df.select(*TRIPLE, *more).collect()))


def test_intervals(spark, history, tmp_path):
    whole = iv.binding_intervals(history)
    found = sorted((r.principal_email or "", r.valid_from.day, r.last_seen.day, r.valid_to and r.valid_to.day, r.snapshots) for r in whole.collect())
    assert found == [("", 2, 3, 4, 2), ("a", 1, 5, None, 5), ("b", 1, 2, 3, 2), ("b", 4, 4, 5, 1), ("c", 5, 5, None, 1)]
    root = str(tmp_path)
    for d in range(1, 6):
        iv.store_snapshot(spark, root, history.filter(F.col("execution_id") == f"run-{d}"), f"2024-01-{d:02d} 04:00:00")
    assert iv.store_snapshot(spark, root, history.filter("execution_id = 'run-5'"), "2024-01-05 04:00:00") == {"closed": 0, "open": 0}
    stored = iv.read_intervals(spark, root)
    assert triples(stored, *iv.INTERVAL[3:]) == triples(whole, *iv.INTERVAL[3:])
    for day in range(1, 7):
        t = f"2024-01-{day:02d} 05:00:00"
        assert triples(iv.bindings_at(stored, t)) == triples(sn.permissions_as_of(history, t).distinct())
    assert iv.bindings_at(stored, "2023-12-31 00:00:00").count() == 0
    want = sn.binding_first_seen(history)
    assert triples(iv.first_seen(stored), "first_seen", "last_seen", "snapshots") == triples(want, "first_seen", "last_seen", "snapshots")
    gone, left = iv.interval_delta(whole.filter("valid_to is null"), history.limit(0), "2024-01-06 04:00:00")
    assert gone.count() == 2 and left.count() == 0


def test_matrix_of_many_roles(spark):
    roles = [f"roles/r{i:04d}" for i in range(300)]
    rows = [("projects/p", "p", f"u{i}", "USER", roles[(i * 37 + j) % 300], "s" if j else None, dt.datetime(2024, 1, 1)) for i in range(8) for j in range(3)]
    rows.append(("projects/p", "p", "none", "USER", None, "s", dt.datetime(2024, 1, 1)))
    history = spark.createDataFrame(rows, "resource_name string, resource_id string, principal string, principal_type string, iam_role string, status string, recorded_at timestamp_ntz")
    got = {r.principal: r.asDict() for r in matrix.permission_matrix_status(history, roles).collect()}
    assert len(got) == 9 and all(v is None for k, v in got["none"].items() if k in roles)
    assert {k for k in roles if got["u3"][k]} == {roles[112], roles[113]}
    counts = {r.principal: r.asDict() for r in matrix.permission_matrix_count(history, roles).collect()}
    assert sum(counts["u3"][r[6:]] for r in roles) == 3 and sum(counts["none"][r[6:]] for r in roles) == 0


@pytest.mark.parametrize("name", ["normalize_resource_inventory", "resolve_ancestors", "bulk_review"])
def test_generated_code_compiles(spark, conf, name):
    """Without the fall-back to interpreted rows, code beyond the size limit is an error."""
    conf("spark.sql.codegen.fallback", "false")
    assert E.queries()[name](spark, SF_SMALL).count() > 0


def test_local_session_without_a_checkpoint_setting(tmp_path):
    """A fresh local session whose configuration names no folder gets one that stays the same."""
    script = ("from grantlens.session import checkpoint_dir, local_session, scratch_path\n"
              "s = local_session(1, 1)\n"
              "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
              "a = checkpoint_dir(s)\n"
              "assert a and a == checkpoint_dir(s)\n"
              "s.range(3).write.parquet(scratch_path(s, 'x'))\n"
              "assert s.read.parquet(scratch_path(s, 'x')).count() == 3\n")
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(p for p in (os.getcwd(), os.environ.get("PYTHONPATH", "")) if p)}
    subprocess.run([sys.executable, "-c", script], env=env, check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def hot_changes(spark, n=6000):
    """Changes of which every third is on one binding, all approved at one of two times or at none."""
    i = F.col("id")
    hot = i % 3 == 0
    return spark.range(0, n, numPartitions=16).select(
        F.concat(F.lit("r"), F.lpad((i * 7919 % n).cast("string"), 6, "0")).alias("request_id"),
        F.when(F.xxhash64("id") % 2 == 0, F.lit("GRANT")).otherwise(F.lit("REVOKE")).alias("action"),
        F.when(i % 50 == 1, F.lit(None)).when(hot | (i % 5 == 0), F.lit("projects/p")).otherwise(F.lit("projects/q")).alias("resource_name"),
        F.lit("roles/r").alias("role"), F.when(hot, F.lit("hot@x")).otherwise(F.concat(F.lit("u"), (i % 89).cast("string"), F.lit("@x"))).alias("principal_email"),
        F.when(i % 4 != 0, F.timestamp_seconds(1_000_000 + i % 2).cast("timestamp_ntz")).alias("approved_at"))


def test_segmented_prefix_equals_window(spark):
    rows = wf._changes(hot_changes(spark)).withColumn("n", F.xxhash64("request_id") % 100)
    kept = []
    def keep(df):
        kept.append(df.checkpoint())
        return kept[-1]
    from grantlens.session import checkpoint_dir
    checkpoint_dir(spark)
    out = before(rows, wf.POLICY_KEY, wf.CHANGE_ORDER, last=["action"], sums=["n"], small_bytes=0, segments=24, keep=keep)
    plain = before(rows, wf.POLICY_KEY, wf.CHANGE_ORDER, last=["action"], sums=["n"])
    assert out.columns == plain.columns and sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    # the hot binding is dealt over several segments, and none holds far more than its share
    sizes = [r["count"] for r in kept[0].groupBy("_segment").count().collect()]
    assert max(sizes) <= 3 * median(sizes)
    assert kept[0].filter("member = 'user:hot@x'").select("_segment").distinct().count() > 4
    assert before(rows.limit(0), wf.POLICY_KEY, wf.CHANGE_ORDER, last=["action"], sums=["n"], small_bytes=0).count() == 0


@pytest.mark.parametrize("small_bytes", [0, 1 << 40])
def test_replay_and_digests_against_a_loop(spark, small_bytes):
    """Every change applied one after the other in Python: outcomes, hashes and what is left."""
    import hashlib
    import json
    changes = hot_changes(spark, 900).filter("resource_name is not null")
    start = [("projects/p", "roles/r", "user:hot@x", None), ("projects/p", "roles/r", "user:hot@x", "c"), ("projects/p", "roles/r", "user:u5@x", "c"),
             ("projects/p", "roles/r", "user:u5@x", "d"), ("projects/q", "roles/r", "user:u7@x", None), ("projects/z", "roles/r", "user:u7@x", None)]
    schema = "resource_name string, role string, member string, condition string"
    bindings = spark.createDataFrame(start + start[:1], schema)

    def digest(held, resource):
        sums = [0] * 16
        for res, role, member, cond in held:
            if res == resource:
                text = json.dumps([role, member, "" if cond is None else "=" + cond], separators=(",", ":"))
                h = "".join(hashlib.sha256((s + text).encode()).hexdigest() for s in "01")
                sums = [(a + int(h[8 * i:8 * i + 8], 16)) % 2**32 for i, a in enumerate(sums)]
        return hashlib.sha256(",".join(map(str, sums)).encode()).hexdigest()

    held, want = set(start), {}
    for r in sorted(changes.collect(), key=lambda r: (r.approved_at is not None, r.approved_at or 0, r.request_id)):
        member = "user:" + r.principal_email
        found, was = digest(held, r.resource_name), set(held)
        if r.action == "GRANT":
            held.add((r.resource_name, r.role, member, None))
        else:
            held = {b for b in held if b[:3] != (r.resource_name, r.role, member)}
        want[r.request_id] = ("SUCCESS" if held != was else "SKIPPED", found, digest(held, r.resource_name))
    left, results = wf.policy_diff(bindings, changes, small_bytes)
    hashes = {r.request_id: (r.before_hash, r.after_hash) for r in wf.change_digests(bindings, changes, small_bytes=small_bytes).collect()}
    assert {r.request_id: (r.result, *hashes[r.request_id]) for r in results.collect()} == want
    assert {tuple(r) for r in left.collect()} == held
    # a stored state is brought up to date by the changes alone
    replay = wf.policy_replay(bindings, changes, small_bytes)
    from grantlens.operators.digests import LANES, advance_states, policy_states
    states = policy_states(bindings)
    stored = {tuple(r) for r in advance_states(states, wf.change_lanes(bindings, replay)).collect() if any(r[c] for c in LANES)}
    assert stored == {tuple(r) for r in policy_states(left).collect()}
    again = wf.change_digests(bindings, changes, replay, states, small_bytes)
    assert {r.request_id: (r.before_hash, r.after_hash) for r in again.collect()} == hashes


def test_masters_are_not_joined_by_a_shuffle_of_all_rows(spark, conf, tables):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    req, master = tables["iam_access_requests"], tables["iam_status_master"]
    snap = sn.bindings_history_snapshot(tables["iam_policy_permissions"], req, master, "run", "2001-08-02 00:00:00")
    found = plan(rp.sheet_permission_history(snap, req, tables["iam_access_change_log"], master, tables["iam_role_master"]))
    joins = [line for line in found.splitlines() if "Join" in line and "LeftOuter" in line]
    by_master = [line for line in joins if "[status#" in line or "[request_status#" in line or "[iam_role#" in line]
    assert by_master and all("BroadcastHashJoin" in line for line in by_master)


def test_intervals_are_not_shuffled_by_time(spark, conf, history):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    found = plan(iv.binding_intervals(history))
    assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found


def test_lines_of_a_large_submission_are_not_sorted_by_it(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    lines = [("1", "APPROVED", None), ("2", "HOLD", "late"), ("", "APPROVED", "late"), ("3", "REJECTED", ""), ("", "APPROVED", "blank")]
    raw = spark.createDataFrame([(i, s, "", "boss@x", b, 1) for i, s, b in lines], "request_id string, status string, reject_reason string, actor_email string, b string, seq long")
    named = wf.normalize_reviews(raw, "b")
    assert "SortMergeJoin" not in plan(named) and "ShuffledHashJoin" in plan(named)
    assert {(r.request_id, r.b): r.batch_error for r in named.collect()} == {
        ("1", None): None, ("2", "late"): "invalid status: HOLD", ("", "late"): "invalid status: HOLD", ("3", ""): None, ("", "blank"): None}
    req = spark.createDataFrame([("1", "PENDING", "boss@x")], "request_id string, status string, approver_email string")
    decided = wf.review_decisions(named.filter("batch_error is null").drop("batch_error", "status_raw"), req, batch_col="b")
    assert sorted((r.b is None, r.request_id, r.outcome, r.error_code) for r in decided.collect()) == [(False, "3", "ERROR", "NOT_FOUND"), (True, "1", "UPDATED", None)]


def test_expired_grants_are_found_once(spark, tables):
    kept = []
    perm = tables["iam_policy_permissions"]
    wf.revoke_expired(tables["iam_access_requests"], perm, wf.binding_rows(perm), "2001-08-02 00:00:00", "run", lambda df: kept.append(df.columns) or df)
    assert len(kept) == 2 and "is_permission_active" in kept[0] and "result" not in kept[0] and "new_status" in kept[1]
