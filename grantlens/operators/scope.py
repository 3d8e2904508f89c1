"""Organisation scope resolution (#49, #50).

``resolve_ancestors`` walks parent pointers by pointer doubling: each round a
node's pointer jumps 1, 2, 4, ... levels, until no pointer can advance; chains
may have any length.  Nodes that are done (an organisation, no parent, a
parent that is not in the inventory) leave the loop, so the rows shrink each
round and no round joins on the few organisations that all chains end in.  A
cycle makes pointers run for ever: a chain cannot be longer than the number of
nodes, so what still runs beyond that ends as NULL.  Each round is written to
the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

ORG_PREFIX = "organizations/"
PROJECT_PREFIX = "projects/"


def inventory_nodes(inventory: DataFrame) -> DataFrame:
    """(node, parent) with full names: bare project ids of the inventory become ``projects/<id>``.

    Of several rows for one node (more than one snapshot), the newest counts; ties go to the larger parent."""
    bare = ~F.col("resource_id").contains("/")
    if "resource_type" in inventory.columns:
        bare = bare & (F.col("resource_type") == "Project")
    node = F.when(bare, F.concat(F.lit(PROJECT_PREFIX), F.col("resource_id"))).otherwise(F.col("resource_id"))
    parent = F.when(F.col("parent_resource_id") != "", F.col("parent_resource_id"))
    stamp = F.col("assessed_at") if "assessed_at" in inventory.columns else F.lit(0)
    rows = inventory.select(F.col("resource_id"), node.alias("node"), F.struct(stamp.alias("at"), parent.alias("parent")).alias("newest"))
    return rows.groupBy("node").agg(F.max("newest").alias("newest"), F.max("resource_id").alias("resource_id")) \
        .select("node", "resource_id", F.col("newest.parent").alias("parent"))


def resolve_ancestors(inventory: DataFrame) -> DataFrame:
    """(resource_id, node, organization or NULL, depth or NULL) for every inventory node."""
    spark = inventory.sparkSession
    base = scratch_path(spark, f"ancestors-{uuid.uuid4().hex}")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    nodes = keep(inventory_nodes(inventory), "nodes")
    total = nodes.count()
    is_org = F.col("up").startswith(ORG_PREFIX)
    # pointers of all nodes (done ones stand still), and the rows that still run
    state = nodes.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("hops"))
    done = state.filter(F.col("up").isNull() | is_org)
    running = state.filter(F.col("up").isNotNull() & ~is_org)
    reach, finished = 1, [done]
    while True:
        # a parent that has finished hands over its end; one that runs hands over its own pointer
        every = finished[0]
        for f in finished[1:]:
            every = every.unionByName(f)
        step = every.unionByName(running).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"), F.lit(True).alias("known"))
        moved = running.join(step, "up", "left")
        ended = F.col("known").isNull() | F.col("next").isNull()
        state = moved.select("node", F.when(ended, F.lit(None)).otherwise(F.col("next")).alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        state = keep(state, f"round-{reach}")
        finished.append(state.filter(F.col("up").isNull() | is_org))
        running = state.filter(F.col("up").isNotNull() & ~is_org)
        reach *= 2
        if running.isEmpty():
            break
        if reach > total:  # only cycles run on
            finished.append(running.withColumn("up", F.lit(None).cast("string")))
            break
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    found = F.col("up").isNotNull()
    return nodes.select("resource_id", "node").join(out, "node").select(
        "resource_id", "node", F.col("up").alias("organization"), F.when(found, F.col("hops")).alias("depth"))


def scope_check(resources: DataFrame, inventory: DataFrame | None = None, target_project: str | None = None,
                target_org: str | None = None, ancestors: DataFrame | None = None) -> DataFrame:
    """#49: (resource_name, in_scope, scope_error) with the reference's error texts.

    Project mode (no ``target_org``): only ``projects/<target_project>``.
    Organisation mode: the project's resolved organisation must equal
    ``organizations/<target_org>``.
    """
    r = resources.select("resource_name").distinct()
    name = F.col("resource_name")
    not_project = F.when(~F.coalesce(name.startswith("projects/"), F.lit(False)),
                         F.lit("resource_name must start with projects/ (folder/org IAM changes are disabled by design)"))
    if not target_org:
        err = not_project.when(name != F.lit(f"projects/{target_project}"),
                               F.concat(F.lit(f"resource is out of managed scope: expected projects/{target_project}, got "),
                                        name))
        out = r.withColumn("scope_error", err)
    else:
        anc = ancestors if ancestors is not None else resolve_ancestors(inventory)
        pid = F.trim(F.regexp_extract(name, r"^[^/]*/(.*)$", 1))
        r2 = r.withColumn("_node", F.concat(F.lit(PROJECT_PREFIX), pid))
        j = r2.join(anc.select(F.col("node").alias("_node"), "organization"), "_node", "left")
        org_id = F.regexp_extract(F.col("organization"), r"^organizations/(.*)$", 1)
        err = (not_project
               .when(pid == "", F.lit("resource_name must contain project id"))
               .when(F.col("organization").isNull(),
                     F.concat(F.lit("failed to resolve organization for resource: "), name))
               .when(org_id != F.lit(str(target_org)),
                     F.concat(F.lit(f"resource is out of managed organization scope: expected organizations/{target_org}, "
                                    "got organizations/"), org_id)))
        out = j.withColumn("scope_error", err).drop("_node", "organization")
    return out.select("resource_name", F.col("scope_error").isNull().alias("in_scope"), "scope_error")
