"""Nested collector documents shaped from the flat fixtures (FIXTURES.md §C).

They stand in for API responses: policy documents, asset search rows and
group documents.  Members are dealt over documents by the first three hex
digits of their SHA-256 (as an API pages them), so a document holds about
1/4096 of a resource's or group's members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOST = "//cloudresourcemanager.googleapis.com/"


def _prefixed_member(email, ptype):
    return (F.when(ptype == "SERVICE_ACCOUNT", F.concat(F.lit("serviceAccount:"), email))
            .otherwise(F.concat(F.lit("user:"), email)))


def _page(member: str):
    return F.substring(F.sha2(member, 256), 1, 3)


def policy_docs(perm: DataFrame) -> DataFrame:
    """struct(resource, asset_type, policy.bindings[].{role, members[]}) per (resource, page)."""
    members = perm.select("resource_name", "resource_type", "role",
                          _prefixed_member(F.col("principal_email"), F.col("principal_type")).alias("member"))
    extra = (perm.select("resource_name", "resource_type").distinct()
             .select("resource_name", "resource_type", F.lit("roles/viewer").alias("role"),
                     F.explode(F.array(F.lit("allUsers"), F.lit("deleted:user:x@example.com"))).alias("member")))
    allm = members.unionByName(extra).distinct().withColumn("page", _page("member"))
    per_role = allm.groupBy("resource_name", "resource_type", "page", "role").agg(
        F.array_sort(F.collect_list("member")).alias("members"))
    docs = per_role.groupBy("resource_name", "resource_type", "page").agg(
        F.array_sort(F.collect_list(F.struct("role", "members"))).alias("bindings"))
    return docs.select(F.concat(F.lit(HOST), F.col("resource_name")).alias("resource"),
                       F.col("resource_type").alias("asset_type"),
                       F.struct(F.col("bindings").alias("bindings")).alias("policy"))


def asset_rows(inventory: DataFrame) -> DataFrame:
    """Asset search rows: full names with host prefix, varied project-id sources."""
    rid = F.col("resource_id")
    num = F.regexp_extract(rid, r"(\d+)$", 1).cast("long")
    is_proj = F.col("resource_type") == "Project"
    pid = F.regexp_extract(rid, r"^projects/(.*)$", 1)
    attrs = F.when(is_proj & (num % 3 == 0), F.create_map(F.lit("projectId"), pid)) \
        .otherwise(F.create_map().cast("map<string,string>"))
    project = F.when(is_proj & (num % 3 == 1), rid)
    display = F.when(num % 2 == 0, F.concat(F.col("resource_type"), F.lit(" "), rid)).otherwise(F.lit(""))
    return inventory.select(
        F.concat(F.lit(HOST), rid).alias("name"),
        F.concat(F.lit("cloudresourcemanager.googleapis.com/"), F.col("resource_type")).alias("asset_type"),
        display.alias("display_name"),
        F.when(F.col("parent_resource_id").isNotNull(), F.concat(F.lit(HOST), F.col("parent_resource_id")))
        .alias("parent_full_resource_name"),
        project.alias("project"), attrs.alias("additional_attributes"))


def group_docs(memberships: DataFrame) -> DataFrame:
    """groupKey.id, displayName, memberships[] per (group, page) of the membership rows."""
    m = memberships.select("group_email", "member_email", "membership_type").distinct() \
        .withColumn("page", _page("member_email"))
    item = F.struct(F.struct(F.col("member_email").alias("id")).alias("preferredMemberKey"),
                    F.array(F.struct(F.col("membership_type").alias("name"))).alias("roles"))
    docs = m.groupBy("group_email", "page").agg(F.array_sort(F.collect_list(item)).alias("memberships"))
    return docs.select(F.struct(F.col("group_email").alias("id")).alias("groupKey"),
                       F.col("group_email").alias("displayName"), "memberships")
