"""Digests of binding sets that follow each change (#84).

A binding's SHA-256 digests are cut into ``LANES`` numbers of 32 bits; a
policy's state is their sum, lane by lane, modulo 2^32, and its hash the
SHA-256 of the state (set-additive incremental hashing).  The sum does not
depend on order, partial sums combine before the shuffle, and a binding that
comes or goes adds or takes away its own lanes.  So the hash after each change
is the state before the batch plus a running sum of the changes, without a
look at the other bindings of the resource, and a stored state is brought up
to date by the changes alone.

The hash shows edits; it is not made against someone who crafts whole sets of
bindings until their sums agree.  A resource without bindings has the state of
the empty set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = [f"lane{i:02d}" for i in range(16)]
MODULUS = 1 << 32


def with_lanes(rows: DataFrame, sign: Column | None = None) -> DataFrame:
    """``rows`` (role, member, condition, ...) with the lanes of each binding, times ``sign`` where one is given."""
    text = F.to_json(F.array("role", "member", F.coalesce(F.concat(F.lit("="), F.col("condition")), F.lit(""))))
    rows = rows.withColumn("_text", text)
    rows = rows.withColumn("_hex", F.concat(F.sha2(F.concat(F.lit("0"), "_text"), 256), F.sha2(F.concat(F.lit("1"), "_text"), 256)))
    number = lambda i: F.conv(F.substring("_hex", 8 * i + 1, 8), 16, 10).cast("long")
    sign = F.lit(1) if sign is None else sign
    return rows.select("*", *((number(i) * sign).alias(c) for i, c in enumerate(LANES))).drop("_text", "_hex")


def lane_sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.pmod(F.sum(c), F.lit(MODULUS)).alias(c) for c in LANES))


def lane_hash(values: list[Column]) -> Column:
    """Hash of a state; ``values`` may be sums that have not been reduced yet."""
    return F.sha2(F.concat_ws(",", *(F.pmod(v, F.lit(MODULUS)).cast("string") for v in values)), 256)


def policy_states(bindings: DataFrame) -> DataFrame:
    """(resource_name, lanes): the state of each resource's binding set; repeated bindings count once."""
    return lane_sums(with_lanes(bindings.select("resource_name", "role", "member", "condition").distinct()), "resource_name")


def policy_fingerprint(bindings: DataFrame) -> DataFrame:
    """#84: order-independent digest of each resource's binding set."""
    return policy_states(bindings).select("resource_name", lane_hash([F.col(c) for c in LANES]).alias("policy_hash"))


def advance_states(states: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stored states brought up to date by the lanes of a batch's changes; nothing else is digested."""
    return lane_sums(states.select("resource_name", *LANES).unionByName(deltas.select("resource_name", *LANES)), "resource_name")
