"""Permission matrices (#57-59): pivot roles into columns.

The pivot schema depends on the data, so the role list is resolved first:
passed in (the role master knows it), or read as a distinct list.  It holds
one string a role, whatever the number of bindings.  The long form
(:func:`permission_matrix_long`) has one row per cell and needs no list, for
matrices with more roles than a table should have columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import newest_per_key


def role_values(history: DataFrame, col: str = "iam_role") -> list[str]:
    """Sorted distinct non-empty role ids (bounded by the number of roles, not of rows)."""
    distinct = history.select(col).filter(F.col(col).isNotNull() & (F.col(col) != "")).distinct()
    return sorted(r[0] for r in distinct.collect())


def _pivot(df: DataFrame, keys: list[str], col: str, values: Sequence[str], cell: Column, blank: Column | None = None) -> DataFrame:
    """Cells by (keys, value) first, then one map a row from which the columns are read.

    The work per input row does not depend on the number of values, and both aggregates combine before they
    shuffle, so a key or value of many rows is folded where it is read."""
    cells = df.groupBy(*keys, col).agg(cell.alias("cell"))
    entries = F.collect_list(F.when(F.col(col).isNotNull(), F.struct(col, "cell")))
    rows = cells.groupBy(*keys).agg(F.map_from_entries(entries).alias("cells"))
    read = [F.try_element_at("cells", F.lit(v)) for v in values]
    return rows.select(*keys, *((F.coalesce(c, blank) if blank is not None else c).alias(v) for c, v in zip(read, values)))


def role_column_list(history: DataFrame, col: str = "iam_role") -> DataFrame:
    """#59: one row: number of pivot roles and their comma-joined sorted list."""
    roles = history.select(col).filter(F.col(col).isNotNull() & (F.col(col) != "")).distinct()
    return roles.agg(F.count(F.lit(1)).alias("n_roles"),
                     F.array_join(F.array_sort(F.collect_list(col)), ",").alias("role_columns"))


def newest_cells(history: DataFrame) -> DataFrame:
    """#64: the newest row per (resource_id, principal, role).

    Ties on recorded_at fall back to the larger execution-independent key
    (status, resource_name, principal_type) so the pick is deterministic."""
    return newest_per_key(history, ["resource_id", "principal", "iam_role"],
                          ["recorded_at", "status", "resource_name", "principal_type"])


def permission_matrix_long(history: DataFrame) -> DataFrame:
    """#57 in long form: one row per filled cell (resource, principal, role) with its status."""
    return (newest_cells(history).filter(F.col("iam_role").isNotNull() & (F.col("iam_role") != ""))
            .groupBy("resource_name", "resource_id", "principal", "principal_type", "iam_role").agg(F.max("status").alias("status")))


def permission_matrix_status(history: DataFrame, roles: Sequence[str] | None = None) -> DataFrame:
    """#57: newest row per (resource_id, principal, role); roles pivoted to MAX(status).

    ``history`` has the permission-history report columns (resource_name,
    resource_id, principal, principal_type, iam_role, status, recorded_at).
    """
    roles = list(roles) if roles is not None else role_values(history)
    newest = newest_cells(history)
    if not roles:
        return newest.groupBy("resource_name", "resource_id", "principal", "principal_type").agg(
            F.lit(None).cast("string").alias("NO_ROLE"))
    return _pivot(newest, ["resource_name", "resource_id", "principal", "principal_type"], "iam_role", roles, F.max("status"))


def permission_matrix_count(history: DataFrame, roles: Sequence[str] | None = None,
                            default_id: str = "default-project") -> DataFrame:
    """#58: principal x resource id, one count column per role short name (``roles/`` stripped).

    A blank resource id becomes ``default_id``; counts are COUNTA of principal
    (0 where a principal has no binding of that role).
    """
    short = F.regexp_replace(F.col("iam_role"), r"^roles/", "")
    rid = F.when(F.col("resource_id").isNull() | (F.col("resource_id") == ""), F.lit(default_id)) \
        .otherwise(F.col("resource_id"))
    src = history.select(F.col("principal"), rid.alias("resource_id"), short.alias("role_short"))
    if roles is None:
        roles = role_values(src, "role_short")
    else:
        roles = sorted({r[len("roles/"):] if r.startswith("roles/") else r for r in roles})
    return _pivot(src, ["principal", "resource_id"], "role_short", roles, F.count(F.when(F.col("principal") != "", F.lit(1))), F.lit(0).cast("long"))
