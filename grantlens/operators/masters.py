"""Master-table maintenance (#53-55, #67-71, #88-89).

Plain parquet has no MERGE, so each MERGE is ``old FULL OUTER JOIN delta``
producing the next version of the table, which the caller writes to a new
folder (see :mod:`grantlens.sources.sinks`).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import nullif_empty, principal_type_priority, ts

CATALOG_COLUMNS = ["principal_email", "principal_name", "principal_type", "principal_status",
                   "deactivated_at", "updated_at"]


def principal_types_from_permissions(perm: DataFrame) -> DataFrame:
    """#53: MAX(principal_type) per non-empty e-mail."""
    return (perm.filter(F.col("principal_email").isNotNull() & (F.col("principal_email") != ""))
            .groupBy("principal_email").agg(F.max("principal_type").alias("principal_type")))


def principal_type_any(perm: DataFrame) -> DataFrame:
    """#54: one type per e-mail (ANY_VALUE made deterministic as MAX)."""
    return perm.groupBy("principal_email").agg(F.max("principal_type").alias("principal_type"))


def dedupe_principals(feed: DataFrame) -> DataFrame:
    """#55: one row per e-mail: longest name (ties: larger name), type by priority.

    Empty names count as missing (fix 2.11-o).  Both picks are partial
    aggregates (``max_by`` / ``min_by``), so a principal repeated across many
    sources is combined map-side.
    """
    name = nullif_empty(F.col("principal_name"))
    ptype = F.col("principal_type")
    return (feed.filter(F.col("principal_email").isNotNull() & (F.col("principal_email") != ""))
            .groupBy("principal_email")
            .agg(F.max_by(name, F.when(name.isNotNull(), F.struct(F.length(name), name))).alias("principal_name"),
                 F.min_by(ptype, F.when(ptype.isNotNull(), F.struct(principal_type_priority(ptype), ptype)))
                 .alias("principal_type")))


def status_master_seed(spark: SparkSession) -> DataFrame:
    """#67: the seven-row status master seed."""
    return spark.createDataFrame(K.STATUS_MASTER_SEED,
                                 "status_ja string, status_code string, description string, sort_order int")


def merge_status_master(master: DataFrame, seed: DataFrame, as_of: str | _dt.datetime) -> DataFrame:
    """#68: MERGE seed into master on status_ja: update matched, insert new, reactivate."""
    m = master.select("status_ja", F.col("status_code").alias("m_code"),
                      (F.col("description") if "description" in master.columns else F.lit(None).cast("string")).alias("m_desc"),
                      F.col("sort_order").cast("int").alias("m_order"), F.col("is_active").alias("m_active"),
                      (F.col("updated_at") if "updated_at" in master.columns else F.lit(None).cast("timestamp_ntz")).alias("m_upd"))
    s = seed.select("status_ja", F.col("status_code").alias("s_code"), F.col("description").alias("s_desc"),
                    F.col("sort_order").cast("int").alias("s_order"), F.lit(True).alias("_in_seed"))
    j = m.join(s, "status_ja", "full")
    hit = F.col("_in_seed").isNotNull()
    return j.select("status_ja",
                    F.when(hit, F.col("s_code")).otherwise(F.col("m_code")).alias("status_code"),
                    F.when(hit, F.col("s_desc")).otherwise(F.col("m_desc")).alias("description"),
                    F.when(hit, F.col("s_order")).otherwise(F.col("m_order")).alias("sort_order"),
                    F.when(hit, F.lit(True)).otherwise(F.col("m_active")).alias("is_active"),
                    F.when(hit, ts(as_of)).otherwise(F.col("m_upd")).alias("updated_at"))


def merge_principals(catalog: DataFrame, source: DataFrame, as_of: str | _dt.datetime,
                     complete: bool = False, source_nonempty: bool | None = None) -> DataFrame:
    """#69-71: MERGE a de-duplicated principal source into the catalog.

    matched -> COALESCE(new, old) name/type, ACTIVE, deactivated_at NULL;
    new -> inserted ACTIVE; catalog-only ACTIVE rows -> INACTIVE (keeping the
    first deactivation time) only when ``complete`` and the source is non-empty
    (a partial collection must never deactivate anyone).  Adds ``affected``.
    """
    if complete and source_nonempty is None:
        source_nonempty = len(source.take(1)) > 0
    deactivate = bool(complete and source_nonempty)
    now = ts(as_of)
    src_cols = source.columns
    s = source.select("principal_email",
                      (F.col("principal_name") if "principal_name" in src_cols else F.lit(None).cast("string")).alias("s_name"),
                      F.col("principal_type").alias("s_type"), F.lit(True).alias("_in_src"))
    upd = F.col("updated_at") if "updated_at" in catalog.columns else F.lit(None).cast("timestamp_ntz")
    c = catalog.select("principal_email", F.col("principal_name").alias("c_name"),
                       F.col("principal_type").alias("c_type"), F.col("principal_status").alias("c_status"),
                       F.col("deactivated_at").alias("c_deact"), upd.alias("c_upd"), F.lit(True).alias("_in_cat"))
    j = c.join(s, "principal_email", "full")
    in_src = F.col("_in_src").isNotNull()
    in_cat = F.col("_in_cat").isNotNull()
    gone = in_cat & ~in_src & (F.col("c_status") == "ACTIVE") & F.lit(deactivate)
    return j.select(
        "principal_email",
        F.when(in_src, F.coalesce("s_name", "c_name")).otherwise(F.col("c_name")).alias("principal_name"),
        F.when(in_src, F.coalesce("s_type", "c_type")).otherwise(F.col("c_type")).alias("principal_type"),
        F.when(in_src, F.lit("ACTIVE")).when(gone, F.lit("INACTIVE")).otherwise(F.col("c_status")).alias("principal_status"),
        F.when(in_src, F.lit(None).cast("timestamp_ntz")).when(gone, F.coalesce("c_deact", now))
        .otherwise(F.col("c_deact")).alias("deactivated_at"),
        F.when(in_src | gone, now).otherwise(F.col("c_upd")).alias("updated_at"),
        (in_src | gone).alias("affected"))


def register_roles(unknown: DataFrame, translations: DataFrame, as_of: str | _dt.datetime) -> DataFrame:
    """#88: new role-master rows for unknown roles; auto flag = a translation exists."""
    t = translations.select(F.col("role_id").alias("role"), F.col("role_name_ja"))
    j = unknown.join(t, "role", "left")
    return j.select(F.col("role").alias("role_id"), "role_name_ja",
                    F.col("role_name_ja").isNotNull().alias("is_auto_translated"), ts(as_of).alias("updated_at"))


def correct_role_name(role_master: DataFrame, corrections: DataFrame, as_of: str | _dt.datetime) -> DataFrame:
    """#89: manual names override the translation and clear the auto flag."""
    c = corrections.select("role_id", F.col("role_name_ja").alias("_fix"))
    upd = F.col("updated_at") if "updated_at" in role_master.columns else F.lit(None).cast("timestamp_ntz")
    j = role_master.select("role_id", "role_name_ja", "is_auto_translated", upd.alias("updated_at")) \
        .join(c, "role_id", "left")
    hit = F.col("_fix").isNotNull()
    return j.select("role_id", F.when(hit, F.col("_fix")).otherwise(F.col("role_name_ja")).alias("role_name_ja"),
                    F.when(hit, F.lit(False)).otherwise(F.col("is_auto_translated")).alias("is_auto_translated"),
                    F.when(hit, ts(as_of)).otherwise(F.col("updated_at")).alias("updated_at"))
