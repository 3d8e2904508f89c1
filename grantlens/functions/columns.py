"""Column-expression helpers shared by the jobs (all JVM-side built-ins)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

TRIPLE = ["principal_email", "resource_name", "role"]


def ts(value: str | _dt.datetime | Column) -> Column:
    """A TIMESTAMP_NTZ literal; string casts avoid any session-time-zone shift."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def hours(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(n) * 3600.0))


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(int(n)))


def nullif_empty(c: Column) -> Column:
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def regexp_extract_or_null(c: Column, pattern: str, idx: int = 1) -> Column:
    """BigQuery REGEXP_EXTRACT semantics: NULL when the pattern does not match."""
    return nullif_empty(F.regexp_extract(c, pattern, idx))


def to_json_keep_nulls(*cols: Column) -> Column:
    """``TO_JSON(STRUCT(...))`` keeping null fields, timestamps as 'yyyy-MM-dd HH:mm:ss'."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false",
                                       "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
                                       "timestampFormat": "yyyy-MM-dd HH:mm:ss"})


def role_short_name(role: Column) -> Column:
    """Role name as the role report shows it: last segment after roles/."""
    return (F.when(role.startswith("roles/"), regexp_extract_or_null(role, r"roles/([^/]+)$"))
            .when(role.rlike("/roles/"), regexp_extract_or_null(role, r"/roles/([^/]+)$"))
            .otherwise(role))


def role_type(role: Column) -> Column:
    return F.when(role.startswith("roles/"), F.lit(K.ROLE_TYPE_PREDEFINED)).otherwise(F.lit(K.ROLE_TYPE_CUSTOM))


def normalize_request_type(raw: Column) -> Column:
    """Portal request-type label -> GRANT / CHANGE / REVOKE (CHANGE wins over REVOKE)."""
    up = F.upper(raw)
    return (F.when(raw.contains(K.TYPE_LABEL_CHANGE) | up.contains(K.CHANGE), F.lit(K.CHANGE))
            .when(raw.contains(K.TYPE_LABEL_REVOKE) | up.contains(K.REVOKE), F.lit(K.REVOKE))
            .otherwise(F.lit(K.GRANT)))


def is_emergency(raw: Column) -> Column:
    return F.coalesce(raw.contains(K.EMERGENCY_MARK_JA) | F.upper(raw).contains(K.EMERGENCY_MARK_EN),
                      F.lit(False))


def normalize_resource_name(res: Column) -> Column:
    """Prefix ``projects/`` unless the value already names a project, folder or organisation."""
    trimmed = F.trim(res)
    known = None
    for p in K.RESOURCE_PREFIXES:
        cond = trimmed.startswith(p)
        known = cond if known is None else (known | cond)
    return (F.when((trimmed == "") | known, trimmed)
            .otherwise(F.concat(F.lit("projects/"), trimmed)))


def member_identifier(email: Column) -> Column:
    """E-mail -> IAM member string (``user:`` / ``serviceAccount:``) unless already typed."""
    return (F.when(email.contains(":"), email)
            .when(email.endswith("gserviceaccount.com"), F.concat(F.lit("serviceAccount:"), email))
            .otherwise(F.concat(F.lit("user:"), email)))


def normalize_action(request_type: Column) -> Column:
    return F.when(F.upper(request_type) == K.REVOKE, F.lit(K.REVOKE)).otherwise(F.lit(K.GRANT))


def type_label_ja(request_type: Column) -> Column:
    return (F.when(request_type == K.REVOKE, F.lit(K.TYPE_LABEL_REVOKE))
            .when(request_type == K.CHANGE, F.lit(K.TYPE_LABEL_CHANGE))
            .otherwise(F.lit(K.TYPE_LABEL_GRANT)))


def principal_type_priority(t: Column) -> Column:
    expr = None
    for name, prio in K.PRINCIPAL_TYPE_PRIORITY:
        expr = (F.when(t == name, F.lit(prio)) if expr is None else expr.when(t == name, F.lit(prio)))
    return expr.otherwise(F.lit(K.PRINCIPAL_TYPE_OTHER))


def stable_id(*parts: Column) -> Column:
    """Deterministic id replacing GENERATE_UUID (sha256 of the '|'-joined parts)."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
