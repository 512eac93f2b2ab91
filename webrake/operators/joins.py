"""Joins, overlays, resume and quality reports.

Equi-joins are declared plainly and left to Catalyst/AQE (broadcast when the
runtime size allows it, skew-split sort-merge otherwise).  No operator here
broadcasts by itself: index tables (targets, entities) grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrake.functions.common import ColumnOrName, as_col


def require_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows whose required string fields are present and non-empty."""
    cond = None
    for f in fields:
        term = F.col(f).isNotNull() & (F.col(f).cast("string") != "")
        cond = term if cond is None else cond & term
    return df.where(cond) if cond is not None else df


def project_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Select columns with a per-field default for nulls (``''``, ``[]``,
    ``False``...).  Missing columns take the default."""
    out = []
    for name, default in defaults.items():
        if isinstance(default, Column):
            lit = default
        elif isinstance(default, list):
            lit = F.array(*[F.lit(x) for x in default]) if default else F.array().cast("array<string>")
        else:
            lit = F.lit(default)
        if name in df.columns:
            out.append(F.coalesce(F.col(name), lit).alias(name))
        else:
            out.append(lit.alias(name))
    return df.select(*out)


def enrich_join(children: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child records joined with their entity's index row (inner)."""
    return children.join(index, list(keys), "inner")


def skipped_children(children: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child records whose entity has no index row (skipped and counted)."""
    return children.join(index.select(*keys), list(keys), "left_anti")


def anti_processed(df: DataFrame, done: DataFrame, keys: Sequence[str],
                   null_safe: bool = False) -> DataFrame:
    """Rows not yet processed.  With ``null_safe`` a null key matches a
    stored null key (``<=>``)."""
    if not null_safe:
        return df.join(done.select(*keys).distinct(), list(keys), "left_anti")
    d = done.select(*[F.col(k).alias(f"__d_{k}") for k in keys])
    cond = None
    for k in keys:
        term = df[k].eqNullSafe(d[f"__d_{k}"])
        cond = term if cond is None else cond & term
    return df.join(d, cond, "left_anti")


def overlay(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Later values overwrite: each patch column replaces the base column
    when the patch has a non-null value; new patch columns are added."""
    pcols = [c for c in patch.columns if c not in keys]
    p = patch.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in pcols])
    j = base.join(p, list(keys), "left")
    out = []
    for c in base.columns:
        out.append(F.coalesce(F.col(f"__p_{c}"), F.col(c)).alias(c) if c in pcols else F.col(c))
    out += [F.col(f"__p_{c}").alias(c) for c in pcols if c not in base.columns]
    return j.select(*out)


def fallback_value(own: ColumnOrName, other: ColumnOrName) -> Column:
    """Own value when non-empty, else the other when non-empty, else null."""
    return F.coalesce(F.nullif(as_col(own), F.lit("")), F.nullif(as_col(other), F.lit("")))


def missing_report(df: DataFrame, group: Sequence[str], field: str) -> DataFrame:
    """Per group: rows and rows whose ``field`` is null or empty."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(field).isNull() | (F.col(field) == "")).alias("n_missing"))


def flatten_distinct(df: DataFrame, arr: ColumnOrName, name: str = "value") -> DataFrame:
    """Distinct elements over all rows' lists."""
    return df.select(F.explode(as_col(arr)).alias(name)).distinct()


def append_rows(df: DataFrame, extra: DataFrame) -> DataFrame:
    """UNION ALL by column name (duplicates kept)."""
    return df.unionByName(extra)
