"""Differences of two evaluations: what changed, what must be looked at again, what is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.schema import Context, Policy


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, or whose other columns differ (nulls are equal)."""
    fields = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*fields).alias("a"))
    b = new.select(key, F.struct(*fields).alias("b"))
    return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def evidence_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sha256, change): added, removed or changed evidence."""
    a = old.select("sha256", F.col("evidence_digest").alias("a"))
    b = new.select("sha256", F.col("evidence_digest").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "sha256", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("sha256", change.alias("change"))


def changed_spam(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hashes whose verdict differs; a hash that is absent is no spam."""
    a = old.select("sha256", F.col("is_spam").alias("a"))
    b = new.select("sha256", F.col("is_spam").alias("b"))
    no = F.lit(False)
    return a.join(b, "sha256", "full_outer").where(F.coalesce("a", no) != F.coalesce("b", no)).select("sha256")


def group_workset(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Groups, old and new, of every candidate that came, went or changed; null is no group."""
    fields = [c for c in old.columns if c != "gallery_key"]
    a = old.select("gallery_key", F.struct(*fields).alias("a"))
    b = new.select("gallery_key", F.struct(*fields).alias("b"))
    both = a.join(b, "gallery_key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(F.explode(F.array(F.col("a")[group], F.col("b")[group])).alias(group)).where(F.col(group).isNotNull()).distinct()


def tombstones(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of old that new has no more."""
    return old.select(key).join(new.select(key), key, "left_anti").distinct()


def artifact_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(gallery_key, op) over selected artifacts: create, delete, rebuild or unchanged."""
    fields = [c for c in old.columns if c not in ("gallery_key", "selected")]
    a = old.where("selected").select("gallery_key", F.struct(*fields).alias("a"))
    b = new.where("selected").select("gallery_key", F.struct(*fields).alias("b"))
    op = (
        F.when(F.col("a").isNull(), "create").when(F.col("b").isNull(), "delete")
        .when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("rebuild")
    )
    return a.join(b, "gallery_key", "full_outer").select("gallery_key", op.alias("op"))


def context_error(old: Context, baseline: Context, new: Context, old_policy: Policy, new_policy: Policy) -> str | None:
    """Why a snapshot at new cannot be evaluated on top of old by its stated baseline; None if it can."""
    if old_policy != new_policy:
        return "policy"
    if baseline != old:
        return "baseline"
    if new.channel != baseline.channel:
        return "channel"
    if new.scope != baseline.scope:
        return "scope"
    return None
