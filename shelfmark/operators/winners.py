"""Effective content, content owners and catalogue winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.evidence import policy_files, uploaded
from shelfmark.schema import Snapshot


def effective_content(galleries: DataFrame, files: DataFrame, spam: DataFrame) -> DataFrame:
    """(gallery_key, content_sha256) of all galleries; null without content that is no spam.

    The digest covers the raw hashes in order, repeated ones included.
    """
    kept = policy_files(files).join(spam.where("is_spam").select("sha256"), "sha256", "left_anti")
    # the hashes of one gallery meet in an array: its own files, whatever the corpus holds
    hashes = F.array_join(F.array_sort(F.collect_list("sha256")), "")
    found = kept.groupBy("gallery_key").agg(F.sha2(F.unhex(hashes), 256).alias("content_sha256"))
    return galleries.select("gallery_key").join(found, "gallery_key", "left")


def candidates(snapshot: Snapshot, content: DataFrame) -> DataFrame:
    """What galleries are compared by: gid, title, download time, content and whether they are uploaded."""
    done = uploaded(snapshot.tags).withColumn("already_uploaded", F.lit(True))
    rows = snapshot.galleries.select("gallery_key", "gid", "title", "download_time").join(content, "gallery_key")
    return rows.join(done, "gallery_key", "left").withColumn("already_uploaded", F.coalesce("already_uploaded", F.lit(False)))


def priority() -> list[Column]:
    """Not yet uploaded, then the longer title (in code points), then the later download."""
    return [(~F.col("already_uploaded")).alias("fresh"), F.char_length("title").alias("length"), F.col("download_time")]


def content_groups(found: DataFrame) -> DataFrame:
    """(content_sha256, candidates) of shared and unshared content."""
    return found.where("content_sha256 is not null").groupBy("content_sha256").agg(F.count(F.lit(1)).alias("candidates"))


def owners(found: DataFrame) -> DataFrame:
    """(content_sha256, gallery_key): of each content the candidate of highest priority, gid and key."""
    best = F.max_by("gallery_key", F.struct(*priority(), "gid", "gallery_key"))
    return found.where("content_sha256 is not null").groupBy("content_sha256").agg(best.alias("gallery_key"))


def gid_candidates(found: DataFrame, owner: DataFrame) -> DataFrame:
    """Candidates without content, and those that own theirs."""
    owner = owner.select("content_sha256", F.col("gallery_key").alias("owner_key"))
    return found.join(owner, "content_sha256", "left").where("content_sha256 is null or owner_key = gallery_key").drop("owner_key")


def winners(competing: DataFrame) -> DataFrame:
    """(gid, gallery_key): of each gid the candidate of highest priority and key."""
    best = F.max_by("gallery_key", F.struct(*priority(), "gallery_key"))
    return competing.groupBy("gid").agg(best.alias("gallery_key"))
