"""Per-hash evidence and the spam verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.schema import METADATA_FILE, UPLOADED, Policy, Snapshot


def policy_files(files: DataFrame) -> DataFrame:
    """Files that count as content: all but the metadata file, repeated hashes included."""
    return files.where(F.col("name") != METADATA_FILE)


def artists(tags: DataFrame) -> DataFrame:
    """(gallery_key, artist): distinct values of exactly the namespace `artist`."""
    return tags.where("namespace = 'artist'").select("gallery_key", F.col("value").alias("artist")).distinct()


def uploaded(tags: DataFrame) -> DataFrame:
    """Galleries with a tag of any namespace whose value says, in any case, that they are uploaded."""
    return tags.where(F.lower("value") == UPLOADED).select("gallery_key").distinct()


def occurrences(files: DataFrame) -> DataFrame:
    """(sha256, gallery_key, occurrence_count)."""
    return policy_files(files).groupBy("sha256", "gallery_key").agg(F.count(F.lit(1)).alias("occurrence_count"))


def totals(files: DataFrame) -> DataFrame:
    """(sha256, occurrence_count) over all galleries."""
    return policy_files(files).groupBy("sha256").agg(F.count(F.lit(1)).alias("occurrence_count"))


def artist_stats(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct artists of each hash, and the most that one of its galleries has.

    pairs holds (sha256, gallery_key); galleries without artists add nothing.
    """
    of = artists(tags)
    per_gallery = of.groupBy("gallery_key").agg(F.count(F.lit(1)).alias("in_gallery"))
    joined = pairs.select("sha256", "gallery_key").join(of.join(per_gallery, "gallery_key"), "gallery_key")
    # distinct first, so that a hash in very many galleries reaches its group as few rows
    few = joined.groupBy("sha256", "artist").agg(F.max("in_gallery").alias("in_gallery"))
    return few.groupBy("sha256").agg(F.count(F.lit(1)).alias("distinct_artists"), F.max("in_gallery").alias("max_artists"))


def evidence(snapshot: Snapshot) -> DataFrame:
    """(sha256, evidence): sorted array of (gallery_key, occurrence_count, sorted artists)."""
    of = artists(snapshot.tags).groupBy("gallery_key").agg(F.array_sort(F.collect_list("artist")).alias("artists"))
    rows = occurrences(snapshot.files).join(of, "gallery_key", "left").withColumn("artists", F.coalesce("artists", F.array().cast("array<string>")))
    item = F.struct("gallery_key", "occurrence_count", "artists")
    return rows.groupBy("sha256").agg(F.array_sort(F.collect_list(item)).alias("evidence"))


def evidence_digest(snapshot: Snapshot) -> DataFrame:
    """(sha256, galleries, occurrence_count, evidence_digest): a fixed-size stand-in for the nested list.

    The digest adds up a hash of each gallery's item, so that no task holds the galleries of a frequent hash.
    """
    of = artists(snapshot.tags).groupBy("gallery_key").agg(F.array_join(F.array_sort(F.collect_list("artist")), "\x1f").alias("artists"))
    rows = occurrences(snapshot.files).join(of, "gallery_key", "left")
    item = F.concat_ws("\x1e", "gallery_key", "occurrence_count", F.coalesce("artists", F.lit("")))
    part = [F.sum(F.conv(F.substring(F.md5(item), 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"part{i}") for i in range(4)]
    found = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("galleries"), F.sum("occurrence_count").alias("occurrence_count"), *part)
    return found.select("sha256", "galleries", "occurrence_count", F.concat_ws(":", *[f"part{i}" for i in range(4)]).alias("evidence_digest"))


def classify(occurred: DataFrame, tags: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(sha256, is_spam) of all hashes in occurred (sha256, gallery_key, occurrence_count).

    Spam occurs often enough, and its artists are more than artist_ratio times as many as one gallery's
    most. Artists are only gathered for hashes that occur often enough.
    """
    total = occurred.groupBy("sha256").agg(F.sum("occurrence_count").alias("n"))
    frequent = total.where(F.col("n") >= policy.min_occurrences).select("sha256")
    stats = artist_stats(occurred.join(frequent, "sha256", "left_semi"), tags)
    verdict = F.coalesce((F.col("max_artists") > 0) & (F.col("distinct_artists") > policy.artist_ratio * F.col("max_artists")), F.lit(False))
    return total.select("sha256").join(stats, "sha256", "left").select("sha256", verdict.alias("is_spam"))


def spam(snapshot: Snapshot, policy: Policy = Policy()) -> DataFrame:
    return classify(occurrences(snapshot.files), snapshot.tags, policy)
