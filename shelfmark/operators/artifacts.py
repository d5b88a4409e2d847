"""Member plans, manifests and artifact inputs."""

from __future__ import annotations

import sys
import zlib
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import codec
from shelfmark.schema import METADATA_FILE, Policy, Snapshot


def member_plan(files: DataFrame, spam: DataFrame, ascii_names: bool = False) -> DataFrame:
    """One row per file in the archive's order; excluded ones keep their position.

    Names are ordered by their case folding, then by themselves. ascii_names says that
    all are ASCII, which keeps the plan in the JVM.
    """
    rows = files.withColumn("fold", codec.fold_ascii(F.col("name"))) if ascii_names else codec.fold(files)
    order = Window.partitionBy("gallery_key").orderBy("fold", "name")
    bad = spam.where("is_spam").select("sha256", F.lit(True).alias("bad"))
    metadata = F.col("name") == METADATA_FILE
    rows = rows.join(bad, "sha256", "left").withColumn("excluded", ~metadata & F.coalesce("bad", F.lit(False)))
    return rows.select(
        "gallery_key",
        (F.row_number().over(order) - 1).cast("bigint").alias("position"),
        F.lit("source").alias("entry_kind"),
        F.col("name").alias("source_name"),
        F.lit(None).cast("string").alias("generated_identity"),
        F.col("sha256").alias("source_sha256"),
        F.col("size_bytes").alias("source_size_bytes"),
        F.col("sha256").alias("payload_sha256"),
        "excluded",
        F.when(metadata, "metadata").otherwise("content").alias("file_role"),
        F.when(~F.col("excluded"), F.col("name")).alias("archive_member_name"),
        F.lit("source_copy").alias("transform_kind"),
    )


def plan_digest(plan: DataFrame) -> DataFrame:
    """(gallery_key, plan_digest, members): one digest over a gallery's ordered plan rows."""
    row = F.concat(
        codec.frame64(F.col("source_name")), F.upper("source_sha256"), codec.hex_u64(F.col("source_size_bytes")),
        F.when(F.col("excluded"), "01").otherwise("00"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", row.alias("row"))))
    body = F.array_join(F.transform(ordered, lambda x: x["row"]), "")
    return plan.groupBy("gallery_key").agg(codec.digest_hex(body).alias("plan_digest"), F.count(F.lit(1)).alias("members"))


def source_manifest(snapshot: Snapshot, ascii_names: bool = False) -> DataFrame:
    """(gallery_key, source_manifest_sha256): a framed digest of all observed facts of a gallery."""
    files = snapshot.files
    files = files.withColumn("fold", codec.fold_ascii(F.col("name"))) if ascii_names else codec.fold(files)
    raw = F.concat(codec.hex_text(F.col("name")), F.lit("00"), codec.hex_u64(F.col("size_bytes")), F.upper("sha256"))
    listed = F.array_sort(F.collect_list(F.struct("fold", "name", codec.frame64_hex(raw).alias("row"))))
    files = files.groupBy("gallery_key").agg(F.array_join(F.transform(listed, lambda x: x["row"]), "").alias("files_hex"))
    raw = F.concat(codec.hex_text(F.col("namespace")), F.lit("00"), codec.hex_text(F.col("value")))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", codec.frame64_hex(raw).alias("row"))))
    tags = snapshot.tags.groupBy("gallery_key").agg(F.array_join(F.transform(listed, lambda x: x["row"]), "").alias("tags_hex"))
    rows = snapshot.galleries.join(tags, "gallery_key", "left").join(files, "gallery_key", "left")
    body = F.concat(
        F.lit(codec.prefix_hex(codec.MANIFEST_PREFIX)),
        codec.frame64(F.col("gallery_key")), codec.frame64(F.col("gallery_name")), codec.frame64(F.col("gid").cast("string")),
        codec.frame64(F.col("title")), codec.frame64(F.date_format("download_time", "yyyy-MM-dd'T'HH:mm:ss")),
        F.coalesce("tags_hex", F.lit("")), F.coalesce("files_hex", F.lit("")),
    )
    return rows.select("gallery_key", codec.digest_hex(body).alias("source_manifest_sha256"))


def artifact_inputs(
    snapshot: Snapshot, spam: DataFrame, content: DataFrame, owner: DataFrame, winner: DataFrame, manifests: DataFrame, policy: Policy = Policy(), ascii_names: bool = False
) -> DataFrame:
    """One row per gallery with everything that makes up its artifact.

    selected does not ask for content: a gallery of spam alone can hold its gid (see publications).
    """
    owner = owner.select("content_sha256", F.col("gallery_key").alias("content_owner_gallery_key"))
    winner = winner.select("gid", F.col("gallery_key").alias("winner_key"))
    rows = snapshot.galleries.select("gallery_key", "gid").join(content, "gallery_key")
    rows = rows.join(owner, "content_sha256", "left").join(winner, "gid", "left")
    owns = F.col("content_sha256").isNull() | F.col("content_owner_gallery_key").eqNullSafe(F.col("gallery_key"))
    rows = rows.withColumn("selected", owns & F.coalesce(F.col("winner_key") == F.col("gallery_key"), F.lit(False)))
    rows = rows.join(manifests, "gallery_key")
    rows = rows.join(plan_digest(member_plan(snapshot.files, spam, ascii_names)), "gallery_key", "left")
    return rows.select(
        "gallery_key", "gid", "source_manifest_sha256", "plan_digest", "members",
        F.col("content_sha256").alias("effective_content_sha256"), "content_owner_gallery_key", "selected",
        F.lit(policy.version).cast("bigint").alias("policy_version"),
    )


def selected(inputs: DataFrame) -> DataFrame:
    return inputs.where("selected")


def publications(inputs: DataFrame) -> DataFrame:
    """Selected galleries that have effective content."""
    return inputs.where("selected and effective_content_sha256 is not null")


@dataclass(frozen=True)
class Producer:
    """What makes artifacts; its fingerprint changes whenever a part of it does."""

    writer: str
    python: str
    images: str
    jpeg: str
    zlib: str

    @classmethod
    def current(cls, writer: str = "shelfmark-artifact-1") -> Producer:
        """This process. Images are not re-encoded here, so their library and JPEG build are unknown."""
        return cls(writer, sys.implementation.cache_tag or f"cpython-{sys.version_info.major}.{sys.version_info.minor}", "unknown", "unknown", zlib.ZLIB_RUNTIME_VERSION)

    def fingerprint(self) -> Column:
        return codec.producer_fingerprint(*[F.lit(getattr(self, f.name)) for f in fields(self)])


def with_fingerprint(producers: DataFrame) -> DataFrame:
    """producers (writer, python, images, jpeg, zlib) with their fingerprint."""
    return producers.withColumn("fingerprint_sha256", codec.producer_fingerprint(*[F.col(f.name) for f in fields(Producer)]))
