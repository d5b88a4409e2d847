"""Digests of what was observed, and checks that it is observed again unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import codec

#: The types of directory entries.
REGULAR, DIRECTORY, SYMLINK, OTHER = 0, 1, 2, 3


def entry_frame() -> Column:
    """Name, device, inode, size, times and type of an entry, as hexadecimal text."""
    return F.concat(
        codec.frame32(F.col("name")), codec.hex_u64(F.col("device")), codec.hex_u64(F.col("inode")), codec.hex_u64(F.col("size_bytes")),
        codec.hex_u64(F.col("modified_ns")), codec.hex_u64(F.col("changed_ns")), F.lpad(F.hex(F.col("file_type").cast("bigint")), 2, "0"),
    )


def entry_audit(entries: DataFrame) -> DataFrame:
    """(gallery_key, entry_audit, regular_files): one digest over a directory's entries by name."""
    listed = F.array_sort(F.collect_list(F.struct(F.encode("name", "UTF-8").alias("k"), entry_frame().alias("row"))))
    body = F.concat(F.lit(codec.prefix_hex(codec.ENTRY_PREFIX)), F.array_join(F.transform(listed, lambda x: x["row"]), ""))
    return entries.groupBy("gallery_key").agg(codec.digest_hex(body).alias("entry_audit"), F.count_if(F.col("file_type") == REGULAR).alias("regular_files"))


def metadata_audit(galleries: DataFrame) -> DataFrame:
    """(gallery_key, metadata_audit): seven 16-byte numbers and three framed texts."""
    numbers = ("gid", "upload_time", "download_micros", "modified_time", "scan_version", "source_file_count", "page_count")
    body = F.concat(
        F.lit(codec.prefix_hex(codec.METADATA_PREFIX)),
        *[codec.hex_i128(F.col(c)) for c in numbers],
        *[codec.frame64(F.col(c)) for c in ("title", "comment", "upload_account")],
    )
    return galleries.select("gallery_key", codec.digest_hex(body).alias("metadata_audit"))


def replay_violations(recorded: DataFrame, again: DataFrame) -> DataFrame:
    """(gallery_key, fault): observations that a second look does not confirm."""
    a = recorded.select("gallery_key", F.col("entry_audit").alias("a"))
    b = again.select("gallery_key", F.col("entry_audit").alias("b"))
    fault = F.when(F.col("a").isNull(), "appeared").when(F.col("b").isNull(), "vanished").otherwise("changed")
    return a.join(b, "gallery_key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("gallery_key", fault.alias("fault"))


def audit_lookup(locators: DataFrame, audits: DataFrame) -> DataFrame:
    """locators with their recorded audit; those without one are to be observed."""
    found = locators.join(audits.select("gallery_key", "entry_audit"), "gallery_key", "left")
    return found.withColumn("observe", F.col("entry_audit").isNull())


#: Fixed value: what a file is recognised by.
STAT = ("device", "inode", "size_bytes", "modified_ns", "changed_ns")


def encode_stat(rows: DataFrame) -> DataFrame:
    """rows with device and inode as eight bytes each, as they are stored."""
    return rows.withColumns({c: codec.encode_u64(F.col(c)) for c in STAT[:2]})


def decode_stat(rows: DataFrame) -> DataFrame:
    """rows with device and inode as numbers again; a malformed row is an error when it is read."""
    bad = F.raise_error(F.lit("a stored stat has two blobs of eight bytes and three numbers"))
    good = F.lit(True)
    for c in STAT:
        good = good & (F.length(c) == 8 if c in STAT[:2] else F.col(c).isNotNull())
    return rows.withColumns({c: F.when(F.coalesce(good, F.lit(False)), codec.decode_u64(F.col(c))).otherwise(bad) for c in STAT[:2]})
