"""Relations, policy and the rows that break their rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The metadata file that is no content, and the tag value of what is already uploaded.
METADATA_FILE = "galleryinfo.txt"
UPLOADED = "already uploaded"

GALLERIES = "gallery_key string, gallery_name string, gid bigint, title string, download_time timestamp_ntz"
FILES = "gallery_key string, name string, sha256 string, size_bytes bigint"
TAGS = "gallery_key string, ordinal int, namespace string, value string"


@dataclass(frozen=True)
class Policy:
    """Thresholds of the spam verdict; the version takes part in every artifact's identity."""

    min_occurrences: int = 3
    artist_ratio: int = 2
    version: int = 1


@dataclass(frozen=True)
class Context:
    """Where a snapshot stands: scope, channel, revision (from 1) and head generation (from 0)."""

    scope: str
    channel: str
    revision: int
    generation: int

    def __post_init__(self):
        if self.revision < 1 or self.generation < 0:
            raise ValueError("revision starts at 1 and generation at 0")


@dataclass(frozen=True)
class Snapshot:
    """One observed corpus: galleries, their files and their tags."""

    galleries: DataFrame
    files: DataFrame
    tags: DataFrame


#: Bytes of a receipt and of a protection token.
RECEIPT_BYTES, TOKEN_BYTES = 16, 184


def revision(value: int) -> int:
    """A catalogue revision: a whole number from 1, below 2^63."""
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value < 1 << 63:
        raise ValueError("a revision is a whole number from 1, below 2^63")
    return value


def exact_bytes(value: bytes, size: int, what: str) -> bytes:
    """Bytes of exactly this length."""
    if type(value) is not bytes or len(value) != size:
        raise ValueError(f"{what} has exactly {size} bytes")
    return value


def receipt(value: bytes) -> bytes:
    return exact_bytes(value, RECEIPT_BYTES, "a receipt")


def token(value: bytes) -> bytes:
    return exact_bytes(value, TOKEN_BYTES, "a protection token")


def is_sha256(column):
    """64 lower-case hexadecimal digits."""
    return F.coalesce(column.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_component(column):
    """A path component: 1 to 255 bytes, neither . nor .., without a slash."""
    return F.coalesce(F.octet_length(column).between(1, 255) & ~column.isin(".", "..") & ~column.contains("/"), F.lit(False))


def is_key_segment(column):
    """A component that may enter a gallery key: no backslash and no NUL either."""
    return is_component(column) & F.coalesce(~column.contains("\\") & ~column.contains("\x00"), F.lit(False))


def is_uint64(column):
    return F.coalesce(column.cast("decimal(38,0)").between(F.lit("0").cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)")), F.lit(False))


def is_int63(column):
    return F.coalesce(column >= 0, F.lit(False))


def violations(snapshot: Snapshot) -> DataFrame:
    """(rule, gallery_key, detail) of every broken rule; empty for a valid snapshot."""

    def rows(df, rule, detail):
        return df.select(F.lit(rule).alias("rule"), "gallery_key", F.col(detail).cast("string").alias("detail"))

    g, f, t = snapshot.galleries, snapshot.files, snapshot.tags
    repeated_keys = g.groupBy("gallery_key").count().where("count > 1")
    repeated_names = f.groupBy("gallery_key", "name").count().where("count > 1")
    found = [
        rows(g.where("gid is null or gid <= 0"), "gid_positive", "gid"),
        rows(g.where("title is null"), "title_present", "title"),
        rows(repeated_keys, "gallery_key_unique", "count"),
        rows(repeated_names, "file_name_unique", "name"),
        rows(f.where(~is_component(F.col("name"))), "file_name_component", "name"),
        rows(f.where(~is_sha256(F.col("sha256"))), "file_sha256", "sha256"),
        rows(f.where(~is_int63(F.col("size_bytes"))), "file_size", "size_bytes"),
        rows(f.join(g, "gallery_key", "left_anti"), "file_gallery_exists", "name"),
        rows(t.join(g, "gallery_key", "left_anti"), "tag_gallery_exists", "ordinal"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
