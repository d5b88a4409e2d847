"""Framed hashes, locator payloads and other byte-exact encodings, as Columns.

Bytes are built as upper-case hexadecimal text and turned into binary once, by unhex.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The prefixes that separate the hash domains.
GALLERY_KEY_PREFIX = "shelfmark.gallery-key.1"
MANIFEST_PREFIX = "shelfmark.source-manifest.1"
PUBLICATION_PREFIX = "shelfmark.publication.1"
METADATA_PREFIX = "shelfmark.metadata-audit.1"
ENTRY_PREFIX = "shelfmark.entry-audit.1"
PRODUCER_PREFIX = "shelfmark.producer.1"


def hex_text(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def hex_u32(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("bigint")), 8, "0")


def hex_u64(n: Column) -> Column:
    """Eight bytes, big endian; negative numbers in two's complement."""
    return F.lpad(F.hex(n.cast("bigint")), 16, "0")


def hex_i128(n: Column) -> Column:
    """Sixteen bytes, big endian, signed."""
    return F.concat(F.when(n < 0, F.lit("F" * 16)).otherwise(F.lit("0" * 16)), hex_u64(n))


def encode_u64(n: Column) -> Column:
    """Eight bytes, big endian, of a whole number from 0 to 2^64 - 1; null outside."""
    fits = n.between(F.lit("0").cast("decimal(20,0)"), F.lit("18446744073709551615").cast("decimal(20,0)"))
    # the cast is an error past 20 digits, and conv() past 64 bits: neither sees a number that does not fit
    return F.unhex(F.lpad(F.conv(F.when(fits, n).cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))


def decode_u64(raw: Column) -> Column:
    """The number (decimal(20,0)) of eight bytes, big endian; null for any other length."""
    return F.when(F.length(raw) == 8, F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)"))


def producer_fingerprint(*parts: Column) -> Column:
    """The digest of what made an artifact: writer, Python, image library, JPEG and zlib builds, each framed."""
    return digest_hex(F.concat(F.lit(prefix_hex(PRODUCER_PREFIX)), *[frame32(p) for p in parts]))


def frame32(text: Column) -> Column:
    return F.concat(hex_u32(F.octet_length(text)), hex_text(text))


def frame64(text: Column) -> Column:
    return F.concat(hex_u64(F.octet_length(text)), hex_text(text))


def frame64_hex(raw: Column) -> Column:
    """A frame of bytes given as hexadecimal text."""
    return F.concat(hex_u64(F.length(raw) / 2), raw)


def prefix_hex(prefix: str) -> str:
    return prefix.encode().hex().upper() + "00"


def digest_hex(raw: Column) -> Column:
    """SHA-256 of bytes given as hexadecimal text."""
    return F.sha2(F.unhex(raw), 256)


def locator_payload(components: Column) -> Column:
    """Version, count, then length and bytes of each component: the order of locators (binary)."""
    body = F.array_join(F.transform(components, frame32), "")
    return F.unhex(F.concat(F.lit("00000001"), hex_u32(F.size(components)), body))


def gallery_key(scope: Column, components: Column) -> Column:
    """The stable key of a gallery in a scope (64 hexadecimal digits)."""
    body = F.array_join(F.transform(components, frame32), "")
    return digest_hex(F.concat(F.lit(prefix_hex(GALLERY_KEY_PREFIX) + "00000001"), F.upper(scope), hex_u32(F.size(components)), body))


def publication_key(gid: Column) -> Column:
    return digest_hex(F.concat(F.lit(prefix_hex(PUBLICATION_PREFIX) + "00000001"), hex_u64(gid)))


def artifact_locator(sha256: Column) -> Column:
    return F.concat(F.lit("sha256/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit(".cbz"))


def is_artifact_locator(locator: Column) -> Column:
    """Well formed, and filed under its own first two digits."""
    found = locator.rlike(r"^sha256/[0-9a-f]{2}/[0-9a-f]{64}\.cbz$") & (F.substring(locator, 8, 2) == F.substring(locator, 11, 2))
    return F.coalesce(found, F.lit(False))


def locator_digest(locator: Column) -> Column:
    return F.substring(locator, 11, 64)


def wall_micros(time: Column) -> Column:
    """Microseconds since 1970 of a UTC wall time; null before that."""
    micros = F.unix_micros(time.cast("timestamp"))
    return F.when(micros >= 0, micros)


@F.pandas_udf(T.StringType())
def _casefold(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.ArrayType(T.StringType()))
def decode_locator(payloads: pd.Series) -> pd.Series:
    """The components of a payload; null if it is malformed."""

    def one(raw):
        if raw is None or len(raw) < 8 or raw[:4] != b"\x00\x00\x00\x01":
            return None
        at, out = 8, []
        for _ in range(int.from_bytes(raw[4:8], "big")):
            size = int.from_bytes(raw[at : at + 4], "big")
            value = raw[at + 4 : at + 4 + size]
            if len(raw) < at + 4 or len(value) != size:
                return None
            at += 4 + size
            try:
                text = value.decode()
            except UnicodeDecodeError:
                return None
            if not 1 <= size <= 255 or text in (".", "..") or "/" in text:
                return None
            out.append(text)
        return out if out and at == len(raw) else None

    return payloads.map(lambda x: one(None if x is None else bytes(x)))


def casefold(name: Column) -> Column:
    """Full Unicode case folding, by Python."""
    return _casefold(name)


def fold_ascii(name: Column) -> Column:
    """Case folding of names known to be ASCII, in the JVM."""
    return F.lower(name)


def fold(names, name: str = "name"):
    """names with a column `fold`: ASCII names in the JVM, the others by the pandas UDF.

    Spark evaluates a Python UDF for all rows of its input, so the two kinds are split first.
    """
    ascii_only = F.col(name).rlike(r"^[\x00-\x7F]*$")
    plain = names.where(ascii_only).withColumn("fold", fold_ascii(F.col(name)))
    return plain.unionByName(names.where(~ascii_only).withColumn("fold", casefold(F.col(name))))
