"""Friendly file names and paths, and thumbnail sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The groupings of published paths by upload date (UTC).
GROUPINGS = {"flat": None, "yyyy": "yyyy", "yyyy_mm": "yyyy/MM", "yyyy_mm_dd": "yyyy/MM/dd"}
MOST_BYTES = 255


def friendly_leaf(gid: Column, name: Column) -> Column:
    """`<gid> - <name>.cbz` of at most 255 bytes: the name loses whole characters at its end."""
    safe = F.translate(name, "/\\\x00", "___")
    safe = F.when(safe == "", F.lit("gallery")).otherwise(safe)
    head = F.concat(gid.cast("string"), F.lit(" - "))
    room = F.lit(MOST_BYTES - len(".cbz")) - F.octet_length(head)
    # a name fits, or its longest prefix that does is looked up among the possible lengths
    lengths = F.sequence(F.lit(0), F.least(F.char_length(safe), room))
    cut = F.array_max(F.filter(lengths, lambda n: F.octet_length(F.left(safe, n)) <= room))
    fitted = F.when(F.octet_length(safe) <= room, safe).otherwise(F.left(safe, cut))
    return F.concat(head, fitted, F.lit(".cbz"))


def friendly_path(gid: Column, name: Column, upload_micros: Column, grouping: str) -> Column:
    leaf = friendly_leaf(gid, name)
    pattern = GROUPINGS[grouping]
    if pattern is None:
        return leaf
    return F.concat(F.date_format(F.timestamp_micros(upload_micros), pattern), F.lit("/"), leaf)


def is_safe_path(path: Column) -> Column:
    """Relative, without empty, . or .. parts and without NUL."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..")) | path.contains("\x00")
    return F.coalesce(~bad, F.lit(False))


def thumbnail_size(width: str, height: str, short_side: str) -> tuple[Column, Column]:
    """Width and height, from columns of these names, with the shorter side at most short_side; never larger than before."""
    w, h, s = F.col(width), F.col(height), F.col(short_side)
    tall = h >= w
    bound_w = F.when(tall, s).otherwise(F.greatest(F.lit(1), F.expr(f"{short_side} * {width} div {height}")))
    bound_h = F.when(tall, F.greatest(F.lit(1), F.expr(f"{short_side} * {height} div {width}"))).otherwise(s)
    shrink = (w > bound_w) | (h > bound_h)
    return F.when(shrink, bound_w).otherwise(w), F.when(shrink, bound_h).otherwise(h)
