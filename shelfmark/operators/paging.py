"""Keyset and offset pages, page numbers, and checks of page order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import written

#: The largest page of the scanner, of adapters, and of a projection.
SCANNER_PAGE, ADAPTER_PAGE, PROJECTION_PAGE = 256, 128, 128


def page_limit(limit: int, most: int = SCANNER_PAGE) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise TypeError("a page limit is an int")
    if not 1 <= limit <= most:
        raise ValueError(f"a page limit lies in 1..{most}")
    return limit


@dataclass(frozen=True)
class Page:
    items: DataFrame
    terminal: bool
    next_after: object


def keyset_page(rows: DataFrame, key: str, after, limit: int, most: int = SCANNER_PAGE) -> Page:
    """The next rows by key after a cursor. One row more than asked for tells whether it is the last page."""
    page_limit(limit, most)
    if after is not None:
        rows = rows.where(F.col(key) > F.lit(after))
    some = rows.orderBy(key).limit(limit + 1)
    keys = [r[0] for r in some.select(key).orderBy(key).collect()]  # limit + 1 rows at most
    terminal = len(keys) <= limit
    items = some.orderBy(key).limit(limit)
    return Page(items, terminal, None if terminal else keys[limit - 1])


def offset_page(rows: DataFrame, ordinal: str, position: int, limit: int, most: int = SCANNER_PAGE) -> Page:
    """Rows whose ordinal lies in [position, position + limit)."""
    page_limit(limit, most)
    some = rows.where((F.col(ordinal) >= position) & (F.col(ordinal) <= position + limit)).orderBy(ordinal)
    keys = [r[0] for r in some.select(ordinal).collect()]
    terminal = len(keys) <= limit
    return Page(some.where(F.col(ordinal) < position + limit), terminal, None if terminal else keys[limit - 1])


def numbered(rows: DataFrame, partition: list[str], keys: list[str], limit: int) -> DataFrame:
    """All pages at once: page and place of each row, and whether its page is its list's last."""
    order = Window.partitionBy(*partition).orderBy(*keys)
    place = F.row_number().over(order) - 1
    count = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    rows = rows.withColumn("place", place.cast("bigint")).withColumn("page", F.expr(f"place div {limit}"))
    return rows.withColumn("terminal", F.expr(f"(page + 1) * {limit}") >= count)


def ranged(rows: DataFrame, key: str, limit: int, spread: int = 64) -> DataFrame:
    """numbered() for one long list, without gathering it in one task.

    The rows are range-partitioned by key and written with their range, so that numbers and counts see
    the same ranges; rows are numbered within ranges, and the counts of the ranges, one row each, are summed and added.
    """
    parts = rows.repartitionByRange(spread, key).withColumn("range", F.spark_partition_id())
    parts = written(parts, "ranges")
    counts = parts.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    ranges = Window.orderBy("range")  # spread rows
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("total", F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    found = parts.join(F.broadcast(counts.drop("n")), "range")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    found = found.withColumn("place", (F.col("before") + inside).cast("bigint")).withColumn("page", F.expr(f"place div {limit}"))
    return found.withColumn("terminal", F.expr(f"(page + 1) * {limit} >= total")).drop("range", "before", "total")


def cursors(pages: DataFrame, partition: list[str], key: str) -> DataFrame:
    """(partition, page, items, next_after): the cursor after each page; null after the last."""
    found = pages.groupBy(*partition, "page").agg(F.count(F.lit(1)).alias("items"), F.max(key).alias("last"), F.bool_or("terminal").alias("terminal"))
    return found.withColumn("next_after", F.when(~F.col("terminal"), F.col("last"))).drop("last")


def increasing(rows: DataFrame, partition: list[str], ordinal: str, key: str) -> DataFrame:
    """Per list: whether keys strictly increase by ordinal."""
    before = F.lag(key).over(Window.partitionBy(*partition).orderBy(ordinal))
    rows = rows.withColumn("ok", F.coalesce(before < F.col(key), before.isNull()))
    return rows.groupBy(*partition).agg(F.bool_and("ok").alias("increasing"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def advances(first_key: Column, cursor: Column) -> Column:
    """Whether a page lies beyond the cursor."""
    return cursor.isNull() | (first_key > cursor)
