"""Leases of workers as a table of events: claim, renew, complete, fail and poll."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timeline(events: DataFrame, seconds: int) -> DataFrame:
    """events (worker, seq, at_micros, kind) with term, live, result and expires_micros.

    A claim starts a term and lives for `seconds`; each renewal in time extends it; the first that comes late
    ends it, and only a new claim helps. Completion ends a term. A failure does not: its lease runs out.
    """
    length = seconds * 1_000_000
    run = Window.partitionBy("worker").orderBy("at_micros", "seq")
    rows = events.withColumn("term", F.count_if(F.col("kind").isin("claim", "complete")).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a completion belongs to the term that it ends
    rows = rows.withColumn("term", F.when(F.col("kind") == "complete", F.col("term") - 1).otherwise(F.col("term")))
    rows = rows.withColumn("opens", F.count_if(F.col("kind") == "claim").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > 0)
    inside = Window.partitionBy("worker", "term").orderBy("at_micros", "seq")
    extends = F.col("kind").isin("claim", "renew")
    claimed = F.bool_or(F.col("kind") == "claim").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    previous = F.last(F.when(extends, F.col("at_micros")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("claimed", claimed).withColumn("previous", previous)
    late = F.coalesce(extends & (F.col("kind") != "claim") & (F.col("at_micros") - F.col("previous") > length), F.lit(False))
    rows = rows.withColumn("broken", F.bool_or(late).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    on_time = F.coalesce(F.col("at_micros") - F.col("previous") <= length, F.lit(False))
    live = F.when(F.col("kind") == "claim", True).otherwise(F.col("claimed") & ~F.col("broken") & on_time)
    rows = rows.withColumn("live", live)
    result = (
        F.when(F.col("kind") == "claim", "granted")
        .when(F.col("kind") == "renew", F.when(F.col("live"), "extended").otherwise("rejected"))
        .when(F.col("kind") == "complete", F.when(F.col("live"), "completed").otherwise("rejected"))
        .when(F.col("kind") == "fail", F.when(F.col("live"), "failed").otherwise("idle"))
        .otherwise(F.when(F.col("live"), "busy").otherwise("idle"))
    )
    expires = F.when(F.col("result").isin("granted", "extended"), F.col("at_micros") + length)
    rows = rows.withColumn("result", result).withColumn("expires_micros", expires)
    return rows.select("worker", "seq", "at_micros", "kind", "term", "live", "result", "expires_micros")


def expired(lines: DataFrame, now_micros: DataFrame) -> DataFrame:
    """(worker, term, expires_micros): terms that ran out before the one value of now_micros."""
    ends = lines.where(F.col("result").isin("granted", "extended", "completed")).groupBy("worker", "term").agg(
        F.max("expires_micros").alias("expires_micros"), F.bool_or(F.col("result") == "completed").alias("completed")
    )
    return ends.crossJoin(F.broadcast(now_micros)).where("not completed and expires_micros < now_micros").select("worker", "term", "expires_micros")


def sticky(lines: DataFrame) -> DataFrame:
    """lines with poisoned: the worker failed earlier in this term, so its calls fail too."""
    before = Window.partitionBy("worker", "term").orderBy("at_micros", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("poisoned", F.coalesce(F.bool_or(F.col("result") == "failed").over(before), F.lit(False)))


def schedule(events: DataFrame, scan_seconds: int, poll_seconds: int) -> DataFrame:
    """(worker, seq, tick, scan, next_poll_micros): the first event of each scan interval starts a scan."""
    run = Window.partitionBy("worker").orderBy("at_micros", "seq")
    first = F.first("at_micros").over(run)
    rows = events.withColumn("first", first).withColumn("tick", F.expr(f"(at_micros - first) div {scan_seconds * 1_000_000}"))
    rows = rows.withColumn("scan", F.coalesce(F.lag("tick").over(run) != F.col("tick"), F.lit(True)))
    wait = F.when(F.col("kind") == "complete", 0).otherwise(poll_seconds * 1_000_000)  # after a success it goes on at once
    return rows.select("worker", "seq", "tick", "scan", (F.col("at_micros") + wait).alias("next_poll_micros"))
