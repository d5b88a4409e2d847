"""Protection tokens, which only ever go from protected to released."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outcomes(log: DataFrame) -> DataFrame:
    """The log (token, seq, op, locator) with the result of each protect or release.

    A token is bound to the locator it came with first; after its release nothing protects it again.
    """
    before = Window.partitionBy("token").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bound = F.first("locator").over(Window.partitionBy("token").orderBy("seq"))
    released = F.coalesce(F.bool_or(F.col("op") == "release").over(before), F.lit(False))
    seen = F.coalesce(F.bool_or(F.col("op") == "protect").over(before), F.lit(False))
    result = (
        F.when(F.col("locator") != bound, "ERROR_LOCATOR")
        .when(F.col("op") == "release", F.when(released, "ALREADY_RELEASED").otherwise("RELEASED"))
        .when(released, "NOT_STORED").when(seen, "ALREADY_PROTECTED").otherwise("PROTECTED")
    )
    return log.withColumn("result", result)


def states(log: DataFrame) -> DataFrame:
    """(token, locator, state, events): the last state of each token."""
    return log.groupBy("token").agg(
        F.min_by("locator", "seq").alias("locator"),
        F.when(F.bool_or(F.col("op") == "release"), "RELEASED").otherwise("PROTECTED").alias("state"),
        F.count(F.lit(1)).alias("events"),
    )
