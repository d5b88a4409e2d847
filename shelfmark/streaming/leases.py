"""The lease timeline as a stateful stream: one state per worker, kept until the stream ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.session import scratch

OUTPUT = "worker bigint, seq bigint, kind string, live boolean, result string, expires_micros bigint"


def fold(seconds: int):
    length = seconds * 1_000_000

    def update(key, batches, state: GroupState):
        ends = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at_micros", "seq"])
        out = []
        for seq, at, kind in zip(rows["seq"], rows["at_micros"], rows["kind"]):
            live = kind == "claim" or (ends is not None and at <= ends)
            if kind == "claim":
                result, ends = "granted", at + length
            elif kind == "renew":
                result = "extended" if live else "rejected"
                ends = at + length if live else ends
            elif kind == "complete":
                result, ends = ("completed" if live else "rejected"), None
            elif kind == "fail":
                result = "failed" if live else "idle"
            else:
                result = "busy" if live else "idle"
            out.append((key[0], seq, kind, bool(live), result, ends if result in ("granted", "extended") else None))
        state.update((None if ends is None else int(ends),))
        frame = pd.DataFrame(out, columns=["worker", "seq", "kind", "live", "result", "expires_micros"])
        frame["expires_micros"] = frame["expires_micros"].astype("Int64")
        yield frame

    return update


def lease_stream(events: DataFrame, seconds: int) -> DataFrame:
    """A streaming DataFrame of calls to their results; events of a worker must not come late."""
    return events.groupBy("worker").applyInPandasWithState(fold(seconds), OUTPUT, "ends bigint", "append", GroupStateTimeout.NoTimeout)


def lease_stream_check(spark: SparkSession, calls: DataFrame, seconds: int) -> DataFrame:
    """Write the calls (worker, seq, at_micros, kind) and stream them through the leases into another table."""
    arrivals, out = scratch(spark, "lease-calls"), scratch(spark, "lease-stream")
    calls.write.mode("overwrite").parquet(arrivals)
    stream = spark.readStream.schema(calls.schema).parquet(arrivals)
    run = lease_stream(stream, seconds).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    run.start(f"{out}/out").awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{out}/out")
