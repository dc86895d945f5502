"""The limiter and the result log as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import politeness as P
from ..plans.storage import fresh

_STATE = "rate double, top double, tokens double, burst double, updated double, blocked_until double, streak int, throttled int"


#: A host that has no event for so long (in the events' time) begins anew, and its state goes; events that come later than that are dropped.
IDLE_S = 86_400 * 7


def limiter(events: DataFrame, limits: P.Limits = P.Limits(), idle_s: int = IDLE_S) -> DataFrame:
    """The streaming twin of ``politeness.replay``: keyed state by host, which expires; a micro-batch's events of a host are put in order first, so it is the trigger that bounds what a task holds."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own: dict[str, P.Bucket] = {}
        if state.exists:
            own[key[0]] = P.Bucket(*state.get)
        held = list(parts)
        rows = held[0] if len(held) == 1 else pd.concat(held)
        rows = rows.take(np.lexsort((rows["seq"].to_numpy(), rows["ts"].to_numpy())))
        out = P.fold(rows, own, limits)
        state.update(P.packed(own[key[0]]))
        state.setTimeoutTimestamp(max(int(rows["ts"].iloc[-1] * 1000), state.getCurrentWatermarkMs()) + idle_s * 1000)
        yield out

    timed = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{idle_s} seconds")
    return timed.groupBy("host").applyInPandasWithState(run, P.SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def pages_per_window(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Results by tumbling window; rows later than the watermark are dropped."""
    w = F.window("ts", width)
    return log.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("ok")).alias("n_ok")).select(F.col("w.start").alias("start"), "n", "n_ok")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there, into the shared folder, and read the result."""
    spark = stream.sparkSession
    path = fresh(spark, name)
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
