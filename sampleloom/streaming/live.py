"""Streaming twins: mergeable confusion counts, windows, sessions and running z-scores over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_table(spark, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def confusion_stream(stream: DataFrame, prediction: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Counts by prediction and target, updated as sets arrive (update or complete mode)."""
    return stream.groupBy(*(by or []), F.col(prediction).alias("prediction"), F.col(target).alias("target")).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str, size: str, slide: str | None, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Mean and count over tumbling or sliding windows; rows later than ``late`` are left out, state is bounded by it."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "mean", "n")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Runs of events no further apart than ``gap``."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_zscore(stream: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """Each value less the mean so far over the deviation so far, per key: constant state of three numbers a key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(stream.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        rows = []
        for x, t in ((r[value], r[time]) for r in pd.concat(list(batches)).sort_values(time).to_dict("records")):
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
            sd = (m2 / n) ** 0.5
            rows.append((k[0], t, x, (x - mean) / sd if sd > 0 else 0.0))
        state.update((n, mean, m2))
        yield pd.DataFrame(rows, columns=[key, time, value, "z"])

    out = f"{key} {kind}, {time} {dict(stream.dtypes)[time]}, {value} double, z double"
    return stream.groupBy(key).applyInPandasWithState(run, out, "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str, sink: Callable | None = None) -> None:
    """Runs a stream over what is there now, into a memory table or through ``sink(batch, id)``."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("memory").queryName(name)).start()
    q.awaitTermination()
