"""The same figures on tables that grow: throughput, meters and selection as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from volframe.operators.curate import KEYS, checks, keep_first
from volframe.operators.telemetry import WINDOW


def live_throughput(log: DataFrame, window: str, late: str, units: float) -> DataFrame:
    """(run, start, steps, rate) of each event-time window; rows later than `late` are left out."""
    seen = log.withWatermark("ts", late).groupBy("run", F.window("ts", window)).agg(F.count("*").alias("steps"))
    seconds = (F.unix_micros("window.end") - F.unix_micros("window.start")) / F.lit(1e6)
    return seen.select("run", F.col("window.start").alias("start"), "steps", (F.col("steps") * F.lit(float(units)) / seconds).alias("rate"))


class LastValues(StatefulProcessor):
    """Keeps the last values of a (run, metric) and, for each new one, gives the meter's figures. Values of one
    micro-batch are taken in order of step; null values are no updates. Of a micro-batch a key's steps and values are held
    as two arrays, and figures go out ROWS_OUT rows at a time."""

    def __init__(self, size: int = WINDOW):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "values array<double>, total double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        values, total, n = self.last.get() if self.last.exists() else ([], 0.0, 0)
        kept = [(r["step"].to_numpy(np.int64), r["value"].to_numpy(np.float64)) for r in (r.dropna(subset=["value"])[["step", "value"]] for r in rows)]
        steps, new = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.argsort(steps, kind="stable")
        steps, new = steps[order], new[order]
        last = np.array(values, np.float64)
        for at in range(0, len(new), ROWS_OUT):
            some = new[at : at + ROWS_OUT]
            held = np.concatenate([last, some])
            so_far = np.cumsum(np.concatenate([[total], some]))[1:]
            figures = pd.DataFrame(meters_of(held, len(last), self.size), columns=["median", "avg", "max"])
            figures = figures.assign(latest=some, global_avg=so_far / np.arange(n + 1, n + 1 + len(some)))
            figures.insert(0, "step", steps[at : at + ROWS_OUT])
            figures.insert(0, "metric", key[1])
            figures.insert(0, "run", key[0])
            yield figures
            last, total, n = held[-self.size :], float(so_far[-1]), n + len(some)
        self.last.update((last.tolist(), total, n))

    def close(self) -> None:
        pass


#: Rows of a frame that the meters give at a time.
ROWS_OUT = 8192


def meters_of(values: np.ndarray, first: int, size: int) -> np.ndarray:
    """[value, (lower median, mean, maximum)] of the last `size` values up to each one, from the first-th on."""
    early = [values[: i + 1] for i in range(first, min(len(values), size - 1))]  # fewer than `size` values so far
    short = np.array([(np.sort(w)[(len(w) - 1) // 2], w.sum() / len(w), w.max()) for w in early]).reshape(-1, 3)
    if len(values) < max(size, first + 1):
        return short
    windows = np.lib.stride_tricks.sliding_window_view(values, size)[max(first - size + 1, 0) :]
    return np.concatenate([short, np.stack([np.sort(windows, 1)[:, (size - 1) // 2], windows.sum(1) / size, windows.max(1)], 1)])


METERS = "run string, metric string, step long, median double, avg double, max double, latest double, global_avg double"


def live_meters(updates: DataFrame, window: int = WINDOW) -> DataFrame:
    """The figures of rolling_meters for (run, metric, step, value) rows as they come. Needs the RocksDB state store."""
    return updates.groupBy("run", "metric").transformWithStateInPandas(LastValues(window), METERS, "Append", "None")


def live_selection(images: DataFrame) -> DataFrame:
    """The selection as manifests arrive, in update mode: a key's row is replaced when a smaller path comes."""
    passed = checks(images).where("labelled AND clean AND extended").drop("labelled", "clean", "extended")
    return keep_first(passed, KEYS, "path")


class _Enough(Exception):
    """Ends a stream before its next micro-batch is looked at."""


def advance(stream: DataFrame, mode: str, out: str, checkpoint: str, most_batches: int | None = None) -> int:
    """Run a stream over what is there, or over most_batches micro-batches of it, and stop between two; gives their number.

    The next call with the same checkpoint goes on with the first micro-batch that was not finished: its rows, its state
    and its number are in the checkpoint, which must lie where the next driver finds it. A micro-batch's rows are written
    below out under its number, over what an unfinished attempt may have left, so that each is there once however often
    a stream was stopped or lost.
    """
    done = 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal done
        if most_batches is not None and done >= most_batches:
            raise _Enough
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done += 1

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if _Enough.__name__ not in str(e):
            raise
    return done


def finished(stream: DataFrame, mode: str, out: str, checkpoint: str) -> int:
    """advance() to the end of what is there."""
    return advance(stream, mode, out, checkpoint)
