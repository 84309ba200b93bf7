"""Structured Streaming operators (ops 133-135).

Sources are file streams over the transaction table; dimensions are joined
stream-static.  Every micro-batch overwrites its own ``batch_id=`` folder of
the output, so a batch that is replayed after a failure replaces its rows
instead of adding them again; checkpoints lie in the shared folder.
By default an operator processes what is there, stops and returns the result
(``availableNow``), which is also how the tests compare them with their batch
twins.  With a ``trigger``, such as ``{"processingTime": "10 seconds"}``, it goes
on until it is stopped and returns a ``Running`` stream whose results can be read
at any time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from txrisk.operators.history import US_PER_HOUR, epoch_micros


def file_stream(spark: SparkSession, directory: str, glob: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    """Stream the Parquet files of ``directory`` matching ``glob`` (new files are
    picked up as they land)."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(directory).schema  # fixed schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory)


@dataclass
class Running:
    """A stream that goes on: its query and what it has written so far."""

    query: StreamingQuery
    read: Callable[[], DataFrame]

    def stop(self) -> None:
        self.query.stop()


#: Keyed state of any size lies on the executors' disks, and the map states of op 134 need this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _run(df: DataFrame, out_path: str, ckpt: str, trigger: dict | None, mode: str = "append",
         result: Callable[[DataFrame], DataFrame] = lambda df: df.drop("batch_id"),
         settings: dict | None = None) -> DataFrame | Running:
    """Run ``df`` into ``out_path``, one folder per micro-batch; ``result`` of all of them.

    ``settings`` hold for this query alone (a query takes those of its start).
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])
    # a stream without rows has an output too
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{out_path}/batch_id=-1")

    def sink(batch: DataFrame, bid: int):
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={bid}")

    def read() -> DataFrame:
        return result(spark.read.schema(schema).parquet(out_path))

    w = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", ckpt)
    before = {k: spark.conf.get(k) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        query = w.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if trigger:
        return Running(query, read)
    query.awaitTermination()
    return read()


# op 133
def stream_risk_windows(tx_stream: DataFrame, out_path: str, ckpt: str, watermark: str = "2 hours",
                        window: str = "1 hour", ts: str = "ts", group: str = "channel",
                        label: str = "is_fraud", trigger: dict | None = None) -> DataFrame | Running:
    """Fraud count/rate per group per tumbling window; rows later than the
    watermark are dropped by the state store.  Every micro-batch writes its
    updates; the final table keeps the latest version of each window."""
    s = tx_stream.select(F.col(ts).cast("timestamp").alias("event_time"), group, label)
    agg = (s.withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", window), group)
           .agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("fraud_cases")))
    out = agg.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("window.end").cast("timestamp_ntz").alias("window_end"), group, "n", "fraud_cases")

    def latest(res: DataFrame) -> DataFrame:
        last = res.groupBy("window_start", "window_end", group).agg(
            F.max_by(F.struct("n", "fraud_cases"), "batch_id").alias("v"))
        return last.select("window_start", "window_end", group, "v.n", "v.fraud_cases",
                           (F.col("v.fraud_cases").cast("double") / F.col("v.n") * 100).alias("fraud_rate_pct"))

    return _run(out, out_path, ckpt, trigger, mode="update", result=latest)


# op 134
UNITS = 1_000_000  # amounts are summed as whole millionths: exact, up to 9.2e12 in a customer's frame
MINUTE = 60_000_000
DAY = 1440  # minutes
FEW = 256  # times of a key's day that are kept in one entry


def merged(*parts: np.ndarray) -> np.ndarray:
    """Rows t, n, units with every time once, by time."""
    t, n, units = np.concatenate(parts, axis=1)
    at, place = np.unique(t, return_inverse=True)
    out = np.zeros((3, len(at)), np.int64)
    out[0] = at
    np.add.at(out[1], place, n)
    np.add.at(out[2], place, units)
    return out


class Velocity(StatefulProcessor):
    """Count and sum of a key's rows in the frame [t - window, t] of each row.

    State per key: entries by their first minute, of all minutes that a row can still need, at
    most window + watermark + a day.  A day of at most ``FEW`` times is one entry, which holds
    them with their totals; a fuller day has an entry of totals for every minute, and minute by
    minute the times in it with their own totals.  So a key of few rows costs a call of the
    state per day and not per row, and a batch reads of a crowded key the totals and, of the
    times, those of the minutes in which its rows' frames begin or end; it writes the days or
    minutes of its own rows.  A timer at the end of the oldest entry's use removes what the
    watermark has passed, and sets itself anew while entries are left.
    """

    def __init__(self, window_us: int, columns: list[str]):
        self.window, self.columns = window_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getMapState("totals", "minute long",
                                         "minutes long, n long, units long, t array<long>, ns array<long>, unitss array<long>")
        self.times = handle.getMapState("times", "minute long", "t array<long>, n array<long>, units array<long>")
        self.untimed = handle.getValueState("untimed", "n long, units long")
        self.timer = handle.getValueState("timer", "at long")

    def _set_timer(self, last: int) -> None:
        """At the end of the use of an entry whose last minute is ``last``."""
        at = ((last + 1) * MINUTE + self.window) // 1000 + 1
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _times(self, minute: int) -> np.ndarray:
        """t, n, units (rows) of a minute."""
        found = self.times.getValue((int(minute),))
        return np.array(found, np.int64).reshape(3, -1) if found is not None else np.zeros((3, 0), np.int64)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)  # one key's rows of a batch
        amount = pdf["amount"].to_numpy(np.float64)
        known = ~np.isnan(amount)  # null amounts neither count nor add; their rows have frames like others
        units = np.rint(np.nan_to_num(amount) * UNITS).astype(np.int64)
        timed = pdf["timed"].to_numpy(bool)
        n, total = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        if not timed.all():
            seen = self.untimed.get() or (0, 0)
            here = ~timed & known
            seen = (int(seen[0] + here.sum()), int(seen[1] + units[here].sum()))
            self.untimed.update(seen)
            n[~timed], total[~timed] = seen
        if timed.any():
            n[timed], total[timed] = self._frames(pdf["t"].to_numpy(np.int64)[timed], units[timed], known[timed])
        out = pd.DataFrame({"id": pdf["id"], "key": pd.Series([key[0]] * len(pdf), dtype=object), "n": n,
                            "sum": pd.Series(total / UNITS).where(n > 0)})
        out.columns = self.columns
        yield out

    def _frames(self, t: np.ndarray, units: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # known: t, n, units of entries; an entry of one minute stands at its begin until its times are read
        known_at: dict[int, np.ndarray] = {}
        last: dict[int, int] = {}
        for (minute,), (minutes, n, total, *held) in self.totals.iterator():
            last[minute] = minute + minutes - 1
            known_at[minute] = np.array(held, np.int64) if minutes > 1 else np.array([[minute * MINUTE], [n], [total]], np.int64)
        split = {m // DAY * DAY for m in last if last[m] == m}  # days kept by minute
        read: set[int] = set()

        new = merged(np.stack([t[known], np.ones(known.sum(), np.int64), units[known]]))
        for day, here in self._by(new, DAY * MINUTE):
            day *= DAY
            if day not in split:
                here = merged(known_at.pop(day), here) if day in known_at else here
                if here.shape[1] <= FEW:
                    known_at[day], last[day] = here, day + DAY - 1
                    self.totals.updateValue((day,), (DAY, int(here[1].sum()), int(here[2].sum()), *here.tolist()))
                    continue
                if last.pop(day, None) is not None:
                    self.totals.removeKey((day,))
            for minute, mine in self._by(here, MINUTE):
                if minute in last:
                    mine = merged(self._times(minute), mine)
                known_at[minute], last[minute] = mine, minute
                read.add(minute)
                self.totals.updateValue((minute,), (1, int(mine[1].sum()), int(mine[2].sum()), [], [], []))
                self.times.updateValue((minute,), tuple(mine.tolist()))
        if last and not self.timer.exists():
            self._set_timer(min(last.values()))
        for minute in np.unique(np.concatenate([t, t - self.window]) // MINUTE).tolist():
            if last.get(minute) == minute and minute not in read:
                known_at[minute] = self._times(minute)
        at = np.concatenate([known_at[m] for m in sorted(known_at)], axis=1) if known_at else np.zeros((3, 0), np.int64)
        upto = np.concatenate([[[0, 0]], np.cumsum(at[1:].T, axis=0)])
        frame = upto[np.searchsorted(at[0], t, "right")] - upto[np.searchsorted(at[0], t - self.window, "left")]
        return frame[:, 0], frame[:, 1]

    @staticmethod
    def _by(rows: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number, rows) of every stretch of ``width`` microseconds that has rows (t, n, units by time)."""
        stretch, first = np.unique(rows[0] // width, return_index=True)
        return zip(stretch.tolist(), np.split(rows, first[1:], axis=1)) if len(stretch) else iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        needed = (timerValues.getCurrentWatermarkInMs() * 1000 - self.window) // MINUTE
        entries = {k[0]: tuple(v) for k, v in self.totals.iterator()}
        left = {m: v for m, v in entries.items() if m + v[0] > needed}
        gone = [m for m in entries if m not in left]
        for minute in gone:
            if entries[minute][0] == 1:
                self.times.removeKey((minute,))
        if len(gone) > len(left):  # the fewer calls of the state
            self.totals.clear()
            for minute, v in left.items():
                self.totals.updateValue((minute,), v)
        else:
            for minute in gone:
                self.totals.removeKey((minute,))
        self.timer.clear()
        if left:
            self._set_timer(min(m + v[0] - 1 for m, v in left.items()))
        return iter([])

    def close(self) -> None:
        pass


def stream_velocity_24h(tx_stream: DataFrame, out_path: str, ckpt: str, key: str = "customer_id",
                        ts: str = "ts", window_us: int = 24 * US_PER_HOUR, watermark: str = "24 hours",
                        id_col: str = "transaction_id", trigger: dict | None = None) -> DataFrame | Running:
    """Live per-customer 24 h count/sum; state by day or minute, removed by event-time timers (``Velocity``).

    Equal to the batch 24 h window when rows arrive in event-time order.  A row that is late by less
    than the watermark still finds the rows before it; rows already emitted are not emitted again
    and rows later than the watermark are dropped.
    Ids and keys keep their types.  Rows without a key are one group, as in the batch window.  Rows
    without a time are peers of each other: a row's frame holds those of its key that have come so far.
    Re-delivered rows count again: send them through ``dropDuplicatesWithinWatermark`` before, in a
    query of its own, where the source may repeat rows.
    """
    s = (tx_stream.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("event_time"),
                          F.col(ts).isNotNull().alias("timed"), F.coalesce(epoch_micros(ts), F.lit(0)).alias("t"),
                          F.col("amount").cast("double").alias("amount"))
         .withWatermark("event_time", watermark))
    columns = [id_col, key, "tx_count_24h", "amount_sum_24h"]
    schema = T.StructType([T.StructField(id_col, s.schema["id"].dataType), T.StructField(key, s.schema["key"].dataType),
                           T.StructField(columns[2], T.LongType()), T.StructField(columns[3], T.DoubleType())])
    out = s.groupBy("key").transformWithStateInPandas(Velocity(window_us, columns), schema, "append", "EventTime")
    return _run(out, out_path, ckpt, trigger, settings=STATE_STORE)


# op 135
def stream_score(tx_stream: DataFrame, model, out_path: str, ckpt: str, id_col: str = "transaction_id",
                 ts: str = "ts", watermark: str = "2 hours", trigger: dict | None = None) -> DataFrame | Running:
    """Drop re-delivered transactions within the watermark, score with a saved model."""
    from txrisk.operators.models import score_table

    s = (tx_stream.withColumn("event_time", F.col(ts).cast("timestamp"))
         .withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([id_col]))
    return _run(score_table(model, s, [id_col]), out_path, ckpt, trigger)
