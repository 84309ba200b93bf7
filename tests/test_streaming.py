"""Streams of several files against their batch twins: order, nulls, text ids, late and repeated rows, restarts."""

import glob
import os
import tempfile
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from txrisk.operators import history as H
from txrisk.sources import fixtures as fx
from txrisk.streaming import stream as ST


def folder():
    return tempfile.mkdtemp(prefix="txrisk-stream-")


def write_files(df, n, path=None, order="ts", first=0):
    """``n`` files in order of time, each with an older change time than the next."""
    path = path or folder()
    table = df.orderBy(order).toArrow()
    size = -(-table.num_rows // n)
    for i in range(n):
        name = f"{path}/part-{first + i:03d}.parquet"
        pq.write_table(table.slice(i * size, size), name)
        t = time.time() - 1000 + first + i
        os.utime(name, (t, t))
    return path


@pytest.fixture(scope="module")
def tx(spark):
    return (fx.tx(spark, SF_SMALL).select("transaction_id", "customer_id", "ts", "amount", "channel", "is_fraud")
            .withColumn("amount", F.when(F.col("transaction_id") % 10 != 0, F.col("amount"))))


def stream(spark, path):
    return ST.file_stream(spark, path, max_files=1)


def rows(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                  for r in df.select(*cols).collect())


VEL = ("transaction_id", "customer_id", "tx_count_24h", "amount_sum_24h")


def test_velocity_over_five_files_with_null_amounts_equals_batch(spark, tx):
    got = ST.stream_velocity_24h(stream(spark, write_files(tx, 5)), folder(), folder())
    want = H.win_24h(tx.select("transaction_id", "customer_id", "ts", "amount"))
    assert sorted(map(tuple, got.select(*VEL[:3]).collect())) == sorted(map(tuple, want.select(*VEL[:3]).collect()))
    g = {r[0]: r[3] for r in got.select(*VEL).collect()}
    for r in want.select(*VEL).collect():
        assert (g[r[0]] is None) == (r[3] is None) and g[r[0]] == pytest.approx(r[3], abs=1e-6)


def test_velocity_keeps_text_ids_and_rows_without_key_or_time(spark, tx):
    """Nulls as in the batch window: no key is a group, rows without a time are peers."""
    t = tx.select(F.concat(F.lit("t"), "transaction_id").alias("transaction_id"),
                  F.when(F.col("transaction_id") % 7 != 0, F.col("customer_id")).cast("string").alias("customer_id"),
                  F.when(F.col("transaction_id") % 5 != 0, F.col("ts")).alias("ts"), "amount", "channel", "is_fraud")
    got = ST.stream_velocity_24h(stream(spark, write_files(t, 1)), folder(), folder())
    want = H.win_24h(t.select("transaction_id", "customer_id", "ts", "amount"))
    assert dict(got.dtypes)["transaction_id"] == "string" and dict(got.dtypes)["customer_id"] == "string"
    assert got.filter("customer_id IS NULL").count() > 0
    key = lambda r: (r[0], r[1], r[2], None if r[3] is None else round(r[3], 6))
    assert sorted(map(key, got.select(*VEL).collect()), key=repr) == sorted(map(key, want.select(*VEL).collect()), key=repr)


def test_velocity_state_is_removed_behind_the_watermark(spark):
    """A key's minutes go once the watermark has passed their use, and a returning key starts anew."""
    def frame(*r):
        return spark.createDataFrame(r, "transaction_id bigint, customer_id bigint, ts string, amount double").select(
            "transaction_id", "customer_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "amount")

    path = write_files(frame((1, 7, "2024-01-01 10:00:00", 1.0), (2, 7, "2024-01-01 10:00:30", 2.0), (3, 8, "2024-01-01 10:00:00", 5.0)), 1)
    write_files(frame((4, 8, "2024-01-09 10:00:00", 1.0)), 1, path, first=1)
    write_files(frame((5, 7, "2024-01-09 11:00:00", 4.0), (6, 8, "2024-01-10 10:00:00", 1.0)), 1, path, first=2)
    ckpt = folder()
    got = ST.stream_velocity_24h(stream(spark, path), folder(), ckpt, watermark="1 hour")
    assert rows(got, *VEL) == [(1, 7, 1, 1.0), (2, 7, 2, 3.0), (3, 8, 1, 5.0), (4, 8, 1, 1.0), (5, 7, 1, 4.0), (6, 8, 2, 2.0)]
    state = (spark.read.format("statestore").option("path", ckpt).option("stateVarName", "totals").load()
             .select("key.key", F.col("user_map_key.minute").alias("minute")).collect())
    first = 1704103200_000_000 // ST.MINUTE  # 2024-01-01 10:00
    assert len(state) == 3 and all(r["minute"] > first + 1 for r in state)


def test_velocity_runs_on_with_a_trigger(spark, tx):
    middle = tx.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    path = write_files(tx.filter(F.col("ts") <= middle), 2)
    running = ST.stream_velocity_24h(stream(spark, path), folder(), folder(), trigger={"processingTime": "1 second"})
    try:
        running.query.processAllAvailable()
        first = running.read().count()
        write_files(tx.filter(F.col("ts") > middle), 2, path, first=2)
        running.query.processAllAvailable()
        got = running.read()
        want = H.win_24h(tx.select("transaction_id", "customer_id", "ts", "amount"))
        assert 0 < first < got.count() and rows(got, *VEL[:3]) == rows(want, *VEL[:3])
    finally:
        running.stop()


def test_velocity_late_row_finds_the_rows_before_it(spark):
    def frame(*r):
        return spark.createDataFrame(r, "transaction_id bigint, customer_id bigint, ts string, amount double").select(
            "transaction_id", "customer_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "amount")

    path = write_files(frame((1, 7, "2024-01-01 10:00:00", 1.25), (2, 7, "2024-01-01 12:00:00", 2.004)), 1)
    write_files(frame((3, 7, "2024-01-01 11:00:00", 4.0)), 1, path, first=1)
    got = ST.stream_velocity_24h(stream(spark, path), folder(), folder())
    assert rows(got, *VEL) == [(1, 7, 1, 1.25), (2, 7, 2, 3.254), (3, 7, 2, 5.25)]


def test_risk_windows_over_five_files_equal_batch_and_drop_late_rows(spark, tx):
    got = ST.stream_risk_windows(stream(spark, write_files(tx, 5)), folder(), folder())
    want = tx.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start"), "channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("fraud_cases"))
    cols = ("window_start", "channel", "n", "fraud_cases")
    assert rows(got, *cols) == rows(want, *cols)
    # a file with rows far older than the watermark adds nothing
    late = tx.orderBy("ts").limit(20)
    path = write_files(tx, 2)
    write_files(late, 1, path, first=2)
    again = ST.stream_risk_windows(stream(spark, path), folder(), folder())
    assert rows(again, *cols) == rows(want, *cols)


def test_restart_goes_on_and_replayed_batch_replaces_itself(spark, tx):
    out, ckpt = folder(), folder()
    middle = tx.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]  # rows older than the watermark would be dropped
    path = write_files(tx.filter(F.col("ts") <= middle), 2)
    first = ST.stream_velocity_24h(stream(spark, path), out, ckpt).count()
    write_files(tx.filter(F.col("ts") > middle), 2, path, first=2)
    last = max(int(os.path.basename(p)) for p in glob.glob(f"{ckpt}/commits/[0-9]*"))
    os.remove(f"{ckpt}/commits/{last}")  # as if the run had stopped after the sink, before the commit
    os.remove(f"{ckpt}/commits/.{last}.crc")
    got = ST.stream_velocity_24h(stream(spark, path), out, ckpt)
    assert first < got.count() == got.select("transaction_id").distinct().count() == tx.count()


def test_scores_drop_redelivered_rows(spark, tx):
    from txrisk.operators import models as ML

    t = tx.select("transaction_id", "ts", F.coalesce("amount", F.lit(0.0)).alias("amount"), "is_fraud")
    model = ML.train_lr(t, ["amount"])
    path = write_files(t, 1)
    write_files(t.orderBy(F.col("ts").desc()).limit(30), 1, path, first=1)  # the newest rows come again
    got = ST.stream_score(stream(spark, path), model, folder(), folder())
    assert got.count() == got.select("transaction_id").distinct().count() == t.count()


def test_stream_without_rows_gives_an_empty_table(spark, tx):
    got = ST.stream_velocity_24h(stream(spark, write_files(tx.limit(0), 1)), folder(), folder())
    assert got.count() == 0 and got.columns == list(VEL)


def test_velocity_entries_of_few_and_of_many_times_equal_batch(spark):
    """A day of few times is one entry of the state; a day that gets more is kept by minute from then on."""
    def entries(ckpt, minutes):
        return (spark.read.format("statestore").option("path", ckpt).option("stateVarName", "totals").load()
                .filter(F.col("user_map_value.minutes") == minutes).count())

    start = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    rows_ = spark.range(3000).select(
        F.col("id").alias("transaction_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("customer_id"),
        (start + F.make_dt_interval(secs=F.floor(F.col("id") * 45))).alias("ts"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 17 + 0.25).alias("amount"))
    want = rows(H.win_24h(rows_), *VEL)
    ckpt = folder()
    got = ST.stream_velocity_24h(stream(spark, write_files(rows_, 4)), folder(), ckpt, watermark="48 hours")
    assert rows(got, *VEL) == want
    assert entries(ckpt, 1) > 500 and 0 < entries(ckpt, ST.DAY) <= 40 * 2
    ckpt = folder()
    got = ST.stream_velocity_24h(stream(spark, write_files(rows_.filter("customer_id != 1"), 4)), folder(), ckpt, watermark="48 hours")
    assert rows(got, *VEL) == [r for r in want if r[1] != 1] and entries(ckpt, 1) == 0
