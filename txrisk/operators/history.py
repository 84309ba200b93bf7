"""Per-customer history features (ops 30-32, 49, 66, 73-81).

Scale design
------------
A window ``PARTITION BY customer`` puts all rows of one customer in one task;
with one customer holding a third of 100 TB that task never finishes.  Two
shapes avoid it while staying exact:

* **Time-range frames** (24 h / 7 d, ``RANGE ... PRECEDING AND CURRENT ROW``):
  a frame's value depends on (customer, time) alone, so rows are first reduced
  map-side to distinct (customer, time) points.  Two-level prefix sums over
  (customer, hour) buckets give S(<= t) and S(< t - w), and the rows fetch
  their frames by (customer, time), which spreads a hot customer.
* **Prior-row frames** (``ROWS UNBOUNDED PRECEDING AND 1 PRECEDING``, i.e.
  expanding statistics): a two-level prefix sum.  Per (customer, bucket)
  totals are pre-aggregated map-side, prefix-summed per customer over the
  buckets, and added to a local running sum inside each bucket.  Distinct
  counts over prior rows are running sums of first occurrences, one event per
  (customer, value).

Both spread a key at the price of several exchanges of three events a row.  Keys whose
rows are few (``KEY_ROWS``) and never crowd a frame (``FRAME_ROWS``) do not need it: they
go through plain windows after one exchange by key, the crowded keys through the
prefix sums (``spread_crowded``).  One narrow count tells which keys are which.

Time is handled as microseconds since the epoch computed from the
``TIMESTAMP_NTZ`` fields, so results never depend on the session time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators.joins import broadcast_if_small, lookup_join
from txrisk.session import materialize, run_folder

US_PER_HOUR = 3_600_000_000
US_PER_DAY = 24 * US_PER_HOUR


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 for a TIMESTAMP_NTZ, time-zone free."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.unix_date(F.to_date(ts)).cast("long")
    sec = F.extract(F.lit("SECOND"), ts)  # seconds with microsecond fraction
    return (day * US_PER_DAY + F.hour(ts).cast("long") * US_PER_HOUR
            + F.minute(ts).cast("long") * 60_000_000
            + (sec * 1_000_000).cast("long"))


#: Amounts are summed as decimals with six digits after the point (18 before it), squares with twelve.
MONEY = "decimal(24,6)"
SQUARE = "decimal(38,12)"


def money_sum(c: Column, w=None) -> Column:
    """Exact sum of an amount column (DECIMAL accumulation, double result).

    Float sums depend on summation order (partitioning); an exact sum makes
    every engine and every partitioning produce the same double.
    """
    s = F.sum(c.cast(MONEY))
    return (s.over(w) if w is not None else s).cast("double")


def square(c: Column) -> Column:
    """An amount's square for exact sums."""
    return (c.cast("double") * c.cast("double")).cast(SQUARE)


def money_avg(c: Column, w=None) -> Column:
    n = F.count(c)
    n = n.over(w) if w is not None else n
    return money_sum(c, w) / n


# ---------------------------------------------------------------------------
# time-range frames
# ---------------------------------------------------------------------------

#: A key with more rows in all, or more in one stretch as long as the widest frame, is spread over tasks.
KEY_ROWS, FRAME_ROWS = 100_000, 128

#: Prefix sums of squares have these digits; plain windows round to the same.
PREFIX_SQUARE = "decimal(38,11)"


def _frame_square(upto: Column, frame: Column) -> Column:
    """A frame's sum of squares as the difference of two prefix sums, rounded as those are."""
    return upto.cast(PREFIX_SQUARE) - (upto - frame).cast(PREFIX_SQUARE)


def spread_crowded(df: DataFrame, key: str, ts: str, width: int, plain: Callable[[DataFrame], DataFrame],
                   spread: Callable[[DataFrame], DataFrame], both: bool = False) -> DataFrame:
    """``spread`` of the rows of crowded keys and ``plain`` of all others, both of ``df`` with its group ``__k``.

    Runs a count of (key, stretch of ``width``), reduced map-side.  A frame of ``width`` meets
    two stretches at most, so ``plain`` sees frames of 2 * ``FRAME_ROWS`` rows and keys of ``KEY_ROWS``.
    """
    rows = df.select("*", F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("v")).alias("__k"))
    stretches = (rows.select("__k", F.floor(epoch_micros(ts) / F.lit(width)).alias("__b")).groupBy("__k", "__b")
                 .agg(F.count(F.lit(1)).alias("__c")))
    many = (F.max("__c") > FRAME_ROWS) | (F.sum("__c") > KEY_ROWS)
    # the crowded keys, and one null for all others: it meets no row
    crowded = broadcast_if_small(stretches.groupBy("__k").agg(many.alias("__m")).select(F.when(F.col("__m"), F.col("__k")).alias("__k")).distinct())
    kinds = {r[0] for r in crowded.select(F.isnull("__k")).distinct().collect()}
    if True not in kinds:  # no other keys
        return spread(rows)
    if not both and False not in kinds:
        return plain(rows)
    # without crowded keys the second part is found to be empty at run time, before it reads anything
    return plain(rows.join(crowded, "__k", "left_anti")).unionByName(spread(rows.join(crowded, "__k", "left_semi")))


def range_windows(df: DataFrame, key: str, ts: str,
                  frames: dict[int, dict[str, tuple[str, str]]], bucket_us: int | None = None,
                  carry: list[str] | None = None) -> DataFrame:
    """Add ``RANGE [t - w, t]`` aggregates per ``key`` for several frame widths at once.

    ``frames`` maps a width in microseconds to {output name: (function, value
    column)}, function one of count, sum, avg, stddev; the current row and its
    peers are included, so rows of one key and time get equal results whatever
    their ids.  Rows without a time are each other's peers and in no other
    frame; rows without a key form one group.

    Counts and sums are exact decimals, so means and deviations do not depend on
    summation order.  Keys with few rows go through plain windows, crowded ones
    through prefix sums (``spread_crowded``).
    """
    keep = carry if carry is not None else df.columns

    def plain(rows: DataFrame) -> DataFrame:
        values = sorted({v for aggs in frames.values() for _, v in aggs.values()})
        rows = rows.select("*", epoch_micros(ts).alias("__t"), *[c.alias(f"__{p}_{v}") for v in values for p, c in (
            ("n", F.col(v).isNotNull().cast("long")), ("s", F.coalesce(F.col(v).cast(MONEY), F.lit(0))),
            ("q", F.coalesce(square(F.col(v)), F.lit(0))))])
        by_time = Window.partitionBy(key).orderBy("__t")
        rows = rows.select("*", *[F.sum(f"__q_{v}").over(by_time.rangeBetween(Window.unboundedPreceding, 0)).alias(f"__upto_{v}") for v in values],
                           *[F.sum(f"__{p}_{v}").over(by_time.rangeBetween(-w, 0)).alias(f"__f{w}_{p}_{v}")
                             for w in sorted(frames) for v in values for p in "nsq"])
        out = [_statistic(fn, F.col(f"__f{w}_n_{v}"), F.col(f"__f{w}_s_{v}"), _frame_square(F.col(f"__upto_{v}"), F.col(f"__f{w}_q_{v}"))).alias(name)
               for w, aggs in sorted(frames.items()) for name, (fn, v) in aggs.items()]
        return rows.select(*keep, *out)

    return spread_crowded(df, key, ts, max(frames), plain, lambda rows: _spread_range_windows(rows, key, ts, frames, bucket_us, keep),
                          both=True)


def _spread_range_windows(df: DataFrame, key: str, ts: str, frames: dict[int, dict[str, tuple[str, str]]], bucket_us: int | None,
                          keep: list[str]) -> DataFrame:
    """``range_windows`` of rows with their group ``__k``, for keys with any number of rows.

    * rows are reduced map-side to one point per (key, time);
    * a point becomes one event at t and one weightless probe per frame at
      t - w, ordered before the points of that time;
    * per (key, bucket) totals are reduced map-side and prefix-summed over a
      key's buckets (an hour wide by default); with the running sum inside the
      bucket this gives S(<= t) and S(< t - w);
    * the rows fetch their point's frames by (key, time).

    No exchange of points or rows is keyed by the key alone, and none moves a
    row's other columns but the last join.
    """
    bucket_us = bucket_us or US_PER_HOUR
    widths = sorted(frames)
    values = sorted({v for aggs in frames.values() for _, v in aggs.values()})

    def place(t: Column) -> Column:
        return F.struct(F.col("__k").alias("k"), t.isNull().alias("n"), t.alias("t")).alias("__at")

    sums = {}
    for v in values:
        x = F.col(v)
        sums[f"__n_{v}"] = F.count(x)
        sums[f"__s_{v}"] = F.coalesce(F.sum(x.cast(MONEY)), F.lit(0))
        sums[f"__q_{v}"] = F.coalesce(F.sum(square(x)), F.lit(0))
    t = F.col("__t")
    points = (df.withColumn("__t", epoch_micros(ts)).groupBy(key, "__t").agg(*[c.alias(n) for n, c in sums.items()])
              .select("*", F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("v")).alias("__k")))
    offsets = F.array(F.struct(F.lit(-1).alias("frame"), t.alias("e")),
                      *[F.struct(F.lit(i).alias("frame"), (t - w).alias("e")) for i, w in enumerate(widths)])
    events = points.select(place(t), *sums, offsets.alias("__x")).withColumn("__x", F.explode("__x")).select(
        "__at", F.col("__at.k").alias("__k"), F.col("__x.frame").alias("__frame"), F.col("__x.e").alias("__e"),
        F.coalesce(F.floor(F.col("__x.e") / F.lit(bucket_us)), F.lit(-(1 << 62))).alias("__b"),
        *[F.when(F.col("__x.frame") < 0, F.col(n)).otherwise(F.lit(0)).alias(n) for n in sums])
    wb = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = (events.groupBy("__k", "__b").agg(*[F.sum(n).alias(n) for n in sums])
              .select("__k", "__b", *[F.coalesce(F.sum(n).over(wb), F.lit(0)).alias(f"__o{n}") for n in sums]))
    # probes carry no weight, so their order among themselves does not matter
    wl = (Window.partitionBy("__k", "__b").orderBy("__e", F.when(F.col("__frame") < 0, 1).otherwise(0))
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = events.join(before, ["__k", "__b"]).select(
        "__at", "__frame", *[(F.col(f"__o{n}") + F.sum(n).over(wl)).alias(n) for n in sums])

    def seen(frame: int, n: str) -> Column:
        return F.max(F.when(F.col("__frame") == frame, F.col(n)))

    framed = running.groupBy("__at").agg(*[(seen(-1, n) - seen(i, n)).alias(f"__f{i}{n}")
                                           for i in range(len(widths)) for n in sums])
    out = []
    for i, w in enumerate(widths):
        for name, (fn, v) in frames[w].items():
            out.append(_statistic(fn, *[F.col(f"__f{i}__{x}_{v}") for x in "nsq"]).alias(name))
    return df.select("*", place(epoch_micros(ts))).join(framed, "__at").select(*keep, *out)


def range_window(df: DataFrame, key: str, ts: str, window_us: int,
                 aggs: dict[str, tuple[str, str]], bucket_us: int | None = None,
                 carry: list[str] | None = None) -> DataFrame:
    """One ``RANGE [t - window, t]`` frame (see ``range_windows``)."""
    return range_windows(df, key, ts, {window_us: aggs}, bucket_us, carry)


WIN_24H_AGGS = {"tx_count_24h": ("count", "amount"), "amount_sum_24h": ("sum", "amount")}
WIN_7D_AGGS = {"tx_count_7d": ("count", "amount"), "amount_mean_7d": ("avg", "amount"),
               "amount_std_7d": ("stddev", "amount")}


def win_24h_7d(df: DataFrame, key: str = "customer_id", ts: str = "ts") -> DataFrame:
    """Ops 73 + 74 in one pass."""
    return range_windows(df, key, ts, {24 * US_PER_HOUR: WIN_24H_AGGS, 7 * US_PER_DAY: WIN_7D_AGGS})


# op 73
def win_24h(df: DataFrame, key: str = "customer_id", ts: str = "ts",
            amount: str = "amount", bucket_us: int | None = None) -> DataFrame:
    return range_window(df, key, ts, 24 * US_PER_HOUR,
                        {"tx_count_24h": ("count", amount), "amount_sum_24h": ("sum", amount)},
                        bucket_us)


# op 74
def win_7d(df: DataFrame, key: str = "customer_id", ts: str = "ts",
           amount: str = "amount", bucket_us: int | None = None) -> DataFrame:
    return range_window(df, key, ts, 7 * US_PER_DAY,
                        {"tx_count_7d": ("count", amount), "amount_mean_7d": ("avg", amount),
                         "amount_std_7d": ("stddev", amount)}, bucket_us)


# ---------------------------------------------------------------------------
# prior-row (expanding) frames: two-level prefix sums
# ---------------------------------------------------------------------------

def prior_sums(df: DataFrame, key: str, ts: str, tiebreak: str,
               values: dict[str, Column], inclusive: bool = False,
               bucket_us: int = US_PER_DAY, distinct: dict[str, str] | None = None) -> DataFrame:
    """Running sums of ``values`` over rows ordered by (ts, tiebreak) per key, and
    running distinct counts of the ``distinct`` columns (output name -> column).

    ``inclusive=False`` covers strictly earlier rows (ROWS UNBOUNDED PRECEDING
    AND 1 PRECEDING); empty sums are 0.  One shuffle of the rows, on
    (key, bucket):

    * distinct counts: the first (ts, tiebreak) of every (key, value), reduced
      map-side, joins the rows as one event of weight 1, so they are running
      sums as well;
    * per (key, bucket) totals, reduced map-side, are prefix-summed over a
      key's buckets (one row per active bucket);
    * rows and events are joined to their bucket's offsets (co-partitioned) and
      a local running sum is added.
    """
    distinct = distinct or {}
    names = [*values, *distinct]
    # partition / join key that is never NULL: rows with a NULL key form their own group (as in
    # SQL windows) and the windows and the offsets join all share one (key, bucket) partitioning
    k = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("v"))
    # rows without a time form the earliest bucket of their own
    b = F.coalesce(F.floor(F.col("__t") / F.lit(bucket_us)), F.lit(-(1 << 62))).alias("__b")
    rows = df.select("*", k.alias("__k"), epoch_micros(ts).alias("__t"), F.col(tiebreak).alias("__i"),
                     F.lit(0).alias("__event"), *[c.alias(f"__v_{n}") for n, c in values.items()],
                     *[F.lit(0).cast("long").alias(f"__v_{n}") for n in distinct]).select("*", b)
    if distinct:
        seen = F.array(*[F.struct(F.lit(o).alias("o"), F.col(c).cast("string").alias("x")) for o, c in distinct.items()])
        # rows count what stands before them; an inclusive row counts its own first value too
        firsts = (df.select(k.alias("__k"), F.struct(epoch_micros(ts).alias("t"), F.col(tiebreak).alias("i")).alias("__f"),
                            seen.alias("__d")).withColumn("__d", F.explode("__d"))
                  .filter("__d.x IS NOT NULL").groupBy("__k", "__d").agg(F.min("__f").alias("__f"))
                  .select("__k", F.col("__f.t").alias("__t"), F.col("__f.i").alias("__i"),
                          F.lit(-1 if inclusive else 1).alias("__event"),
                          *[(F.col("__d.o") == o).cast("long").alias(f"__v_{o}") for o in distinct]).select("*", b))
        rows = rows.unionByName(firsts, allowMissingColumns=True)
    tot = rows.groupBy("__k", "__b").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    wb = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("__k", "__b", *[F.coalesce(F.sum(f"__s_{n}").over(wb), F.lit(0))
                                     .alias(f"__o_{n}") for n in names])
    wl = (Window.partitionBy("__k", "__b").orderBy("__t", "__i", "__event")
          .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    out = rows.join(off, ["__k", "__b"]).select(
        *df.columns, "__event",
        *[(F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(wl), F.lit(0))).alias(n) for n in names])
    return out.filter("__event = 0").drop("__event")


# op 75 + 76
def prior_mean_ratio(df: DataFrame, key: str = "customer_id", ts: str = "ts",
                     tiebreak: str = "transaction_id", amount: str = "amount") -> DataFrame:
    """customer_mean_amount_prior and amount_vs_mean_ratio_safe.

    Mean of strictly earlier rows; no earlier row -> own amount; mean 0 -> ratio null -> 1.0.
    """
    s = prior_sums(df, key, ts, tiebreak,
                   {"__pn": F.col(amount).isNotNull().cast("long"), "__ps": F.col(amount).cast(MONEY)})
    mean = F.when(F.col("__pn") > 0, F.col("__ps").cast("double") / F.col("__pn")) \
        .otherwise(F.col(amount))
    s = s.select(*df.columns, mean.alias("customer_mean_amount_prior"))
    ratio = F.col(amount) / F.nullif(F.col("customer_mean_amount_prior"), F.lit(0.0))
    return s.select("*", F.coalesce(ratio, F.lit(1.0)).alias("amount_vs_mean_ratio_safe"))


def prior_distinct(df: DataFrame, key: str, ts: str, tiebreak: str,
                   cols: dict[str, str], inclusive: bool = False) -> DataFrame:
    """Number of distinct values of each column over prior rows of the key."""
    return prior_sums(df, key, ts, tiebreak, {}, inclusive=inclusive, distinct=cols)


# op 77
def history_features(df: DataFrame, key: str = "customer_id", ts: str = "ts",
                     tiebreak: str = "transaction_id", amount: str = "amount",
                     channel: str = "channel", location: str = "location",
                     online_channels: list[str] = ("view", "click", "signup")) -> DataFrame:
    """Leak-safe lifetime measures: statistics of strictly earlier rows only,
    all running sums and distinct counts in ONE two-level prefix pass."""
    div = {"channel_diversity_prior": channel, "location_diversity_prior": location}
    x = F.col(amount).cast(MONEY)
    vals = {"__n": F.lit(1).cast("long"), "__m": x.isNotNull().cast("long"), "__s": x, "__q": square(F.col(amount)),
            "__on": F.col(channel).isin(list(online_channels)).cast("long")}
    s = prior_sums(df, key, ts, tiebreak, vals, distinct=div)
    n, m = F.col("__n"), F.col("__m")  # rows, rows with an amount
    sm, sq = F.col("__s").cast("double"), F.col("__q").cast("double")
    var = (sq - sm * sm / m) / F.nullif(m - 1, F.lit(0))
    return s.select(*df.columns,
                    n.alias("tx_count_prior"),
                    F.when(m > 0, sm / m).alias("amount_mean_prior"),
                    F.when(m > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("amount_std_prior"),
                    F.when(n > 0, F.col("__on").cast("double") / n).alias("online_channel_ratio_prior"),
                    *div.keys())


# ---------------------------------------------------------------------------
# one pass for range frames, prior rows and lifetime totals
# ---------------------------------------------------------------------------

def history_pass(df: DataFrame, key: str = "customer_id", ts: str = "ts", tiebreak: str = "transaction_id",
                 amount: str = "amount", frames: dict[int, dict[str, str]] | None = None,
                 flags: dict[str, Column] | None = None, distinct: dict[str, str] | None = None,
                 bucket_us: int = US_PER_HOUR) -> DataFrame:
    """``df`` with range frames, statistics of prior rows and lifetime totals of its key, from one event log.

    ``frames`` maps a width to {output: count, sum, avg or stddev of the amount} over
    [t - width, t].  Columns ``before_...`` and ``total_...`` are over the key's strictly
    earlier rows (by time, then ``tiebreak``) and over all of its rows: rows, n (amounts),
    s and q (sum of amounts and of squares) and each flag (number of rows where it is
    true); ``total_...`` also each distinct column's number of values (nulls are none).  Rows
    without a key form one group; rows without a time come first and are each other's peers.

    Keys with few rows go through plain windows, crowded ones through prefix sums (``spread_crowded``).
    """
    frames, flags, distinct = frames or {}, flags or {}, distinct or {}
    value = {"rows": F.lit(1).cast("long"), "n": F.col(amount).isNotNull().cast("long"),
             "s": F.coalesce(F.col(amount).cast(MONEY), F.lit(0)), "q": F.coalesce(square(F.col(amount)), F.lit(0)),
             **{f: F.coalesce(c.cast("long"), F.lit(0)) for f, c in flags.items()}}
    columns = df.columns

    def plain(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", epoch_micros(ts).alias("__t"), *[c.alias(f"p_{n}") for n, c in value.items()])
        key_rows = Window.partitionBy("__k")
        earlier = key_rows.orderBy("__t", tiebreak).rowsBetween(Window.unboundedPreceding, -1)
        out = [_statistic(fn, F.col(f"f{w}_n"), F.col(f"f{w}_s"), _frame_square(F.col("upto_q"), F.col(f"f{w}_q"))).alias(name)
               for w, aggs in sorted(frames.items()) for name, fn in aggs.items()]
        # by (time, tiebreak) first: that order serves the frames as well
        done = rows.select("*", *[F.coalesce(F.sum(f"p_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in value])
        by_time, peers = key_rows.orderBy("__t"), Window.partitionBy("__k", "__t")
        done = done.select("*", F.sum("p_q").over(by_time.rangeBetween(Window.unboundedPreceding, 0)).alias("upto_q"),
                           F.sum("p_q").over(peers).alias("peers_q"),
                           F.sum("p_q").over(peers.orderBy(tiebreak).rowsBetween(Window.unboundedPreceding, -1)).alias("peers_before_q"),
                           *[F.sum(f"p_{n}").over(by_time.rangeBetween(-w, 0)).alias(f"f{w}_{n}") for w in sorted(frames) for n in "nsq"])
        done = done.select("*", *[F.sum(f"p_{n}").over(key_rows).alias(f"total_{n}") for n in value])
        if distinct:
            kinds = rows.groupBy("__k").agg(*[F.count_distinct(F.col(c).cast("string")).alias(f"total_{o}") for o, c in distinct.items()])
            done = done.join(kinds, "__k")
        before_q = F.col("upto_q").cast(PREFIX_SQUARE) - F.col("peers_q") + F.coalesce("peers_before_q", F.lit(0))
        return done.select(*columns, *out, *[before_q.alias("before_q") if n == "q" else f"before_{n}" for n in value],
                           *[f"total_{n}" for n in [*value, *distinct]])

    return spread_crowded(df, key, ts, max(frames, default=bucket_us), plain,
                          lambda rows: _spread_history_pass(rows, columns, ts, tiebreak, value, frames, distinct, bucket_us))


def _spread_history_pass(df: DataFrame, columns: list[str], ts: str, tiebreak: str, value: dict[str, Column],
                         frames: dict[int, dict[str, str]], distinct: dict[str, str], bucket_us: int) -> DataFrame:
    """``history_pass`` of rows with their group ``__k``, for keys with any number of rows.

    Three narrow reads of ``df``: two reduce it map-side to points (key, time) and to
    values (key, value), which become events (one for the sums over a key's buckets, one
    for those inside a bucket, which give every point what stands before it); the last
    fetches the points by (key, time) and adds peers of equal time.  No exchange is keyed by the key alone,
    and every reduction is a hash aggregate over numbers.
    """
    widths, kinds = sorted(frames), list(distinct)
    group = F.col("__k")
    sums = list(value)

    def at(k: Column, t: Column) -> Column:
        return F.struct(k.alias("k"), t.isNull().alias("n"), t.alias("t")).alias("__at")

    # kind -1: a row at its time; kind i: a value of distinct column i, at its first time
    entry = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("x")),
                    *[F.struct(F.lit(i).alias("kind"), F.col(distinct[o]).cast("string").alias("x")) for i, o in enumerate(kinds)])
    log = (df.select(group.alias("k"), epoch_micros(ts).alias("t"), *[c.alias(f"v_{n}") for n, c in value.items()],
                     F.explode(entry).alias("e"))
           .filter("e.kind < 0 OR e.x IS NOT NULL")
           .groupBy("k", F.col("e.kind").alias("kind"), "e.x", F.when(F.col("e.kind") < 0, F.col("t")).alias("own"))
           .agg(F.min("t").alias("t"),
                *[F.sum(F.when(F.col("e.kind") < 0, F.col(f"v_{n}")).otherwise(0)).alias(f"v_{n}") for n in sums]))
    points = log.groupBy(at(F.col("k"), F.col("t"))).agg(
        *[F.sum(f"v_{n}").alias(f"v_{n}") for n in sums],
        *[F.sum((F.col("kind") == i).cast("long")).alias(f"v_{o}") for i, o in enumerate(kinds)])
    t = F.col("__at.t")
    offsets = F.array(F.struct(F.lit(-1).alias("frame"), t.alias("e")),
                      *[F.struct(F.lit(i).alias("frame"), (t - w).alias("e")) for i, w in enumerate(widths)])
    events = points.select("*", F.explode(offsets).alias("__x")).select(
        "__at", F.col("__at.k").alias("__k"), F.col("__x.frame").alias("__frame"), F.col("__x.e").alias("__e"),
        F.coalesce(F.floor(F.col("__x.e") / F.lit(bucket_us)), F.lit(-(1 << 62))).alias("__b"),
        *[F.when(F.col("__x.frame") < 0, F.col(f"v_{n}")).otherwise(F.lit(0)).alias(f"v_{n}") for n in [*sums, *kinds]])
    earlier = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = events.groupBy("__k", "__b").agg(*[F.sum(f"v_{n}").alias(f"v_{n}") for n in [*sums, *kinds]]).select(
        "__k", "__b", *[F.coalesce(F.sum(f"v_{n}").over(earlier), F.lit(0)).alias(f"o_{n}") for n in sums],
        *[F.sum(f"v_{n}").over(Window.partitionBy("__k")).alias(f"t_{n}") for n in [*sums, *kinds]])
    # probes carry no weight and stand before the points of their time
    inside = (Window.partitionBy("__k", "__b").orderBy("__e", F.when(F.col("__frame") < 0, 1).otherwise(0))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = events.join(buckets, ["__k", "__b"]).select(
        "__at", "__frame", *[f"v_{n}" for n in sums], *[f"t_{n}" for n in [*sums, *kinds]],
        *[(F.col(f"o_{n}") + F.sum(f"v_{n}").over(inside)).alias(f"r_{n}") for n in sums])

    def of(frame: int, c: str) -> Column:
        return F.max(F.when(F.col("__frame") == frame, F.col(c)))

    found = running.groupBy("__at").agg(
        *[of(-1, f"r_{n}").alias(f"r_{n}") for n in sums], *[of(-1, f"v_{n}").alias(f"v_{n}") for n in sums],
        *[F.max(f"t_{n}").alias(f"t_{n}") for n in [*sums, *kinds]],
        *[of(i, f"r_{n}").alias(f"f{i}_{n}") for i in range(len(widths)) for n in ("n", "s", "q")])
    peers = Window.partitionBy("__at").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    rows = (df.select("*", F.col(tiebreak).alias("__i"), at(group, epoch_micros(ts)), *[c.alias(f"p_{n}") for n, c in value.items()])
            .join(found, "__at"))
    before = [(F.col(f"r_{n}") - F.col(f"v_{n}") + F.coalesce(F.sum(f"p_{n}").over(peers), F.lit(0))).alias(f"before_{n}") for n in sums]
    out = [_statistic(fn, *[F.col(f"r_{n}") - F.col(f"f{i}_{n}") for n in "nsq"]).alias(name)
           for i, w in enumerate(widths) for name, fn in frames[w].items()]
    return rows.select(*columns, *out, *before, *[F.col(f"t_{n}").alias(f"total_{n}") for n in [*sums, *kinds]])


def _statistic(fn: str, n: Column, s: Column, q: Column) -> Column:
    """count, sum, avg or stddev from the number, the exact sum and the exact sum of squares."""
    s, q = s.cast("double"), q.cast("double")
    if fn == "count":
        return n
    if fn == "sum":
        return F.when(n > 0, s)
    if fn == "avg":
        return F.when(n > 0, s / n)
    if fn == "stddev":
        return F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))
    raise ValueError(fn)


def customer_history(df: DataFrame, key: str = "customer_id", amount: str = "amount", channel: str = "channel",
                     location: str = "location", online_channels: list[str] = ("view", "click", "signup")) -> DataFrame:
    """What ops 30, 49, 66 and 73-77 add to a row (but prior distinct counts), from one ``history_pass``."""
    frames = {24 * US_PER_HOUR: {"tx_count_24h": "count", "amount_sum_24h": "sum"},
              7 * US_PER_DAY: {"tx_count_7d": "count", "amount_mean_7d": "avg", "amount_std_7d": "stddev"}}
    h = history_pass(df, key=key, amount=amount, frames=frames, flags={"online": F.col(channel).isin(list(online_channels))},
                     distinct={"channels": channel, "locations": location})
    b, t = ([F.col(f"{part}_{n}") for n in "nsq"] for part in ("before", "total"))
    known = F.col(key).isNotNull()
    mean = F.coalesce(_statistic("avg", *b), F.col(amount))
    h = h.select("*", F.when(known, _statistic("avg", *t)).alias("amount_mean_total"), mean.alias("customer_mean_amount_prior"))
    return h.select(
        *[c for c in h.columns if not c.startswith(("before_", "total_"))],
        F.coalesce(F.col(amount) / F.nullif("customer_mean_amount_prior", F.lit(0.0)), F.lit(1.0)).alias("amount_vs_mean_ratio_safe"),
        F.col("before_rows").alias("tx_count_prior"), _statistic("avg", *b).alias("amount_mean_prior"),
        _statistic("stddev", *b).alias("amount_std_prior"),
        F.when(F.col("before_rows") > 0, F.col("before_online").cast("double") / F.col("before_rows")).alias("online_channel_ratio_prior"),
        F.when(known, F.col("total_rows")).alias("tx_count_total"), F.when(known, _statistic("stddev", *t)).alias("amount_std_total"),
        F.when(known, F.col("total_channels")).alias("channel_diversity"),
        F.when(known, F.col("total_locations")).alias("location_diversity"),
        F.when(known, F.col("total_online").cast("double") / F.col("total_rows")).alias("online_channel_ratio"),
        (F.col(amount) / F.nullif("amount_mean_total", F.lit(0.0))).alias("amount_vs_mean_ratio"))


# op 66
def customer_lifetime(df: DataFrame, key: str = "customer_id", amount: str = "amount",
                      channel: str = "channel", location: str = "location",
                      online_channels: list[str] = ("view", "click", "signup")) -> DataFrame:
    """Whole-history (leaky when joined to rows) per-customer aggregates."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("tx_count_total"),
                 money_avg(F.col(amount)).alias("amount_mean_total"),
                 F.stddev_samp(amount).alias("amount_std_total"),
                 F.count_distinct(channel).alias("channel_diversity"),
                 F.count_distinct(location).alias("location_diversity"),
                 F.avg(F.col(channel).isin(list(online_channels)).cast("double"))
                 .alias("online_channel_ratio")))


# op 49
def profile_join_back(df: DataFrame, key: str = "customer_id", **kw) -> DataFrame:
    """Lifetime stats on every row: aggregate + equi-join (AQE splits a hot key)."""
    return df.join(customer_lifetime(df, key, **kw), key, "left")


# op 30
def amount_vs_lifetime_ratio(df: DataFrame, amount: str = "amount",
                             mean: str = "amount_mean_total") -> DataFrame:
    return df.select("*", (F.col(amount) / F.nullif(F.col(mean), F.lit(0.0)))
                     .alias("amount_vs_mean_ratio"))


# op 31
def velocity_score(c24: str = "tx_count_24h", c7: str = "tx_count_7d",
                   total: str = "tx_count_total") -> Column:
    return (F.col(c24).cast("double") * 7 + F.col(c7)) / (F.col(total) + 1)


# op 32
def composite_risk(df: DataFrame, velocity: str = "velocity_score",
                   ratio: str = "amount_vs_mean_ratio_safe", channel: str = "channel",
                   label: str = "is_fraud", weights=(1 / 3, 1 / 3, 1 / 3), written: bool = False) -> DataFrame:
    """Weighted sum of min-max normalised velocity, amount ratio and channel fraud rate.

    ``written``: ``df`` reads a table, so that its three passes cost three reads."""
    # three passes (rates, min/max, rows) over an expensive input: written once to the shared folder
    df = df if written else materialize(df, run_folder(df.sparkSession, "risk_input"))
    rates = (df.groupBy(channel).agg(F.avg(F.col(label).cast("double")).alias("__chr")))
    # one row per channel: broadcast after a size check (a shuffle on a 6-value key would
    # put all rows in 6 tasks)
    j = lookup_join(df, rates, channel, "left")
    mm = j.agg(*[f(F.col(c)).alias(f"__{n}{c}") for c in (velocity, ratio, "__chr")
                 for n, f in (("lo", F.min), ("hi", F.max))])
    j = j.crossJoin(mm)  # one row

    def norm(c):
        lo, hi = F.col(f"__lo{c}"), F.col(f"__hi{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    wv, wr, wc = weights
    score = norm(velocity) * wv + norm(ratio) * wr + norm("__chr") * wc
    return j.select(*df.columns, score.alias("composite_risk"))


# op 78
def leakage_lifetime_constant(df: DataFrame, columns: list[str], key: str = "customer_id",
                              min_rows: int = 2) -> DataFrame:
    """Share of customers (with >= min_rows rows) on whose rows each column is constant
    (a smallest and a largest value that are equal; only nulls: not constant),
    plus the verdict for the busiest customer (ties: smallest key)."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"),
                              *[F.coalesce(F.min(c) == F.max(c), F.lit(False)).alias(f"__d{i}")
                                for i, c in enumerate(columns)])
    per = per.filter(F.col("__n") >= min_rows)
    top = per.orderBy(F.col("__n").desc(), F.col(key)).limit(1)
    shares = per.agg(F.count(F.lit(1)).alias("n_customers"),
                     *[F.avg(F.col(f"__d{i}").cast("double")).alias(f"__s{i}")
                       for i in range(len(columns))])
    j = top.crossJoin(shares)
    entries = [F.struct(F.lit(c).alias("column_name"),
                        F.col(f"__d{i}").alias("is_lifetime_constant"),
                        F.col(f"__s{i}").alias("constant_share"))
               for i, c in enumerate(columns)]
    return j.select(F.col(key).alias("customer_checked"),
                    F.col("__n").alias("n_transactions_checked"), "n_customers",
                    F.explode(F.array(*entries)).alias("e")).select(
        "customer_checked", "n_transactions_checked", "n_customers", "e.*")


# op 79
def leakage_recompute(df: DataFrame, stored: str, recomputed: str, tol: float = 1e-6) -> DataFrame:
    s, r = F.col(stored), F.col(recomputed)
    d = s - r
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum((F.abs(d) <= tol).cast("long")).alias("n_match"),
                  F.sum((d > tol).cast("long")).alias("n_stored_higher"),
                  F.sum((d < -tol).cast("long")).alias("n_stored_lower")).select(
        "*", (F.col("n_match").cast("double") / F.col("n_rows")).alias("match_rate"))


# op 80
def prefix_safety(full: DataFrame, prefix: DataFrame, id_col: str, feature: str,
                  tol: float = 1e-9) -> DataFrame:
    """Compare a feature computed on all rows with the same feature computed on a
    time prefix of the table; clean iff no row of the prefix changed."""
    a = full.select(id_col, F.col(feature).alias("__full"))
    b = prefix.select(id_col, F.col(feature).alias("__prefix"))
    j = b.join(a, id_col)
    same = (F.abs(F.col("__full") - F.col("__prefix")) <= tol) | \
        (F.col("__full").isNull() & F.col("__prefix").isNull())
    return j.agg(F.lit(feature).alias("feature"), F.count(F.lit(1)).alias("n_prefix_rows"),
                 F.sum((~same).cast("long")).alias("n_changed")).select(
        "*", (F.col("n_changed") == 0).alias("is_prefix_safe"))


def _share(seed: str, *parts: Column) -> Column:
    """A seeded whole number from 0 to 65,535 that only the parts decide."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("long")


def prefix_audit(df: DataFrame, build: Callable[[DataFrame], DataFrame], features: list[str],
                 key: str = "customer_id", ts: str = "ts", id_col: str = "transaction_id",
                 markers: dict[str, object] | None = None, cutoff: Column | None = None,
                 seed: str = "42", tol: float = 1e-9) -> DataFrame:
    """Which features of a row depend on later rows of its key: all features, all keys, one pass.

    Every key gets a seeded cut inside its own span of time (``cutoff``: one time for all, rows
    from it on are later ones).  A second version of the table keeps the rows up to the cut, drops
    a seeded half of the later ones (all, if there are no ``markers``) and overwrites the
    ``markers`` columns of the others, so that a feature that looks ahead at values, at times or at
    the number of rows differs between the versions.  Both versions go through ``build`` once, as
    one table whose key is (key, version); a hot key is spread as ``build`` spreads it.

    ``build`` must keep the columns that it is given and may relate rows by key and time only (a
    statistic over all keys would mix the versions; compare those by ``prefix_safety``).  Rows without a
    key form one group.  Rows without a time are no later ones.  Rows that share id, key and time
    are compared by their smallest and largest values.  Numbers are equal within ``tol``,
    other types if equal; null equals null alone.  One row per feature: n_prefix_rows (rows up to
    the cut), n_changed, n_keys (keys that have later rows), n_keys_changed, is_prefix_safe.

    Reads ``df`` once for the cuts (not with ``cutoff``) and as often as ``build`` reads its input.
    """
    group = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("v"))
    t = epoch_micros(ts)
    if cutoff is None:
        lo, hi = F.min(t), F.max(t)
        # steps of 1/65536 of the span keep the product inside a long, and the cut before the last row
        cut = lo + F.floor((hi - lo) / 65536) * _share(seed, F.first("__g")["v"])
        cuts = df.select(group.alias("__g"), F.col(ts).alias(ts)).groupBy("__g").agg(cut.alias("__cut"))
        rows = lookup_join(df.select("*", group.alias("__g")), cuts, "__g", "left")
        later = t > F.col("__cut")
    else:
        rows = df.select("*", group.alias("__g"))
        later = F.col(ts) >= cutoff
    rows = rows.select(*df.columns, F.coalesce(later, F.lit(False)).alias("__later"),
                       F.explode(F.array(F.lit(0), F.lit(1))).alias("__version"))
    altered = F.col("__later") & (F.col("__version") == 1)
    gone = altered & (_share(f"{seed}:drop", F.col(id_col)) < 32768) if markers else altered
    markers = markers or {}
    types = dict(zip(df.columns, (f.dataType for f in df.schema.fields)))
    tagged = rows.filter(~gone).select(
        *[F.struct(F.col(key).alias("v"), F.col("__version").alias("version")).alias(key) if c == key
          else F.when(altered, F.lit(markers[c]).cast(types[c])).otherwise(F.col(c)).alias(c) if c in markers
          else F.col(c) for c in df.columns], "__later")
    built = build(tagged)
    number = {f.name for f in built.schema.fields if isinstance(f.dataType, T.NumericType)}
    version = F.col(key)["version"]

    def side(fn, i: int, c: str, v: int) -> Column:
        return fn(F.when(version == v, F.col(c))).alias(f"{fn.__name__}{i}_{v}")

    # later rows meet here too: they tell which keys have any
    met = built.groupBy(F.struct(F.col(key)["v"].alias("v")).alias("g"), F.col("__later").alias("later"),
                        F.col(id_col).alias("id"), F.col(ts).alias("t")).agg(
        F.sum((version == 0).cast("long")).alias("rows"),
        *[side(fn, i, c, v) for i, c in enumerate(features) for fn in (F.min, F.max) for v in (0, 1)])

    def differs(i: int, c: str) -> Column:
        pairs = [(F.col(f"{fn}{i}_0"), F.col(f"{fn}{i}_1")) for fn in ("min", "max")]
        same = [a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tol, F.lit(False)) if c in number else a.eqNullSafe(b)
                for a, b in pairs]
        return ~(same[0] & same[1])

    kept = ~F.col("later")
    per_key = met.groupBy("g").agg(
        F.sum(F.when(kept, F.col("rows")).otherwise(0)).alias("rows"), F.max(F.col("later").cast("int")).alias("open"),
        *[F.sum(F.when(kept & differs(i, c), F.col("rows")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(features)])
    one = per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("open"), F.lit(0)).cast("long").alias("open"),
        *[F.struct(F.lit(c).alias("feature"), F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias("n_changed"),
                   F.count(F.when(F.col(f"c{i}") > 0, 1)).alias("n_keys_changed")).alias(f"e{i}")
          for i, c in enumerate(features)])
    e = one.select("rows", "open", F.explode(F.array(*[f"e{i}" for i in range(len(features))])).alias("e"))
    return e.select("e.feature", F.col("rows").alias("n_prefix_rows"), "e.n_changed", F.col("open").alias("n_keys"),
                    "e.n_keys_changed", (F.col("e.n_changed") == 0).alias("is_prefix_safe"))


# op 81
def rank_within(values: Column, k: int = 3) -> Column:
    """Top-k (feature, value) structs by |value| descending from an array of structs."""
    ranked = F.array_sort(values, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                          .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                          .when(a["feature"] < b["feature"], -1)
                          .when(a["feature"] > b["feature"], 1).otherwise(0))
    return F.slice(ranked, 1, k)
