"""Profiling and data-quality audits (ops 9-18).

Every audit is a single aggregation pass over the table (all columns in one
``agg``), reduced map-side, followed by an unpivot of the one result row to a
long table.  Nothing is collected except where a result is O(1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)

def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns (booleans excluded, as numpy's number selection does)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in set(exclude)]


def _long(rows: list[Column]) -> Column:
    return F.explode(F.array(*rows))


# op 9
def profile_schema(df: DataFrame) -> DataFrame:
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(F.col(f"`{c}`")).alias(f"__c{i}") for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"),
                        F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                        F.col(f"__c{i}").alias("non_null"))
               for i, c in enumerate(cols)]
    return (agg.select(F.col("__n").alias("n_rows"), F.lit(len(cols)).alias("n_columns"),
                       _long(entries).alias("e"))
            .select("e.position", "e.column_name", "e.dtype", "e.non_null",
                    "n_rows", "n_columns"))


#: Items kept by the sketch that brackets a quantile; its error in rank is one part in as many.
SKETCH = 10_000
#: Most distinct values in a bracket that are ranked in one task.
RANKED = 1_000_000


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Ascending brackets without overlaps."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _in_cells(clean: DataFrame, brackets: list[list[tuple[float, float]]]) -> DataFrame:
    """One row per value: column ``m``, value ``x`` and cell ``cell``, odd inside a bracket, even between brackets."""
    def entry(i: int, of: list[tuple[float, float]]) -> Column:
        x = F.col(f"x{i}")
        cell = F.lit(0)
        for lo, hi in of:
            cell = cell + (x >= F.lit(lo)).cast("int") + (x > F.lit(hi)).cast("int")
        return F.when(x.isNotNull(), F.struct(F.lit(i).alias("m"), x.alias("x"), cell.alias("cell")))

    entries = [entry(i, of) for i, of in enumerate(brackets) if of]
    return clean.select(F.explode(F.array(*entries)).alias("e")).filter(F.col("e").isNotNull()).select("e.*")


def _narrowed(cells: DataFrame, brackets: list[list[tuple[float, float]]], ranks: list[list[int]],
              ranked: int) -> list[list[tuple[float, float]]] | None:
    """Brackets of the same ranks inside the given ones; None if none holds more than ``ranked`` distinct values.

    Two aggregates over (column, cell): what each cell holds, and a sketch of the values
    of the cells that hold too many.
    """
    per = cells.groupBy("m", "cell").agg(F.count(F.lit(1)).alias("c"), F.approx_count_distinct("x", 0.02).alias("d")).collect()
    held = {(r["m"], r["cell"]): (r["c"], r["d"]) for r in per}
    # 1.1: the distinct count is an estimate
    wide = [k for k, (_, d) in held.items() if k[1] % 2 and d * 1.1 > ranked]
    if not wide:
        return None
    asked, probs = [], {}
    for m, cell in wide:
        below = sum(c for (i, j), (c, _) in held.items() if i == m and j < cell)
        n = held[m, cell][0]
        inside = [r - below for r in ranks[m] if below < r <= below + n]
        probs[m, cell] = [min(max(r / n + d, 0.0), 1.0) for r in inside for d in (-4 / SKETCH, 4 / SKETCH)]
        if inside:
            here = (F.col("m") == m) & (F.col("cell") == cell)
            asked.append(F.percentile_approx(F.when(here, F.col("x")), F.array(*[F.lit(p) for p in probs[m, cell]]), SKETCH)
                         .alias(f"b{m}_{cell}"))
    near = cells.agg(*asked).first() if asked else {}
    out = []
    for m, of in enumerate(brackets):
        new = []
        for k, bracket in enumerate(of):
            cell = 2 * k + 1
            if (m, cell) not in probs:
                new.append(bracket)
            elif probs[m, cell]:
                b = near[f"b{m}_{cell}"]
                new += list(zip(b[::2], b[1::2]))
        out.append(_merged(new))
    return None if out == brackets else out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], ranked: int = RANKED) -> DataFrame:
    """One row with an array of the exact, linearly interpolated quantiles per column (``q0``, ``q1``, ...).

    Nulls and NaN are left out; a column without values gives null elements.

    Distributed selection: a sketch of bounded size brackets each quantile between two
    values, four times its error apart on either side; while a bracket may hold more than ``ranked``
    distinct values, counts tell the quantile's rank inside it and a sketch of its values gives
    a bracket 1,250 times narrower.  One aggregate then counts the values between brackets
    and the distinct values inside them, and these, at most ``ranked`` a bracket, are ranked in a
    task per column.  Up to 1,000 times ``ranked`` rows (10^9) that is one small job
    beforehand and one pass; ten million times as many take one round more.
    """
    clean = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}")
                        for i, c in enumerate(cols)])
    slack = 4 / SKETCH
    near = F.array(*[F.lit(min(max(p + d, 0.0), 1.0)) for p in probs for d in (-slack, slack)])
    sketch = clean.agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(cols))],
                       *[F.percentile_approx(f"x{i}", near, SKETCH).alias(f"b{i}") for i in range(len(cols))]).first()
    n = [sketch[f"n{i}"] for i in range(len(cols))]
    brackets = [_merged(list(zip(b[::2], b[1::2]))) if (b := sketch[f"b{i}"]) else [] for i in range(len(cols))]
    # ranks from 1 of the values on either side of a quantile
    where = [[p * (n[i] - 1) for p in probs] for i in range(len(cols))]
    ranks = [sorted({r for w in ws for r in (math.floor(w) + 1, math.ceil(w) + 1)}) if n[i] else []
             for i, ws in enumerate(where)]
    if not any(n):
        return df.sparkSession.range(1).select(*[F.array(*[F.lit(None).cast("double")] * len(probs)).alias(f"q{i}")
                                                 for i in range(len(cols))])
    # a bracket spans at most ten times the sketch's error in ranks, and a tie is one value
    while max(n) * 10 / SKETCH > ranked and (less := _narrowed(_in_cells(clean, brackets), brackets, ranks, ranked)):
        brackets = less
    inside = F.when(F.col("cell") % 2 == 1, F.col("x"))
    values = (_in_cells(clean, brackets).groupBy("m", "cell", inside.alias("v"))
              .agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    upto = Window.partitionBy("m").orderBy("cell", "lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = values.select("*", F.sum("c").over(upto).alias("upto"))

    asked = F.create_map(*[e for i, of in enumerate(ranks) if of
                           for e in (F.lit(i), F.array(*[F.lit(r).cast("long") for r in of]))])
    hits = runs.select("*", F.explode(F.filter(
        asked[F.col("m")], lambda r: (F.col("upto") - F.col("c") < r) & (r <= F.col("upto")))).alias("rank"))
    # a bracket's value, or an end of the gap beside a bracket
    value = (F.when((F.col("lo") == F.col("hi")) | (F.col("rank") == F.col("upto") - F.col("c") + 1), F.col("lo"))
             .when(F.col("rank") == F.col("upto"), F.col("hi"))
             .otherwise(F.raise_error(F.lit("a quantile's rank lies outside its bracket")).cast("double")))
    # one entry per column and rank asked for
    found = hits.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("_", "m", "rank"), value))).alias("v"))

    def quantile(i: int, w: float) -> Column:
        low, high = (F.col("v")[f"{i}_{r(w) + 1}"] for r in (math.floor, math.ceil))
        part = w - math.floor(w)
        return low * F.lit(1 - part) + high * F.lit(part) if part else low

    return found.select(*[F.array(*[quantile(i, w) if n[i] else F.lit(None).cast("double") for w in where[i]])
                          .alias(f"q{i}") for i in range(len(cols))])


# op 10
def profile_describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(x).alias(f"hi{i}")]
    one = df.agg(*aggs).crossJoin(exact_quantiles(df, cols, [0.25, 0.5, 0.75]))  # one row each
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"),
                        F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                        F.col(f"lo{i}").alias("min"), F.col(f"q{i}")[0].alias("p25"),
                        F.col(f"q{i}")[1].alias("p50"), F.col(f"q{i}")[2].alias("p75"),
                        F.col(f"hi{i}").alias("max"))
               for i, c in enumerate(cols)]
    return one.select(_long(entries).alias("e")).select("e.*")


# op 11
def null_audit(df: DataFrame, only_positive: bool = True) -> DataFrame:
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"__z{i}")
                   for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"__z{i}").alias("null_count"))
               for i, c in enumerate(cols)]
    out = (one.select("__n", _long(entries).alias("e"))
           .select("e.column_name", "e.null_count",
                   (F.col("e.null_count").cast("double") * 100 / F.col("__n")).alias("null_pct")))
    return out.filter(F.col("null_count") > 0) if only_positive else out


# op 12
def duplicate_audit(df: DataFrame, key: list[str] | str) -> DataFrame:
    key = [key] if isinstance(key, str) else key
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("cnt"))
    return per.agg(F.sum("cnt").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                   F.sum(F.col("cnt") - 1).alias("n_duplicate_rows"),
                   F.sum((F.col("cnt") > 1).cast("long")).alias("n_duplicated_keys"))


def drop_duplicates(df: DataFrame, key: list[str] | str) -> DataFrame:
    return df.dropDuplicates([key] if isinstance(key, str) else key)


# op 13
def class_balance(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("n").alias("total"),
                  F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("n0"),
                  F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("n1"))
    return (per.crossJoin(tot)  # 1-row totals
            .select(F.col(label), F.col("n").alias("count"),
                    (F.col("n").cast("double") * 100 / F.col("total")).alias("pct"),
                    F.floor(F.col("n0") / F.col("n1")).cast("long").alias("imbalance_ratio")))


# op 14
def range_checks(df: DataFrame, col: str = "amount") -> DataFrame:
    x = F.col(col)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum((x > 0).cast("long")).alias("n_positive"),
                  F.sum((x == 0).cast("long")).alias("n_zero"),
                  F.sum((x < 0).cast("long")).alias("n_negative"),
                  F.sum(x.isNull().cast("long")).alias("n_null"),
                  F.min(x).alias("min_value"), F.max(x).alias("max_value"))


# op 15
def iqr_outliers(df: DataFrame, col: str = "amount", k: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, [col], [0.25, 0.75])
    b = q.select(F.col("q0")[0].alias("q1"), F.col("q0")[1].alias("q3"))
    b = b.select("q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))
    b = b.select("*", (F.col("q1") - k * F.col("iqr")).alias("lower"),
                 (F.col("q3") + k * F.col("iqr")).alias("upper"))
    x = F.col(col)
    cnt = (df.select(col).crossJoin(F.broadcast(b.select("lower", "upper")))  # 1 row
           .agg(F.count(F.lit(1)).alias("n_rows"),
                F.sum(((x < F.col("lower")) | (x > F.col("upper"))).cast("long"))
                .alias("n_outliers")))
    return (b.crossJoin(cnt)
            .select("q1", "q3", "iqr", "lower", "upper", "n_rows", "n_outliers",
                    (F.col("n_outliers").cast("double") / F.col("n_rows")).alias("outlier_share")))


# op 16
def domain_violations(df: DataFrame, col: str, expected: list) -> DataFrame:
    """Values of ``col`` outside the expected set, with counts (nulls excluded)."""
    exp = df.sparkSession.createDataFrame([(v,) for v in expected], [col])
    vals = df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col(col).isNotNull())
    # expected list is a literal parameter (bounded): broadcast it
    return vals.join(F.broadcast(exp), col, "left_anti")


def cardinality(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("n_distinct"))
               for i, c in enumerate(cols)]
    return one.select(_long(entries).alias("e")).select("e.*")


# op 17
def time_coverage(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"),
                  F.count_distinct(F.year(ts), F.month(ts)).alias("n_months"),
                  F.count_distinct(F.to_date(ts)).alias("n_days"))


# op 18
def zero_variance_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return (cardinality(df, cols)
            .select("*", (F.col("n_distinct") <= 1).alias("is_constant")))
