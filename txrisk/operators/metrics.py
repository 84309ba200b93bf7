"""Evaluation metrics as DataFrames (ops 48, 100-110).

ROC / PR / AUC need cumulative counts in score order.  The plan:

1. ``groupBy(score)`` collapses ties (partial aggregation, so a score shared
   by a third of the rows costs nothing extra);
2. the distinct scores are cut into ``B`` buckets of roughly equal size by
   approximate quantiles of the *distinct* scores (O(B) numbers reach the
   driver), so a dense score region cannot pile up in one task;
3. per-bucket totals (B rows, bounded) are prefix-summed and broadcast;
4. a window partitioned by bucket adds the local running sum.

Never a ``Window.orderBy`` without ``partitionBy`` over raw rows.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.session import materialize, run_folder

LEAST_BUCKETS = 64


def _buckets(df: DataFrame, n_buckets: int | None) -> int:
    """As many as the session's shuffle partitions, so that a bucket stays a task's share."""
    return n_buckets or max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bucketize(g: DataFrame, score: str, n_buckets: int) -> DataFrame:
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = g.approxQuantile(score, probs, 0.1 / n_buckets) if probs else []
    splits = [float("-inf")] + sorted(set(c for c in cuts if c is not None)) + [float("inf")]
    return Bucketizer(splits=splits, inputCol=score, outputCol="__bk",
                      handleInvalid="keep").transform(g)


def cumulative_by_score(df: DataFrame, score: str = "score", label: str = "is_fraud",
                        n_buckets: int | None = None, group: str | None = None, written: bool = False) -> DataFrame:
    """One row per distinct score (per ``group`` if given): pos, neg, and tp/fp =
    counts with score >= s, plus the totals P, N (of the group).

    The rows of a score are counted for the cuts, the totals and the running sums; ``written``:
    once, to the shared folder."""
    g_cols = [group] if group else []
    n_buckets = _buckets(df, n_buckets)
    y = F.col(label).cast("long")
    g = (df.filter(F.col(score).isNotNull())
         .groupBy(*g_cols, score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))
    g = g.select(*g_cols, F.col(score).cast("double").alias(score), "pos", "neg")
    if written:
        g = materialize(g, run_folder(df.sparkSession, "score-counts"))
    gb = _bucketize(g, score, n_buckets)
    tot = gb.groupBy(*g_cols, "__bk").agg(F.sum("pos").alias("__bp"), F.sum("neg").alias("__bn"))
    # prefix over at most n_buckets rows per group (higher buckets = higher scores first)
    wg = Window.partitionBy(*g_cols) if g_cols else Window.partitionBy()
    wb = wg.orderBy(F.col("__bk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*g_cols, "__bk", F.coalesce(F.sum("__bp").over(wb), F.lit(0)).alias("__op"),
                     F.coalesce(F.sum("__bn").over(wb), F.lit(0)).alias("__on"),
                     F.sum("__bp").over(wg).alias("P"), F.sum("__bn").over(wg).alias("N"))
    wl = (Window.partitionBy(*g_cols, "__bk").orderBy(F.col(score).desc())
          .rowsBetween(Window.unboundedPreceding, 0))
    # <= n_buckets rows: broadcast; per group (groups x n_buckets rows): broadcast after a size check
    if g_cols:
        from txrisk.operators.joins import broadcast_if_small

        off = broadcast_if_small(off)
    else:
        off = F.broadcast(off)
    j = gb.join(off, [*g_cols, "__bk"])
    return j.select(*g_cols, score, "pos", "neg",
                    (F.col("__op") + F.sum("pos").over(wl)).alias("tp"),
                    (F.col("__on") + F.sum("neg").over(wl)).alias("fp"), "P", "N")


# op 100
def auc_roc(cum: DataFrame) -> DataFrame:
    """Exact AUC with ties counted 1/2: sum over scores of neg * (#pos above + pos/2) / (P*N)."""
    return cum.agg(
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))
         / (F.first("P").cast("double") * F.first("N").cast("double"))).alias("auc"))


# op 104
def roc_curve(cum: DataFrame, score: str = "score") -> DataFrame:
    start = cum.limit(1).select(F.lit(None).cast("double").alias("threshold"),
                                F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    pts = cum.select(F.col(score).alias("threshold"),
                     (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))
    return start.unionByName(pts)


# op 105
def pr_curve_f1(cum: DataFrame, score: str = "score") -> DataFrame:
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.col("P")
    return cum.select(F.col(score).alias("threshold"), p.alias("precision"), r.alias("recall"),
                      (2 * p * r / (p + r + F.lit(1e-9))).alias("f1"))


# op 108
def threshold_for_recall(cum: DataFrame, target: float = 0.75, score: str = "score") -> DataFrame:
    return (cum.filter(F.col("tp") / F.col("P") >= target)
            .agg(F.max(score).alias("threshold"), F.lit(target).alias("target_recall"))
            .join(cum.select(F.col(score).alias("threshold"), "tp", "fp", "P", "N"),
                  "threshold", "left")
            .select("threshold", "target_recall", (F.col("tp") / F.col("P")).alias("recall"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision")))


# ---------------------------------------------------------------- confusion-based
def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, pred: Column, label: str = "is_fraud") -> DataFrame:
    y = F.col(label)
    p = pred.cast("int")
    return df.agg(F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
                  F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
                  F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
                  F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"))


def predict_gt(score: str = "score", threshold: float = 0.5) -> Column:
    """Class rule of ``predict``: 1 iff p > threshold."""
    return (F.col(score) > threshold).cast("int")


# op 101
def confusion_matrix(df: DataFrame, score: str = "score", label: str = "is_fraud",
                     threshold: float = 0.5) -> DataFrame:
    c = confusion(df, predict_gt(score, threshold), label)
    return c.select("tn", "fp", "fn", "tp",
                    F.floor(F.col("fp") / F.greatest(F.col("tp"), F.lit(1))).cast("long")
                    .alias("false_alarms_per_catch"))


def _metric_cols(tp, fp, fn, tn) -> dict[str, Column]:
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    return {
        "accuracy": _safe_div(tp + tn, tp + fp + fn + tn),
        "precision": prec,
        "recall": rec,
        "f1": F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)),
    }


# op 102
def core_metrics(df: DataFrame, score: str = "score", label: str = "is_fraud",
                 threshold: float = 0.5) -> DataFrame:
    c = confusion(df, predict_gt(score, threshold), label)
    m = _metric_cols(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    return c.select("tp", "fp", "fn", "tn", *[v.alias(k) for k, v in m.items()])


# op 103
def classification_report(df: DataFrame, score: str = "score", label: str = "is_fraud",
                          threshold: float = 0.5) -> DataFrame:
    c = confusion(df, predict_gt(score, threshold), label)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def cls(name, tp_, fp_, fn_, support):
        p = _safe_div(tp_, tp_ + fp_)
        r = _safe_div(tp_, tp_ + fn_)
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        return F.struct(F.lit(name).alias("class_label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), support.alias("support"))

    c1 = cls("1", tp, fp, fn, tp + fn)
    c0 = cls("0", tn, fn, fp, tn + fp)
    rows = c.select(c0.alias("a"), c1.alias("b"), (tp + fp + fn + tn).alias("n"),
                    _safe_div(tp + tn, tp + fp + fn + tn).alias("acc"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    macro = F.struct(F.lit("macro avg").alias("class_label"),
                     ((a["precision"] + b["precision"]) / 2).alias("precision"),
                     ((a["recall"] + b["recall"]) / 2).alias("recall"),
                     ((a["f1"] + b["f1"]) / 2).alias("f1"), n.alias("support"))

    def wavg(f):
        return (a[f] * a["support"] + b[f] * b["support"]) / n

    weighted = F.struct(F.lit("weighted avg").alias("class_label"), wavg("precision").alias("precision"),
                        wavg("recall").alias("recall"), wavg("f1").alias("f1"), n.alias("support"))
    acc = F.struct(F.lit("accuracy").alias("class_label"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                   n.alias("support"))
    return rows.select(F.explode(F.array(a, b, macro, weighted, acc)).alias("r")).select("r.*")


# op 106
def threshold_sweep(df: DataFrame, score: str = "score", label: str = "is_fraud",
                    thresholds=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Confusion counts at each threshold (p >= t) in ONE aggregation pass."""
    y, s = F.col(label), F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = s >= F.lit(t)
        aggs += [F.sum((hit & (y == 1)).cast("long")).alias(f"tp{i}"),
                 F.sum((hit & (y == 0)).cast("long")).alias(f"fp{i}"),
                 F.sum((~hit & (y == 1)).cast("long")).alias(f"fn{i}"),
                 F.sum((~hit & (y == 0)).cast("long")).alias(f"tn{i}")]
    one = df.agg(*aggs)
    entries = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                        F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"),
                        F.col(f"tn{i}").alias("tn")) for i, t in enumerate(thresholds)]
    r = one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    return r.select("*", prec.alias("precision"), rec.alias("recall"),
                    (2 * prec * rec / (prec + rec + F.lit(1e-9))).alias("f1"))


# op 107
def threshold_value(sweep: DataFrame, alpha: float = 0.01, beta_ratio: float = 10.0,
                    benefit: float | None = None, cost_fp: float | None = None,
                    cost_fn: float | None = None) -> DataFrame:
    """argmax over thresholds of TP - a*FP - (10a)*FN (or the benefit/cost form);
    ties -> the lowest threshold."""
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    if benefit is not None:
        v = tp * benefit - fp * cost_fp - fn * cost_fn
    else:
        v = tp - fp * alpha - fn * (alpha * beta_ratio)
    sv = sweep.select("threshold", "tp", "fp", "fn", v.alias("value"))
    best = sv.agg(F.max_by(F.struct("threshold", "tp", "fp", "fn", "value"),
                           F.struct(F.col("value"), -F.col("threshold"))).alias("b"))
    return best.select("b.*")


# op 109
def model_comparison(df: DataFrame, score_a: str, score_b: str, label: str = "is_fraud",
                     threshold: float = 0.5, n_buckets: int | None = None) -> DataFrame:
    def one(score):
        m = core_metrics(df, score, label, threshold)
        a = auc_roc(cumulative_by_score(df, score, label, n_buckets))
        return m.crossJoin(a)

    ma, mb = one(score_a), one(score_b)
    names = ["auc", "accuracy", "precision", "recall", "f1"]

    def long(m, col):
        return m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"),
                                                     F.col(n).alias(col)) for n in names])).alias("e")
                        ).select("e.*")

    j = long(ma, "model_a").join(long(mb, "model_b"), "metric")
    return j.select("metric", "model_a", "model_b",
                    F.when(F.col("model_a") != 0, (F.col("model_b") - F.col("model_a"))
                           / F.col("model_a") * 100).alias("relative_change_pct"))


# op 110
def alert_cost(df: DataFrame, score: str = "score", label: str = "is_fraud", threshold: float = 0.5,
               cost_per_alert: float = 10.0) -> DataFrame:
    c = confusion(df, predict_gt(score, threshold), label)
    alerts = F.col("tp") + F.col("fp")
    return c.select(alerts.alias("alerts"), (alerts * F.lit(cost_per_alert)).alias("investigation_cost"),
                    _safe_div(F.col("fp"), alerts).alias("false_discovery_rate"),
                    _safe_div(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"))


# op 48
def roc_interp_join(curve_a: DataFrame, curve_b: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """np.interp(fpr_b, fpr_a, tpr_a) as an ordered as-of merge, plus the gap tpr_b - interp.

    The points of both curves are put in one order (fpr, curve A first, tpr), so among
    equal fpr the last (largest tpr) of A wins, as in numpy.  The points are written once and cut
    into ranges of that whole order, which hold equal shares however many points lie at
    one fpr; the ranges' first and last points of A (a row a range) are carried over
    the ranges without one.  Points without an fpr take no part; without points of A the
    interpolated value is null.
    """
    spark = curve_a.sparkSession
    n_ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["x", "src", "y"]
    points = (curve_a.select(F.col("fpr").alias("x"), F.lit(0).alias("src"), F.col("tpr").alias("y"))
              .unionByName(curve_b.select(F.col("fpr").alias("x"), F.lit(1).alias("src"), F.col("tpr").alias("y")))
              .filter(F.col("x").isNotNull()))
    folder = run_folder(spark, "roc-merge")
    points = materialize(points, f"{folder}/points")  # cutting ranges reads them twice
    u = materialize(points.repartitionByRange(n_ranges, *order)
                    .select("*", F.spark_partition_id().alias("range")), f"{folder}/ranges")
    a_point = F.when(F.col("src") == 0, F.struct("x", "y"))
    ends = u.groupBy("range").agg(F.min(a_point).alias("first"), F.max(a_point).alias("last"))
    # one row per range
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select("range", F.last("last", ignorenulls=True).over(earlier).alias("cin"),
                          F.first("first", ignorenulls=True).over(later).alias("cout"))
    w = Window.partitionBy("range").orderBy(*order)
    upto, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    r = u.join(F.broadcast(carried), "range").select(
        "x", "src", F.col("y").alias("tpr_b"),
        F.coalesce(F.last(a_point, ignorenulls=True).over(upto), "cin").alias("l"),
        F.coalesce(F.first(a_point, ignorenulls=True).over(on), "cout").alias("r")).filter(F.col("src") == 1)
    x0, y0, x1, y1 = F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y")
    interp = (F.when(F.col("l").isNull(), y1)
              .when(F.col("r").isNull() | (F.col("x") == x0), y0)
              .otherwise(y0 + (y1 - y0) * (F.col("x") - x0) / (x1 - x0)))
    return r.select(F.col("x").alias("fpr"), "tpr_b", interp.alias("tpr_a_interp"),
                    (F.col("tpr_b") - interp).alias("gap"))
