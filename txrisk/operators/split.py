"""Deterministic splits and samples (ops 85-89).

Determinism across engines and re-runs comes from ranking by
``md5(CAST(id AS STRING))`` (optionally salted with a seed), never from
``rand``.  Exact per-class quotas without a window over a whole class:

* a split needs only the hash at which its class's quota is reached.  One job
  counts the rows of every (class, first ``hex_digits`` hex digits), which gives the
  bucket that holds the cut; a second job writes the ids of these buckets
  alone (one row in 65,536) and counts them by their next digits; what is ranked
  in the end is one row in 4 billion.  The rows then compare their hash with the
  cut of their class;
* a fold needs every row's rank: the rows of a bucket are ranked in one task, from
  the number of the class's rows in earlier buckets.

Rows without a class are a class of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.joins import lookup_join
from txrisk.session import materialize, run_folder


def hash_key(id_col: str, seed: str | None = None) -> Column:
    s = F.col(id_col).cast("string")
    if seed is not None:
        s = F.concat(F.lit(f"{seed}:"), s)
    return F.md5(s)


def _digits(h: Column, first: int, n: int) -> Column:
    return F.conv(F.substring(h, first + 1, n), 16, 10).cast("long")


def _before(counts: DataFrame, bucket: str) -> DataFrame:
    """``counts`` (class ``__g``, bucket, ``__c``) with the class's rows in earlier buckets and in all."""
    w = Window.partitionBy("__g").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("*", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__before"),
                         F.sum("__c").over(Window.partitionBy("__g")).alias("__n"))


def _holds(rank: Column) -> Column:
    return (F.col("__before") < rank) & (rank <= F.col("__before") + F.col("__c"))


def cut_hashes(df: DataFrame, id_col: str, label: str, frac: float, hex_digits: int = 4,
               seed: str | None = None) -> DataFrame:
    """One row per class ``__g``: the (md5, id) of its round(frac * n)-th row in that order.

    Classes whose quota is 0 have none.  Runs two jobs: the counts, and the ids in the
    buckets that hold a cut, which go to a table in the shared checkpoint folder.
    """
    r = df.select(F.struct(F.col(label).alias("v")).alias("__g"), hash_key(id_col, seed).alias("__h"),
                  F.col(id_col).alias("__id"))
    first = r.select("__g", _digits(F.col("__h"), 0, hex_digits).alias("__bk"))
    quota = F.round(F.col("__n") * F.lit(frac)).cast("long")
    at = (_before(first.groupBy("__g", "__bk").agg(F.count(F.lit(1)).alias("__c")), "__bk")
          .filter(_holds(quota)).select("__g", "__bk", (quota - F.col("__before")).alias("__rank")))
    # at: one row per class
    near = lookup_join(r.select("*", _digits(F.col("__h"), 0, hex_digits).alias("__bk")), at, ["__g", "__bk"], "inner")
    near = materialize(near.select("__g", "__h", "__id", "__rank", _digits(F.col("__h"), hex_digits, 4).alias("__b2")),
                       run_folder(df.sparkSession, "split-cut"))
    counts = near.groupBy("__g", "__b2").agg(F.count(F.lit(1)).alias("__c"), F.first("__rank").alias("__rank"))
    inner = (_before(counts, "__b2").filter(_holds(F.col("__rank")))
             .select("__g", "__b2", (F.col("__rank") - F.col("__before")).alias("__left")))
    last = near.select("__g", "__b2", "__h", "__id").join(inner, ["__g", "__b2"])
    w = Window.partitionBy("__g", "__b2").orderBy("__h", "__id")
    return (last.select("*", F.row_number().over(w).alias("__r")).filter(F.col("__r") == F.col("__left"))
            .select("__g", F.struct(F.col("__h").alias("h"), F.col("__id").alias("id")).alias("__cut")))


# op 85
def stratified_split(df: DataFrame, id_col: str = "transaction_id", label: str = "is_fraud",
                     test_frac: float = 0.2, hex_digits: int = 4, seed: str | None = None,
                     out: str = "is_test") -> DataFrame:
    """Exactly round(test_frac * n_class) rows of each class go to test: the ones
    with the smallest md5(id).  Rows that repeat the id of the last of them go with it.

    The rows are read once after the two jobs of ``cut_hashes`` and are not shuffled
    unless the classes are too many to broadcast."""
    cuts = cut_hashes(df, id_col, label, test_frac, hex_digits, seed)
    own = F.struct(hash_key(id_col, seed).alias("h"), F.col(id_col).alias("id"))
    rows = df.select("*", F.struct(F.col(label).alias("v")).alias("__g"))
    return lookup_join(rows, cuts, "__g", "left").select(
        *df.columns, F.coalesce(own <= F.col("__cut"), F.lit(False)).alias(out))


# op 87
def stratified_kfold(df: DataFrame, k: int = 3, id_col: str = "transaction_id",
                     label: str = "is_fraud", hex_digits: int = 4, seed: str | None = None,
                     out: str = "fold") -> DataFrame:
    """fold = (rank within class by md5 - 1) % k; ranks from bucket offsets + local rank.

    Rows meet the offset of their bucket where the bucket is ranked: both are dealt by
    (class, bucket), and nothing is broadcast unless it is measured to be small."""
    h = hash_key(id_col, seed)
    b = df.select("*", F.struct(F.col(label).alias("v")).alias("__g"), h.alias("__h"), _digits(h, 0, hex_digits).alias("__bk"))
    off = _before(b.groupBy("__g", "__bk").agg(F.count(F.lit(1)).alias("__c")), "__bk")
    wl = Window.partitionBy("__g", "__bk").orderBy("__h", id_col)
    rank = F.col("__before") + F.row_number().over(wl)
    return b.join(off.select("__g", "__bk", "__before"), ["__g", "__bk"]).select(
        *df.columns, ((rank - 1) % k).cast("int").alias(out))


# op 86
def temporal_split(df: DataFrame, ts: str = "ts", cutoff: str = "2024-01-24",
                   out: str = "split") -> DataFrame:
    c = F.lit(cutoff).cast("timestamp_ntz")
    return df.select("*", F.when(F.col(ts) < c, "train").otherwise("test").alias(out))


# op 88
def select_cases(df: DataFrame, id_col: str = "transaction_id", label: str = "is_fraud",
                 pred: str = "predicted", n_fraud: int = 50, n_fp: int = 50,
                 seed: str = "42") -> DataFrame:
    """<= n_fraud actual frauds + <= n_fp false positives, chosen by seeded md5.

    Each type is a distributed top-k (per-partition top n, then merge), not a
    window over the whole class.
    """
    h = hash_key(id_col, seed)
    fraud = (df.filter(F.col(label) == 1).select("*", h.alias("__h"))
             .orderBy("__h", id_col).limit(n_fraud)
             .select("*", F.lit("true_fraud").alias("case_type")))
    fp = (df.filter((F.col(label) == 0) & (F.col(pred) == 1)).select("*", h.alias("__h"))
          .orderBy("__h", id_col).limit(n_fp)
          .select("*", F.lit("false_positive").alias("case_type")))
    return fraud.unionByName(fp).drop("__h")


def flagged_cases(df: DataFrame, label: str = "is_fraud", pred: str = "predicted") -> DataFrame:
    """Every actual fraud and every false positive, with its case_type: one narrow pass."""
    kind = (F.when(F.col(label) == 1, "true_fraud")
            .when((F.col(label) == 0) & (F.col(pred) == 1), "false_positive"))
    return df.select("*", kind.alias("case_type")).filter(F.col("case_type").isNotNull())


# op 89
def blind_rating_sample(cases: DataFrame, id_col: str = "row_index", case_type: str = "case_type",
                        size: int = 50, seed: str = "42") -> DataFrame:
    """size/2 per type by seeded md5, top-up from the rest to ``size``, shuffled by
    a second md5, numbered 1..n.  Two top-k selections: the first rows per type
    (limited per partition before the shuffle), then the first ``size`` of the rest."""
    per = size // 2
    h = hash_key(id_col, seed)
    ranked = cases.select("*", h.alias("__h"),
                          F.row_number().over(Window.partitionBy(case_type).orderBy(h, id_col))
                          .alias("__r"))
    first = ranked.filter(F.col("__r") <= per)
    rest = (ranked.drop("__r").join(F.broadcast(first.select(id_col)), id_col, "left_anti")
            .orderBy("__h", id_col).limit(size))  # first: at most size / 2 rows per type
    first = first.drop("__r")
    n_first = first.agg(F.count(F.lit(1)).alias("__n1"))
    top_up = (rest.crossJoin(n_first)
              .select("*", F.row_number().over(Window.orderBy("__h", id_col)).alias("__t"))
              .filter(F.col("__t") <= F.lit(size) - F.col("__n1"))
              .drop("__n1", "__t"))
    chosen = first.unionByName(top_up)
    shuffle = hash_key(id_col, f"{seed}:shuffle")
    return (chosen.select("*", F.row_number().over(Window.orderBy(shuffle, id_col)).alias("case_id"))
            .drop("__h"))
