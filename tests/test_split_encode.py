"""Splits by the cut hash, value dictionaries and the cube over cells: brute force, many classes, plan shapes."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from txrisk.operators import encode, risk, split


def md5(x):
    return hashlib.md5(str(x).encode()).hexdigest()


def by_class(rows):
    groups = defaultdict(list)
    for i, c in rows:
        groups[c].append(i)
    return {c: sorted(ids, key=lambda i: (md5(i), i)) for c, ids in groups.items()}


def half_up(x):
    return int(x + 0.5)


@pytest.mark.parametrize("frac", [0.0, 0.2, 0.37, 1.0])
def test_split_takes_the_smallest_hashes(spark, frac):
    rnd = random.Random(3)
    rows = [(i, None if rnd.random() < 0.05 else (0 if rnd.random() < 0.7 else rnd.randrange(1, 6))) for i in range(3000)]
    df = spark.createDataFrame(rows, "transaction_id long, is_fraud int")
    for digits in (1, 4):  # few buckets: the second count and the ranking work too
        got = {r["transaction_id"] for r in split.stratified_split(df, test_frac=frac, hex_digits=digits).filter("is_test").collect()}
        want = {i for ids in by_class(rows).values() for i in ids[:half_up(frac * len(ids) + 1e-9)]}
        assert got == want


def test_split_of_ten_thousand_classes(spark):
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("transaction_id"),
                               F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10_000).cast("int").alias("is_fraud"))
    s = split.stratified_split(df, test_frac=0.5)
    per = s.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t"))
    assert per.filter(F.col("t") != F.round(F.col("n") * 0.5)).count() == 0
    assert per.count() > 9_990 and s.count() == n


def test_split_reads_rows_once_and_leaves_them_where_they_are(spark, tmp_path):
    path = f"{tmp_path}/rows"
    spark.range(2000).select(F.col("id").alias("transaction_id"), (F.col("id") % 9 == 0).cast("int").alias("is_fraud")
                             ).write.parquet(path)
    s = split.stratified_split(spark.read.parquet(path))
    plan = s._jdf.queryExecution().executedPlan().toString()
    # the small tables below the broadcast are already there: the rows' own branch has no exchange
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("BroadcastExchange")[0]


def test_repeated_ids_go_together(spark):
    rows = [(i // 3, 0) for i in range(300)]
    s = split.stratified_split(spark.createDataFrame(rows, "transaction_id long, is_fraud int"), test_frac=0.335)
    sides = s.groupBy("transaction_id").agg(F.count_distinct("is_test").alias("n"))
    assert sides.filter("n > 1").count() == 0
    assert 100 <= s.filter("is_test").count() <= 103


def test_split_and_folds_of_no_rows(spark):
    none = spark.createDataFrame([], "transaction_id long, is_fraud int")
    assert split.stratified_split(none).columns == ["transaction_id", "is_fraud", "is_test"]
    assert split.stratified_split(none).count() == 0 and split.stratified_kfold(none).count() == 0


def test_folds_keep_rows_without_a_class(spark):
    rows = [(i, None if i % 4 == 0 else i % 2) for i in range(900)]
    got = {r["transaction_id"]: r["fold"] for r in split.stratified_kfold(
        spark.createDataFrame(rows, "transaction_id long, is_fraud int"), 3).collect()}
    want = {i: r % 3 for ids in by_class(rows).values() for r, i in enumerate(ids)}
    assert got == want


def test_dictionary_of_many_values(spark):
    n = 20_000
    df = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("v")).unionByName(
        spark.createDataFrame([(None,), ("",)], "v string"))
    got = [r["v"] for r in encode.label_encode(df, "v").filter("v IS NOT NULL").orderBy("v_encoded").collect()]
    assert got == sorted(["", *[md5(i) for i in range(n)]])
    assert encode.label_encode(df, "v").filter("v IS NULL AND v_encoded IS NULL").count() == 1
    # ranks are taken range by range; the only window without a key is over the sizes of the ranges
    d = encode.dictionary(df, "v", "code")
    sizes = d.agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.count_distinct("code").alias("n")).first()
    assert (sizes["lo"], sizes["hi"], sizes["n"]) == (0, n, n + 1)


def test_sparse_one_hot_is_one_hot(spark):
    rows = [(i, None if i % 7 == 0 else f"c{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, c string")
    wide = {r["id"]: list(r[2:]) for r in encode.one_hot(df, "c").collect()}
    got = {r["id"]: r["c_vector"] for r in encode.one_hot_sparse(df, "c").collect()}
    for i, values in wide.items():
        assert list(got[i].toArray()) == [v or 0 for v in values], i
    no_nulls = encode.one_hot_sparse(df.filter("c IS NOT NULL"), "c").collect()
    assert all(r["c_vector"].size == 5 and r["c_vector"].numNonzeros() == 1 for r in no_nulls)


def test_one_hot_refuses_a_wide_column(spark):
    with pytest.raises(ValueError):
        encode.one_hot(spark.range(encode.MAX_COLUMNS + 5).select(F.col("id").cast("string").alias("c")), "c")


def test_cube_expands_cells_and_not_rows(spark):
    rows = [(f"b{i % 3}", None if i % 5 == 0 else f"l{i % 4}", f"c{i % 2}", None if i % 11 == 0 else i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "bank string, location string, channel string, is_fraud int")
    got = risk.risk_cube(df)
    plain = df.cube("bank", "location", "channel").agg(
        F.grouping_id().alias("gid"), F.count("is_fraud").alias("total"), F.sum("is_fraud").cast("long").alias("fraud_cases"))
    assert got.select(plain.columns).exceptAll(plain).count() == 0 and got.count() == plain.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")  # an aggregate stands below the expansion
