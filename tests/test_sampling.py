"""Split quotas, folds and samples."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import sampling as S


def _labels(spark, n_pos=37, n_neg=250):
    rows = [(i, 1) for i in range(n_pos)] + [(1000 + i, 0) for i in range(n_neg)]
    return spark.createDataFrame(rows, "id long, label int")


def test_split_quotas_per_class(spark):
    df = _labels(spark)
    s = S.stratified_split(df, ["id"], "label", (0.6, 0.2, 0.2))
    got = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for label, n in ((1, 37), (0, 250)):
        nt = math.ceil(n * 0.2)
        nv = math.ceil((n - nt) * 0.25)
        assert got[(label, "test")] == nt and got[(label, "val")] == nv
        assert got[(label, "train")] == n - nt - nv
    assert s.select("id").distinct().count() == 287


def test_split_is_deterministic(spark):
    df = _labels(spark)
    a = S.stratified_split(df, ["id"], "label").where("split = 'test'").select("id").collect()
    b = S.stratified_split(df, ["id"], "label").where("split = 'test'").select("id").collect()
    assert sorted(a) == sorted(b)


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        S.stratified_split(_labels(spark), ["id"], "label", (0.5, 0.2, 0.2))


def test_kfold_balanced(spark):
    f = S.stratified_kfold(_labels(spark), ["id"], "label", k=5)
    got = {(r.label, r.fold): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    for label, n in ((1, 37), (0, 250)):
        sizes = sorted(got[(label, k)] for k in range(5))
        assert sizes[-1] - sizes[0] <= 1 and sum(sizes) == n


def test_stratified_sample_tops_up(spark):
    s = S.stratified_sample(_labels(spark), ["id"], "label", 100)
    got = {r.label: r["count"] for r in s.groupBy("label").count().collect()}
    assert got == {1: 37, 0: 63}
    assert S.stratified_sample(_labels(spark), ["id"], None, 10).count() == 10


def test_hash_rank_is_a_permutation(spark):
    r = S.hash_rank(_labels(spark), ["id"], ["label"], n_buckets=7)
    for label, n in ((1, 37), (0, 250)):
        ranks = sorted(x._rank for x in r.where(F.col("label") == label).select("_rank").collect())
        assert ranks == list(range(n))
