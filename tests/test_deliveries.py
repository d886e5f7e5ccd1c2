import random

import pytest

from threshline.operators.deliveries import dropped_deliveries, kept_deliveries, merged_deliveries
from threshline.operators.skew import join_by_frequency
from pyspark.sql import functions as F

SCHEMA = "delivery_id LONG, id LONG, updated_at STRING, _n STRING, _at STRING"


def brute(rows):
    best = {}
    for d, i, u, *_ in rows:
        if i is not None:
            key = (u or "", -d)
            best[i] = max(best.get(i, (key, d)), (key, d))
    return sorted(d for d, i, *_ in rows if i is not None and best[i][1] != d)


@pytest.mark.parametrize("part", [200_000, 7])
def test_hot_group_ties_and_nulls(spark, part):
    rnd = random.Random(1)
    stamps = [None, *[f"2024-01-{d:02d}T00:00:00Z" for d in range(1, 29)]]
    rows = [(k, rnd.choice([7] * 40 + list(range(100)) + [None]), rnd.choice(stamps), "x", None) for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    dropped = sorted(r[0] for r in dropped_deliveries(df, rows_per_part=part).collect())
    kept = sorted(r[0] for r in kept_deliveries(df, rows_per_part=part).collect())
    assert dropped == brute(rows)
    assert sorted(dropped + kept) == [r[0] for r in rows]


@pytest.mark.parametrize("cut", [0, 250])
def test_stored_and_new(spark, cut):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([7] * 9 + list(range(60)) + [None]), rnd.choice([None, "2024-01-01T00:00:00Z", "2024-01-01T09:00:00+09:00", "2024-02-01T00:00:00Z"]), "x", None) for k in range(600)]
    old, new = (spark.createDataFrame(part, SCHEMA) for part in (rows[:cut], rows[cut:]))
    stored = old.join(kept_deliveries(old, rows_per_part=20), "delivery_id", "left_semi")
    everything = kept_deliveries(spark.createDataFrame(rows, SCHEMA))
    assert sorted(merged_deliveries(stored, new, rows_per_part=20).collect()) == sorted(everything.collect())


def test_offsets_decide_by_instant(spark):
    rows = [(1, 1, "2024-01-01T10:00:00+09:00", "", ""), (2, 1, "2024-01-01 02:00:00 UTC", "", ""), (3, 1, "no time", "", ""), (4, 2, None, "", ""), (5, 2, None, "", "")]
    assert sorted(r[0] for r in dropped_deliveries(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 3, 5]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dropped_deliveries(df).collect() == [] and kept_deliveries(df).collect() == []


def test_join_by_frequency_equals_join(spark):
    rows = spark.range(1000).select((F.col("id") % 5 * (F.col("id") % 2)).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 3")
    for how in ("inner", "left"):
        want = sorted(tuple(r) for r in rows.join(keyed, "k", how).select("k", "id", "n").collect())
        got = sorted(tuple(r) for r in join_by_frequency(rows, keyed, "k", "n", F.col("id"), how, rows_per_part=50).select("k", "id", "n").collect())
        assert str(got) == str(want)
