"""Ranks in stretches against plain windows: skew, ties, nulls."""

import random

from pyspark.sql import Window, functions as F

from sparrowmill.operators import ranks


def test_like_a_window(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, 1.0, 1.0, 2.5] + [rnd.gauss(0, 1) for _ in range(4)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(4)
    w = Window.partitionBy("k").orderBy(F.col("v").asc_nulls_first(), "id")
    want = {r.id: r.n for r in df.withColumn("n", F.row_number().over(w)).collect()}
    assert {r.id: r.n for r in ranks.ranked(df, ["k"], F.col("v"), [F.col("id")], "n").collect()} == want
    assert ranks.ranked(df.where("false"), ["k"], F.col("v"), [F.col("id")]).count() == 0
    same = df.withColumn("v", F.lit(3.0))
    assert sorted(r["rank"] for r in ranks.ranked(same.where("k = 'hot'"), ["k"], F.col("v"), [F.col("id")]).collect()) == list(range(1, same.where("k = 'hot'").count() + 1))
