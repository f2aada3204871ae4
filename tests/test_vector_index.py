"""The inverted file of vectors: all lists give the exact result, few lists most of it, and it opens again."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import retrieval, vector_index


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    rnd = random.Random(8)
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 16))
    rows = [(i, (middles[rnd.randrange(12)] + rng.normal(size=16) * 0.6).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # one list holds a third of all rows
    rows += [(2000, [1.0, 2.0]), (2001, [2.0, 4.1]), (2002, None), (2003, []), (2004, [math.nan] * 16), (2005, [math.inf] + [0.0] * 15), (None, rows[1][1]), (2006, [0.0] * 16), (7, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash")).withColumn("v", F.lit(1)).repartition(3)
    path = str(tmp_path_factory.mktemp("index") / "ivf")
    vector_index.build(df, path)
    return df, vector_index.Index.open(spark, path)


def asking(df):
    return df.where("vec_id % 40 = 0 or vec_id = 2000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def test_all_lists_give_the_exact_result(spark, filed, monkeypatch):
    df, index = filed
    monkeypatch.setattr(retrieval, "VECTORS_A_BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUERIES_A_BLOCK", 4)
    usable = df.where("vec_id is not null and vec_id not in (2004, 2005)")
    key = lambda d: sorted((r.query_id, r["rank"], r.vec_id, round(r.similarity, 6)) for r in d.collect())
    for others in (False, True):
        got = vector_index.search(index, asking(df), 7, len(index.centroids), others)
        assert key(got) == key(retrieval.nearest(usable, asking(usable), 7, others=others))


def test_few_lists_find_most(spark, filed):
    df, index = filed
    probes = vector_index.probes_for(index, 0.95, 7)
    assert probes < len(index.centroids) // 2
    usable = df.where("vec_id is not null and vec_id not in (2004, 2005)")
    seen = vector_index.recall(vector_index.search(index, asking(df), 7, probes), retrieval.nearest(usable, asking(usable), 7)).first()
    assert seen.recall >= 0.9 and seen.wanted == 7 * (seen.queries - 1) + 2
    assert index.lists.count() == 1204


def test_empty_table(spark, filed, tmp_path):
    df, _ = filed
    index = vector_index.build(df.where("false"), str(tmp_path / "none"))
    assert vector_index.search(index, asking(df), 3, 5).count() == 0 and vector_index.probes_for(index, 0.9) == 1
