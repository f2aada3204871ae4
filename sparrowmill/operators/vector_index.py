"""An inverted file of vectors: coarse centroids, each with the list of vectors nearest to it.

Centroids are fitted by k-means on a bounded sample; every vector is then filed under its nearest
one, and the table, partitioned by cell, and the centroids are kept in a folder that later sessions
open.  A query probes the lists of its nearest centroids only and scores their vectors exactly, so
that recall is what is approximate: :func:`probes_for` takes from a sample of queries how many
lists are needed for a given recall.

Lists may be of any size: a list is cut into blocks of bounded size by hash, and a query meets each
block of the lists that it probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import discard, written
from . import retrieval

#: Vectors that the centroids are fitted on, about, and centroids at most: the driver holds these.
SAMPLE, MOST_CELLS = 65_536, 4_096
#: Queries that :func:`probes_for` asks, about.
ASKED = 256
#: The list of vectors that have another length than most; queries of their length probe it.
OTHER = -1


@dataclass
class Index:
    """A folder with the tables ``lists`` (vec_id, v, dims, cell) and ``centroids`` (cell, v)."""

    path: str
    lists: DataFrame
    centroids: np.ndarray

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
        return cls(path, spark.read.parquet(f"{path}/lists"), np.array([r.v for r in rows], float).reshape(len(rows), len(rows[0].v) if rows else 0))

    def cells(self, vectors: DataFrame, id_column: str, n: int) -> DataFrame:
        """(id, v, dims, cell, turn): the ``n`` nearest cells of each vector, ``turn`` from 0."""
        return _nearest_cells(vectors, id_column, self.centroids, n)


def _usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Unit vectors; null and empty ones, and those with parts that are no finite numbers, are left out."""
    rows = df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).select(id_column, F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.where(finite).select(id_column, retrieval.unit(F.col("v")).alias("v"), F.size("v").alias("dims"))


def _nearest_cells(rows: DataFrame, id_column: str, centroids: np.ndarray, n: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    kind = rows.schema[id_column].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        half = (known * known).sum(1) / 2
        for batch in batches:
            same = batch["dims"].to_numpy() == (known.shape[1] if len(known) else -1)
            cells = np.full((len(batch), n), OTHER, np.int32)
            if same.any():
                far = half - np.stack(batch["v"][same]) @ known.T
                cells[same, : min(n, len(known))] = np.argsort(far, 1, kind="stable")[:, :n]
            turn = np.tile(np.arange(n, dtype=np.int32), len(batch))
            out = batch.loc[batch.index.repeat(n)].assign(cell=cells.ravel(), turn=turn)
            yield out[(out["turn"] == 0) | (out["cell"] != OTHER)]

    return rows.mapInPandas(assign, f"{id_column} {kind}, v array<double>, dims int, cell int, turn int")


def build(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = 10, seed: int = 11) -> Index:
    """An index of (vec_id, embedding) in a new folder; about sqrt(n) cells unless told otherwise.

    Rows of null ids and unusable vectors are left out; rows that repeat an id are all filed.
    """
    rows = written(_usable(vectors, "vec_id", "embedding"), "vectors")
    sizes = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims, n = (sizes[0].dims, sizes[0]["count"]) if sizes else (0, 0)
    cells = min(MOST_CELLS, cells or max(1, int(n**0.5)))
    share = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40)) < F.lit(int(min(1.0, SAMPLE / max(1, n)) * (1 << 40)))
    centroids = np.zeros((0, dims))
    if n:
        sample = rows.where((F.col("dims") == dims) & share).select(array_to_vector("v").alias("features"))
        fitted = KMeans(k=max(2, cells), maxIter=rounds, seed=seed).fit(sample) if cells > 1 else None
        centroids = np.array(fitted.clusterCenters() if fitted else [np.zeros(dims)], float)
    spark = vectors.sparkSession
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    filed = _nearest_cells(rows, "vec_id", centroids, 1).drop("turn")
    filed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/lists") if n else filed.write.parquet(f"{path}/lists")
    discard(rows)
    return Index.open(spark, path)


def search(index: Index, queries: DataFrame, k: int, probes: int, others: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, similarity) of the ``k`` best among the lists that each of (query_id, query) probes.

    The order is that of :func:`retrieval.nearest`, so that all lists together give the same rows.
    """
    asked = index.cells(_usable(queries, "query_id", "query"), "query_id", probes)
    parts = index.lists.groupBy("cell").agg(F.ceil(F.count("*") / retrieval.VECTORS_A_BLOCK).cast("int").alias("parts"))
    left = index.lists.join(parts, "cell").select("vec_id", "v", "dims", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
    blocks = max(1, -(-asked.select("query_id").distinct().count() // retrieval.QUERIES_A_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    right = asked.join(parts, "cell").select("query_id", "v", "dims", "cell", block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dims", "cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(retrieval.best_of_block(k, others), "query_id long, vec_id long, similarity double")
    return retrieval.top(found, k, [F.desc(F.round("similarity", 9)), F.col("vec_id")])


def probes_for(index: Index, recall: float, k: int = 10, seed: int = 5) -> int:
    """How many lists a query must probe so that about this share of its ``k`` nearest is found.

    Vectors of the index, about ``ASKED`` of them, ask for their own neighbours by the exact search; where
    these are filed, in the order of the lists that the query would probe, gives the number.
    """
    n = index.lists.count()
    if not n or not len(index.centroids):
        return 1
    own = index.lists.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 40)) < F.lit(int(min(1.0, ASKED / n) * (1 << 40))))
    asking = own.dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"))
    exact = retrieval.nearest(index.lists.select("vec_id", F.col("v").alias("embedding")), asking, k, others=True)
    where = exact.join(index.lists.select("vec_id", "cell"), "vec_id").select("query_id", "cell")
    turns = index.cells(_usable(asking, "query_id", "query"), "query_id", len(index.centroids)).select("query_id", "cell", "turn")
    counts = {r.turn: r["count"] for r in where.join(turns, ["query_id", "cell"]).groupBy("turn").count().collect()}  # a row a turn
    total, seen = sum(counts.values()), 0
    for turn in sorted(counts):
        seen += counts[turn]
        if seen >= recall * total:
            return turn + 1
    return max(1, len(index.centroids))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries``, ``wanted``, ``found`` and ``recall`` of two ranked lists (query_id, vec_id)."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
