"""Exact top-k search by inner product with vector-approximation files.

Each component of a vector is one of 256 cells of equal width, so a vector's approximation is a byte
a component, written once.  A query's lookup table of a dimension is then a line, and all lookups of
a block are one product over bytes, which gives an upper bound of every inner product, and a lower
one at a distance that the query alone decides.  Blocks of approximations are scanned by blocks of
queries; what may be among the k best goes on.  Exact vectors are read in the order of these bounds:
first the best few, whose k-th score then says which of the rest must be read to be certain.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..scratch import discard, shuffle_partitions, written
from ._arrow import fields

#: Vectors and queries of a block at most, about, and queries whose bounds are held at a time.
VECTORS, QUERIES, AT_A_TIME = 65_536, 8_192, 64
#: Fewer vectors than this aren't parted for the sake of more tasks.
LEAST_VECTORS = 2_048
CELLS = 256


def grid(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The whole width of each dimension's cells."""
    return np.maximum(1.0, np.ceil((high - low + 1) / CELLS))


def cells(vectors: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The approximations: a cell number for each component."""
    return np.clip(np.floor((vectors - low) / width), 0, CELLS - 1).astype(np.uint8)


def bounds(codes: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of inner products (query by vector), and how far below the lower bounds lie.

    Whole numbers below 2**53 are exact; beyond that a margin covers what doubles lose.
    """
    lines = (queries * width) @ codes.astype(np.float64).T
    top = queries @ low + np.maximum(queries, 0) @ (width - 1)
    far = np.abs(queries) @ np.maximum(np.abs(low), np.abs(low + CELLS * width))
    margin = np.where(far < 2.0**52, 0.0, far * 1e-12)
    return lines + (top + margin)[:, None], np.abs(queries) @ (width - 1) + 2 * margin


def exact(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of two whole-numbered vectors, of any size."""
    if float(np.abs(a) @ np.abs(b)) < 2.0**52:
        return int(a @ b)
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def in_64_bits(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


def survivors(upper: np.ndarray, slack: float, k: int) -> np.ndarray:
    """Places of the vectors whose upper bound reaches the k-th greatest lower bound, best first."""
    order = np.argsort(-upper, kind="stable")
    return order[upper[order] >= upper[order[k - 1]] - slack] if len(order) > k else order


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, read: list | None = None) -> list[tuple[int, int, int]]:
    """(query, vector, score) of the k best of vectors in memory for each query, ties to smaller ids.

    Exact vectors are read in the order of their bounds until no other can be among the best;
    ``read``, if given, gets the number of those read for each query.
    """
    low = vectors.min(0)
    width = grid(low, vectors.max(0))
    upper, slack = bounds(cells(vectors, low, width), low, width, queries)
    out = []
    for i, query in enumerate(query_ids.tolist()):
        others = np.flatnonzero(ids != query)
        best: list[tuple[int, int]] = []
        seen = 0
        for j in others[survivors(upper[i, others], slack[i], k)].tolist():
            if len(best) >= k and upper[i, j] < -best[k - 1][0]:
                break
            seen += 1
            best = sorted([*best, (-exact(vectors[j], queries[i]), int(ids[j]))])[:k]
        if read is not None:
            read.append(seen)
        out += [(query, vec, in_64_bits(-score)) for score, vec in best]
    return out


CODED = fields(row=T.LongType(), vec_id=T.LongType(), dims=T.IntegerType(), code=T.BinaryType())
ENDS = fields(dims=T.IntegerType(), low=T.ArrayType(T.DoubleType()), high=T.ArrayType(T.DoubleType()))
MAYBE = fields(query_row=T.LongType(), query_id=T.LongType(), row=T.LongType(), vec_id=T.LongType(), upper=T.DoubleType(), slack=T.DoubleType())


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id`` and floor(scale * x) of each component, of rows with finite components only."""
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    scaled = lambda x: x.cast("double") * float(scale)
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) >= 2.0**53, scaled(x)).otherwise(F.floor(scaled(x)).cast("double")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size("embedding").alias("dims"))


def _grids(table: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Each number of dimensions with its least components and the widths of its cells."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dims, v in zip(batch.column("dims").to_pylist(), batch.column("v").to_numpy(zero_copy_only=False), strict=True):
                if dims in held:
                    np.minimum(held[dims][0], v, out=held[dims][0])
                    np.maximum(held[dims][1], v, out=held[dims][1])
                else:
                    held[dims] = [np.array(v), np.array(v)]
        yield pa.RecordBatch.from_pylist([{"dims": d, "low": x[0].tolist(), "high": x[1].tolist()} for d, x in held.items()], schema=pa.schema({"dims": pa.int32(), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64())}))

    ends = table.select("dims", "v").mapInArrow(run, ENDS)
    each = ends.select("dims", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).groupBy("dims", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    found: dict[int, list] = {}
    for r in each.orderBy("dims", "at").collect():  # a row for each dimension
        found.setdefault(r["dims"], []).append((r["low"], r["high"]))
    out = {}
    for dims, x in found.items():
        low, high = np.array(x).T
        out[dims] = (low, grid(low, high))
    return out


def approximated(table: DataFrame, grids: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The approximation file of a table (row, vec_id, dims, v): a byte for each component."""

    def run(batches):
        for batch in batches:
            codes = [cells(np.asarray(v)[None, :], *grids[dims])[0].tobytes() for dims, v in zip(batch.column("dims").to_pylist(), batch.column("v").to_numpy(zero_copy_only=False), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "vec_id", "dims")], pa.array(codes, pa.binary())], names=CODED.names)

    return table.select("row", "vec_id", "dims", "v").mapInArrow(run, CODED)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The ``k`` best other vectors of each query, queries being ids divisible by ``every``.

    Vectors that are null, empty, or hold null or non-finite components take no part; queries
    meet vectors of their own number of dimensions.  A repeated id is searched, and found, as
    often as it stands there, but never finds its own id.  Equal scores rank by id.
    """
    table = written(integers(vectors).where("dims > 0").withColumn("row", F.monotonically_increasing_id()), "vectors")
    grids = _grids(table)
    codes = written(approximated(table, grids), "approximations")
    queries = table.where(F.col("vec_id") % every == 0)
    total, asked = codes.count(), queries.count()
    parts = max(1, math.ceil(total / VECTORS), min(shuffle_partitions(vectors.sparkSession), total // LEAST_VECTORS))
    blocks = max(1, math.ceil(asked / QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = codes.select("dims", deal(parts).alias("part"), each(blocks).alias("block"), "row", "vec_id", "code")
    right = queries.select("dims", deal(blocks).alias("block"), each(parts).alias("part"), "row", "vec_id", "v")

    def scan(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({n: pd.Series([], dtype="float64" if n in ("upper", "slack") else "int64") for n in MAYBE.names})]
        if len(own) and len(asking):
            dims = int(own["dims"].iloc[0])
            held = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(-1, dims)
            ids, rows = own["vec_id"].to_numpy(np.int64), own["row"].to_numpy(np.int64)
            for a in range(0, len(asking), AT_A_TIME):
                some = asking.iloc[a : a + AT_A_TIME]
                upper, slack = bounds(held, *grids[dims], np.stack(some["v"]))
                for i, (query, row) in enumerate(zip(some["vec_id"].tolist(), some["row"].tolist(), strict=True)):
                    others = np.flatnonzero(ids != query)
                    at = others[survivors(upper[i, others], slack[i], k)]
                    out.append(pd.DataFrame({"query_row": row, "query_id": query, "row": rows[at], "vec_id": ids[at], "upper": upper[i, at], "slack": slack[i]}))
        return pd.concat(out)

    keys = ["dims", "part", "block"]
    maybe = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, MAYBE), "maybe")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("upper"), "row"))
    placed = written(maybe.withColumn("place", place), "placed")
    first = scored(placed.where(F.col("place") <= 2 * k), table)
    first = written(first, "first-read")
    kth = first.withColumn("n", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score")))).where(F.col("n") == k).select("query_row", F.col("score").alias("least"))
    rest = placed.where(F.col("place") > 2 * k).join(kth, "query_row").where(F.col("upper") >= F.col("least"))
    found = first.unionByName(scored(rest.drop("least"), table))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    result = written(found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(table, codes, maybe, placed, first)
    return result


def scored(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (query_row, query_id, row, vec_id) with their exact ``score``, from the exact vectors.

    Scores beyond 64 bits stop there, and so tie.
    """
    kept = ["query_row", "query_id", "vec_id"]
    both = pairs.select(*kept, "row").join(table.select("row", F.col("v").alias("b")), "row").join(table.select(F.col("row").alias("query_row"), F.col("v").alias("a")), "query_row")

    def run(batches):
        for batch in batches:
            scores = [in_64_bits(exact(np.asarray(a), np.asarray(b))) for a, b in zip(batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores, pa.int64())], names=[*kept, "score"])

    return both.select(*kept, "a", "b").mapInArrow(run, fields(query_row=T.LongType(), query_id=T.LongType(), vec_id=T.LongType(), score=T.LongType()))
