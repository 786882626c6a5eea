"""Exact nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors in double precision."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.store import workspace, written
from sheaf.sources.tables import table

EVERY, NEAREST = 20, 20
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
#: Rows of a tile that are held against its queries at a time.
STRIP = 2048
#: Components whose int8 products float32 sums without rounding: 127^2 times as many is below 2^24.
EXACT = 1024


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, each vector's scale, and the length of what rounding took away."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    whole = np.rint(vectors / scale[:, None]).astype(np.int8)
    return whole, scale, np.sqrt(((vectors - whole * scale[:, None]) ** 2).sum(axis=1))


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 vectors, exact: float32 holds sums of up to ``EXACT`` of their products, and longer vectors are summed in slices."""
    parts = (a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T for k in range(0, a.shape[1], EXACT))
    return sum((p.astype(np.float64) for p in parts), np.zeros((len(a), len(b))))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


Item = tuple[float, int, int]


def ranked(score: float, vector: int, row: int) -> Item:
    """What heaps compare: the greater score is the nearer, then the smaller id. A score that is no number comes last."""
    return (score if score == score else -math.inf, -vector, -row)


def kept(heap: list[tuple[Item, float]], item: Item, score: float, nearest: int) -> None:
    """Put a candidate on a heap of the ``nearest`` best, of which the worst is on top."""
    if len(heap) < nearest:
        heapq.heappush(heap, (item, score))
    elif item > heap[0][0]:
        heapq.heapreplace(heap, (item, score))


def best_of(places: np.ndarray, ids: np.ndarray, scores: np.ndarray, nearest: int) -> np.ndarray:
    """Which candidates are among their query's ``nearest`` best, so that no more than those go to its heap."""
    order = np.lexsort((ids, -scores, places))
    place = places[order]
    return order[np.arange(len(place)) - np.searchsorted(place, place, side="left") < nearest]


def tile_nearest(
    query_rows: np.ndarray, queries: np.ndarray, row_keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, nearest: int
) -> list[list[tuple[Item, float]]]:
    """Each query's heap of the ``nearest`` rows of a tile, its own row left out.

    The int8 product p of two vectors is exact. With scales s, t and rounding errors of length e, f, the inner
    product lies within |x| f + e t |y'| of s t p, y' being y's int8 vector. Rows whose upper bound is below a
    query's ``nearest``-th greatest lower bound can't be among its nearest; the others are computed in double
    precision. Ties at the bound survive, and so does every pair whose bound is not finite, so none is lost.
    """
    heaps: list[list[tuple[Item, float]]] = [[] for _ in queries]
    if not len(queries) or not len(rows):
        return heaps
    with np.errstate(over="ignore", invalid="ignore"):
        q8, s, e = quantised(queries)
        r8, t, f = quantised(rows)
        reach = np.sqrt((queries**2).sum(axis=1))
        shadow = np.sqrt((r8.astype(np.float64) ** 2).sum(axis=1)) * t
        floor = np.full(len(queries), -np.inf)
        for at in range(0, len(rows), STRIP):
            end = min(at + STRIP, len(rows))
            near = whole_products(q8, r8[at:end]) * s[:, None] * t[None, at:end]
            slack = (
                reach[:, None] * f[None, at:end] + e[:, None] * shadow[None, at:end]
            ) * (1 + 1e-9) + 1e-12 * reach[:, None] * (shadow[None, at:end] + f[None, at:end])
            other = row_keys[None, at:end] != query_rows[:, None]
            if end - at > nearest:  # one row may be the query itself
                low = near - slack
                low = np.where(other & np.isfinite(low), low, -np.inf)
                floor = np.maximum(floor, np.partition(low, -nearest, axis=1)[:, -nearest])
            i, j = np.nonzero(other & ~(near + slack < floor[:, None]))
            for part in range(0, len(i), 1 << 19):
                a, b = i[part : part + (1 << 19)], j[part : part + (1 << 19)] + at
                score = inner(queries[a], rows[b])
                top = best_of(a, ids[b], score, nearest)
                for place, value, vector, key in zip(
                    a[top].tolist(), score[top].tolist(), ids[b[top]].tolist(), row_keys[b[top]].tolist(), strict=True
                ):
                    kept(heaps[place], ranked(value, vector, key), value, nearest)
            for place, heap in enumerate(heaps):
                if len(heap) == nearest:
                    floor[place] = max(floor[place], heap[0][0][0])
    return heaps


def search(
    vectors: DataFrame, asked: Column, nearest: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK,
    row_block: int = ROW_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of which ``asked`` is true the rows of largest inner product but itself, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part on either side, nor do null
    ids. With fewer candidates than ``nearest``, all are returned. Rows are told apart by a key: those that
    repeat an id are queries and candidates of their own, and such a query finds the others of its id. Vectors
    of another length than a query's are no candidates of it. A sum that overflows to no number ranks last.

    Queries and rows are dealt into blocks by hash, and each pair of a query block and a row block is a task of
    bounded size. A task keeps a heap for each query and returns its nearest only; a query's lists then meet,
    sorted by it, and a heap of ``nearest`` merges them as they pass.
    """
    at = workspace(vectors.sparkSession, "blocks")
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall(
            "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        ) & F.exists("v", lambda x: x != 0)
    )
    rows = written(usable.withColumns({"n": F.size("v"), "row": F.monotonically_increasing_id()}), f"{at}/rows")
    queries, all_rows = rows.agg(F.count_if("asked"), F.count("*")).first()
    across, down = max(1, math.ceil(queries / query_block)), max(1, math.ceil(all_rows / row_block))
    spread = lambda d, count, own, other, times: d.withColumn(
        own, F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    ).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    left = spread(rows.where("asked"), across, "qb", "rb", down).select("n", "qb", "rb", "row", "id", "v")
    right = spread(rows, down, "rb", "qb", across).select("n", "qb", "rb", "row", "id", "v")

    def matrix(table: pd.DataFrame) -> np.ndarray:
        return np.array(table["v"].tolist(), np.float64).reshape(len(table), -1) if len(table) else np.zeros((0, 1))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = tile_nearest(a["row"].to_numpy(np.int64), matrix(a), b["row"].to_numpy(np.int64), b["id"].to_numpy(np.int64), matrix(b), nearest)
        made = [
            (q, i, -item[2], -item[1], score) for q, i, heap in zip(a["row"].tolist(), a["id"].tolist(), found, strict=True) for item, score in heap
        ]
        return pd.DataFrame(made, columns=["query", "query_id", "row", "vec_id", "score"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query: int | None = None
        query_id, heap = 0, []

        def finished() -> list[tuple[int, int, int, float]]:
            return [(query_id, rank, -item[1], score) for rank, (item, score) in enumerate(sorted(heap, reverse=True), 1)]

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"]
            )

        for batch in batches:
            made: list[tuple] = []
            for q, own_id, row, vector, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q != query:
                    made += finished()
                    query, query_id, heap = q, own_id, []
                score = math.nan if score is None else score  # pandas has no other null
                kept(heap, ranked(score, vector, row), score, nearest)
            if made:
                yield batch_of(made)
        if heap:
            yield batch_of(finished())

    lists = left.groupBy("n", "qb", "rb").cogroup(right.groupBy("n", "qb", "rb")).applyInPandas(
        tile, "query long, query_id long, row long, vec_id long, score double"
    )
    return lists.repartition("query").sortWithinPartitions("query").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op7_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP7_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding,
lambda x: x <> 0)) > 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
