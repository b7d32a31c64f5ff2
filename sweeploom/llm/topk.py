"""Exact top-k inner products by reading sorted lists without random access.

Candidates are cut into blocks and queries into batches.  A task holds one of
each and keeps, for every component, the block's values as a sorted list.  A
query reads the list of a component from the top where its own component is
positive and from the bottom where it is negative.  After all lists were read
to some depth, a row's upper bound takes the values that were read and, for the
others, the value at which reading stopped; its lower bound takes the far end
of the list.  Rows whose upper bound is below the k-th best lower bound cannot
qualify.  Reading goes on until few rows are left, and these get their final
scores.  Queries of a batch read in step, so the bounds of a depth are matrix
products.  The k best rows of every block are merged at the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

# Rows of a candidate block and of a batch of queries, on average.
BLOCK_ROWS = 8_192
BATCH_ROWS = 1_024
# Queries whose bounds are held at once, and rows that are few enough to finish.
AT_ONCE = 128
FEW = 64
# Depths at which bounds are compared, in parts of the list.
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0)
SCALE = 256


def integer_components(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, computed in double precision."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(embedding: Column) -> Column:
    """True where a vector is there and all its components are finite."""
    return embedding.isNotNull() & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )


def matrix(column, n: int) -> np.ndarray:
    """Vectors of one width as a matrix of Python or machine integers."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def exact_floats(*tables: np.ndarray) -> list[np.ndarray]:
    """Tables as doubles if all their inner products are exact in them, else as Python integers."""
    largest = [max(abs(int(t.max())), abs(int(t.min())), 1) if t.size else 1 for t in tables]
    fine = largest[0] * largest[-1] * max(tables[0].shape[1], 1) < 1 << 53
    return [t.astype(float if fine else object) for t in tables]


def as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; what is beyond them becomes the nearest one."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    edge = np.iinfo(np.int64)
    return np.array([min(max(int(s), edge.min), edge.max) for s in scores], np.int64)


class SortedLists:
    """One sorted list per component of a block."""

    def __init__(self, block: np.ndarray) -> None:
        self.block = block
        self.order = np.argsort(block, axis=0, kind="stable")
        self.values = np.take_along_axis(block, self.order, axis=0)

    def read(self, depth: int):
        """Bounds of every value after ``depth`` entries: (upper, lower) from the top and from the bottom."""
        n, width = self.block.shape
        column = np.arange(width)
        sides = []
        for part, stop, end in (
            (slice(n - depth, n), self.values[n - depth], self.values[0]),
            (slice(0, depth), self.values[depth - 1], self.values[n - 1]),
        ):
            for unread in (stop, end):
                known = np.repeat(unread[None, :], n, axis=0)
                known[self.order[part], column] = self.values[part]
                sides.append(known)
        return sides


def best_of_block(block: np.ndarray, ids: np.ndarray, query: np.ndarray, own: np.ndarray, k: int):
    """(query, row, score) of the k best rows of other ids for every query, and the entries read."""
    n, width = block.shape
    lists = SortedLists(block)
    up, down = np.maximum(query, 0), np.minimum(query, 0)
    waiting = np.arange(len(query))
    found, read = [], 0
    for share in DEPTHS if width else (1.0,):
        depth = max(int(np.ceil(n * share)), 1)
        if width:
            high, high_end, low, low_end = lists.read(depth)
        still = []
        for at in range(0, len(waiting), AT_ONCE):
            q = waiting[at : at + AT_ONCE]
            mine = ids[:, None] == own[q][None, :]
            if width:
                upper = high @ up[q].T + low @ down[q].T
                lower = high_end @ up[q].T + low_end @ down[q].T
            else:
                upper = lower = np.zeros((n, len(q)))
            lower = np.where(mine, -np.inf, lower)
            least = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(q), -np.inf)
            alive = (upper >= least) & ~mine
            done = (alive.sum(axis=0) <= max(FEW, k)) | (depth == n)
            for j in np.flatnonzero(done):
                rows = np.flatnonzero(alive[:, j])
                score = block[rows] @ query[q[j]] if width else np.zeros(len(rows))
                first = np.lexsort((ids[rows], -score))[:k]
                found.append((np.full(len(first), q[j]), rows[first], as_long(score[first])))
            read += depth * width * int(done.sum())
            still.append(q[~done])
        waiting = np.concatenate(still) if still else waiting[:0]
        if not len(waiting):
            break
    none = np.zeros(0, np.int64)
    return [np.concatenate(c) if found else none for c in (zip(*found) if found else [none] * 3)], read


def in_blocks(rows: DataFrame, most: int, seed: str, *key: str) -> tuple[DataFrame, int]:
    """``rows`` with a ``block`` by a hash of ``key``, and the number of blocks of about ``most`` rows."""
    blocks = max(1, -(-rows.count() // most))
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(blocks)).cast("int")), blocks


def search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k rows of highest inner product for every query: (query_id, rank, vec_id, score).

    ``queries`` has (query_id, v) and ``rows`` (vec_id, v), with vectors of whole
    numbers.  Rows of the query's id do not count; vectors of another width have
    no product with it; ties go to the smaller id.  A row that repeats takes as
    many ranks; a query that repeats with its vector is asked once, and one id
    with several vectors is asked for each.  Rows without an id or vector take no
    part.  Products beyond 64 bits come as the nearest 64-bit number.
    """
    single = queries.filter("query_id is not null and v is not null").select("query_id", "v").distinct()
    held = rows.filter("vec_id is not null and v is not null").groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    single = common.stored(single, "topk-queries")
    held = common.stored(held, "topk-rows")
    single, batches = in_blocks(single, BATCH_ROWS, "query", "query_id", "v")
    held, blocks = in_blocks(held, BLOCK_ROWS, "row", "vec_id", "v")
    asked = single.select(
        F.size("v").alias("width"), "query_id", "v", F.lit(0).cast("long").alias("copies"), F.col("block").alias("batch"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.xxhash64("v").alias("mark"),
    )
    offered = held.select(
        F.size("v").alias("width"), F.col("vec_id").alias("query_id"), "v", "copies",
        F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "block", F.lit(0).cast("long").alias("mark"),
    )

    def compare(table):
        import pyarrow as pa

        copies = table.column("copies").to_numpy()
        ids, mark = table.column("query_id").to_numpy(), table.column("mark").to_numpy()
        vectors = matrix(table.column("v"), len(ids))
        is_row = copies > 0
        made = [np.zeros(0, np.int64)] * 3
        if is_row.any() and not is_row.all():
            block, query = exact_floats(vectors[is_row], vectors[~is_row])
            made, _ = best_of_block(block, ids[is_row], query, ids[~is_row], k)
        q, row, score = made
        return pa.table(
            {
                "query_id": ids[~is_row][q], "mark": mark[~is_row][q], "vec_id": ids[is_row][row],
                "score": score, "copies": copies[is_row][row],
            }
        )

    best = asked.unionByName(offered).groupBy("width", "batch", "block").applyInArrow(
        compare, "query_id long, mark long, vec_id long, score long, copies long"
    )
    each = best.withColumn("again", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, k: int, every: int = 1, scale: int = SCALE) -> DataFrame:
    """``search`` among the vectors themselves: rows whose vec_id is divisible by ``every`` are the queries.

    Components are taken as floor(scale * x).  Vectors that are NULL or hold NULL
    or non-finite components, and rows without vec_id, take no part; other columns
    are ignored; an empty table gives no rows.
    """
    embedding = F.col("embedding")
    fine = vectors.filter(F.col("vec_id").isNotNull() & usable(embedding))
    rows = fine.select("vec_id", integer_components(embedding, scale).alias("v"))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return search(queries, rows, k)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), 5, 50)


OP11_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT DISTINCT vec_id AS query_id, v FROM fine WHERE vec_id % 50 = 0),
scored AS (
  SELECT q.query_id, q.v, f.vec_id, CAST(list_dot_product(q.v, f.v) AS BIGINT) AS score
  FROM queries q JOIN fine f ON f.vec_id <> q.query_id AND len(f.v) = len(q.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""
