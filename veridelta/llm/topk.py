"""Operator 1: exact top-k search by tiled integer matrix products.

Rows become quantised vectors packed into tiles as they are scanned, so that no key decides where a row goes. Every
query tile meets every candidate tile once (a stated query set against all rows, in blocks); a task multiplies one pair
of tiles, keeps the k best of each query and drops the products. The lists of a query are then merged in a tree.

Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part. Vectors of
different lengths don't meet. Several rows with one id: none is a candidate for that id's queries; a query id with
several vectors is asked once for each distinct one. Scores beyond a long are held at its ends. An empty table gives no
rows; only the id and the vector are read, whatever other columns there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.llm.common import read

#: Rows of a candidate tile and of a query tile.
TILE_ROWS, TILE_QUERIES = 8192, 2048
#: Lists that one step of the tree merges.
FAN_IN = 8
#: Queries multiplied at once inside a pair of tiles.
SLICE = 256

TILE = "dim int, tile long, ids binary, copies binary, matrix binary"
PARTIAL = "query_id long, query_copy long, vec_id long, score long, node long"


def usable(column: str) -> Column:
    """The vector is there and all its components are finite."""
    return F.col(column).isNotNull() & F.forall(
        F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )


def _pack(rows: int, scale: float):
    """Batches of (id, copy, vector) to tiles of at most ``rows`` rows, one list for each vector length."""

    def pack(batches):
        part, made, held = TaskContext.get().partitionId(), 0, {}

        def tile(dim):
            nonlocal made
            ids, copies, vectors = zip(*held.pop(dim))
            made += 1
            values = np.floor(scale * np.stack(vectors).astype(np.float64))
            if values.size == 0 or np.abs(values).max() < 2**15:
                values = values.astype(np.int16)
            return pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim], pa.int32()),
                    "tile": pa.array([(part << 32) + made], pa.int64()),
                    "ids": [np.array(ids, np.int64).tobytes()],
                    "copies": [np.array(copies, np.int64).tobytes()],
                    "matrix": [values.tobytes()],
                }
            )

        for batch in batches:
            ids, copies = batch.column("id").to_numpy(), batch.column("copy").to_numpy()
            lists = batch.column("vector")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())
            for i, vector in enumerate(np.split(flat, ends[:-1]) if len(ends) else []):
                own = held.setdefault(len(vector), [])
                own.append((ids[i], copies[i], vector))
                if len(own) >= rows:
                    yield tile(len(vector))
        for dim in list(held):
            yield tile(dim)

    return pack


def _unpack(table: pa.Table, dim: int):
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()])
    copies = np.concatenate([np.frombuffer(x, np.int64) for x in table["copies"].to_pylist()])
    rows = [len(x) // 8 for x in table["ids"].to_pylist()]
    matrices = [
        np.frombuffer(x, np.int16 if len(x) == 2 * n * dim else np.float64).reshape(n, dim).astype(np.float64)
        for x, n in zip(table["matrix"].to_pylist(), rows)
    ]
    return ids, copies, np.concatenate(matrices)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-numbered rows, as longs."""
    most = [np.abs(x).max() if x.size else 0 for x in (left, right)]
    if left.shape[1] * most[0] * most[1] < 2**53:
        return (left @ right.T).astype(np.int64)
    as_ints = [np.array([[int(v) for v in row] for row in x], dtype=object) for x in (left, right)]
    ends = np.iinfo(np.int64)
    return np.clip(as_ints[0] @ as_ints[1].T, ends.min, ends.max).astype(np.int64)


def select(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best scores without its own; ties to the leftmost column."""
    scores = np.where(own, np.iinfo(np.int64).min, scores)
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else scores.min(axis=1)
    row, column = np.nonzero((scores >= least[:, None]) & ~own)
    order = np.lexsort((column, ~scores[row, column], row))  # ~x falls as x rises, without overflow
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], column[kept]


def _meet(k: int):
    def meet(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {name: [] for name in ("query_id", "query_copy", "vec_id", "score", "node")}
        if queries.num_rows and rows.num_rows:
            dim, node = key[0].as_py(), key[2].as_py()
            qid, copies, q = _unpack(queries, dim)
            cid, _, c = _unpack(rows, dim)
            order = np.argsort(cid, kind="stable")
            cid, c = cid[order], c[order]
            for at in range(0, len(qid), SLICE):
                some = slice(at, at + SLICE)
                scores = product(q[some], c)
                row, column = select(scores, qid[some, None] == cid[None, :], k)
                out["query_id"].append(qid[some][row])
                out["query_copy"].append(copies[some][row])
                out["vec_id"].append(cid[column])
                out["score"].append(scores[row, column])
                out["node"].append(np.full(len(row), node, np.int64))
        return pa.table({n: pa.array(np.concatenate(v) if v else [], pa.int64()) for n, v in out.items()})

    return meet


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, query_copy, rank, vec_id, score): each query's k best rows by integer inner product."""
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(vector_col).alias("copy"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    n_rows, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    groups, blocks = max(1, math.ceil(n_rows / TILE_ROWS)), max(1, math.ceil(n_queries / TILE_QUERIES))
    asked = rows.where("asks").dropDuplicates(["id", "copy"]).select("id", "copy", "vector")
    queries = asked.mapInArrow(_pack(TILE_QUERIES, scale), TILE)
    candidates = rows.select("id", "copy", "vector").mapInArrow(_pack(TILE_ROWS, scale), TILE)
    queries = queries.select("*", F.pmod(F.xxhash64("tile"), F.lit(blocks)).alias("block")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("node")
    )
    candidates = candidates.select("*", F.pmod(F.xxhash64("tile"), F.lit(groups)).alias("node")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block")
    )
    keys = ["dim", "block", "node"]
    lists = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_meet(k), PARTIAL)
    best = (F.col("score").desc(), F.col("vec_id"))
    while groups > 1:
        groups = math.ceil(groups / FAN_IN)
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        merge = Window.partitionBy("query_id", "query_copy", "node").orderBy(*best)
        lists = lists.withColumn("place", F.row_number().over(merge)).where(F.col("place") <= k).drop("place")
    merge = Window.partitionBy("query_id", "query_copy").orderBy(*best)
    return lists.select(
        "query_id", "query_copy", F.row_number().over(merge).alias("rank"), "vec_id", "score"
    ).where(F.col("rank") <= k)


def op1_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best rows of every query vector (ids divisible by 50)."""
    found = top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
