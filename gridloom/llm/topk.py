"""Exact top-k inner products over integer vectors by MaxScore.

A vector's components are the terms, each component's values over a shard its posting. A query
splits its terms by their score bounds (the most that any vector of the shard can gain from a
term): the non-essential ones are those of least bound that together with the vector's score in
the essential ones have to reach the query's threshold, its k-th best score so far. Essential
postings are traversed for all vectors of the shard; the others are probed only for vectors that
are still competitive. Shards' lists merge by score and id.

Cases: vectors that are null, hold a null or non-finite component, or have no id take no part;
a shorter vector is as one with zeros at its end; ties in score fall to the smaller id; a query
is the vector of its id (the least one where rows repeat an id), and every row with the query's
id is its own. An empty table, or one without queries, gives no rows. Other columns are not read.
A score that does not fit 53 bits raises an error rather than being rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import lean, shipped, written
from gridloom.llm.vectors import matrix

#: Queries whose vectors are sent to all tasks at once; rows of a shard's piece.
QUERY_BLOCK, ROWS = 4096, 4096
SCALE = 1024


def quantised(rows: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(rows * float(scale))


class Searcher:
    """The queries of a block against the vectors of one shard, piece by piece."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.best_score = np.full((len(ids), k), -np.inf)
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        width = max(rows.shape[1], self.q.shape[1])
        if rows.shape[1] < width:
            rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
        if self.q.shape[1] < width:
            self.q = np.pad(self.q, ((0, 0), (0, width - self.q.shape[1])))
        postings = np.ascontiguousarray(rows.T)
        high, low = rows.max(axis=0, initial=0), rows.min(axis=0, initial=0)
        bounds = np.where(self.q > 0, self.q * high, self.q * low)  # at least 0
        if (np.abs(self.q) @ np.maximum(high, -low)).max(initial=0) >= 2**53:
            raise OverflowError("scores do not fit 53 bits")
        order = np.argsort(bounds, axis=1, kind="stable")
        total = np.cumsum(np.take_along_axis(bounds, order, 1), axis=1)
        for i in range(len(self.ids)):
            floor = self.best_score[i, -1]
            cut = 0
            if floor > -np.inf:
                # Half of the threshold may come from the non-essential terms.
                cut = int(np.searchsorted(total[i], max(floor, 0) / 2, "right"))
            rest, essential = order[i, :cut], order[i, cut:]
            score = self.q[i, essential] @ postings[essential]
            if cut:
                alive = np.flatnonzero(score + total[i, cut - 1] >= floor)
                score = score[alive] + self.q[i, rest] @ postings[np.ix_(rest, alive)]
                found = ids[alive]
            else:
                found = ids
            good = (score >= floor) & (found != self.ids[i])
            score, found = score[good], found[good]
            if len(score):
                if len(score) > 4 * self.k:  # ties with the k-th stay
                    least = np.partition(score, len(score) - self.k)[len(score) - self.k]
                    keep = score >= least
                    score, found = score[keep], found[keep]
                s = np.concatenate([self.best_score[i], score])
                v = np.concatenate([self.best_id[i], found])
                top = np.lexsort((v, -s))[: self.k]
                self.best_score[i], self.best_id[i] = s[top], v[top]

    def table(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.best_score > -np.inf)
        return pa.record_batch({"query_id": pa.array(self.ids[q], pa.int64()), "vec_id": pa.array(self.best_id[q, j], pa.int64()), "score": pa.array(self.best_score[q, j].astype(np.int64), pa.int64())})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best other rows of (vec_id, embedding).

    Queries go through in blocks of about query_block, each a broadcast of bounded size against
    one scan of all rows, freed when the block's lists are written; the lists are united.
    """
    spark = vectors.sparkSession
    lean(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    asked = rows.where(is_query & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    asked = written(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    n_blocks = -(-asked.count() // query_block)
    lists: list[DataFrame] = []

    def block_lists(block: Broadcast[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*block.value, k)
            for batch in batches:
                m, ok = matrix(batch.column("embedding"))
                ids, m = np.asarray(batch.column("vec_id"))[ok], quantised(m[ok], scale)
                at = 0
                while at < len(ids):  # short pieces first, to have a threshold early
                    to = at + (256 if at == 0 else ROWS)
                    searcher.add(ids[at:to], m[at:to])
                    at = to
            yield searcher.table()

        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = rows.mapInArrow(search, "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).orderBy("vec_id").toArrow()
        with shipped(spark, (np.asarray(part["vec_id"]), quantised(matrix(part["embedding"])[0], scale))) as block:
            lists.append(written(block_lists(block), "top-k"))
    return reduce(DataFrame.union, lists) if lists else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
