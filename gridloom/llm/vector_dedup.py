"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of a label are dealt into tiles of bounded size and every pair of tiles of the label is one
task; tiles are as large as a task can hold, since each vector is shipped once for each tile of its label. A unit vector is rounded to int8 steps of its own size; what is lost is its error, whose
norm is kept. The tiles' int8 product (integers, exact in float32 since they stay below 2**24)
times the step sizes is at most |e_x| + |e_y| * |x'| off the true cosine, so that only pairs possibly
at or above the threshold are computed again, in double precision. A task returns each vector's
number of links and a spanning forest of the links, never the links themselves.

Cases: equal vectors of a label are one class with a count (copies link with each other and are not
expanded); a null label, and vectors that are null, empty, zero or hold null or non-finite
components, link with nothing; a shorter vector is as one with zeros at its end; rows that repeat
an id are vectors of their own with that id; a row without id counts as a link of others, but neither names
nor connects components. Ties
at the threshold link. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import components, lean, written
from gridloom.llm.graph import local_components
from gridloom.llm.vectors import matrix

THRESHOLD = 0.93
#: Vectors in a small label's tile, about; tiles that a label is cut into at least if it has so many vectors, for the tasks'
#: sake; bytes of a large label's tile.
TILE, SPREAD, TILE_BYTES = 2048, 8, 1 << 24
#: Above any rounding of the bounds' own arithmetic.
SLACK = 1e-5


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m, ok = matrix(batch.column("embedding"))
        norm = np.sqrt((m * m).sum(axis=1)) if m.shape[1] else np.zeros(len(m))
        scale = np.abs(m).max(axis=1, initial=0)
        tiny = ok & (scale > 0) & ((norm < 1e-150) | ~np.isfinite(norm))
        m[tiny] /= scale[tiny, None]  # squares that would vanish or overflow
        ok &= scale > 0
        data = [np.trim_zeros(r, "b").tobytes() if k else None for r, k in zip(m + 0.0, ok, strict=True)]
        key = [hashlib.blake2b(d, digest_size=16).digest() if d is not None else None for d in data]
        yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "key": pa.array(key, pa.binary()), "vector": pa.array(data, pa.binary())})


def int8(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, step sizes, norms of the errors, norms of the rounded rows) of unit rows."""
    step = np.maximum(np.abs(rows).max(axis=1), 1e-300) / 127
    q = np.rint(rows / step[:, None])
    back = q * step[:, None]
    return q.astype(np.int8), step, np.sqrt(((rows - back) ** 2).sum(axis=1)), np.sqrt((back**2).sum(axis=1))


def unit(vectors: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(v, np.float64) for v in vectors]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", x, y)


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows of x, rows of y, pairs computed again) at or above the threshold, piece by piece; x, y: unit rows."""
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in (x, y))
    qx, sx, ex, nx = int8(x)
    qy, sy, ey, _ = int8(y)
    # float32 holds the integer sums exactly up to 2**24; wider vectors go in double.
    exact = np.float32 if width * 127 * 127 < 1 << 24 else np.float64
    step, wide = (1024, 2048) if width < 1000 else (256, 2048)
    for c in range(0, len(y), wide):
        fy = qy[c : c + wide].astype(exact).T
        for a in range(0, len(x), step):
            tile = qx[a : a + step].astype(exact) @ fy
            bound = tile * sx[a : a + step, None] * sy[None, c : c + wide] + ex[a : a + step, None] + nx[a : a + step, None] * ey[None, c : c + wide] + SLACK
            i, j = np.nonzero(bound >= threshold)
            for b in range(0, len(i), 1 << 16):  # bounded memory where all pairs are near
                ii, jj = i[b : b + (1 << 16)] + a, j[b : b + (1 << 16)] + c
                good = cosines(x[ii], y[jj]) >= threshold
                yield ii[good], jj[good], len(ii)


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each node the smallest one that it is connected with, after the pairs (a, b) as well."""
    x, y = root[a], root[b]
    apart = x != y
    return local_components(x[apart], y[apart], len(root))[root] if apart.any() else root


def links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, edges) of (vec_id, label, embedding).

    rows: vec_id, label, key of every row; classes: label, key, rep (the smallest id), copies and
    links (rows linked with each of its rows); edges: (a, b) representatives, which connect all
    that is linked.
    """
    kind = dict(vectors.dtypes)
    lean(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", "embedding").mapInArrow(_keys, f"vec_id {kind['vec_id']}, label {kind['label']}, key binary, vector binary")
    rows = written(rows, "vectors")
    classes = rows.where("label is not null and key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"))
    classes = written(classes, "vector-classes")
    n, size = F.count(F.lit(1)), F.max(F.length("vector"))
    per = classes.groupBy("label").agg(F.least(F.ceil(n / tile), F.greatest(F.lit(SPREAD), F.ceil(n * size / TILE_BYTES))).cast("int").alias("tiles"))
    dealt = classes.join(per, "label").withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    # Each vector goes to the tasks of its tile with every tile of the label.
    task = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("label", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "key", "rep", "copies", "vector")

    def run(table: pa.Table) -> pa.Table:
        t, i, j = (np.asarray(table[c]) for c in ("t", "i", "j"))
        keys, copies, vectors_ = table["key"].to_pylist(), np.asarray(table["copies"]), unit(table["vector"].to_pylist())
        reps = table["rep"].to_pylist()
        one = np.flatnonzero(t == i)
        two = one if i[0] == j[0] else np.flatnonzero(t == j)
        n = len(t)
        count, root, named = np.zeros(n), np.arange(n), np.array([r is not None for r in reps], bool)
        for a, b, _ in near(vectors_[one], vectors_[two], threshold):
            a, b = one[a], two[b]
            if i[0] == j[0]:
                keep = a < b
                a, b = a[keep], b[keep]
            count += np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            # Rows without id connect nothing: as roots they would be dropped with all below them.
            own = named[a] & named[b]
            root = joined(root, a[own], b[own])
        edges = [(int(r), k) for k, r in enumerate(root.tolist()) if r != k]
        some = np.flatnonzero(count)
        label = table["label"][0].as_py()
        m = len(some) + len(edges)
        return pa.table(
            {
                "label": pa.array([label] * m, table["label"].type),
                "key": pa.array([keys[x] for x in some] + [None] * len(edges), pa.binary()),
                "links": pa.array([int(count[x]) for x in some] + [0] * len(edges), pa.int64()),
                "a": pa.array([None] * len(some) + [reps[x] for x, _ in edges], pa.int64()),
                "b": pa.array([None] * len(some) + [reps[y] for _, y in edges], pa.int64()),
            }
        )

    found = written(task.groupBy("label", "i", "j").applyInArrow(run, f"label {kind['label']}, key binary, links long, a long, b long"), "vector-links")
    counted = found.where("key is not null").groupBy("label", "key").agg(F.sum("links").alias("links"))
    classes = classes.drop("vector").join(counted, ["label", "key"], "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return rows.drop("vector"), classes, found.where("a is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows, classes, edges = links(vectors, threshold, tile)
    groups = components(edges)
    classes = classes.join(groups, classes["rep"] == groups["node"], "left").select("label", "key", "links", F.coalesce("component", "rep").alias("component"))
    out = rows.join(classes, ["label", "key"], "left")
    component = F.coalesce(F.col("component"), F.col("vec_id")).cast("long")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (
  SELECT vec_id AS n, vec_id AS c FROM embeddings
  UNION
  SELECT l.b AS n, r.c FROM r JOIN l ON l.a = r.n),
g AS (
  SELECT n, min(c) AS c FROM r GROUP BY n),
k AS (
  SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, g.c AS component_id, e.vec_id = g.c AS kept
FROM embeddings e JOIN g ON g.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
