"""Packing texts into batches of little padding by optimal length buckets.

The global histogram of lengths goes through a dynamic program that chooses the bucket boundaries
of least total padding; inside a bucket, texts in a hash-shuffled order fill batches of as many
rows as the token budget holds at the bucket's length.

Cases: null and empty texts have length 0 and go to the shortest bucket; a text longer than the
budget is a batch of its own, and lengths of EXACT words or more share histogram cells of 1/OCTAVE of an octave, so that
boundaries there are optimal among the cells' longest texts; ties in length share a bucket; repeated rows are rows of their own;
an empty table gives no batch. Other columns stay as they are.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import chunked, n_words, written

#: Buckets, and tokens (padding included) a batch holds.
BUCKETS, BUDGET = 16, 32768
#: Lengths below this are histogram cells of their own; above, an octave has so many cells.
EXACT, OCTAVE = 1 << 14, 1 << 13


def cell(length: Column) -> Column:
    """The histogram cell: the length itself below EXACT, else 1/OCTAVE of its octave wide.

    At most EXACT + 50 * OCTAVE cells whatever the data, which bounds what the driver gets.
    """
    octave = F.floor(F.log2(F.greatest(length, F.lit(EXACT)).cast("double")))
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), octave) / OCTAVE)
    return F.when(length < EXACT, length).otherwise((F.floor(length / step) * step).cast("long"))


def boundaries(hist: list[tuple[int, int, int]], n_buckets: int) -> list[int]:
    """Upper lengths of the buckets of least padding, from (longest, count, summed length) cells.

    Least sum over buckets of (boundary * count - summed length). With prefix sums the choice of
    the cell before a bucket is a minimum over lines, so that each of n_buckets rounds takes one
    pass along a lower hull. Fewer buckets come back where there are fewer cells.
    """
    hist = sorted(hist)
    n = len(hist)
    if not n:
        return []
    longest = [h[0] for h in hist]
    count, total = [0], [0]
    for _, c, s in hist:
        count.append(count[-1] + c)
        total.append(total[-1] + s)
    best: list = [0] + [None] * n
    back: list[list[int]] = []
    for _ in range(min(n_buckets, n)):
        new: list = [None] * (n + 1)
        came = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, height, cell
        top = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, height = -count[j - 1], best[j - 1] + total[j - 1]
                while len(hull) - top >= 2 and (height - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, height, j - 1))
            x = longest[j - 1]
            while top + 1 < len(hull) and hull[top + 1][0] * x + hull[top + 1][1] <= hull[top][0] * x + hull[top][1]:
                top += 1
            if top < len(hull):
                new[j] = hull[top][0] * x + hull[top][1] + x * count[j] - total[j]
                came[j] = hull[top][2]
        back.append(came)
        if best[n] is not None and new[n] is not None and new[n] >= best[n]:
            back.pop()
            break
        best = new
    out, j = [], n
    for came in reversed(back):
        out.append(longest[j - 1])
        j = came[j]
        if j == 0:
            break
    return out[::-1]


def pack(docs: DataFrame, n_buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep's columns (default all) and n_tokens, bucket, bucket_length, batch, batch_row, padding.

    A column of docs that has one of these names, or is called rank or before, is left out.
    """
    added = ("n_tokens", "bucket", "bucket_length", "batch", "batch_row", "padding", "rank", "before")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    length = n_words(F.col("text")) if length is None else length
    rows = docs.withColumn("n_tokens", length.cast("long")).withColumn("_pack_key", F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))))
    rows = written(rows.select(*keep, "n_tokens", "_pack_key"), "pack-lengths")
    cells = rows.groupBy(cell(F.col("n_tokens")).alias("c")).agg(F.max("n_tokens").alias("l"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("s"))
    hist = [(r["l"], r["n"], r["s"]) for r in cells.collect()]
    bounds = boundaries(hist, n_buckets)
    n = sum(h[1] for h in hist)
    digits = 1
    while 16**digits * 1000 < n:
        digits += 1
    of = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(of, lambda b: b < F.col("n_tokens"))))
    rows = chunked(rows, ["bucket"], ["_pack_key", "n_tokens"], F.lit(0), "_pack_run", F.substring("_pack_key", 1, digits), 16**digits).drop("before", "_pack_key")
    rows = rows.withColumn("bucket_length", F.get(of, F.col("bucket")))
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_length")))).cast("long")
    batch = F.floor(F.col("rank") / per).cast("long")
    return rows.withColumn("batch", batch).withColumn("batch_row", (F.col("rank") - batch * per).cast("long")).withColumn("padding", F.col("bucket_length") - F.col("n_tokens")).drop("rank")


def bucket_for(length: int, bounds: list[int]) -> int:
    return bisect_left(bounds, length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])


def _rounds() -> str:
    """The dynamic program, a table a number of buckets: least padding of the first j cells, and the cell before the last bucket."""
    out = ["b1 AS MATERIALIZED (SELECT j, l * cn - ts AS cost, 0::BIGINT AS prev FROM h WHERE j > 0)"]
    for k in range(2, BUCKETS + 1):
        out.append(
            f"b{k} AS MATERIALIZED (SELECT x.j, min(b.cost + x.l * (x.cn - g.cn) - (x.ts - g.ts)) AS cost, arg_min(g.j, struct_pack(c := b.cost + x.l * (x.cn - g.cn) - (x.ts - g.ts), i := -g.j)) AS prev"
            f" FROM h x JOIN b{k - 1} b ON b.j < x.j JOIN h g ON g.j = b.j GROUP BY x.j)"
        )
    return ",\n".join(out)


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens,
         md5(concat_ws(' ', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS k FROM documents),
c AS (
  SELECT CASE WHEN n_tokens < {EXACT} THEN n_tokens ELSE CAST(floor(n_tokens / (pow(2, floor(log2(n_tokens))) / {OCTAVE})) * (pow(2, floor(log2(n_tokens))) / {OCTAVE}) AS BIGINT) END AS cell, n_tokens FROM d),
z AS (
  SELECT max(n_tokens) AS l, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS s FROM c GROUP BY cell),
h AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY l) AS j, l, CAST(sum(n) OVER (ORDER BY l) AS BIGINT) AS cn, CAST(sum(s) OVER (ORDER BY l) AS BIGINT) AS ts FROM z UNION ALL SELECT 0, 0, 0, 0),
{_rounds()},
e AS ({" UNION ALL ".join(f"SELECT {k} AS k, j, cost, prev FROM b{k}" for k in range(1, BUCKETS + 1))}),
t AS (
  SELECT min(k) AS k FROM (SELECT k, cost, lead(cost) OVER (ORDER BY k) AS more FROM e WHERE j = (SELECT max(j) FROM h)) WHERE more IS NULL OR more >= cost),
p AS (
  SELECT CAST(t.k AS INT) AS k, (SELECT max(j) FROM h) AS j FROM t UNION ALL
  SELECT p.k - 1, e.prev FROM p JOIN e ON e.k = p.k AND e.j = p.j WHERE e.prev > 0),
o AS (
  SELECT list(h.l ORDER BY h.l) AS bounds FROM p JOIN h ON h.j = p.j),
b AS (
  SELECT doc_id, n_tokens, k, bounds, len(list_filter(bounds, lambda x: x < n_tokens)) AS bucket FROM d, o),
r AS (
  SELECT *, bounds[bucket + 1] AS bucket_length, greatest(1, {BUDGET} // greatest(1, bounds[bucket + 1])) AS per, row_number() OVER (PARTITION BY bucket ORDER BY k, n_tokens) - 1 AS rank FROM b)
SELECT doc_id, n_tokens, CAST(bucket AS INT) AS bucket, bucket_length, rank // per AS batch, rank % per AS batch_row, bucket_length - n_tokens AS padding FROM r
"""
