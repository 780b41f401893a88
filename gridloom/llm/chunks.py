"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes, white space left out; a word after which it is less than after the RADIUS words before,
and no more than after the RADIUS words behind, ends a chunk. Cuts depend on a few words around them only, so an insertion moves
the chunks beside it and no others, and a passage has the same chunks wherever it stands, but for its
ends. A stretch without a cut is one at every MOST words. Chunks are known by a 128-bit digest of their words. Of each digest
the first occurrence, by doc_id and place, stays; every later one is a repeat. Neighbouring repeats make up a passage, which is
marked if it is long enough to be no chance (LEAST words, the caller's choice) or the whole of its text.

Chunks whose digest occurs once are left out by a filter of bounded size before anything is shuffled.

Cases: null and empty texts have no chunk; a text without a cut is one chunk, or several of MOST words; a chunk repeated inside one text
is a repeat from its second occurrence on; rows that repeat a text are marked from the second row on, however short; a
row without id comes first in order; texts of any length are cut whole, in slices of whole texts; an empty table gives no rows.
Case and the amount of white space do not count. Other columns are kept or not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import lean, shipped, written
from gridloom.llm.filters import repeated
from gridloom.llm.passages import cut
from gridloom.llm.textkernel import SPACE, Tally, Words, signed, slices

#: Words on either side that a cut's hash is less than; words of the shortest passage marked and of the longest chunk.
RADIUS, LEAST, MOST = 2, 28, 64
#: Bytes that the gear hash reaches back.
REACH = 16
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """h[i] = sum over j < REACH of G[data[i - j]] << j, modulo 2**32, as far as byte i - j is of the same text:
    h[i] = (h[i-1] << 1) + G[data[i]] without what lies more than REACH bytes back. starts: the texts' first bytes."""
    h, n = _GEAR[data], len(data)
    have = 1
    while have < REACH:
        more = h.copy()
        more[have:] += h[:-have] << np.uint32(have) if n > have else 0
        first = (starts[:, None] + np.arange(have)).ravel()
        first = first[first < n]
        more[first] = h[first]  # these reach back to the text's start already
        h, have = more, 2 * have
    return h


def cuts(w: Words, radius: int = RADIUS, most: int = MOST) -> np.ndarray:
    """First words of the chunks of all texts."""
    n = len(w.hash)
    if not n:
        return np.empty(0, int)
    inside = ~SPACE[w.data]
    place = np.r_[0, np.cumsum(inside)]
    h = gear(w.data[inside], place[w.doc_byte[:-1]])[place[w.last] - 1].astype(np.int64)
    # A place at a text's edge has no neighbours there: they count as higher.
    high = np.int64(1) << 40
    row = np.repeat(np.arange(len(w.doc_first) - 1), w.counts())
    least = np.ones(n, bool)
    for d in range(1, radius + 1):
        before, after = np.full(n, high), np.full(n, high)
        before[d:] = np.where(row[d:] == row[:-d], h[:-d], high)
        after[:-d] = np.where(row[d:] == row[:-d], h[d:], high)
        least &= (h < before) & (h <= after)
    starts = np.flatnonzero(least) + 1
    firsts = w.doc_first[:-1][w.counts() > 0]
    at = np.unique(np.concatenate([firsts, starts[starts < n]]))
    parts = -(-np.diff(np.r_[at, n]) // most)
    return np.repeat(at, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))


def _chunks(w: Words, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, two digests) of each chunk."""
    at = cuts(w, radius)
    end = np.r_[at[1:], len(w.hash)] if len(at) else at
    return at, end, w.spans(at, end), w.spans(at, end, 1)


def marked(rows: DataFrame, radius: int = RADIUS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(texts, spans) of (doc_id, _row, text), _row a number of the row's own.

    texts: doc_id, _row, n_words, n_chunks; spans: _row, start, end, chunks of all runs of repeated chunks and whether
    the run is marked: of least words or the whole text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, _, w in slices(batch.column(0)):
                k, c = np.unique(_chunks(w, radius)[2], return_counts=True)
                tally.add(k, c)
            if tally.full():
                k, c = tally.take()
                yield pa.record_batch({"h": signed(k), "n": pa.array(c[:, 0], pa.int64())})
        k, c = tally.take()
        yield pa.record_batch({"h": signed(k), "n": pa.array(c[:, 0], pa.int64())})

    lean(rows.sparkSession)
    filter_ = repeated(rows.select("text").mapInArrow(count, "h long, n long"))
    kind = dict(rows.dtypes)["doc_id"]
    item = pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("no", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, chunks, counts, parts = [], [], [], []
            for _, _, w in slices(batch.column("text")):
                at, end, d1, d2 = _chunks(w, radius)
                doc = np.searchsorted(w.doc_first, at, "right") - 1
                n = np.bincount(doc, minlength=len(w.doc_first) - 1)
                no = np.arange(len(at)) - (np.cumsum(n) - n)[doc]
                keep = often.value(d1)  # noqa: F821  bound below, before the job runs
                base = w.doc_first[doc]
                size.append(w.counts())
                chunks.append(n)
                counts.append(np.bincount(doc[keep], minlength=len(n)))
                parts.append((d1[keep], d2[keep], no[keep], (at - base)[keep], (end - base)[keep]))
            if not size:
                continue
            d1, d2, no, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            items = pa.StructArray.from_arrays([signed(d1), signed(d2), *[pa.array(x, pa.int32()) for x in (no, start, end)]], fields=list(item))
            offsets = pa.array(np.r_[0, np.cumsum(np.concatenate(counts))], pa.int32())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "_row": batch.column("_row"), "n_words": pa.array(np.concatenate(size), pa.int64()), "n_chunks": pa.array(np.concatenate(chunks), pa.int64()), "found": pa.ListArray.from_arrays(offsets, items)})

    with shipped(rows.sparkSession, filter_) as often:
        found = written(rows.select("doc_id", "_row", "text").mapInArrow(run, f"doc_id {kind}, _row long, n_words long, n_chunks long, found array<struct<d1:long,d2:long,no:int,start:int,end:int>>"), "chunks")
    each = found.select("doc_id", "_row", F.explode("found").alias("c")).select("doc_id", "_row", "c.*")
    first = each.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "_row", "no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = each.join(first, ["d1", "d2"]).where((F.col("_row") != F.col("first._row")) | (F.col("no") != F.col("first.no")))
    w = Window.partitionBy("_row").orderBy("no")
    run_of = late.select("_row", "no", "start", "end", (F.col("no") - F.row_number().over(w)).alias("run"))
    spans = run_of.groupBy("_row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("chunks")).drop("run")
    texts = found.drop("found")
    whole = spans.join(texts.select("_row", "n_words"), "_row")
    size = F.col("end") - F.col("start")
    return texts, whole.withColumn("marked", (size >= least) | (size == F.col("n_words"))).drop("n_words")


def report(docs: DataFrame, radius: int = RADIUS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, n_chunks, dup_chunks, dup_words, n_passages, repeated_chunks, repeated_words) of every text:
    what is in marked passages, and all chunks that stand earlier, however short."""
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    texts, spans = marked(rows, radius, least)
    size, own = F.col("end") - F.col("start"), F.col("marked")
    sums = {"dup_chunks": F.sum(F.when(own, F.col("chunks"))), "dup_words": F.sum(F.when(own, size)), "n_passages": F.count_if("marked"), "repeated_chunks": F.sum("chunks"), "repeated_words": F.sum(size)}
    out = texts.join(spans.groupBy("_row").agg(*[v.alias(k) for k, v in sums.items()]), "_row", "left")
    return out.select("doc_id", "n_words", "n_chunks", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums])


def deduplicated(docs: DataFrame, radius: int = RADIUS, least: int = LEAST) -> DataFrame:
    """docs with every marked passage cut out but for its first occurrence; least=1 cuts every repeated chunk."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "chunk-rows")
    _, spans = marked(rows.select("doc_id", "_row", "text"), radius, least)
    return cut(rows, spans.where("marked").select("_row", "start", "end"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
t AS (SELECT doc_id, i, w[i] AS word, right(hex(encode(array_to_string(w[greatest(1, i - {REACH - 1}):i], ''))), {2 * REACH}) AS t FROM i),
g AS (SELECT doc_id, i, word, CAST(list_sum(list_transform(range(0, len(t) // 2), lambda j: ([{", ".join(map(str, _GEAR.tolist()))}][CAST('0x' || substr(t, len(t) - 2 * j - 1, 2) AS INT) + 1] * (1::BIGINT << j)) % 4294967296)) AS BIGINT) % 4294967296 AS h FROM t),
e AS (SELECT doc_id, i, word, h < least(lag(h, 1, 4294967296) OVER o, lag(h, 2, 4294967296) OVER o) AND h <= least(lead(h, 1, 4294967296) OVER o, lead(h, 2, 4294967296) OVER o) AS ends FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, word, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
p AS (SELECT doc_id, i, word, c, (row_number() OVER (PARTITION BY doc_id, c ORDER BY i) - 1) // {MOST} AS part FROM s),
c AS (SELECT doc_id, min(i) AS a, max(i) AS b, string_agg(word, ' ' ORDER BY i) AS text FROM p GROUP BY doc_id, c, part),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS no, row_number() OVER (PARTITION BY text ORDER BY doc_id, a) AS k FROM c),
r AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run FROM n WHERE k > 1),
u AS (SELECT doc_id, run, count(*) AS chunks, max(b) - min(a) + 1 AS size FROM r GROUP BY doc_id, run),
z AS (SELECT doc_id, len(w) AS n_words FROM w),
m AS (SELECT z.doc_id, sum(chunks) FILTER (size >= {LEAST} OR size = n_words) AS dup_chunks, sum(size) FILTER (size >= {LEAST} OR size = n_words) AS dup_words, count(*) FILTER (size >= {LEAST} OR size = n_words) AS n_passages, sum(chunks) AS repeated_chunks, sum(size) AS repeated_words FROM u JOIN z USING (doc_id) GROUP BY z.doc_id),
q AS (SELECT doc_id, count(*) AS n_chunks FROM c GROUP BY doc_id)
SELECT z.doc_id, z.n_words, coalesce(n_chunks, 0) AS n_chunks, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("dup_chunks", "dup_words", "n_passages", "repeated_chunks", "repeated_words"))}
FROM z LEFT JOIN q USING (doc_id) LEFT JOIN m USING (doc_id)
"""
