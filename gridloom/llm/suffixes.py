"""Substring dedup by sparse suffix arrays.

Every window of WORDS words has a minimiser: the least hash among its k-word pieces. Suffixes are
retained at minimisers only, each with the windows that its minimiser stands for, which reach left
and right of it. Equal windows have equal minimisers, so suffixes sorted by minimiser bring every
repeated window next to its copies: neighbours are compared, and a match is extended left and right
a word at a time by the windows around it, to the longest repeated passage. The first occurrence,
by doc_id and place, stays; every word of a later one is marked.

A minimiser that occurs once in the corpus is left out by a filter of bounded size. Minimisers of very many
suffixes are dealt out over salts: each salt finds its own first windows, then the salts' firsts
are compared window by window.

The marks are those of a full suffix array, which is why the windows are compared and not only a sorted suffix's two
neighbours: the earlier occurrence that matches farthest to the left is not always the one that matches farthest to the right.

Cases: null, empty and short texts have no window and no mark; texts of any length are taken whole; a passage repeated inside
one text is marked from its second occurrence on; rows that repeat a text are marked from the second row on;
a row without id comes first in order; an empty table gives no rows. Case and white space do not
count. Other columns are kept or not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import lean, shipped, written
from gridloom.llm.filters import Repeated, repeated
from gridloom.llm.passages import cut, merged, totals
from gridloom.llm.textkernel import U as U64
from gridloom.llm.textkernel import Tally, Words, signed, slices

#: Words of the shortest repeat that is found, and of the pieces that minimisers are chosen from.
WORDS, PIECE = 50, 16
#: Suffixes of a minimiser that one task compares.
GROUP = 1000


def runs(w: Words, words: int = WORDS, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser, whether it stands in the run's words more than once) of each
    run of windows that share a minimiser."""
    pieces = least = w.grams(piece)
    width, have = words - piece + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        have += step
    n = len(w.hash)
    if not len(least):
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.uint64), np.empty(0, bool)
    # A window starts at each word with `words` words of its text from there on.
    left = np.repeat(w.doc_first[1:], w.counts()) - np.arange(n)
    starts = np.flatnonzero(left[: len(least)] >= words)
    m = least[starts]
    new = np.r_[True, (m[1:] != m[:-1]) | (starts[1:] != starts[:-1] + 1)] if len(starts) else np.empty(0, bool)
    at = np.flatnonzero(new)
    first, n, m = starts[at], np.diff(np.r_[at, len(starts)]), m[at]
    again = np.zeros(len(at), bool)
    for a in range(0, len(at), 1 << 15):  # the first window's first and the last one's last place of it
        part = slice(a, a + (1 << 15))
        early = (pieces[first[part, None] + np.arange(width)] == m[part, None]).argmax(1)
        late = width - 1 - (pieces[(first + n - 1)[part, None] + np.arange(width - 1, -1, -1)] == m[part, None]).argmax(1)
        again[part] = early != late + n[part] - 1
    return first, n, m, again


def _minimisers(words: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, _, w in slices(batch.column(0)):
                _, _, m, again = runs(w, words, piece)
                k, at = np.unique(m, return_inverse=True)
                tally.add(k, np.bincount(at, 1 + again, len(k)).astype(np.int64))
            if tally.full():
                k, c = tally.take()
                yield pa.record_batch({"h": signed(k), "n": pa.array(c[:, 0], pa.int64())})
        k, c = tally.take()
        yield pa.record_batch({"h": signed(k), "n": pa.array(c[:, 0], pa.int64())})

    return run


def suffixes(rows: DataFrame, often: Broadcast[Repeated], words: int = WORDS, piece: int = PIECE) -> DataFrame:
    """(doc_id, _row, n_words, found): of each text its suffixes at minimisers that may be repeated,
    as (h, at, windows): the minimiser, the first window's word, the windows' hashes."""
    kind = dict(rows.dtypes)["doc_id"]
    item = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("windows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, counts, h, at, windows = [], [], [], [], []
            for _, _, w in slices(batch.column("text")):
                first, n, m, _ = runs(w, words, piece)
                keep = often.value(m)
                first, n, m = first[keep], n[keep], m[keep]
                whole = w.grams(words)
                doc = np.searchsorted(w.doc_first, first, "right") - 1
                size.append(w.counts())
                counts.append(np.bincount(doc, minlength=len(w.doc_first) - 1))
                h.append(m)
                at.append(first - w.doc_first[doc])
                data = whole.tobytes()
                windows += [data[8 * a : 8 * (a + k)] for a, k in zip(first.tolist(), n.tolist(), strict=True)]
            if not size:
                continue
            offsets = pa.array(np.r_[0, np.cumsum(np.concatenate(counts))], pa.int32())
            items = pa.StructArray.from_arrays([signed(np.concatenate(h)), pa.array(np.concatenate(at), pa.int32()), pa.array(windows, pa.binary())], fields=list(item))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "_row": batch.column("_row"), "n_words": pa.array(np.concatenate(size), pa.int64()), "found": pa.ListArray.from_arrays(offsets, items)})

    return rows.select("doc_id", "_row", "text").mapInArrow(run, f"doc_id {kind}, _row long, n_words long, found array<struct<h:long,at:int,windows:binary>>")


def _compare(rows: DataFrame, words: int, firsts: bool) -> DataFrame:
    """Rows (h, salt, doc_id, _row, at, windows), of which those of an (h, salt) are compared.

    Returns (_row, start, end) marks; with firsts also the windows that no earlier one of the salt has, as (x, doc_id,
    _row, at), the others' columns null.
    """
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def compare(t: pa.Table) -> pa.RecordBatch:
            data = t["windows"].to_pylist()
            size = np.array([len(d) for d in data]) // 8
            x = np.frombuffer(b"".join(data), np.uint64)
            row = np.repeat(np.arange(len(data)), size)
            begin = np.cumsum(size) - size
            place = np.asarray(t["at"]).astype(np.int64)[row] + np.arange(len(x)) - begin[row]
            group = np.asarray(t["_g"])[row]
            # Rows are in order of occurrence, so the first of equal neighbours stays.
            order = np.lexsort((np.arange(len(x)), group, x))
            same = np.r_[False, (x[order][1:] == x[order][:-1]) & (group[order][1:] == group[order][:-1])] if len(x) else np.empty(0, bool)
            late = np.zeros(len(x), bool)
            late[order] = same
            late &= x != 0
            hit = np.flatnonzero(late)
            new = np.flatnonzero(np.r_[True, (row[hit][1:] != row[hit][:-1]) | (hit[1:] != hit[:-1] + 1)]) if len(hit) else hit
            last = np.r_[new[1:], len(hit)] - 1 if len(hit) else hit
            n = len(new)
            rows_ = np.asarray(t["_row"])
            columns = {"_row": pa.array(rows_[row[hit[new]]], pa.int64()), "start": pa.array(place[hit[new]], pa.int32()), "end": pa.array(place[hit[last]] + words, pa.int32())}
            if not firsts:
                return pa.record_batch(columns)
            first = np.flatnonzero(~late & (x != 0))
            own = pa.array(row[first])
            m = len(first)
            none = pa.nulls
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([columns["_row"], pa.array(rows_[row[first]], pa.int64())]),
                    pa.concat_arrays([columns["start"], none(m, pa.int32())]),
                    pa.concat_arrays([columns["end"], none(m, pa.int32())]),
                    pa.concat_arrays([none(n, pa.int64()), signed(x[first])]),
                    pa.concat_arrays([none(n, t["doc_id"].type), t["doc_id"].combine_chunks().take(own)]),
                    pa.concat_arrays([none(n, pa.int32()), pa.array(place[first], pa.int32())]),
                ],
                ["_row", "start", "end", "x", "doc_id", "at"],
            )

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            t = pa.concat_tables([rest, t]) if rest is not None else t
            h, salt = np.asarray(t["h"]), np.asarray(t["salt"])
            edge = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
            cut_ = int(np.flatnonzero(edge)[-1])  # the last group may go on
            if cut_:
                yield compare(t.slice(0, cut_).append_column("_g", pa.array(np.cumsum(edge)[:cut_])))
            rest = t.slice(cut_)
        if rest is not None:
            yield compare(rest.append_column("_g", pa.array(np.zeros(rest.num_rows, np.int64))))

    schema = "_row long, start int, end int" + (f", x long, doc_id {kind}, at int" if firsts else "")
    dealt = rows.select("h", "salt", "doc_id", "_row", "at", "windows").repartition("h", "salt").sortWithinPartitions("h", "salt", "doc_id", "_row", "at")
    return dealt.mapInArrow(run, schema)


def repeats(rows: DataFrame, words: int = WORDS, piece: int = PIECE, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(texts, spans) of (doc_id, _row, text), _row a number of the row's own.

    texts: doc_id, _row, n_words; spans: _row, start, end, the merged marks in words.
    """
    spark = rows.sparkSession
    lean(spark)
    with shipped(spark, repeated(rows.select("text").mapInArrow(_minimisers(words, piece), "h long, n long"))) as often:
        found = written(suffixes(rows, often, words, piece), "suffixes")
    each = found.select("doc_id", "_row", F.explode("found").alias("s")).select("doc_id", "_row", "s.h", "s.at", "s.windows")
    hot = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("h", F.ceil(F.col("n") / group).cast("int").alias("salts"))
    hot = written(hot, "suffix-hot")
    if hot.limit(1).count():
        each = each.join(hot, "h", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("_row", "at"), F.col("salts")) + 1).otherwise(0).cast("int"))
        plain = _compare(each.where("salt = 0"), words, False)
        parts = written(_compare(each.where("salt > 0"), words, True), "suffix-parts")
        windows = parts.where("x is not null").select("x", "doc_id", "_row", "at")
        first = windows.groupBy("x").agg(F.min(F.struct("doc_id", "_row", "at")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = windows.join(first, "x").where((F.col("_row") != F.col("f._row")) | (F.col("at") != F.col("f.at")))
        again = again.select("_row", F.col("at").alias("start"), (F.col("at") + words).alias("end"))
        marks = plain.union(parts.where("start is not null").select("_row", "start", "end")).union(again)
    else:
        marks = _compare(each.withColumn("salt", F.lit(0)), words, False)
    return found.select("doc_id", "_row", "n_words"), merged(marks)


def numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_row", F.monotonically_increasing_id())


def report(docs: DataFrame, words: int = WORDS, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_words, dup_words, n_passages) of every text."""
    texts, spans = repeats(numbered(docs.select("doc_id", "text")), words, piece)
    out = texts.join(totals(spans), "_row", "left")
    return out.select("doc_id", "n_words", F.coalesce("dup_words", F.lit(0)).alias("dup_words"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"))


def deduplicated(docs: DataFrame, words: int = WORDS, piece: int = PIECE) -> DataFrame:
    """docs with every repeated passage cut out but for its first occurrence."""
    rows = written(numbered(docs), "suffix-rows")  # fixes the row numbers
    _, spans = repeats(rows.select("doc_id", "_row", "text"), words, piece)
    return cut(rows, spans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, w, unnest(CASE WHEN len(w) < 50 THEN [] ELSE range(0, len(w) - 49) END) AS i FROM w),
h AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i+1:i+50], ' ') ORDER BY doc_id, i) AS k FROM s),
m AS (
  SELECT doc_id, i, coalesce(i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true) AS new FROM h WHERE k > 1),
g AS (
  SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM m),
p AS (
  SELECT doc_id, r, max(i) + 50 - min(i) AS n FROM g GROUP BY doc_id, r),
t AS (
  SELECT doc_id, sum(n) AS dup_words, count(*) AS n_passages FROM p GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(dup_words, 0) AS BIGINT) AS dup_words, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages
FROM w LEFT JOIN t ON t.doc_id = w.doc_id
"""
