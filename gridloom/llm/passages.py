"""Spans of words in documents: merging them, counting them and cutting them out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.textkernel import slices


def merged(spans: DataFrame, row: str = "_row") -> DataFrame:
    """(row, start, end): overlapping and touching spans of a row as one."""
    w = Window.partitionBy(row).orderBy("start", "end")
    high = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (F.coalesce(high, F.lit(-1)) < F.col("start")).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(row, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def totals(spans: DataFrame, row: str = "_row") -> DataFrame:
    """(row, dup_words, n_passages) from merged spans."""
    return spans.groupBy(row).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("dup_words"), F.count(F.lit(1)).alias("n_passages"))


def cut(docs: DataFrame, spans: DataFrame, row: str = "_row") -> DataFrame:
    """docs with the words of each row's merged spans cut out of text, and without the row column.

    A cut runs from the span's first byte to the next word that stays; rows without spans keep their
    text byte for byte. n_chars, if there, is the new length of a text that was cut.
    """
    lists = spans.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    both = docs.join(lists, row, "left").drop(row)
    names = docs.drop(row).columns
    chars = "n_chars" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").to_pylist()
            n = batch.column("n_chars").to_pylist() if chars else None
            lists_ = batch.column("_spans")
            some = np.flatnonzero(np.asarray(lists_.is_valid()))
            part = pa.array([text[i] for i in some], pa.string())
            for a, b, w in slices(part, lower=False):
                raw = w.raw.tobytes()
                for d in range(a, b):
                    i = int(some[d])
                    first = w.doc_first[d - a]
                    low, high = int(w.doc_byte[d - a]), int(w.doc_byte[d - a + 1])
                    out, at = [], low
                    for s in lists_[i].as_py():
                        x, y = first + s["start"], first + s["end"]
                        out.append(raw[at : w.first[x]])
                        at = int(w.first[y]) if y < w.doc_first[d - a + 1] else high
                    out.append(raw[at:high])
                    text[i] = b"".join(out).decode()
                    if chars:
                        n[i] = len(text[i])
            arrays = []
            for c in names:
                if c == "text":
                    arrays.append(pa.array(text, pa.string()))
                elif c == "n_chars":
                    arrays.append(pa.array(n, batch.schema.field(c).type))
                else:
                    arrays.append(batch.column(c))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return both.select(*names, "_spans").mapInArrow(run, docs.drop(row).schema)
