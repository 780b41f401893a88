"""Folds over the rows of a page: what depends on all earlier rows of it, in one Arrow task a batch of pages.

A page's rows are one list, so the unit that meets in a task is a page, whatever the document or the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Rows = dict[str, pa.Array]
#: From a batch's rows by column and the places where its pages begin (and the last ends): the places of the
#: rows that go on, and the columns that take the place of theirs or are new. Without places: all of them.
Fold = Callable[[Rows, np.ndarray], tuple[np.ndarray | None, Rows]]


def numbers(column: pa.Array) -> np.ndarray:
    """As float64, null as NaN."""
    return np.asarray(column.cast(pa.float64()).fill_null(float("nan")) if column.null_count else column.cast(pa.float64()))


def medians(values: np.ndarray, page: np.ndarray, pages: int, none: float) -> np.ndarray:
    """Of each page the median of its values that are above 0."""
    good = values > 0
    values, page = values[good], page[good]
    values = values[np.lexsort((values, page))]
    n = np.bincount(page, minlength=pages)
    first = np.cumsum(n) - n
    if not len(values):
        return np.full(pages, none)
    low, high = (np.minimum(first + k, len(values) - 1) for k in ((np.maximum(n, 1) - 1) // 2, n // 2))
    return np.where(n > 0, (values[low] + values[high]) / 2, none)


def by_page(df: DataFrame, key: list[str], fold: Fold, added: str = "", without: tuple[str, ...] = (), number: str = "") -> DataFrame:
    """df's rows as the fold leaves them: key, df's other columns but for those without, then the added ones ('name type, ...').

    number: the name of a last column that counts the rows of the key's first column from 0, page by page, as the fold gives them:
    pages are still folded one by one, and only the count goes from one to the next."""
    rest = [c for c in df.columns if c not in key]
    kinds = dict(df.dtypes)
    new = [part.strip().split(" ")[0].strip("`") for part in added.split(", ")] if added else []
    keep = [c for c in rest if c not in (*without, *new)]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*key, *keep]] + ([added] if added else []) + ([f"`{number}` int"] if number else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("_rows")
            at = np.asarray(lists.offsets).astype(np.int64)
            items = lists.values.slice(at[0], at[-1] - at[0])
            at = at - at[0]
            rows = dict(zip(rest, items.flatten(), strict=True))
            places, made = fold(rows, at)
            page = np.repeat(np.arange(len(at) - 1), np.diff(at))
            take = None if places is None else pa.array(places, pa.int64())
            own = pa.array(page if places is None else page[places], pa.int64())
            columns = [batch.column(c).take(own) for c in key]
            columns += [made[c] if c in made else rows[c] if take is None else rows[c].take(take) for c in keep]
            columns += [made[c] for c in new]
            if number:
                at_page = page if places is None else page[places]
                n = np.bincount(at_page, minlength=len(at) - 1)
                sofar = np.cumsum(n) - n
                first = np.maximum.accumulate(np.where(np.asarray(batch.column("_nth")) == 1, np.arange(len(n)), -1))
                start = sofar - np.where(first >= 0, sofar[first], -before)
                before = int(start[-1] + n[-1])
                columns.append(pa.array((np.arange(len(at_page)) - sofar[at_page] + start[at_page]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, [*key, *keep, *new, *([number] if number else [])])

    lists = df.groupBy(*key).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    if number:
        lists = lists.withColumn("_nth", F.row_number().over(Window.partitionBy(key[0]).orderBy(*key[1:])))
    return lists.mapInArrow(run, schema)
