"""A filter of bounded size for hashes that occur more than once in a distributed table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_scratch, written
from gridloom.llm.textkernel import mix

#: Bits of the largest filter (32 MiB), and of one segment.
MOST, SEGMENT = 28, 16
BITS_A_KEY, PROBES = 16, 3


class Repeated:
    """Says of a 64-bit hash whether it may be repeated; never wrongly that it isn't.

    A Bloom filter. With more keys than the largest filter is made for, more hashes pass: what is done
    with those that pass has to be right for hashes that occur once.
    """

    def __init__(self, bits: int, field: np.ndarray):
        self.bits, self.field = bits, field

    def __call__(self, h: np.ndarray) -> np.ndarray:
        left = np.arange(len(h))
        for j in range(PROBES):
            i = _place(h[left], j, self.bits)
            left = left[(self.field[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(h), bool)
        out[left] = True
        return out


def _place(h: np.ndarray, j: int, bits: int) -> np.ndarray:
    return mix(h + np.uint64(j + 1)) >> np.uint64(64 - bits)


def repeated(hashes: DataFrame) -> Repeated:
    """From rows (h, n), n times each: the filter of the hashes whose sum of n is over 1."""
    keys = written(hashes.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "repeated", small=True)
    n = keys.count()
    bits = int(min(MOST, max(SEGMENT, (BITS_A_KEY * max(n, 1) - 1).bit_length())))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            at = np.unique(np.concatenate([_place(h, j, bits) for j in range(PROBES)])).astype(np.int64)
            yield pa.record_batch({"at": pa.array(at), "s": pa.array(at >> SEGMENT, pa.int32())})

    def run(table: pa.Table) -> pa.Table:
        at = np.asarray(table["at"])
        field = np.zeros(1 << SEGMENT, np.uint8)
        field[at & ((1 << SEGMENT) - 1)] = 1
        return pa.table({"s": table["s"].slice(0, 1), "b": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())})

    rows = keys.mapInArrow(places, "at long, s int").groupBy("s").applyInArrow(run, "s int, b binary").toArrow()
    drop_scratch(keys)
    field = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (SEGMENT - 3)
    for s, b in zip(rows["s"].to_pylist(), rows["b"].to_pylist(), strict=True):
        field[s * size : (s + 1) * size] = np.frombuffer(b, np.uint8)
    return Repeated(bits, field)
