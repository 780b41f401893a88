"""The reading pass: pictures in tiles, read by a model, merged; then the ink that no fragment covers, read once more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import cells as C
from gridloom.operators import fragments as R
from gridloom.plans import prompts
from gridloom.plans.models import called
from gridloom.plans.schemas import FRAGMENTS
from gridloom.sources import pictures
from gridloom.sources.scratch import kept

Open = Callable[[], Callable[[dict], str]]
WORDS = ("doc_id", "page", "ord", "text", "x", "y", "w", "h", "conf")
#: Bytes of pictures that a task holds.
TASK = 32 << 20
FIELDS = ["doc_id", "id", "text", "x", "y", "w", "h", "conf", "page", "alternates", "contested"]


def tasks_of(pages: DataFrame) -> int:
    """How many tasks hold TASK bytes each of the pictures of pages (doc_id, page, image)."""
    size = pages.agg(F.sum(F.col("image.height").cast("long") * F.col("image.width") * F.col("image.nChannels"))).first()[0]
    return (size or 0) // TASK + 1


def dealt(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """pages (doc_id, page, image) dealt out by page, so that a task holds some TASK bytes of pictures.

    Exchanges are planned by compressed bytes, of which blank pages have next to none: all of them came to one task.
    """
    return pages.repartition(tasks or tasks_of(pages), "doc_id", "page")


def _cut(pages: DataFrame, boxes: DataFrame, tasks: int | None) -> DataFrame:
    return pictures.parts(R.beside(pages.select("doc_id", "page", "image"), boxes, tasks))


def _asked(parts: DataFrame, model: Open) -> DataFrame:
    """(doc_id, page, read, id, text, x, y, w, h) that the model reads in parts (doc_id, page, read, x1, y1, image)."""
    requests = parts.withColumn("prompt", F.lit(prompts.READING)).withColumn("schema", F.lit(FRAGMENTS))
    raw = called(requests, model).select("doc_id", "page", "read", F.col("x1").alias("tile_x"), F.col("y1").alias("tile_y"), "raw")
    return R.parsed(raw)


def _numbered(each: DataFrame) -> DataFrame:
    return each.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("read", "id")))


def tiled(pages: DataFrame, tile: int = 1024, overlap: float = 0.2, offsets: tuple[int, ...] = (0,), tasks: int | None = None) -> DataFrame:
    """pages (doc_id, page, image) by tile: read, x1, y1, x2, y2 and the tile's part of the image. Each offset is a
    read of all tiles, moved up and to the left by so much, so that what lies on a seam is whole in one of them.
    tasks: into how many the pages are dealt()."""
    plan = R.tiles(pages.select("doc_id", "page", "image.width", "image.height"), tile, overlap)
    moved = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(offsets)]))
    plan = plan.withColumn("_m", moved)
    back = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("_m.o")).cast("int").alias(c)
    box = F.struct((F.col("_m.i") * 1_000_000 + F.col("tile_no")).cast("int").alias("read"), back("x1"), back("y1"), F.col("x2").cast("int").alias("x2"), F.col("y2").cast("int").alias("y2"))
    boxes = plan.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    return _cut(pages, boxes, tasks)


def _boxed(pages: DataFrame, regions: DataFrame, tasks: int) -> DataFrame:
    """Parts of pages at regions (doc_id, page, x1, y1, x2, y2), read from top to bottom."""
    box = F.struct(*[F.floor(c).cast("int").alias(c) for c in ("y1", "x1", "x2", "y2")])
    boxes = regions.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(box)), lambda b, i: F.struct(i.alias("read"), b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"))).alias("boxes"))
    return _cut(pages, boxes, tasks)


def reread(pages: DataFrame, regions: DataFrame, model: Open, threshold: float = 0.5) -> DataFrame:
    """Fragments read from regions of the pages only, merged."""
    tasks = tasks_of(pages)
    return R.merged(_numbered(_asked(_boxed(dealt(pages, tasks), regions, tasks), model)), threshold)


def claimed(payloads: DataFrame) -> DataFrame:
    """(doc_id, page, x1, y1, x2, y2) of the text that models say the reading pass missed; claims without a box are left out."""
    m = C.missed(payloads).where((F.size("b") == 4) & ~F.exists("b", lambda v: v.isNull()))
    return m.select("doc_id", F.coalesce("p", F.lit(1)).alias("page"), *[F.col("b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def with_more(fragments: DataFrame, new: DataFrame, threshold: float = 0.5) -> DataFrame:
    """fragments with new ones (doc_id, page, read, id, text, x, y, w, h) merged in: pages that have some are merged
    again, as the fragments first and then the new ones; the others stay as they are."""
    touched = new.select("doc_id", "page").distinct()
    old = fragments.join(touched, ["doc_id", "page"], "left_semi").select("doc_id", "page", F.lit(-1).alias("read"), "id", "text", "x", "y", "w", "h")
    again = R.merged(_numbered(old.unionByName(new.withColumn("read", F.col("read").cast("int")))), threshold).select(*FIELDS)
    return R.renumbered(fragments.join(touched, ["doc_id", "page"], "left_anti").select(*FIELDS).unionByName(again))


def read_pages(pages: DataFrame, model: Open, tile: int = 1024, overlap: float = 0.2, offsets: tuple[int, ...] = (0,), threshold: float = 0.5, sweep: bool = True) -> DataFrame:
    """Fragments of (doc_id, page, image), numbered by document. sweep: patches of ink that no fragment meets are
    read once more, and what is found there is merged in."""
    tasks = tasks_of(pages)
    pages = dealt(pages, tasks)
    merged = kept(R.merged(_numbered(_asked(tiled(pages, tile, overlap, offsets, tasks), model)), threshold), "fragments")
    if not sweep:
        return merged.select(*FIELDS)
    new = kept(_asked(_boxed(pages, R.unread_ink(pages, merged, tasks=tasks), tasks), model), "swept")
    return with_more(merged, new, threshold)


def with_missed(pages: DataFrame, fragments: DataFrame, payloads: DataFrame, model: Open, threshold: float = 0.5) -> DataFrame:
    """fragments and what a second reading finds where payloads claim missed text."""
    tasks = tasks_of(pages)
    new = kept(_asked(_boxed(dealt(pages, tasks), claimed(payloads), tasks), model), "missed")
    return with_more(fragments, new, threshold)


def ocr_words(pages: DataFrame, engine: Callable[[], Callable[[np.ndarray], list[tuple]]]) -> DataFrame:
    """(doc_id, page, ord, text, x, y, w, h, conf) of an OCR engine's lines on (doc_id, page, image): their texts without
    white space at the ends, blank ones left out, around the corners it gives. A page without image has none.

    engine is opened once a task; it takes a page as an array (height, width, channels) and returns (text, corners, confidence).
    """
    kind = dict(pages.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                lines = [] if r.data is None else [(str(t or "").strip(), c, p) for t, c, p in read(pictures.array_of(r.data, int(r.height), int(r.width), int(r.nChannels)))]
                for ord_, (text, corners, conf) in enumerate(line for line in lines if line[0]):
                    xs, ys = zip(*corners, strict=True)
                    out.append((r.doc_id, r.page, ord_, text, float(min(xs)), float(min(ys)), float(max(xs) - min(xs)), float(max(ys) - min(ys)), float(conf)))
            yield pd.DataFrame(out, columns=[*WORDS])

    flat = pages.select("doc_id", "page", "image.data", "image.width", "image.height", "image.nChannels")
    return flat.mapInPandas(run, f"doc_id {kind['doc_id']}, page {kind['page']}, ord int, text string, x double, y double, w double, h double, conf double")
