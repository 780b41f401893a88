"""Pages as arrays: turning, shrinking, cropping and drawing on Spark's image structs."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
# Spark's modes of 8-bit images by channels.
MODES = {1: 0, 3: 16, 4: 24}
#: Bytes of parts of pages that go back to Spark at once.
BATCH = 8 << 20


def array_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def turned(a: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise on a canvas that holds all of it; what is beyond the page is black. By the nearest pixel."""
    if degrees % 90 == 0:
        return np.rot90(a, int(degrees // 90) % 4)
    h, w = a.shape[:2]
    t = np.radians(degrees)
    sin, cos = np.sin(t), np.cos(t)
    height, width = (int(np.ceil(abs(p * cos) + abs(q * sin) - 1e-9)) for p, q in ((h, w), (w, h)))
    y, x = np.mgrid[:height, :width]
    y, x = y - (height - 1) / 2, x - (width - 1) / 2
    from_x, from_y = np.rint(x * cos - y * sin + (w - 1) / 2).astype(int), np.rint(x * sin + y * cos + (h - 1) / 2).astype(int)
    inside = (from_x >= 0) & (from_x < w) & (from_y >= 0) & (from_y < h)
    out = np.zeros((height, width, a.shape[2]), a.dtype)
    out[inside] = a[from_y[inside], from_x[inside]]
    return out


# What each EXIF orientation asks for, as quarter turns counter-clockwise after a mirroring of the sides.
UPRIGHT = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (1, True), 6: (3, False), 7: (3, True), 8: (1, False)}


def orientation(content: bytes) -> int:
    """The EXIF orientation of a JPEG file, 1 if it says none."""
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        part = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and part[:6] == b"Exif\0\0" and part[6:8] in (b"II", b"MM"):
            tiff, order = part[6:], "<" if part[6:8] == b"II" else ">"
            try:
                (first,) = struct.unpack_from(f"{order}I", tiff, 4)
                (n,) = struct.unpack_from(f"{order}H", tiff, first)
                for i in range(n):
                    tag, _, _, value = struct.unpack_from(f"{order}HHIH", tiff, first + 2 + 12 * i)
                    if tag == 0x0112:
                        return value if value in UPRIGHT else 1
            except struct.error:
                return 1
        at += 2 + size
    return 1


def upright(a: np.ndarray, tag: int) -> np.ndarray:
    turns, mirrored = UPRIGHT.get(tag, (0, False))
    return np.rot90(a[:, ::-1] if mirrored else a, turns)


def png(a: np.ndarray) -> bytes:
    """A PNG file of an image struct's array, whose colours are in the order blue, green, red."""
    kind = {1: 0, 3: 2, 4: 6}[a.shape[2]]
    a = a if a.shape[2] == 1 else np.concatenate([a[:, :, 2::-1], a[:, :, 3:]], axis=2)
    lines = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), a.reshape(a.shape[0], -1)], axis=1)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def data_uri(a: np.ndarray, max_side: int | None = 1536) -> str:
    return "data:image/png;base64," + base64.b64encode(png(shrunk(a, max_side))).decode()


def shrunk(a: np.ndarray, max_side: int | None) -> np.ndarray:
    """Smaller by the mean over whole blocks and nearest pixels, so that no side is over max_side."""
    if not max_side or max(a.shape[:2]) <= max_side:
        return a
    scale = max(a.shape[:2]) / max_side
    h, w = max(1, round(a.shape[0] / scale)), max(1, round(a.shape[1] / scale))
    sums = np.zeros((a.shape[0] + 1, a.shape[1] + 1, a.shape[2]))
    sums[1:, 1:] = a.cumsum(0).cumsum(1)
    ys, xs = np.linspace(0, a.shape[0], h + 1).astype(int), np.linspace(0, a.shape[1], w + 1).astype(int)
    total = sums[ys[1:]][:, xs[1:]] - sums[ys[:-1]][:, xs[1:]] - sums[ys[1:]][:, xs[:-1]] + sums[ys[:-1]][:, xs[:-1]]
    area = (np.diff(ys)[:, None] * np.diff(xs)[None, :])[:, :, None]
    return np.rint(total / area).astype(np.uint8)


def outlined(a: np.ndarray, boxes: list[tuple], width: int = 2) -> np.ndarray:
    """With a frame around each (x1, y1, x2, y2, colour), cut off at the edges."""
    a = a.copy()
    h, w = a.shape[:2]
    for x1, y1, x2, y2, colour in boxes:
        x1, x2, y1, y2 = (int(np.clip(v, 0, m - 1)) for v, m in ((x1, w), (x2, w), (y1, h), (y2, h)))
        for part in ((slice(y1, y1 + width), slice(x1, x2 + 1)), (slice(max(y2 - width + 1, 0), y2 + 1), slice(x1, x2 + 1)), (slice(y1, y2 + 1), slice(x1, x1 + width)), (slice(y1, y2 + 1), slice(max(x2 - width + 1, 0), x2 + 1))):
            a[part] = colour
    return a


def _mapped(rows: DataFrame, change, *more: str) -> DataFrame:
    keep = [c for c in rows.columns if c != "image"]
    kind = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keep)
    flat = rows.select(*keep, "image.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images = []
            for r in frame.to_dict("records"):
                a = np.ascontiguousarray(change(array_of(r["data"], r["height"], r["width"], r["nChannels"]), r))
                images.append({"origin": r["origin"], "height": a.shape[0], "width": a.shape[1], "nChannels": a.shape[2], "mode": MODES[a.shape[2]], "data": a.tobytes()})
            yield pd.DataFrame({**{c: frame[c] for c in keep}, "image": images})

    return flat.mapInPandas(run, f"{kind + ', ' if kind else ''}image {IMAGE}")


def prepared(rows: DataFrame, degrees: float = 0, max_side: int | None = None) -> DataFrame:
    """rows with image set upright (by the column content, the picture's file, if there is one), turned and shrunk."""
    return _mapped(rows, lambda a, r: shrunk(turned(upright(a, orientation(r["content"])) if r.get("content") is not None else a, degrees), max_side))


def parts(pages: DataFrame, boxes: str = "boxes") -> DataFrame:
    """pages (image and boxes, an array of structs with x1, y1, x2, y2) by box: the struct's fields, and the box's
    part of the image. A page goes to Python once, whatever its number of boxes; boxes of less than two pixels are left out."""
    keep = [c for c in pages.columns if c not in ("image", boxes)]
    item = pages.schema[boxes].dataType.elementType
    names = [f.name for f in item.fields]
    kinds = dict(pages.dtypes)
    kind = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{f.name}` {f.dataType.simpleString()}" for f in item.fields] + [f"image {IMAGE}"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for frame in frames:
            for r in frame.to_dict("records"):
                a = array_of(r["data"], r["height"], r["width"], r["nChannels"])
                for b in r[boxes] if r[boxes] is not None else []:
                    x1, y1, x2, y2 = max(0, int(b["x1"])), max(0, int(b["y1"])), min(r["width"], int(b["x2"])), min(r["height"], int(b["y2"]))
                    if x2 - x1 >= 2 and y2 - y1 >= 2:
                        own = np.ascontiguousarray(a[y1:y2, x1:x2])
                        image = {"origin": r["origin"], "height": y2 - y1, "width": x2 - x1, "nChannels": r["nChannels"], "mode": r["mode"], "data": own.tobytes()}
                        out.append({**{c: r[c] for c in keep}, **{n: b[n] for n in names}, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "image": image})
                        size += own.nbytes
                if size >= BATCH:
                    yield pd.DataFrame(out, columns=[*keep, *names, "image"])
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=[*keep, *names, "image"])

    return pages.select(*keep, boxes, "image.*").mapInPandas(run, kind)


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Of just this size, by the nearest pixel, in three colours."""
    a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]
    ys, xs = (np.arange(height) * a.shape[0] // height), (np.arange(width) * a.shape[1] // width)
    return a[ys[:, None], xs[None, :]]


def fitted(rows: DataFrame, width: int = 512, height: int = 512) -> DataFrame:
    """rows with image resized(), as some models ask for."""
    return _mapped(rows, lambda a, r: resized(a, width, height))


def cropped(rows: DataFrame) -> DataFrame:
    """rows (image, x1, y1, x2, y2) with the part of the image in the box."""
    return _mapped(rows, lambda a, r: a[max(0, int(r["y1"])) : int(r["y2"]), max(0, int(r["x1"])) : int(r["x2"])])


def with_cell_boxes(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (uid, image) with the boxes of cells drawn: header cells blue, others red."""
    boxes = cells.where("bbox is not null").groupBy("uid").agg(F.collect_list(F.struct("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2", "tag")).alias("boxes"))

    def draw(a: np.ndarray, r: dict) -> np.ndarray:
        a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]
        own = r["boxes"] if r["boxes"] is not None else []
        return outlined(a, [(b["x1"], b["y1"], b["x2"], b["y2"], (200, 60, 20) if b["tag"] == "th" else (20, 20, 220)) for b in own])

    return _mapped(rows.join(boxes, "uid", "left"), draw).drop("boxes")
