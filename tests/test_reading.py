import io
import json
import struct
import urllib.error
import urllib.request
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import metrics
from gridloom.plans import bakeoff, client, job, models, reading, schemas
from gridloom.plans.reconstruct import Plan, reconstruct
from gridloom.sources import files, paged, pictures
from gridloom.streaming import scoring

IMAGE = f"doc_id string, page int, image {pictures.IMAGE}"


def picture(a, name="p"):
    return {"origin": name, "height": a.shape[0], "width": a.shape[1], "nChannels": a.shape[2], "mode": pictures.MODES[a.shape[2]], "data": a.tobytes()}


#: Words as blots: where they stand on the page, their grey, and the text that goes with it.
BLOTS = {10: (20, 20, "red"), 30: (200, 20, "5"), 50: (20, 120, "blue"), 70: (200, 120, "7"), 90: (20, 220, "late"), 110: (200, 220, "9")}


def blotted(width=300, height=300):
    a = np.full((height, width, 1), 255, np.uint8)
    for grey, (x, y, _) in BLOTS.items():
        a[y : y + 20, x : x + 40] = grey
    return a


def seeing(skip=()):
    """A model that reads a picture's blots by their grey, but for some on pictures of more than a blot."""

    def open_model():
        def read(row):
            i = row["image"]
            a = np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"])
            found = []
            for grey, (_, _, text) in BLOTS.items():
                ys, xs = np.nonzero(a == grey)
                if len(ys) and not (text in skip and len(np.unique(a)) > 3):
                    found.append({"t": text, "b": [int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1]})
            return json.dumps({"fragments": found})

        return read

    return open_model


def test_reading_pass_sweeps_what_was_not_read(spark):
    pages = spark.createDataFrame([("d", 1, picture(blotted())), ("e", 1, picture(np.full((40, 40, 1), 255, np.uint8)))], IMAGE)
    whole = {r["text"]: (r["x"], r["y"], r["w"], r["h"], r["conf"]) for r in reading.read_pages(pages, seeing()).collect()}
    assert whole == {t: (x, y, 40.0, 20.0, 1.0) for x, y, t in BLOTS.values()}
    blind = reading.read_pages(pages, seeing(("late", "5")), sweep=False)
    assert blind.count() == 4
    swept = reading.read_pages(pages, seeing(("late", "5"))).orderBy("id").collect()
    assert [r["text"] for r in swept] == ["red", "5", "blue", "7", "late", "9"] and [r["id"] for r in swept] == list(range(6))
    tiled = reading.read_pages(pages, seeing(), tile=160, overlap=0.4, offsets=(0, 16))
    assert {r["text"] for r in tiled.collect()} == {t for _, _, t in BLOTS.values()} and tiled.where("w > 40 or h > 20").count() == 0
    # What a model says was missed is read at its box.
    claim = spark.createDataFrame([("d", {"columns": [], "cells": [], "ignored": None, "ocr_missed": [{"t": "late", "b": [15.0, 215.0, 70.0, 245.0], "p": 1}, {"t": "x", "b": [1.0], "p": 1}]})], "doc_id string, payload " + __import__("gridloom.operators.cells", fromlist=["PAYLOAD"]).PAYLOAD)
    more = reading.with_missed(pages, reading.read_pages(pages, seeing(("late",)), sweep=False), claim, seeing())
    assert [r["text"] for r in more.orderBy("id").collect()] == ["red", "5", "blue", "7", "late", "9"]
    assert [r["text"] for r in reading.reread(pages, reading.claimed(claim), seeing()).collect()] == ["late"]


def placing_model():
    """A model that puts six fragments into two columns but leaves out the second one."""

    def open_model():
        return answer

    def answer(row):
        i = row.get("images")
        assert i is not None and len(i) == 1 and json.loads(row["schema"])["required"] == ["columns", "cells"]
        cells = [{"r": k // 2, "c": k % 2, "f": [k]} for k in range(6) if k != 1]
        return json.dumps({"columns": [{"name": "a", "kind": "text"}, {"name": "b", "kind": "numeric"}], "cells": cells, "ignored": [1]})

    return open_model


def test_ink_in_blank_cells_is_flagged(spark):
    pages = spark.createDataFrame([("d", 1, picture(blotted()))], IMAGE)
    out = reconstruct(reading.read_pages(pages, seeing()), Plan(draw=placing_model(), rounds=0), pages).first()
    assert [f["message"][:24] for f in out["findings"] if f["family"] == "ink"] == ["ink in blank cell r=0 c=1"[:24]] and out["n_problems"] == 0


def test_job(spark, tmp_path):
    path = tmp_path / "page.png"
    path.write_bytes(pictures.png(blotted()))

    sees, places = seeing(), placing_model()

    def open_model():
        see, place = sees(), places()

        def ask(row):
            if row.get("image") is not None:
                return see(row)
            if "candidates" in (row.get("schema") or ""):
                return "none"
            return place(row)

        return ask

    said = []
    assert job.main([str(tmp_path / "none.png")]) == 2
    assert job.main([str(path), "--out", str(tmp_path / "out.html"), "--draw"], spark, open_model, said.append) == 0
    assert ">blue<" in (tmp_path / "out.html").read_text() and len(json.loads((tmp_path / "out.json").read_text())["cells"]) == 5
    assert (tmp_path / "out_boxes.png").read_bytes()[:4] == b"\x89PNG" and any("flags" in s for s in said)


def test_pictures_upright_turned_and_as_files(spark):
    a = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    data = pictures.png(a)
    size = struct.unpack(">II", data[16:24])
    raw = np.frombuffer(zlib.decompress(data[41:-16]), np.uint8).reshape(2, 10)
    assert size == (3, 2) and (raw[:, 1:].reshape(2, 3, 3) == a[:, :, ::-1]).all()
    back = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert back.count() == 1 and pictures.data_uri(a).startswith("data:image/png;base64,iVBOR")
    g = np.arange(12, dtype=np.uint8).reshape(3, 4, 1)
    want = {1: g, 2: g[:, ::-1], 3: g[::-1, ::-1], 4: g[::-1], 5: g.transpose(1, 0, 2), 6: np.rot90(g, -1), 7: g[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(g)}
    for tag, b in want.items():
        assert (pictures.upright(g, tag) == b).all()
        for order in "<>":
            tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}IHHHIH", 8, 1, 0x0112, 3, 1, tag) + b"\0\0"
            assert pictures.orientation(b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff) == tag
    assert pictures.orientation(b"\x89PNG") == pictures.orientation(b"") == 1
    t = pictures.turned(np.full((10, 20, 1), 9, np.uint8), 30)
    assert t.shape == (19, 23, 1) and 150 < (t == 9).sum() < 250 and (pictures.turned(g, -90) == np.rot90(g, -1)).all()


def test_served_client(monkeypatch):
    seen, waits, codes = [], [], [503]

    def opened(request, timeout):
        if codes:
            raise urllib.error.HTTPError("u", codes.pop(), "busy", {"Retry-After": "3"}, None)
        seen.append(json.loads(request.data))
        return io.BytesIO(b'{"choices": [{"message": {"content": "ok"}}]}')

    monkeypatch.setattr(urllib.request, "urlopen", opened)
    ask = client.served("m", "http://h/v1", post=lambda u, b, k: client.posted(u, b, k, wait=waits.append))()
    image = picture(np.zeros((4, 4, 1), np.uint8))
    assert ask({"prompt": "do", "image": image, "schema": schemas.cells(True), "temperature": 0.4, "seed": 2}) == "ok" and waits == [3.0]
    body = seen[0]
    assert body["seed"] == 2 and body["guided_json"]["required"] == ["columns", "cells"] and [c["type"] for c in body["messages"][0]["content"]] == ["image_url", "text"]
    codes.append(400)
    with pytest.raises(urllib.error.HTTPError):
        ask({"prompt": "do"})


def test_nested_answers(spark):
    t = "<table><tr><td>1</table>"
    raws = [json.dumps({"a": [{"b": "none"}, {"c": {"d": f"x {t} y"}}], "e": "<table>2</table>"}), f"plain {t}{t}", "[1, null]", None, '{"broken": "<TABLE>\n</Table>']
    got = models.first_table(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()
    assert [r["html"] for r in got] == [t, t, "", "", "<TABLE>\n</Table>"]


def test_scan_ends_at_an_empty_page():
    asked = []

    def page(url, params, headers):
        asked.append(params["offset"])
        return {"rows": [{"row": {"html": "x"}}] * max(0, min(params["length"], 250 - params["offset"]))}

    globals()["_page"] = page
    reader = paged.PagedReader({"rows": "20000", "until_empty": "true", "fetch": "tests.test_reading:_page"})
    import sys

    sys.modules["tests.test_reading"] = sys.modules[__name__]
    (all_,) = reader.partitions()
    assert len(list(reader.read(all_))) == 250 and asked == [0, 100, 200, 300]


def test_rewards_and_totals(spark):
    a = spark.createDataFrame([("<SOLUTION> 12 </SOLUTION>", "12"), ("12", "12"), ("<SOLUTION></SOLUTION>", "")], "a string, t string")
    assert [r[0] for r in a.select(metrics.correctness(F.col("a"), F.col("t"))).collect()] == [2.0, 0.0, 0.0]
    rows = [("Item", "$10"), ("Other", "5.5"), ("Sub-total", "15.50"), ("VAT 10 %", "1.55"), ("Grand total", "17.05")]
    cells = [(u, r, c, t if u == "u" or r != 4 or c == 0 else "18") for u in "uv" for r, p in enumerate(rows) for c, t in enumerate(p)]
    got = {r["uid"]: (r["items"], r["items_reconcile"], r["total_reconciles"]) for r in metrics.totals(spark.createDataFrame(cells, "uid string, row int, col int, text string")).collect()}
    assert got == {"u": (15.5, True, True), "v": (15.5, True, False)}


def test_bakeoff(spark):
    t = "<table><tr><td>a<td>b</table>"
    records = spark.createDataFrame([(f"u{i}", t, "easy", 0, "") for i in range(8)], "uid string, html string, difficulty string, n_spanning int, image_path string")
    good, bad = (lambda: lambda row: t), (lambda: lambda row: "no")
    out = bakeoff.run(records, records.select("uid", F.lit("p").alias("prompt")), {"anchor": good, "weak": bad, "absent": None})
    assert [r["run_name"] for r in bakeoff.ranked(out).collect()] == ["anchor", "weak"]
    assert {(r["run_name"], r["verdict"]) for r in bakeoff.against(out, "anchor").collect()} == {("weak", "regresses")}
    assert {(r["run_name"], r["n"]) for r in bakeoff.probe(out, records.limit(3)).where("difficulty is null").collect()} == {("anchor", 3), ("weak", 3)}


def test_manifest_is_built_once(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.createDataFrame([("a", "x.png", "<table>")], "uid string, image_path string, html string")

    path = str(tmp_path / "m")
    assert files.manifest_of(spark, path, build).count() == files.manifest_of(spark, path, build).count() == 1 and len(made) == 1


def test_votes_as_drafts_land(spark, tmp_path):
    cells = lambda t: json.dumps({"columns": [{"name": "a", "kind": "text"}], "cells": [{"r": 0, "c": 0, "t": t}]})
    land = lambda rows: spark.createDataFrame(rows, "doc_id string, draft int, raw string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run = lambda: scoring.voted(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), 2).awaitTermination(180)
    land([("d", 0, cells("x")), ("d", 0, cells("copy")), ("e", 0, cells("y"))])
    run()
    land([("d", 1, cells("x")), ("d", 1, cells("z"))])
    run()
    land([("e", 1, cells("y")), ("d", 2, cells("late"))])
    run()
    got = sorted((r["doc_id"], r["t"], r["votes"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("d", "x", 2), ("e", "y", 2)]
