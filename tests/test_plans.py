import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.operators import fragments
from gridloom.plans import models, prompts, report
from gridloom.plans.reconstruct import Plan, reconstruct
from gridloom.sources import files, paged, pictures
from gridloom.streaming import scoring


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry(spark):
    m = models.registry(spark)
    assert m.count() == 10 and models.for_data(m, "public").where("data = 'private'").count() == 0
    assert {r["name"] for r in models.trainable(m, "private").collect()} == {"qwen3.6-27b", "qwen3-vl-8b", "qwen3-vl-4b"}
    assert models.specialist(m, "public").count() == 4 and models.generative(m, "public").count() == 3
    with pytest.raises(ValueError):
        models.for_data(m, "secret")


def test_prompts(spark):
    assert "data-bbox" in prompts.instruction("full", boxes=True) and "1. " in prompts.instruction("schema")
    with pytest.raises(ValueError):
        prompts.instruction("other")
    r = spark.createDataFrame([("a", "grid"), ("b", None)], "uid string, layout string")
    out = {x["uid"]: x["prompt"] for x in prompts.prompts(r, "do", "layout").collect()}
    assert out["a"].endswith("grid") and out["b"] == "do"


FRAGMENTS = [("red", 0, 0), ("5", 100, 0), ("blue", 0, 20), ("7", 100, 20), ("green", 0, 40), ("9", 100, 40)]


def read_of(doc):
    items = [{"t": t, "b": [x, y, x + 10 * len(t), y + 10]} for t, x, y in FRAGMENTS]
    return (doc, 1, 0, 0, 0, json.dumps({"fragments": items}))


def scripted(first, second):
    """A model that answers a prompt with an earlier answer's problems differently from the first one."""

    def open_model():
        return lambda row: second if "problems" in row["prompt"] else first

    return open_model


def cells_json(drop=(), columns=2):
    cells = [{"r": i // 2, "c": i % 2, "f": [i]} for i in range(6) if i not in drop]
    return json.dumps({"columns": [{"name": f"c{i}", "kind": "text"} for i in range(columns)], "cells": cells})


def test_reconstruction_and_repair(spark):
    reads = spark.createDataFrame([read_of("d")], "doc_id string, page int, read int, tile_x int, tile_y int, raw string")
    frags = fragments.merged(fragments.parsed(reads).withColumn("ord", F.col("id")))
    assert frags.count() == 6
    good = reconstruct(frags, Plan(draw=scripted(cells_json(), cells_json()), drafts=3)).first()
    assert (good["n_problems"], good["repair_rounds"]) == (0, 0) and good["html"].count("<td") == 6 and good["table_confidence"] > 0.4
    mended = reconstruct(frags, Plan(draw=scripted(cells_json(drop=(5,)), cells_json()))).first()
    assert (mended["n_problems"], mended["repair_rounds"]) == (0, 1) and ">9<" in mended["html"]
    worse = reconstruct(frags, Plan(draw=scripted(cells_json(drop=(5,)), cells_json(drop=(1, 3, 5))))).first()
    assert (worse["n_problems"], worse["repair_rounds"]) == (1, 0)
    none = reconstruct(frags, Plan(draw=scripted("no", "no"))).first()
    assert (none["html"], none["table_confidence"]) == ("", 0.0)


def fake_page(url, params, headers):
    rows = [{"row": {"html_table": f"<table><tr><td>{params['offset'] + i}</table>", "image": {"src": f"u{i}"}}} for i in range(params["length"])]
    return {"rows": rows}


def test_paged_source(spark):
    reader = paged.PagedReader({"rows": "250", "fetch": "tests.test_plans:fake_page"})
    assert [(p.offset, p.length) for p in reader.partitions()] == [(0, 100), (100, 100), (200, 50)]


    waits, codes = [], [429, 503]

    def opened(request, timeout):
        import io
        import urllib.error

        if codes:
            raise urllib.error.HTTPError("u", codes.pop(0), "again", {}, None)
        return io.BytesIO(b'{"rows": []}')

    import urllib.request

    real, urllib.request.urlopen = urllib.request.urlopen, opened
    try:
        assert paged.fetch("http://x", {}, sleep=waits.append) == {"rows": []} and waits == [2.0, 4.0]
    finally:
        urllib.request.urlopen = real


def test_files_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("b", "x.png", "<table>"), ("a", "/y.png", "")], "uid string, image_path string, html string")
    files.write_manifest(m, str(tmp_path / "m"), single=True)
    back = files.read_manifest(spark, str(tmp_path / "m")).orderBy("uid").collect()
    assert [r["image_path"] for r in back] == ["/y.png", f"{tmp_path}/m/x.png"]
    with pytest.raises(Exception):
        files.read_manifest(spark, str(tmp_path / "none")).count()
    labels = spark.createDataFrame([("a", "<table>1"), ("b", "no")], "uid string, html string")
    files.append_labels(labels, str(tmp_path / "l"), tables_only=True)
    files.append_labels(labels, str(tmp_path / "l"), known=spark.read.json(str(tmp_path / "l")))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    got = files.downloaded(spark.createDataFrame([("ok",), ("bad",)], "image_url string"), get=lambda u: b"1" if u == "ok" else (_ for _ in ()).throw(OSError()))
    assert {r["image_url"]: r["ok"] for r in got.collect()} == {"ok": True, "bad": False}


def test_pictures():
    import numpy as np

    a = np.arange(24, dtype=np.uint8).reshape(4, 6, 1)
    assert pictures.turned(a, 90).shape == (6, 4, 1) and pictures.shrunk(a, 3).shape == (2, 3, 1) and pictures.shrunk(a, None) is a
    framed = pictures.outlined(np.zeros((20, 20, 3), np.uint8), [(2, 2, 50, 10, (1, 2, 3))])
    assert tuple(framed[2, 2]) == (1, 2, 3) and not framed[5, 6].any()


def test_report(spark):
    c = spark.createDataFrame([("u", 0.5, "easy", '<table><tr><td colspan="2">a</td></tr></table>', "t")], "uid string, score double, difficulty string, pred_html string, true_html string")
    page = report.page(c, "a <run>")
    assert 'class="span"' in page and "a &lt;run&gt;" in page and report.grade(0.95) == "good"


def test_streaming(spark, tmp_path):
    t = "<table><tr><td>a<td>b</table>"
    landed = spark.createDataFrame([("u", f"```{t}```", "2024-01-01 00:00:00"), ("u", "late copy", "2024-01-01 00:01:00"), ("v", "none", "2024-01-01 01:30:00")], "uid string, raw string, at string")
    landed.write.json(str(tmp_path / "in"))
    records = spark.createDataFrame([("u", t), ("v", t)], "uid string, html string")
    q = scoring.run(scoring.scored(scoring.predictions(spark, str(tmp_path / "in")), records), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["uid"] for r in out) == ["u", "v"] and {r["teds_struct"] for r in out if r["uid"] == "v"} == {0.0}
