import random

from pyspark.sql import functions as F

from gridloom.operators import cells as C
from gridloom.operators import corpus, fragments, layout, metrics, schema, structure, verify

WORDS = "doc_id string, page int, ord int, text string, x double, y double, w double, h double"


def words(spark, rows, doc="d"):
    return spark.createDataFrame([(doc, 1, i, t, float(x), float(y), float(w), 10.0) for i, (t, x, y, w) in enumerate(rows)], WORDS)


PAGE = [("Item", 0, 0, 30), ("Price", 100, 1, 30), ("red", 0, 20, 20), ("box", 25, 21, 20), ("5", 110, 20, 10), ("blue", 0, 40, 30), ("Total", 0, 60, 30), ("7", 110, 61, 10)]


def test_rows_and_grid(spark):
    w = words(spark, PAGE)
    grid = layout.grid_rows(layout.grid(w)).orderBy("row").toPandas()["cells"].tolist()
    assert [list(r) for r in grid] == [["Item", "Price"], ["red box", "5"], ["blue", ""], ["Total", "7"]]
    assert layout.grid_text(layout.grid(w)).first()["text"].split("\n")[1] == "red box | 5"
    assert layout.grid_html(layout.grid(words(spark, [("a<b", 0, 0, 9)]))).first()["html"] == "<table><tr><td>a&lt;b</td></tr></table>"
    assert layout.grid(words(spark, [])).count() == 0


def test_rows_fold_against_a_loop(spark):
    rng = random.Random(5)
    data = [(f"w{i}", rng.uniform(0, 500), rng.uniform(0, 120), 10) for i in range(150)]
    got = {r["ord"]: r["row"] for r in layout.with_rows_of(words(spark, data)).collect()}
    rows, total, n, row = {}, 0.0, 0, -1
    for i in sorted(range(len(data)), key=lambda i: (data[i][2] + 5, i)):
        cy = data[i][2] + 5
        if n and abs(cy - total / n) <= 6:
            total, n = total + cy, n + 1
        else:
            total, n, row = cy, 1, row + 1
        rows[i] = row
    assert got == rows


def test_survey(spark):
    s = layout.survey(words(spark, PAGE))
    assert [r["kind"] for r in s["rows"].orderBy("row").collect()] == ["header", "data", "section", "summary"]
    assert {r["col"]: r["kind"] for r in s["tracks"].collect()} == {0: "text", 1: "numeric"}
    assert s["pitch"].first()["pitch"] > 15


def test_merge_is_by_first_fragment(spark):
    rows = [("d", 1, 0, "abc", 0.0, 0.0, 30.0, 10.0), ("d", 1, 1, "abc", 1.0, 0.0, 30.0, 10.0), ("d", 1, 2, "abd", 2.0, 0.0, 30.0, 10.0), ("d", 1, 3, "far", 200.0, 0.0, 30.0, 10.0)]
    m = fragments.merged(spark.createDataFrame(rows, WORDS)).orderBy("id").collect()
    assert [(r["id"], r["text"], round(r["conf"], 3), r["alternates"], r["contested"]) for r in m] == [(0, "abc", 0.667, ["abd"], True), (1, "far", 1.0, [], False)]


def test_tiles_and_parse(spark):
    pages = spark.createDataFrame([("a", 500, 400), ("b", 1500, 500), ("c", 0, 5)], "doc_id string, width int, height int")
    t = {(r["doc_id"], r["x1"], r["x2"]) for r in fragments.tiles(pages).collect()}
    assert t == {("a", 0, 500), ("b", 0, 1024), ("b", 476, 1500)}
    raw = '<think>no</think>```json\n{"fragments": [{"t": " a  b ", "b": [1, 2, 5, 6]}, {"t": "", "b": [1, 2, 3, 4]}, {"t": "c", "b": [5, 5, 5, 9]}]}\n```'
    reads = spark.createDataFrame([("d", 1, 0, 10, 20, raw), ("d", 1, 1, 0, 0, "junk")], "doc_id string, page int, read int, tile_x int, tile_y int, raw string")
    assert [tuple(r)[4:] for r in fragments.parsed(reads).collect()] == [("a b", 11.0, 22.0, 4.0, 4.0)]


def test_unread_ink():
    import numpy as np

    page = np.full((96, 96), 255, np.uint8)
    page[40:60, 40:60] = 0
    page[0:10, 0:10] = 0
    assert fragments.patch_boxes(page, np.array([[0.0, 0.0, 12.0, 12.0]])) == [(32, 32, 64, 64)]


def payload(spark, cells, columns=3, doc="d", **more):
    cell = [dict({"r": 0, "c": 0, "rs": 1, "cs": 1, "h": False, "t": "v", "b": [0.0, 0.0, 1.0, 1.0], "p": 1, "f": None}, **c) for c in cells]
    row = {"columns": [{"name": f"c{i}", "kind": "text"} for i in range(columns)], "cells": cell, "ignored": None, "ocr_missed": None, **more}
    return spark.createDataFrame([(doc, row)], f"doc_id string, payload {C.PAYLOAD}")


def test_validate(spark):
    p = payload(spark, [{"cs": 2}, {"c": 1}, {"r": 1, "c": 2, "cs": 2}, {"r": 2, "t": " "}, {"r": 3, "b": [5.0, 1.0, 2.0, 3.0]}, {"r": 4, "p": 9}, {"r": -1}, {"r": None}])
    found = sorted((r["r"] is not None and r["r"], r["message"].split(": ")[1][:12]) for r in C.validate(p).collect())
    assert found == sorted([(0, "position (0,"), (1, "reaches past"), (2, "no text; bla"), (3, "the box has "), (4, "the page is "), (-1, "a negative p"), (False, "position and")])
    assert C.validate(payload(spark, [{}, {"c": 1}])).count() == 0
    empty = spark.createDataFrame([("d", None)], f"doc_id string, payload {C.PAYLOAD}")
    assert C.validate(empty).count() == 1


def test_identity_and_fill(spark):
    frags = spark.createDataFrame([("d", i, t, float(x), 0.0, 5.0, 5.0, 1) for i, (t, x) in enumerate([("a", 0), ("b", 10), ("c", 20), ("e", 30)])], "doc_id string, id int, text string, x double, y double, w double, h double, page int")
    p = payload(spark, [{"f": [1, 0], "t": None}, {"c": 1, "f": [0, 9], "t": None}, {"c": 2, "t": None}], ignored=[3, 8, 1])
    kinds = sorted(r["message"].rsplit(" ", 1)[-1] for r in C.identity(p, frags).collect())
    assert kinds == sorted(["fragment", "(invented)", "(duplicated)", "8", "ignored", "(dropped)"])
    filled = C.filled(C.cells(p), frags).orderBy("ord").collect()
    assert (filled[0]["t"], filled[0]["b"], filled[0]["p"]) == ("a b", [0.0, 0.0, 15.0, 5.0], 1) and filled[2]["t"] is None


def test_vote(spark):
    draft = lambda i, cells: payload(spark, cells).select("doc_id", F.lit(i).alias("draft"), "payload")
    d = draft(0, [{"t": "A"}, {"c": 1, "t": "x"}]).union(draft(1, [{"t": "a"}, {"c": 1, "t": "y"}])).union(draft(2, [{"t": "b"}, {"c": 2, "t": "z"}]))
    got = {(r["r"], r["c"]): (r["t"], round(r["confidence"], 3)) for r in C.vote(d)[0].collect()}
    assert got == {(0, 0): ("A", 0.667), (0, 1): ("x", 0.333)}
    one = {(r["r"], r["c"]): r["confidence"] for r in C.vote(draft(0, [{}, {"c": 1}]))[0].collect()}
    assert one == {(0, 0): 1.0, (0, 1): 1.0}


def test_html_of_cells(spark):
    p = payload(spark, [{"h": True, "cs": 2, "b": None, "t": "a & b"}, {"r": 1, "c": 1, "b": [0.5, 1.5, 2.0, 3.0]}, {"r": 0, "c": 1, "t": "lost"}], columns=2)
    assert C.html(p).first()["html"] == '<table><tr><th colspan="2">a &amp; b</th></tr><tr><td></td><td data-bbox="0,2,2,3">v</td></tr></table>'


def test_checks(spark):
    col = lambda c, vs: [{"r": i, "c": c, "t": v, "b": [c * 50.0, i * 10.0, c * 50.0 + 20, i * 10.0 + 8]} for i, v in enumerate(vs)]
    p = payload(spark, col(0, ["10", "20", "30", "58"]) + col(1, ["a", "b", "77", "c"]), columns=3)
    standing = C.occupancy(C.cells(p))
    assert [r["c"] for r in verify.arithmetic(standing).collect()] == [0]
    assert [(r["r"], r["c"]) for r in verify.types(standing).collect()] == [(2, 1)]
    assert [r["c"] for r in verify.schema_echo(p, standing).collect()] == [2]
    assert verify.geometry(standing).count() == 0
    moved = payload(spark, col(0, ["1", "2", "3"]) + col(1, ["4", "5"]) + [{"r": 2, "c": 1, "t": "6", "b": [0.0, 20.0, 20.0, 28.0]}], columns=2)
    assert [(r["r"], r["c"]) for r in verify.geometry(C.occupancy(C.cells(moved))).collect()] == [(2, 1)]
    assert {r["family"] for r in verify.verify(p).collect()} == {"arithmetic", "type", "schema"}


def test_schema_choice(spark):
    s = layout.survey(words(spark, PAGE))
    raw = '{"candidates": [{"columns": [{"name": "Item", "kind": "text"}, {"name": "Price", "kind": "numeric", "parent": "Cost", "printed": false}]}, {"columns": [{"name": "one", "kind": "text"}]}, {"columns": []}]}'
    proposed = schema.candidates(spark.createDataFrame([("d", raw)], "doc_id string, raw string"))
    assert proposed.count() == 2
    ranked = schema.discover(s["tracks"], s["rows"], proposed).orderBy("rank").collect()
    assert ranked[0]["cand"] == 0 and ranked[0]["total"] == 0 and ranked[-1]["column_count_delta"] == -1
    hint = schema.hint(proposed.where("cand = 0")).first()["hint"]
    assert hint.endswith("  Item [text]\n  Cost -> Price [numeric] (implicit)")
    assert "track 0" in schema.dossier(s["tracks"], s["rows"]).first()["dossier"]


def cell_rows(spark, rows, uid="u"):
    return spark.createDataFrame([(uid, r, c, rs, cs, t) for r, c, rs, cs, t in rows], "uid string, row int, col int, rowspan int, colspan int, text string")


def test_metrics(spark):
    true = cell_rows(spark, [(0, 0, 1, 2, "A"), (1, 0, 1, 1, "x"), (1, 1, 1, 1, "")])
    pred = cell_rows(spark, [(0, 0, 1, 1, "a"), (0, 1, 2, 1, "q"), (1, 0, 1, 1, "y")])
    p = metrics.placement(pred, true).first()
    assert (p["placed"], p["texts"], p["kept"], p["blanks"]) == (1, 2, 1, 1)
    s = metrics.spans(pred, true).first()
    assert (s["matched"], s["total"], s["spurious"], s["span_f1"]) == (0, 1, 1, 0.0)
    m = metrics.schema_match(pred, true).first()
    assert m["exact"] and metrics.adjacency_f1(true, true).first()["adjacency_f1"] == 1.0
    assert metrics.bootstrap([]) == (0.0, 0.0, 0.0) and metrics.bootstrap([0.5]) == (0.5, 0.5, 0.5)
    low, high = metrics.bootstrap([0.0, 1.0] * 20)[1:]
    assert low < 0.5 < high


def test_evaluate_and_compare(spark):
    t = "<table><tr><td>a<td>b</tr></table>"
    records = spark.createDataFrame([(f"u{i}", t, "easy" if i % 2 else "hard", 0, "") for i in range(6)], "uid string, html string, difficulty string, n_spanning int, image_path string")
    good = metrics.evaluate(records, records.select("uid", "html")).withColumn("run_name", F.lit("a"))
    assert good.agg(F.min("teds_struct")).first()[0] == 1.0
    bad = metrics.evaluate(records, records.where("uid = 'u0'").select("uid", "html")).withColumn("run_name", F.lit("a"))
    assert bad.where("parse_failed").count() == 5
    c = metrics.compare(metrics.summarised(good), metrics.summarised(bad))
    assert {r["difficulty"]: r["verdict"] for r in c.collect()}["easy"] == "regresses"
    assert "all" in metrics.compare_text(c)
    assert metrics.cases(bad, 2).count() == 2


def test_corpus(spark):
    span = "<table><tr><td colspan=2>a</tr><tr><td>b<td>{}</tr></table>"
    rows = [(0, span.format("x"), "i"), (1, span.format(" x"), "i"), (2, "", "i"), (3, "<table><tr><td>q</table>", "i"), (4, span.format("z"), None), (5, span.format("z"), "i"), (6, span.format("w"), "i")]
    tables = spark.createDataFrame(rows, "ord long, html string, image_url string")
    chosen, scores = corpus.select_hard(tables, 5)
    assert sorted(r["ord"] for r in chosen.collect()) == [0, 1, 6]
    assert scores.where("bin = 'empty'").count() == 1
    s = spark.createDataFrame([(i, i / 10, "easy") for i in range(10)], "ord int, score double, bin string")
    assert {r["bin"]: r["count"] for r in corpus.percentile_bins(s).groupBy("bin").count().collect()} == {"easy": 4, "medium": 3, "hard": 3}
    assert corpus.summary(s).first()["p50"] == 0.5
    a = spark.createDataFrame([(" x ",), ("y",)], "html string")
    assert corpus.leaks(a, spark.createDataFrame([("x",)], "html string")).count() == 1
    assert corpus.latest_checkpoint(spark.createDataFrame([("c-2",), ("c-10",), ("x",)], "name string")).first()[0] == "c-10"


def test_structure_tokens_round_trip(spark):
    cells = spark.createDataFrame([("u", 0, 0, 0, 2, 1), ("u", 1, 0, 1, 1, 2), ("u", 2, 1, 1, 1, 1), ("u", 3, 1, 2, 1, 1)], "uid string, ord int, row int, col int, rowspan int, colspan int")
    t = structure.grid_tokens(cells)
    assert t.first()["tokens"] == "C C L NL U C C NL"
    got = {tuple(r)[1:] for r in structure.cells_of_tokens(t).collect()}
    assert got == {(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1)}
    assert spark.range(1).select(structure.route(F.lit(0.95)), structure.route(F.lit(0.85), F.lit(0.2)), structure.route(F.lit(0.1))).first()[:] == ("accept", "accept", "fallback")
