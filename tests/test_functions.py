import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import html as H
from gridloom.functions import teds
from gridloom.functions.boxes import axis_box, box_from_text, column_index
from gridloom.functions.kinds import accepts, induced, kind_of, number
from gridloom.functions.text import clean_prediction, html_from_tokens, outer_json, table_in, without_thinking


def one(spark, expression, *values, schema="v string"):
    rows = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in rows.select(expression).collect()]


def test_kinds(spark):
    want = {"12": "numeric", "-3.5": "numeric", "1,204": "amount", "$7": "amount", "(40)": "amount", "12.5%": "percent", "2021-03-04": "date", "3 Mar 2020": "date", "x": "symbol", "Dr": "symbol", "Nil": "text", "12 units": "text", "": "other", " ": "other"}
    assert one(spark, kind_of(F.col("v")), *want) == list(want.values())
    assert one(spark, kind_of(F.col("v")), None) == ["other"]


def test_number(spark):
    assert one(spark, number(F.col("v")), "1,204.50", "$9", "(30)", "15%", "none", "", "1d", None) == [1204.5, 9.0, -30.0, 15.0, None, None, None, None]


def test_accepts(spark):
    rows = spark.createDataFrame([("numeric", "5%", True), ("numeric", "ab", False), ("symbol", "12", False), ("date", "2020", True), ("text", "9", True), ("amount", "", True)], "k string, v string, ok boolean")
    assert rows.where(accepts(F.col("k"), F.col("v")) != F.col("ok")).count() == 0


def test_induced_takes_first_seen_on_a_tie(spark):
    rows = spark.createDataFrame([("a", 1, "xyz"), ("a", 2, "7"), ("b", 1, ""), ("b", 2, " ")], "g string, o int, v string")
    assert dict(induced(rows, ["g"], "v", "o").collect()) == {"a": "text", "b": "other"}


def test_html_occupancy_and_recovery():
    html = "<table><thead><tr><th rowspan=2>A<th colspan=2>B</tr><tr><th>x<th>y</thead><tr><td>1<td>2<td>3"
    assert [c[:4] for c in H.cells_of(html)] == [(0, 0, 2, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 2, 1, 1), (2, 0, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1)]
    assert H.header_depth(html) == 2
    assert H.cells_of("<tr><td>a</td><td rowspan=x>b") == [(0, 0, 1, 1, "td", "a", None), (0, 1, 1, 1, "td", "b", None)]
    assert H.cells_of("no table") == [] and H.cells_of(None) == [] and H.structure_of("") == ""
    assert H.cells_of('<table><td data-bbox="9;2,3,8">k</td></table>') == []  # a cell needs a row
    assert H.cells_of('<table><tr><td data-bbox="9;2,3,8.5">k</td></tr></table>')[0][6] == (3, 2, 9, 8)


def test_html_cells_and_udtf(spark):
    t = spark.createDataFrame([("u", "<table><tr><td>a<td>b</table>"), ("e", "")], "uid string, html string")
    assert [tuple(r) for r in H.cells(t).select("uid", "row", "col", "text").orderBy("col").collect()] == [("u", 0, 0, "a"), ("u", 0, 1, "b")]
    H.register(spark)
    t.createOrReplaceTempView("t_html")
    assert spark.sql("SELECT c.text FROM t_html, LATERAL html_cells(html) c ORDER BY c.col").toPandas()["text"].tolist() == ["a", "b"]


def brute_distance(a, b):
    """Edit distance of forests, straight from its definition."""
    from functools import lru_cache

    def size(f):
        return sum(1 + size(t[1]) for t in f)

    @lru_cache(None)
    def d(f, g):
        if not f or not g:
            return size(f) + size(g)
        (x, fx), (y, gy) = f[-1], g[-1]
        return min(d(f[:-1] + fx, g) + 1, d(f, g[:-1] + gy) + 1, d(f[:-1], g[:-1]) + d(fx, gy) + (x != y))

    return d(a, b)


def test_teds_against_the_definition():
    rng = random.Random(3)

    def table():
        rows = []
        for _ in range(rng.randint(1, 3)):
            cells = [(rng.choice(["td", "th"]), rng.choice([1, 1, 2])) for _ in range(rng.randint(0, 3))]
            rows.append(cells)
        html = "<table>" + "".join("<tr>" + "".join(f'<{t} colspan="{c}">v</{t}>' for t, c in r) + "</tr>" for r in rows) + "</table>"
        tree = (("table", tuple((("tr",), tuple(((t, c), ()) for t, c in r)) for r in rows)),)
        return html, tuple(((n if isinstance(n, tuple) else (n,)), k) for n, k in tree)

    for _ in range(40):
        (ha, ta), (hb, tb) = table(), table()
        x, y = (teds.Shapes(teds.table_of(h).root, True) for h in (ha, hb))
        assert teds.tree_distance(x, y) == brute_distance(ta, tb)
    assert teds.score(ha, ha) == 1.0 and teds.score(None, ha) == 0.0
    with pytest.raises(ValueError):
        teds.score(ha, "no table")
    assert teds.levenshtein("kitten", "sitting") == 3 and teds.batch([ha], ["none"]) == [0.0]


def test_teds_of_texts_and_of_a_large_table():
    a, b = ("<table>" + "".join(f"<tr><td>{x}<td>{y}</tr>" for x, y in rows) + "</table>" for rows in ([("ab", "c"), ("d", "")], [("abc", "c"), ("d", "e")]))
    assert teds.score(a, b, structure_only=False) == pytest.approx(1 - (1 / 3 + 1) / 7)
    row = "<tr>" + "<td>v" * 10 + "</tr>"
    large, other = f"<table>{row * 400}</table>", f"<table>{row * 200}<tr><th>v</tr>{row * 199}</table>"
    assert teds.score(other, large) == pytest.approx(1 - 10 / 4401)


def test_long_spans_cost_nothing():
    html = "<table><tr><td rowspan=1000000000 colspan=1000000000>a<td>b</tr><tr><td>c</tr></table>"
    assert [c[:4] for c in H.cells_of(html)] == [(0, 0, 10**9, 10**9), (0, 10**9, 1, 1), (1, 10**9, 1, 1)]


def test_cells_against_a_set_of_positions():
    rng = random.Random(11)
    for _ in range(200):
        rows = [[(rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={a} colspan={b}>x" for a, b in r) + "</tr>" for r in rows) + "</table>"
        taken, want = set(), []
        for y, r in enumerate(rows):
            x = 0
            for down, right in r:
                x = next(k for k in range(x, 99) if (y, k) not in taken)
                taken |= {(y + i, x + j) for i in range(down) for j in range(right)}
                want.append((y, x, down, right))
        assert [c[:4] for c in H.cells_of(html)] == want


def test_cleaning(spark):
    t = "<table><tr><td>1</td></tr></table>"
    raws = [t, f"```html\n{t}\n```", f"see {t} end", "none", "", "<TABLE><tr>", f"```\nno\n```\n```\n{t}\n```", None]
    assert one(spark, clean_prediction(F.col("v")), *raws) == [t, t, t, "", "", "<TABLE><tr>", t, ""]
    assert one(spark, without_thinking(F.col("v")), "<think>a\nb</think> x ", "y") == ["x", "y"]
    assert one(spark, outer_json(F.col("v"), "cells"), 'a {"cells": []} b', '```json\n{"cells": [1]}\n```', "none") == ['{"cells": []}', '{"cells": [1]}', None]
    assert one(spark, table_in(F.col("v")), f"a{t}b{t}", None) == [t, ""]


def test_tokens_and_boxes(spark):
    rows = spark.createDataFrame([(["<tr>", "<td", ' colspan="2"', ">", "</td>", "<td>", "</td>", "</tr>"],)], "t array<string>")
    assert rows.select(html_from_tokens(F.col("t"), F.array(F.lit("a"), F.lit("b")))).first()[0] == '<table><tr><td colspan="2">a</td><td></td></tr></table>'
    assert one(spark, box_from_text(F.col("v")), "9,2,3,8", "1;2;3;4.5", "1,2,3", "a,b,c,d", None)[0].asDict() == {"x1": 3, "y1": 2, "x2": 9, "y2": 8}
    assert spark.range(1).select(axis_box(F.array(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(4.0), F.lit(2.0))))).first()[0].asDict() == {"x": 1.0, "y": 2.0, "w": 3.0, "h": 3.0}
    assert spark.range(1).select(column_index(F.lit(15.0), F.array(F.lit(10.0), F.lit(20.0))), column_index(F.lit(1.0), F.lit(None).cast("array<double>"))).first()[:] == (1, 0)
