"""Plans that deal rows out as often as the work needs, whatever the tables' size."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from gridloom.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """Exchanges by hash in a plan, equal ones once."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len({re.sub(r"#\d+L?", "", m) for m in re.findall(r"Exchange (hashpartitioning\(.*?), (?:ENSURE|REPARTITION)", plan)})


def test_lines_equal_their_sql_and_stay_together(spark):
    line = X.lines(spark, SF)
    sql = spark.sql(X.LINES, lineitem=X.table(spark, SF, "lineitem"), part=X.table(spark, SF, "part"))
    assert line.dtypes == sql.dtypes
    assert line.exceptAll(sql).count() == sql.exceptAll(line).count() == 0
    assert exchanges(X.words(X.cells(spark, SF)).groupBy("doc_id", "ord").agg(F.max("text"))) == 1


def test_names_are_not_dealt_out_with_the_lines(spark, tmp_path):
    plan = X.lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") < plan.index("Window")
    line = X.table(spark, SF, "lineitem").where("l_orderkey < 300")
    line.withColumn("l_partkey", F.when(F.col("l_linenumber") % 5 > 0, F.col("l_partkey"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    part = X.table(spark, SF, "part").where("p_partkey % 3 > 0")
    for more in (part.limit(0), part.limit(20), part.limit(1).withColumn("p_partkey", F.lit(None).cast("bigint"))):
        part.unionByName(more).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
        got = X.lines(spark, str(tmp_path))
        sql = spark.sql(X.LINES, lineitem=X.table(spark, tmp_path, "lineitem"), part=X.table(spark, tmp_path, "part"))
        assert got.dtypes == sql.dtypes and got.count() == sql.count() > 0
        assert got.drop("row").exceptAll(sql.drop("row")).count() == 0
        assert got.groupBy("uid", "row").count().exceptAll(sql.groupBy("uid", "row").count()).count() == 0


@pytest.mark.parametrize("name", ["order_ensemble", "adjacency_f1", "vote_cells", "audit"])
def test_queries_that_need_the_lines_exchange_only(spark, name):
    assert exchanges(queries()[name](spark, SF)) == 1


def test_adjacency_counts_every_pair_of_shared_places(spark):
    from gridloom.operators import metrics

    cell = "uid string, row int, col int, rowspan int, colspan int, text string"
    rows = [("t", 0, 0, 1, 2, "A"), ("t", 0, 0, 1, 2, "a"), ("t", 0, 2, 1, 1, "b"), ("t", 0, 2, 1, 1, "c"), ("t", 1, 0, 1, 1, " "), ("t", 2, 2, 1, 1, "d"), ("u", 0, 2, 1, 1, "x")]
    true = spark.createDataFrame(rows, cell)
    got = sorted(tuple(r) for r in metrics.adjacency(true).collect())
    assert got == [("t", "a", "b", "right")] * 2 + [("t", "a", "c", "right")] * 2
    pred = spark.createDataFrame([rows[0], rows[2], ("t", 1, 2, 1, 1, "z"), ("v", 0, 0, 1, 1, "y")], cell)
    assert {r["uid"]: r["adjacency_f1"] for r in metrics.adjacency_f1(pred, true).collect()} == {"t": 2 * 1 / (4 + 2)}


def test_blank_pages_are_dealt_out_by_the_bytes_of_their_pictures(spark, monkeypatch):
    from gridloom.plans import reading
    from gridloom.plans.source_queries import HEIGHT, WIDTH, _pages

    monkeypatch.setattr(reading, "TASK", 20 * HEIGHT * WIDTH)
    pages = _pages(spark, SF).select("doc_id", "page", "image").where("doc_id <= 100")
    assert reading.dealt(pages).rdd.getNumPartitions() == pages.count() // 20 + 1
    assert reading.dealt(pages.limit(0)).count() == 0
    assert reading.dealt(pages).exceptAll(pages).count() == pages.exceptAll(reading.dealt(pages)).count() == 0


def test_audit_holds_each_cell_against_each_fragment_of_its_id(spark):
    from gridloom.operators import design

    cells = spark.createDataFrame([("d", 0, 0, 0, [0.0, 0.0, 9.0, 9.0], [1, 2, 7, None]), ("d", 1, 1, 0, [0.0, 0.0, 2.0, 2.0], [1]), ("d", 2, 2, 0, [0.0], [1]), (None, 3, 3, 0, [0.0, 0.0, 1.0, 1.0], [1])], "doc_id string, ord int, r int, c int, b array<double>, f array<int>")
    read = spark.createDataFrame([("d", 1, "one", 0.0, 0.0, 8.0, 8.0), ("d", 2, "two", 5.0, 5.0, 9.0, 1.0), ("d", 2, "to", 5.0, 5.0, 1.0, 9.0), ("d", 3, "three", 0.0, 0.0, 90.0, 1.0)], "doc_id string, id long, text string, x double, y double, w double, h double")
    got = sorted((r["r"], r["message"].partition("fragment ")[2]) for r in design.audit(cells, read).collect())
    assert got == [(0, "2 'to'"), (0, "2 'two'"), (1, "1 'one'")]


def test_skew_is_a_fold_over_the_page_and_equals_trying_all_angles(spark):
    import math
    import random
    from collections import Counter, defaultdict
    from statistics import median

    from gridloom.operators import structure

    assert "Generate explode([-3" not in queries()["skew"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    draw = random.Random(5)
    rows = [(d, p, *(None if draw.random() < 0.05 else round(draw.uniform(0, m), 1) for m in (300, 200, 60)), draw.choice([None, 0.0, 9.0, 12.0, 14.0])) for d in range(20) for p in (1, 2) for _ in range(draw.choice([1, 2, 12]))]
    rows += [(99, 1, 1.0, 1.0, 2.0, None), (None, 1, 1.0, 1.0, 2.0, 3.0)]
    got = {(r["doc_id"], r["page"]): r["degrees"] for r in structure.best_skew(spark.createDataFrame(rows, "doc_id int, page int, x double, y double, w double, h double")).collect()}
    pages = defaultdict(list)
    for d, p, *box in rows:
        pages[d, p].append(box)
    want = {}
    for key, boxes in pages.items():
        tall = [b[3] for b in boxes if b[3] is not None]
        m, tried = max(median(tall) if tall else 0, 1e-9), []
        for a in (-3.0 + 6.0 * i / 60 for i in range(61)):
            cos, sin = math.cos(math.radians(a)), math.sin(math.radians(a))
            n = Counter(None if None in b else math.floor(((b[0] + b[2] / 2) * cos + (b[1] + b[3] / 2) * sin) / m) for b in boxes)
            tried.append((sum(v * v for v in n.values()), -round(abs(a), 9), a))
        want[key] = max(tried)[2]
    del want[None, 1]
    assert got == want


def test_equal_structures_are_compared_once_and_unlike_ones_never_mixed_up(monkeypatch):
    from gridloom.functions import teds

    seen, plain = [], teds.tree_distance
    monkeypatch.setattr(teds, "_known", {})
    monkeypatch.setattr(teds, "tree_distance", lambda x, y: seen.append(1) or plain(x, y))
    one = "<table><tr><td>{}</td><td>{}</td></tr></table>"
    assert len({teds.score(one.format(i, i), one.format("a", i)) for i in range(5)}) == 1 and len(seen) == 1
    # Equal tags in postorder, unlike trees.
    assert teds.score("<table><tr><td>a</td></tr><tr></tr></table>", "<table><tr><td>a</td></tr><tr></tr></table>") == 1.0
    assert teds.score("<table><tr></tr><tr><td>a</td></tr></table>", "<table><tr><td>a</td></tr><tr></tr></table>") < 1.0
    assert teds.score("<table><thead><tr></tr></thead></table>", "<table><tr></tr><thead></thead></table>") < 1.0
    assert teds.score(one.format("x", "y"), one.format("x", "z"), structure_only=False) < 1.0


def test_layout_text_is_one_fold_over_the_page_and_equals_the_grid(spark):
    import random

    from gridloom.operators import layout

    assert exchanges(queries()["layout_text"](spark, SF)) == 1
    draw = random.Random(3)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -1.0]
    some = lambda m: draw.choice(odd) if draw.random() < 0.1 else round(draw.uniform(0, m), 1)
    rows = [(d, p, o, draw.choice(["a", "bb", " ", "c d", None, ""]), some(200), some(60), some(30), some(12)) for d in range(60) for p in (1, 2) for o in range(draw.choice([1, 2, 5, 30]))]
    words = spark.createDataFrame(rows, "doc_id int, page int, ord int, text string, x double, y double, w double, h double")
    at = layout.with_columns_of(layout.with_rows_of(words))
    assert {repr(r) for r in layout.placed(words).select(at.columns).collect()} == {repr(r) for r in at.collect()}
    assert sorted(map(repr, layout.layout_text(words).collect())) == sorted(map(repr, layout.grid_text(layout.grid_of(at)).collect()))


def _strewn(spark):
    """Words on a coarse raster, so that many share a cell, some of them with odd places; some texts of every kind."""
    import random

    draw = random.Random(4)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -1.0]
    texts = ["a", "bb", " ", "c d", None, "", "12", "1,234", "(5)", "$ 4", "3%", "2020-01-02", "12 Jan 2020", "Total", "TOTAL ", "\t", "1.", "ab3", "name", "日本"]
    some = lambda m, low=0.0: draw.choice(odd) if draw.random() < 0.03 else low + float(draw.randrange(0, m, 20))
    rows = [(d, p, o, draw.choice(texts), some(200), some(160), some(20, 9.0), some(20, 12.0)) for d in range(60) for p in (1, 2) for o in range(draw.choice([1, 2, 6, 40]))]
    return spark.createDataFrame(rows, "doc_id int, page int, ord int, text string, x double, y double, w double, h double")


def test_a_page_is_surveyed_in_one_fold_that_equals_the_operators(spark):
    from gridloom.operators import layout

    assert exchanges(queries()["page_survey"](spark, SF)) == 1
    words = _strewn(spark)
    found, at = layout.survey(words), layout.placed(words)
    first = layout.tracks(at)
    anchor = layout.anchors(first)
    rows = layout.row_kinds(layout.grid_rows(layout.grid_of(at)), anchor, first)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(found["anchors"], anchor)
    assert same(found["rows"].drop("cy"), rows)
    assert same(layout.tracked(words).select("doc_id", "page", F.inline("tracks")), first)
    body = at.join(rows.where("kind not in ('header', 'empty')").select("doc_id", "page", "row"), ["doc_id", "page", "row"])
    again = {tuple(r)[:3]: tuple(r)[5:7] for r in layout.tracks(body).collect()}
    old = {tuple(r)[:3]: tuple(r)[5:7] for r in first.collect()}
    assert {tuple(r)[:3]: tuple(r)[5:7] for r in found["tracks"].collect()} == old | again


def test_survey_tracks_needs_the_lines_exchange_only(spark):
    tracks = queries()["survey_tracks"](spark, SF)
    assert exchanges(tracks) == 1
    assert "array<struct<row:" not in tracks._jdf.queryExecution().executedPlan().treeString() and "anchors" not in tracks._jdf.queryExecution().executedPlan().toString()


def test_dossier_and_hint_of_listed_pages_equal_those_of_rows(spark):
    from gridloom.operators import layout, schema

    assert exchanges(queries()["dossier"](spark, SF)) == 1
    assert exchanges(queries()["schema_hint"](spark, SF)) == 1
    words = _strewn(spark).where("page = 1 and w > 0")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    found = layout.survey(words)
    assert same(schema.page_dossier(layout.surveyed(words)), schema.dossier(found["tracks"], found["rows"]))
    own = schema.baseline(layout.tracks(layout.placed(words)))
    assert same(schema.page_baseline(layout.tracked(words)), own)
    more = spark.createDataFrame([(1, [("a", "text", True, None), ("b", "text", None, "P"), ("c", "date", False, None), (None, "text", True, "P"), ("d", "x", True, "")]), (2, [])], "doc_id int, columns array<struct<name:string,kind:string,printed:boolean,parent:string>>")
    assert [tuple(r) for r in schema.hint(more).collect()] == [(1, "Columns found by the survey (check them against the print):\n  a [text], c [date] (implicit), d [x]\n  P -> b [text] (implicit)")]


def test_html_is_written_from_the_payload_itself_and_shows_what_stands(spark):
    import random

    from gridloom.operators import cells as C

    assert exchanges(queries()["cells_html"](spark, SF)) == 1
    draw = random.Random(7)
    one = lambda: None if draw.random() < 0.05 else (draw.choice([None, -1, *range(5)]), draw.choice([None, *range(5)]), draw.choice([None, 0, 1, 1, 2, 3]), draw.choice([None, 1, 1, 2, 9]), draw.choice([None, True, False]), draw.choice([None, " a  b ", "<&>", ""]), draw.choice([None, [0.5, 1.5, 2.0, 3.0], [1.0], [1.0, None, 2.0, 2.0]]), draw.choice([None, 1, 1, 1, 2]), None)
    rows = [(d, (draw.choice([None, [], [("a", "text")] * 7]), [one() for _ in range(draw.choice([0, 1, 4, 9]))], None, None)) for d in range(80)] + [(80, None), (81, (None, None, [1], None))]
    p = spark.createDataFrame(rows, f"doc_id int, payload {C.PAYLOAD}")
    c = C.cells(p)
    standing = C.occupancy(c)
    tags, paged = {}, {d for d, payload in rows if payload and any(e is not None and (e[7] or 1) > 1 for e in payload[1] or [])}
    for r in standing.collect():
        many = r["p"] is not None and r["doc_id"] in paged
        tag = "th" if r["h"] else "td"
        box = ' data-bbox="0,2,2,3"' if r["b"] and len(r["b"]) == 4 and None not in r["b"] else ""
        spans = "".join(f' {n}="{r[k]}"' for n, k in (("rowspan", "rs"), ("colspan", "cs")) if r[k] > 1)
        text = " ".join((r["t"] or "").split()).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        page = f' data-page="{r["p"]}"' if many else ""
        tags[r["doc_id"], r["r"], r["c"]] = f"<{tag}{spans}{box}{page}>{text}</{tag}>"
    dim = C.dims(p, c)
    tags |= {tuple(r): "<td></td>" for r in C.holes(standing, dim).collect()}
    want = {}
    for r in dim.collect():
        body = ["<tr>" + "".join(tags.get((r["doc_id"], y, x), "") for x in range(r["n_cols"])) + "</tr>" for y in range(r["n_rows"])]
        want[r["doc_id"]] = "<table>" + "".join(body) + "</table>" if body else ""
    assert dict(map(tuple, C.html(p).collect())) == want
    assert dict(map(tuple, C.html(p, c).collect())) == want


def test_fragments_are_accounted_for_in_one_grouping(spark):
    import random
    from collections import Counter

    from gridloom.operators import cells as C

    assert exchanges(queries()["fragment_identity"](spark, SF)) == 1
    draw = random.Random(2)
    ids = lambda: draw.choice([None, [draw.choice([None, *range(8)]) for _ in range(draw.randrange(4))]])
    docs = [(d, draw.choice([None, [(r, 0, 1, 1, False, "t", None, 1, ids()) for r in range(draw.randrange(4))]]), ids()) for d in range(60)]
    p = spark.createDataFrame([(d, (None, cells, skip, None)) for d, cells, skip in docs] + [(70, None), (None, (None, [(9, 0, 1, 1, False, "t", None, 1, [1])], [2], None))], f"doc_id int, payload {C.PAYLOAD}")
    frags = [(d, draw.choice([None, *range(6)]), "x") for d in [*range(62), 70, None] for _ in range(6)]
    got = Counter((r["doc_id"], r["r"], r["message"]) for r in C.identity(p, spark.createDataFrame(frags, "doc_id int, id int, text string")).collect())
    want = Counter()
    for d, cells, skip in [*docs, (70, None, None), (None, [(9, 0, 1, 1, False, "t", None, 1, [1])], [2])]:
        known = {i for e, i, _ in frags if e == d and d is not None and i is not None}
        used = set()
        for e in cells or []:
            say = lambda text, r=e[0]: (d, r, None if text is None else f"cell r={r} c=0: {text}")  # noqa: B023, E731
            if not e[8]:
                want[say("cites no fragment")] += 1
            for f in e[8] or []:
                if f not in known:
                    want[say(None if f is None else f"cites unknown fragment {f} (invented)")] += 1
                elif f in used:
                    want[say(f"fragment {f} is cited before (duplicated)")] += 1
                used |= {f} & known
        for f in skip or []:
            if f not in known:
                want[d, None, None if f is None else f"ignored lists unknown fragment {f}"] += 1
            elif f in used:
                want[d, None, f"fragment {f} is both used and ignored"] += 1
        if d is not None:
            for _, i, _ in [x for x in frags if x[0] == d and (x[1] is None or x[1] not in used | set(skip or []))]:
                want[d, None, None if i is None else f"fragment {i} 'x' is neither used nor ignored (dropped)"] += 1
    assert got == want


def test_pairs_of_lines_are_one_fold_over_the_page(spark):
    from statistics import median

    from gridloom.operators import design

    assert exchanges(queries()["pair_features"](spark, SF)) == 1
    lines = _strewn(spark).where("not isnan(y) and abs(y) < 1000 and h > 0 and h < 1000").withColumn("col", F.when(F.col("ord") % 5 > 0, F.col("ord") % 5))
    pages = {}
    for r in lines.collect():
        pages.setdefault((r["doc_id"], r["page"]), []).append(r)
    want = set()
    for key, own in pages.items():
        pairs = []
        for col in {r["col"] for r in own}:
            line = sorted((r for r in own if r["col"] == col), key=lambda r: (r["y"], r["ord"]))
            pairs += zip(line[:-1], line[1:], strict=True)
        for a, b in pairs:
            beside = [sum(a["y"] <= z["y"] + z["h"] / 2 <= b["y"] + b["h"] for z in own if z["col"] == c) for c in {r["col"] for r in own} - {a["col"], None}] if a["col"] is not None else []
            gap, middle = b["y"] - a["y"] - a["h"], median(q["y"] - p["y"] - p["h"] for p, q in pairs)
            want.add((*key, a["col"], a["ord"], b["ord"], round(gap / median(r["h"] for r in own), 6), round(gap / max(abs(middle), 1e-9), 6), sum(beside), max(beside, default=0) <= 1))
    got = design.pair_features(lines).select("doc_id", "page", "col", "ord", "next", F.round("gap_norm", 6), F.round("gap_vs_median", 6), "lines_beside", "band_is_single_line").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_answers_are_parsed_once(spark):
    plan = queries()["payload_parse"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_merged_fragments_are_numbered_as_the_pages_are_folded(spark):
    import random

    from pyspark.sql import Window

    from gridloom.operators import fragments

    assert exchanges(queries()["merge_fragments"](spark, SF)) == 2  # the lines, and the query's own sums by document
    draw = random.Random(9)
    rows = [(d, p, o, draw.choice("abc"), draw.choice([0.0, 40.0, 80.0]) + draw.random(), draw.choice([0.05, 0.15, 0.25, 0.35, 1.0, 20.0, 30.2]), 30.0, draw.choice([12.0, 12.5])) for d in (None, *range(40)) for p in range(draw.choice([1, 2, 7])) for o in range(draw.choice([1, 5, 20]))]
    reads = spark.createDataFrame(rows, "doc_id int, page int, ord int, text string, x double, y double, w double, h double")
    order = Window.partitionBy("doc_id").orderBy("page", F.round(F.col("y") + F.col("h") / 2, 1), F.col("x") + F.col("w") / 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = fragments.merged(reads).withColumn("want", F.row_number().over(order) - 1).select("id", "want", "doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) > 300 and all(r["id"] == r["want"] for r in got)


def test_tables_are_scored_where_they_are_parsed(spark):
    import random

    import pyarrow as pa

    from gridloom.functions import html, teds
    from gridloom.operators import metrics

    assert exchanges(queries()["evaluate_run"](spark, SF)) == 1
    assert "ArrowEvalPython" in (plan := queries()["report_cases"](spark, SF)._jdf.queryExecution().executedPlan().toString()) and "explode" not in plan
    draw = random.Random(1)
    text = lambda: draw.choice(["", " ", "a", "A", "a  b", " A b ", "b>c", "12", "'\"", "~;="])
    table = lambda: "<table>" + "".join("<tr>" + "".join(f"<td>{text()}</td>" for _ in range(draw.randint(1, 4))) + "</tr>" for _ in range(draw.randint(1, 4))) + "</table>"
    odd = ["", None, " ", "no table", "<table></table>", "<table><tr></tr></table>", "<table><tr><td>&amp;</td></tr></table>", "<table><tr><td>a</td></tr></table>\n", "<table><tr><td>\t</td></tr></table>", "<table><tr><td colspan=2>A</td><th rowspan=2>é</th></tr><tr><td>b</td></tr></table>", "<TABLE><tr><td>É<td>q</table>"]
    pairs = [(t := table(), table() if draw.random() < 0.5 else t.replace("a", draw.choice("aAq"))) for _ in range(80)] + [(a, b) for a in [*odd, table()] for b in [*odd, table()]]
    true, pred = (pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))
    assert sum(html.plain(true).to_pylist()) > 80
    for (t, p), got in zip(pairs[3:], metrics._judged(pred.slice(3), true.slice(3)).to_pylist(), strict=True):
        guess, truth = html.table_of(p), html.table_of(t)
        assert tuple(got.values()) == (None if truth is None else teds.similarity(guess, truth), *metrics._counted(guess, truth))
    records = spark.createDataFrame([(i, t, "easy", 0, "") for i, (t, _) in enumerate(pairs)], "uid int, html string, difficulty string, n_spanning int, image_path string")
    answers = spark.createDataFrame([(i, p) for i, (_, p) in enumerate(pairs)], "uid int, html string")
    names = ["content_placement", "blank_preservation", "span_recall", "span_f1"]
    got = metrics.evaluate(records, answers).select("uid", *names, "schema_cols_correct")
    c, g = html.cells(records), html.cells(answers)
    want = records.select("uid").join(metrics.placement(g, c), "uid", "left").join(metrics.spans(g, c), "uid", "left").join(metrics.schema_match(g, c), "uid", "left").fillna(1.0, names)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select("uid", *names, F.col("cols_correct").alias("schema_cols_correct")).collect()))
    own = metrics.evaluate(records.join(answers.withColumnRenamed("html", "pred_html"), "uid"))
    assert sorted(map(repr, own.select(got.columns).collect())) == sorted(map(repr, got.collect()))


def test_reads_of_all_pages_are_clustered_at_once_as_page_by_page():
    import random

    import numpy as np

    from gridloom.operators import fragments

    draw = random.Random(5)
    odd = [float("nan"), float("inf"), -5.0, 0.0]
    some = lambda v: draw.choice(odd) if draw.random() < 0.02 else v
    sizes = [draw.choice([1, 2, 5, 20, 60]) for _ in range(200)]
    at = np.append(0, np.cumsum(sizes))
    x, y, w, h = np.array([[some(draw.choice([0.0, 10.0, 40.0]) + draw.randrange(20)), some(draw.choice([0.0, 20.0]) + draw.choice([0, 3, 5])), some(draw.randrange(5, 40)), some(12.0)] for _ in range(at[-1])]).T
    box = np.stack([x, y, x + w, y + h], axis=1)
    with np.errstate(invalid="ignore"):
        want = np.concatenate([fragments.first_clusters(box[a:b], 0.5) + a for a, b in zip(at[:-1], at[1:], strict=True)])
        got = fragments.first_clusters_of_pages(box, np.repeat(np.arange(len(sizes)), sizes), 0.5)
    assert got.tolist() == want.tolist() and 200 < len(set(want.tolist())) < at[-1]
    assert fragments.first_clusters_of_pages(box[:0], np.empty(0, int), 0.5).tolist() == []


def test_pictures_are_not_broadcast(spark, monkeypatch):
    from gridloom.plans import reading

    plans, kept = [], reading.kept
    monkeypatch.setattr(reading, "kept", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    assert queries()["reading_pass"](spark, SF).count() > 100
    assert len(plans) == 2 and all("ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan for plan in plans)


def test_reconstruction_is_planned_in_small_parts_and_collects_no_documents(spark, monkeypatch):
    """The driver holds a plan of few tables at a time, and joins by document are not planned by the bytes of files."""
    import json

    from pyspark.sql.readwriter import DataFrameWriter

    from gridloom.operators import cells, fragments
    from gridloom.plans.reconstruct import Plan, reconstruct

    plans, write = [], DataFrameWriter.parquet

    def spied(self, *a, **b):
        plan = self._df._jdf.queryExecution()
        plans.append((plan.optimizedPlan().collectLeaves().size(), plan.executedPlan().toString()))
        return write(self, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    rows = [("d", 1, i, t, float(x), float(y), 20.0, 10.0) for i, (t, x, y) in enumerate([("a", 0, 0), ("b", 50, 0), ("c", 0, 20), ("5", 50, 20)])]
    read = fragments.merged(spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, x double, y double, w double, h double"))
    answer = lambda row: json.dumps({"columns": [{"name": "p", "kind": "text"}, {"name": "q", "kind": "text"}], "cells": [{"r": i // 2, "c": i % 2, "f": [i]} for i in range(4 if "problems" in row["prompt"] else 3)]})
    got = reconstruct(read, Plan(draw=lambda: answer)).first()
    assert (got["n_problems"], got["repair_rounds"]) == (0, 1) and got["html"].count("<td") == 4
    assert max(n for n, _ in plans) <= 12 and len(plans) > 20
    assert not [plan for _, plan in plans if "BroadcastHashJoin" in plan]
    # What is wrong with a cell is said in one pass, also where documents have their own numbers of pages.
    payload = spark.createDataFrame([("d", {"columns": [{"name": "p", "kind": "text"}], "cells": [{"r": 0, "c": 0, "t": " ", "b": [1.0], "p": p} for p in (2, 3)]})], f"doc_id string, payload {cells.PAYLOAD}")
    pages = spark.createDataFrame([("d", 2)], "doc_id string, n_pages int")
    assert len(cells.validations(payload, pages)) == 3
    assert sorted(r["message"].split(": ")[1] for r in cells.validate(payload, pages).collect()) == ["no text; blank cells are left out"] * 2 + ["position (0, 0) is taken by cell number 0"] + ["the box is not four numbers"] * 2 + ["the page is outside 1..2"]
