"""Every query of the engine by name, over the given tables; ORACLES has the SQL that they equal."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import html as H
from gridloom.functions.kinds import accepts, induced, kind_of, number
from gridloom.functions.text import clean_prediction, fits_length, without_thinking
from gridloom.operators import cells as C
from gridloom.operators import corpus, fragments, layout, metrics, schema, structure, verify
from gridloom.plans import fixtures as X
from gridloom.plans import models
from gridloom.plans.oracle import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _long(name: str):
    return F.col(name).cast("long").alias(name)


def _r(name: str, digits: int = 9):
    return F.round(name, digits).alias(name)


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    true = X.cells(spark, sf)
    return X.predicted(true), true


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return X.words(X.cells(spark, sf))


def _run(spark: SparkSession, sf: str) -> DataFrame:
    pred, true = _pair(spark, sf)
    size = true.groupBy("uid").agg(X.difficulty(F.max("row") + 1).alias("difficulty"))
    return metrics.placement(pred, true).join(size, "uid").withColumn("run_name", F.lit("run"))


@query
def content_placement(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.placement(*_pair(spark, sf)).select("uid", "placed", "texts", _r("content_placement"))


@query
def blank_preservation(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.placement(*_pair(spark, sf)).select("uid", "kept", "blanks", _r("blank_preservation"))


@query
def schema_match(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.schema_match(*_pair(spark, sf)).select("uid", "true_rows", "true_cols", "pred_rows", "pred_cols", "cols_correct")


@query
def span_recovery(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.spans(*_pair(spark, sf)).select("uid", "matched", "total", "spurious", _r("span_recall"), _r("span_f1"))


@query
def run_summary_by_bin(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.summary(_run(spark, sf))
    return s.select(F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "n", _r("mean_content_placement", 6), _r("mean_blank_preservation", 6))


@query
def compare_delta(spark: SparkSession, sf: str) -> DataFrame:
    run = _run(spark, sf)

    def of(value: str) -> DataFrame:
        s = metrics.summary(run.withColumn("teds_struct", F.col(value)))
        return s.withColumn("ci_low", F.col("mean_teds")).withColumn("ci_high", F.col("mean_teds"))

    out = metrics.compare(of("blank_preservation"), of("content_placement"))
    return out.select(F.coalesce("difficulty", F.lit("all")).alias("difficulty"), _r("baseline", 6), _r("candidate", 6), _r("delta", 6))


@query
def classify_kind_hist(spark: SparkSession, sf: str) -> DataFrame:
    return X.cells(spark, sf).groupBy("col", kind_of(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def kind_of_words(spark: SparkSession, sf: str) -> DataFrame:
    w = X.table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("t")).where("t <> ''")
    d = w.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy(kind_of(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n"))


@query
def induce_kind(spark: SparkSession, sf: str) -> DataFrame:
    return induced(X.cells(spark, sf), ["uid", "col"], "text", "row").select("uid", "col", "kind")


@query
def kind_accepts(spark: SparkSession, sf: str) -> DataFrame:
    want = F.element_at(F.array(*map(F.lit, X.KINDS)), F.col("col") + 1)
    p = X.predicted(X.cells(spark, sf)).withColumn("want", want)
    return p.groupBy("col", "want").agg(F.count_if(accepts(F.col("want"), F.col("text"))).alias("accepted"), F.count(F.lit(1)).alias("n"))


@query
def parse_number(spark: SparkSession, sf: str) -> DataFrame:
    v = number(F.col("text"))
    return X.cells(spark, sf).groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("numbers"), F.round(F.sum(v), 2).alias("total"))


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("html"), (F.col("n_chars").cast("double") / 30000).alias("score"), "lang")


@query
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.first_of_each(_scanned(spark, sf)).select("ord")


@query
def top_n_hardest(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.hardest(_scanned(spark, sf).select("ord", "score"), 50).select("ord", _r("score"))


@query
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.summary(_scanned(spark, sf).select("score")).select("n", _r("p10"), _r("p50"), _r("p90"), "easy", "medium", "hard", "empty")


@query
def percentile_bins(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.percentile_bins(_scanned(spark, sf).select("ord", "score")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query
def leakage_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are in both of two splits, as documents of even and of odd id."""
    d = X.table(spark, sf, "documents").select("doc_id", "text")
    return corpus.leaks(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "text")


@query
def difficulty_score(spark: SparkSession, sf: str) -> DataFrame:
    c = X.cells(spark, sf)
    depth = c.select("uid").distinct().withColumn("header_depth", F.lit(2))
    return corpus.complexity(c, depth).select("uid", "n_rows", "n_cols", _long("n_cells"), _long("n_spanning"), _r("score", 6))


@query
def column_separators(spark: SparkSession, sf: str) -> DataFrame:
    return layout.separators(_words(spark, sf)).select("doc_id", _long("k"), "separator")


@query
def grid_assign(spark: SparkSession, sf: str) -> DataFrame:
    return layout.with_columns_of(_words(spark, sf).drop("row", "col")).select("doc_id", "ord", _long("col"))


@query
def grid_complete(spark: SparkSession, sf: str) -> DataFrame:
    return layout.grid(_words(spark, sf).drop("row", "col")).select("doc_id", "row", "col", "text")


@query
def cluster_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Words that lie up to 16 off their row's height of 20, so that rows run into each other."""
    return layout.with_rows_of(X.tilted(_words(spark, sf)).drop("row", "col")).select("doc_id", "ord", "row")


@query
def track_fill(spark: SparkSession, sf: str) -> DataFrame:
    t = layout.tracks(layout.placed(_words(spark, sf).drop("row", "col")))
    return t.select("doc_id", _long("col"), "x1", "x2", "fill", "n_rows")


@query
def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return layout.anchors(layout.tracks(layout.placed(_words(spark, sf).drop("row", "col")))).select("doc_id", _long("col"))


@query
def contested(spark: SparkSession, sf: str) -> DataFrame:
    return layout.contested(_words(spark, sf), margin=1.0).select("doc_id", "ord", F.col("columns")[0].cast("long").alias("k"))


@query
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    return layout.alignment(layout.with_columns_of(_words(spark, sf).drop("row", "col"))).select("doc_id", _long("col"), "align")


@query
def pitch(spark: SparkSession, sf: str) -> DataFrame:
    return layout.pitch(_words(spark, sf).drop("row", "col")).select("doc_id", _r("pitch", 6))


@query
def merge_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Reads that lie 20 to 49 hundredths of a word apart, so that some overlap enough and others just not, on two pages."""
    m = fragments.merged(X.moved_reads(_words(spark, sf)))
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fragments"), F.count_if("contested").alias("contested"), F.round(F.sum("x"), 6).alias("x_sum"), F.round(F.sum("conf"), 6).alias("conf_sum"), F.round(F.sum(F.col("id") * F.col("conf") * F.col("page")), 6).alias("order_sum"))


def _fragments(word: DataFrame) -> DataFrame:
    return word.select("doc_id", F.col("ord").alias("id"), "text", "x", "y", "w", "h", "page")


@query
def fragment_identity(spark: SparkSession, sf: str) -> DataFrame:
    word = _words(spark, sf)
    pk, own = F.col("pk"), F.col("ord").cast("int")
    cited = F.when(pk % 6 == 0, F.array(own + 50000)).when(pk % 9 == 1, F.array(own, own)).when(pk % 10 == 3, F.array().cast("array<int>")).otherwise(F.array(own))
    payload = X.payloads(X.cell_list(word).withColumn("f", cited), passed=F.array_append(F.collect_list(F.when(pk % 4 == 1, F.col("ord").cast("int"))), F.lit(90000)))
    found = C.identity(payload, _fragments(word))
    ends = {"uncited": "cites no fragment", "invented": "(invented)", "duplicated": "(duplicated)", "dropped": "(dropped)", "both": "both used and ignored"}
    n = lambda end: F.count_if(F.col("message").endswith(end))
    return found.groupBy("doc_id").agg(*[n(end).alias(k) for k, end in ends.items()], F.count_if(F.col("message").startswith("ignored lists")).alias("unknown"))


@query
def fill_cells(spark: SparkSession, sf: str) -> DataFrame:
    word = _words(spark, sf)
    row = X.cell_list(word).groupBy("doc_id", "r").agg(F.reverse(F.array_sort(F.collect_list(F.col("ord").cast("int")))).alias("f"))
    none = lambda t: F.lit(None).cast(t)
    cell = row.select("doc_id", F.col("r").alias("ord"), "r", F.lit(0).alias("c"), F.lit(1).alias("rs"), F.lit(1).alias("cs"), F.lit(False).alias("h"), none("string").alias("t"), none("array<double>").alias("b"), none("int").alias("p"), "f")
    return C.filled(cell, _fragments(word)).select("doc_id", "r", "t", F.col("b")[0].alias("x1"), F.col("b")[2].alias("x2"))


@query
def vote_cells(spark: SparkSession, sf: str) -> DataFrame:
    cell = X.cell_list(_words(spark, sf)).withColumn("f", F.lit(None).cast("array<int>"))
    draft = cell.withColumn("draft", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where(~((F.col("draft") > 0) & (F.col("pk") % 5 == 0)))
    wrong = ((F.col("draft") == 1) & (F.col("pk") % 3 == 0)) | ((F.col("draft") == 2) & (F.col("pk") % 4 == 0))
    draft = draft.withColumn("t", F.when(wrong, F.concat("t", F.lit("*"))).otherwise(F.col("t")))
    voted, _ = C.vote(X.payloads(draft, "doc_id", "draft"))
    return voted.select("doc_id", "r", "c", "t", "votes", _r("confidence"))


@query
def overlap_check(spark: SparkSession, sf: str) -> DataFrame:
    cell = X.cell_list(_words(spark, sf)).withColumn("cs", F.when(F.col("pk") % 8 == 0, 2).otherwise(1))
    return C.overlaps(cell).groupBy("doc_id").agg(F.count(F.lit(1)).alias("overlaps"))


@query
def word_bag(spark: SparkSession, sf: str) -> DataFrame:
    word = _words(spark, sf)
    text = F.when(F.col("pk") % 6 == 0, F.concat("t", F.lit("!"))).when(F.col("pk") % 10 == 1, F.concat(F.lit("zz"), F.substr("t", F.lit(2)))).otherwise(F.col("t"))
    found = C.word_bag(X.payloads(X.cell_list(word).withColumn("t", text)), word)
    return found.groupBy("doc_id").agg(*[F.count_if(F.col("message").endswith(f"({k})")).alias(k) for k in ("invented", "dropped")])


def _plain_cells(cell: DataFrame) -> DataFrame:
    """Cells of (uid, row, col, text) as they stand in the grid."""
    none = lambda t: F.lit(None).cast(t)
    return cell.select(F.col("uid").alias("doc_id"), (F.col("row") * 7 + F.col("col")).alias("ord"), F.col("row").alias("r"), F.col("col").alias("c"), F.lit(1).alias("rs"), F.lit(1).alias("cs"), F.lit(False).alias("h"), F.col("text").alias("t"), none("array<double>").alias("b"), F.lit(1).alias("p"), none("array<int>").alias("f"))


@query
def type_coherence(spark: SparkSession, sf: str) -> DataFrame:
    return verify.types(_plain_cells(X.predicted(X.cells(spark, sf)))).select("doc_id", "r", "c")


@query
def arithmetic_near_miss(spark: SparkSession, sf: str) -> DataFrame:
    return verify.arithmetic(_plain_cells(X.cells(spark, sf))).select("doc_id", "c")


@query
def geometry_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Cells a column too far left, and tables whose columns run from the right."""
    c = F.col("c")
    placed = F.when(F.col("doc_id") % 13 == 0, 6 - c).when((F.col("pk") % 17 == 0) & (c > 0), c - 1).otherwise(c)
    return verify.geometry(C.occupancy(X.cell_list(_words(spark, sf)).withColumn("c", placed).drop("pk"))).select("doc_id", "r", "c")


@query
def schema_echo(spark: SparkSession, sf: str) -> DataFrame:
    cell = X.cell_list(_words(spark, sf))
    return verify.schema_echo(X.payloads(cell), cell).select("doc_id", "c")


# Three schemas that are tried on every table.
_TRIED = (("text", "numeric", "amount", "symbol", "percent", "percent", "symbol"), ("text", "numeric", "numeric", "numeric", "percent", "symbol"), ("text", "symbol", "date"))


def _tried(spark: SparkSession, sf: str) -> DataFrame:
    p = X.predicted(X.cells(spark, sf))
    filled = p.where("text <> ''")
    track = filled.groupBy(F.col("uid").alias("doc_id"), "col").agg(F.count(F.lit(1)).alias("fill"))
    row = p.groupBy(F.col("uid").alias("doc_id"), "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    row = row.select("doc_id", "row", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.coalesce(F.col("m")[i], F.lit(""))).alias("cells"), F.lit("data").alias("kind"))
    column = lambda i, k: F.struct(F.lit(f"c{i}").alias("name"), F.lit(k).alias("kind"), F.lit(True).alias("printed"), F.lit(None).cast("string").alias("parent"))
    pool = F.array(*[F.struct(F.lit(n).alias("cand"), F.array(*[column(i, k) for i, k in enumerate(kinds)]).alias("columns")) for n, kinds in enumerate(_TRIED)])
    each = track.select("doc_id").distinct().select("doc_id", F.explode(pool).alias("e")).select("doc_id", "e.cand", "e.columns", F.lit("").alias("justification"))
    return schema.trial(each, track, row)


@query
def schema_trial(spark: SparkSession, sf: str) -> DataFrame:
    return _tried(spark, sf).select("doc_id", "cand", "column_count_delta", "type_violations", "total")


@query
def select_schema(spark: SparkSession, sf: str) -> DataFrame:
    return schema.choose(_tried(spark, sf)).select("doc_id", "cand", "rank", "carried", "out_of_family")


@query
def plan_tiles(spark: SparkSession, sf: str) -> DataFrame:
    p = X.table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), (300 + F.col("p_partkey") % 3000).cast("int").alias("width"), (200 + F.col("p_size") * 100).cast("int").alias("height"))
    return fragments.tiles(p).select("page_id", "tile_no", "x1", "y1", "x2", "y2")


@query
def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping pairs of enlarged word boxes of a document."""
    large = _words(spark, sf).withColumn("w", F.col("w") * 1.5).withColumn("h", F.lit(26.0))
    return fragments.overlaps(large).select("doc_id", "a", "b", _r("iou", 6))


@query
def levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    p = X.table(spark, sf, "part").select("p_partkey", "p_name")
    o = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    return p.join(o, "p_partkey").select(F.col("p_partkey").alias("a"), "b", F.levenshtein("p_name", "other").cast("long").alias("distance"))


def _answers(spark: SparkSession, sf: str, shapes: tuple[str, ...]) -> DataFrame:
    """Every turn's text in one of several shapes of a model's answer, in turn."""
    r = X.table(spark, sf, "conversations")
    shape = F.element_at(F.array(*map(F.lit, shapes)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(shapes))) + 1).cast("int"))
    return r.select("conv_id", "turn", F.replace(shape, F.lit("@"), F.col("text")).alias("raw"))


@query
def clean_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf, X.TABLE_ANSWERS).select("conv_id", "turn", clean_prediction(F.col("raw")).alias("html"))


@query
def strip_thinking(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf, X.THOUGHTS).select("conv_id", "turn", without_thinking(F.col("raw")).alias("text"))


@query
def registry_gate(spark: SparkSession, sf: str) -> DataFrame:
    return models.for_data(models.registry(spark), "public").select("name", "role", "backend")


@query
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    records = X.table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "lang")
    return corpus.left_to_do(records, X.table(spark, sf, "labels").select(F.col("doc_id").alias("uid")))


@query
def length_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = X.table(spark, sf, "documents")
    fits = fits_length(F.col("text"), F.lit(None).cast("string"), 200 + F.col("doc_id") % 900, F.lit(800), 2048, 1_000_000)
    return d.where(fits).select("doc_id")


@query
def adjacency_f1(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda d: d.withColumn("rowspan", F.lit(1)).withColumn("colspan", F.lit(1))
    pred, true = _pair(spark, sf)
    return metrics.adjacency_f1(one(pred), one(true)).select("uid", _r("adjacency_f1"))


@query
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.diagnostics(*_pair(spark, sf)).select("uid", "row_error", "col_error", "over_split", "under_split", _r("empty_recall"))


@query
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.placement(*_pair(spark, sf)).withColumn("ok", F.col("blank_preservation") == 1.0)
    return metrics.reliability(s, "content_placement", "ok").select("bin", "n", _r("mean_confidence", 6), _r("accuracy", 6))


@query
def edge_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    word = _words(spark, sf)
    true = word.select("doc_id", F.col("ord").alias("id"), F.struct("ord").alias("place"))
    pred = word.select("doc_id", F.col("ord").alias("id"), F.struct(F.when(F.col("pk") % 7 == 0, F.col("ord") + 100).otherwise(F.col("ord")), "ord").alias("place"))
    return structure.edge_accuracy(pred, true).select("doc_id", "edges", _r("edge_accuracy"))


@query
def pages_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    pages = X.table(spark, sf, "pages").select(F.col("page_id").alias("uid"), "html")
    return corpus.scored(pages).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query
def grid_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Grids with wide first cells, whose second position they cover, and holes where a price is lost."""
    c = X.cells(spark, sf).withColumn("ord", F.col("row") * 7 + F.col("col")).withColumn("rowspan", F.lit(1))
    return structure.grid_tokens(c.where(~((F.col("col") == 1) & (F.col("pk") % 5 == 0)) & ~((F.col("col") == 2) & (F.col("pk") % 11 == 0))))


@query
def teds(spark: SparkSession, sf: str) -> DataFrame:
    pred, true = _pair(spark, sf)
    both = X.html(true).join(X.html(pred).withColumnRenamed("html", "pred_html"), "uid", "left")
    return both.select("uid", F.round(metrics.teds_score("pred_html", "html"), 9).alias("teds_struct"))


@query
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    s = X.table(spark, sf, "supplier")
    key = next(c for c in s.columns if c.endswith("suppkey"))
    nation = next(c for c in s.columns if c.endswith("nationkey"))
    value = next(c for c in s.columns if c.endswith("acctbal"))
    return metrics.intervals(s.select(F.col(key).alias("uid"), nation, value), [nation], value)


@query
def bootstrap_poisson(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.poisson_intervals(_run(spark, sf), ["difficulty"], "content_placement", resamples=20)
    return out.select("difficulty", _r("mean", 6), _r("ci_low", 6), _r("ci_high", 6))


@query
def page_survey(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.survey(_words(spark, sf).drop("row", "col"))["rows"]
    return rows.select("doc_id", "row", "kind", F.array_join("cells", "|").alias("cells"), _r("cy", 6))


@query
def layout_text(spark: SparkSession, sf: str) -> DataFrame:
    return layout.layout_text(_words(spark, sf).drop("row", "col")).select("doc_id", "text")


@query
def cells_html(spark: SparkSession, sf: str) -> DataFrame:
    return C.html(X.payloads(X.cell_list(_words(spark, sf))))


@query
def skew(spark: SparkSession, sf: str) -> DataFrame:
    return structure.best_skew(_words(spark, sf)).select("doc_id", _r("degrees", 6))


def _placing_model() -> Callable[[dict], str]:
    """A stand-in for a model: puts each fragment that the prompt lists where it lies."""
    line = re.compile(r'^(\d+): ".*" \(x=(\d+), y=(\d+), w=\d+, h=\d+, p=\d+\)', re.M)

    def answer(row: dict) -> str:
        cell = [{"r": int(y) // 20, "c": int(x) // 100, "f": [int(i)]} for i, x, y in line.findall(row["prompt"])]
        return "```json\n" + json.dumps({"columns": [{"name": n, "kind": k} for n, k in zip(X.COLUMNS, X.KINDS, strict=True)], "cells": cell}) + "\n```"

    return answer
