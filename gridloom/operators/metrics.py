"""Scores of predicted against true tables, their summary over a run, and the comparison of runs.

Cells are rows (uid, row, col, rowspan, colspan, text), as html.cells() gives them; evaluate() parses each table once
and scores a pair of them where it is parsed.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gridloom.functions import teds
from gridloom.functions.html import Node, Table, plain, plain_cells, table_of
from gridloom.functions.kinds import folded, number

#: Resamples, confidence and seed of the bootstrap.
RESAMPLES, CONFIDENCE, SEED = 2000, 0.95, 0
BINS = ("easy", "medium", "hard")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; nothing to be right about is 1."""
    return F.when(whole == 0, 1.0).otherwise(part / F.greatest(whole, F.lit(1)))


def _anchors(cells: DataFrame, out: str) -> DataFrame:
    return cells.groupBy("uid", "row", "col").agg(F.max(folded(F.coalesce("text", F.lit("")))).alias(out))


def placement(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(uid, placed, texts, content_placement, kept, blanks, blank_preservation): true texts in their place and
    true blanks left blank. A position that the prediction lacks is blank."""
    both = _anchors(true, "t").join(_anchors(pred, "p"), ["uid", "row", "col"], "left").withColumn("p", F.coalesce("p", F.lit("")))
    s = both.groupBy("uid").agg(
        F.count_if((F.col("t") != "") & (F.col("t") == F.col("p"))).alias("placed"),
        F.count_if(F.col("t") != "").alias("texts"),
        F.count_if((F.col("t") == "") & (F.col("p") == "")).alias("kept"),
        F.count_if(F.col("t") == "").alias("blanks"),
    )
    return s.withColumn("content_placement", ratio(F.col("placed"), F.col("texts"))).withColumn("blank_preservation", ratio(F.col("kept"), F.col("blanks")))


def spans(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(uid, matched, total, spurious, span_recall, span_precision, span_f1) over spanning cells by place and shape."""
    of = lambda d, n: d.where("rowspan > 1 or colspan > 1").select("uid", "row", "col", "rowspan", "colspan").distinct().withColumn(n, F.lit(1))
    both = of(true, "t").join(of(pred, "p"), ["uid", "row", "col", "rowspan", "colspan"], "full")
    s = both.groupBy("uid").agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("matched"), F.count("t").alias("total"), F.count_if(F.col("t").isNull()).alias("spurious"))
    s = true.select("uid").distinct().join(s, "uid", "left").fillna(0, ["matched", "total", "spurious"])
    return with_span_ratios(s)


def with_span_ratios(s: DataFrame) -> DataFrame:
    s = s.withColumn("span_recall", ratio(F.col("matched"), F.col("total"))).withColumn("span_precision", ratio(F.col("matched"), F.col("matched") + F.col("spurious")))
    return s.withColumn("span_f1", span_f1(F.col("span_precision"), F.col("span_recall")))


def span_f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def shape(cells: DataFrame, prefix: str) -> DataFrame:
    return cells.groupBy("uid").agg(F.max(F.col("row") + F.col("rowspan")).alias(f"{prefix}_rows"), F.max(F.col("col") + F.col("colspan")).alias(f"{prefix}_cols"))


def schema_match(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(uid, true_rows, true_cols, pred_rows, pred_cols, cols_correct, exact)."""
    s = shape(true, "true").join(shape(pred, "pred"), "uid", "left").fillna(0, ["pred_rows", "pred_cols"])
    cols = F.col("true_cols") == F.col("pred_cols")
    return s.withColumn("cols_correct", cols).withColumn("exact", cols & (F.col("true_rows") == F.col("pred_rows")))


@F.pandas_udf(DoubleType())
def teds_score(pred: pd.Series, true: pd.Series) -> pd.Series:
    """Structure similarity; a pair without a true table is null."""
    pairs = ((table_of(p), table_of(t)) for p, t in zip(pred, true, strict=True))
    return pd.Series([None if t is None else teds.similarity(p, t) for p, t in pairs], dtype="float64")


#: What a pair's tables are counted by, beside their structure similarity: as placement(), spans() and schema_match() have it.
COUNTS = ("placed", "texts", "kept", "blanks", "matched", "total", "spurious", "true_cols", "pred_cols", "cells")


def _counted(guess: Table | None, truth: Table | None) -> list[int]:
    """COUNTS of a pair."""
    places, spanning, width = [], [], []
    for table in (guess, truth):
        found = [] if table is None else table.cells()
        places.append({})
        for r, c, _, _, _, text, _ in found:
            places[-1][r, c] = max(text.lower(), places[-1].get((r, c), ""))
        spanning.append({cell[:4] for cell in found if cell[2] > 1 or cell[3] > 1})
        width.append(max((cell[1] + cell[3] for cell in found), default=0))
    both = [(t, places[0].get(at, "")) for at, t in places[1].items()]
    texts = [t == p for t, p in both if t]
    matched = len(spanning[0] & spanning[1])
    return [sum(texts), len(texts), sum(not t and not p for t, p in both), len(both) - len(texts), matched, len(spanning[1]), len(spanning[0]) - matched, width[1], width[0], len(both)]


#: Similarities of plain tables that a process remembers, by their rows' numbers of cells.
KNOWN = 1 << 16
_known: dict[tuple[bytes, bytes], float] = {}


def _similarity(guess: np.ndarray, truth: np.ndarray) -> float:
    key = guess.tobytes(), truth.tobytes()
    if key[0] == key[1]:
        return 1.0
    if (found := _known.get(key)) is None:
        if len(_known) >= KNOWN:
            _known.clear()
        bare = lambda rows: Table(Node("table", children=[Node("tr", children=[Node("td")] * n) for n in rows.tolist()]), [])
        found = _known[key] = teds.similarity(bare(guess) if len(guess) else None, bare(truth))
    return found


def _plain_pairs(pred: pa.Array, true: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, COUNTS) of plain() true tables and predictions that are plain() or '', all at once."""
    n = len(true)
    of, row_of, width, first, text = plain_cells(true)
    their_of, _, their_width, their_first, theirs = plain_cells(pred)
    ends, their_ends = np.searchsorted(of, np.arange(n + 1)), np.searchsorted(their_of, np.arange(n + 1))
    row = np.repeat(np.arange(len(of)), width)
    pair, col = of[row], np.arange(len(row)) - first[row]
    other = their_ends[pair] + row_of[row]
    there = other < their_ends[pair + 1]
    other = np.where(there, other, 0)
    if len(their_width):
        there &= col < their_width[other]
        found = theirs.take(pa.array(np.where(there, their_first[other] + col, 0), mask=~there)).fill_null("")
    else:
        found = pa.repeat(pa.scalar(""), len(row))
    blank, equal = np.asarray(pc.equal(text, "")), np.asarray(pc.equal(text, found))
    count = lambda mark: np.bincount(pair[mark], minlength=n)
    widest = np.zeros((2, n), np.int64)
    np.maximum.at(widest[0], of, width)
    np.maximum.at(widest[1], their_of, their_width)
    none = np.zeros(n, np.int64)
    counts = [count(~blank & equal), count(~blank), count(blank & equal), count(blank), none, none, none, widest[0], widest[1], np.bincount(pair, minlength=n)]
    a, b = ends.tolist(), their_ends.tolist()
    return np.array([_similarity(their_width[b[i] : b[i + 1]], width[a[i] : a[i + 1]]) for i in range(n)], float), np.stack(counts, axis=1)


def _judged(pred: pa.Array, true: pa.Array) -> pa.StructArray:
    pred, n = pred.fill_null(""), len(true)
    none = np.asarray(pc.equal(pred, ""))
    easy = np.asarray(plain(true)) & (none | np.asarray(plain(pred)))
    score, counts = np.full(n, np.nan), np.zeros((n, len(COUNTS)), np.int64)
    at = np.flatnonzero(easy)
    if len(at):
        score[at], counts[at] = _plain_pairs(pred.take(pa.array(at)), true.take(pa.array(at)))
    for i in np.flatnonzero(~easy).tolist():
        guess, truth = table_of(pred[i].as_py()), table_of(true[i].as_py())
        score[i] = np.nan if truth is None else teds.similarity(guess, truth)
        counts[i] = _counted(guess, truth)
    return pa.StructArray.from_arrays([pa.array(score, mask=np.isnan(score)), *[pa.array(c) for c in counts.T]], ["teds_struct", *COUNTS])


@F.arrow_udf(StructType([StructField("teds_struct", DoubleType()), *[StructField(c, LongType()) for c in COUNTS]]))
def judged(pred: pa.Array, true: pa.Array) -> pa.Array:
    """Structure similarity and COUNTS of two tables as HTML, from one parse of each; the similarity is null without a true table."""
    return _judged(pred, true)


def evaluate(records: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Scores of each record (uid, html, difficulty, n_spanning, image_path); a missing prediction is ''.

    predictions: (uid, html); without them, records have their own as pred_html, and no join is needed. Nothing is written and no cell is dealt out: what goes through the results more than once keeps them.
    """
    both = records if predictions is None else records.join(predictions.select("uid", F.col("html").alias("pred_html")), "uid", "left")
    both = both.withColumn("pred_html", F.coalesce("pred_html", F.lit(""))).withColumnRenamed("html", "true_html")
    seen = both.withColumn("_j", judged("pred_html", "true_html"))
    j = lambda c: F.col(f"_j.{c}")
    recall, precision = ratio(j("matched"), j("total")), ratio(j("matched"), j("matched") + j("spurious"))
    out = seen.withColumn("teds_struct", j("teds_struct")).withColumn("parse_failed", F.trim("pred_html") == "")
    out = out.withColumns({"content_placement": ratio(j("placed"), j("texts")), "blank_preservation": ratio(j("kept"), j("blanks")), "span_recall": recall, "span_f1": F.when(j("cells") > 0, span_f1(precision, recall)).otherwise(1.0)})
    return out.withColumn("schema_cols_correct", F.when(j("cells") > 0, j("true_cols") == j("pred_cols"))).drop("_j")


def bootstrap(values: list[float], resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = SEED) -> tuple[float, float, float]:
    """(mean, low, high) by the percentile bootstrap of the mean, with the standard generator of the seed."""
    n = len(values)
    if n < 2:
        return (values[0],) * 3 if n else (0.0, 0.0, 0.0)
    draw = random.Random(seed).randrange
    means = sorted(sum(values[draw(n)] for _ in range(n)) / n for _ in range(resamples))
    tail = (1 - confidence) / 2
    return sum(values) / n, means[int(tail * resamples)], means[min(int((1 - tail) * resamples), resamples - 1)]


def intervals(results: DataFrame, group: list[str], value: str, order: str = "uid", resamples: int = RESAMPLES) -> DataFrame:
    """(group, mean, ci_low, ci_high): the bootstrap of each group, its values in order, so that a run can be
    repeated to the digit. A group is one task: for evaluation sets. poisson_intervals() has no such limit."""
    keys = ", ".join(f"{g} {dict(results.dtypes)[g]}" for g in group)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mean, low, high = bootstrap(frame.sort_values(order)[value].astype(float).tolist(), resamples)
        return pd.DataFrame([{**{g: frame[g].iloc[0] for g in group}, "mean": mean, "ci_low": low, "ci_high": high}])

    return results.select(*group, order, value).groupBy(*group).applyInPandas(run, f"{keys}, mean double, ci_low double, ci_high double")


def poisson_intervals(results: DataFrame, group: list[str], value: str, key: str = "uid", resamples: int = 200, confidence: float = CONFIDENCE) -> DataFrame:
    """(group, mean, ci_low, ci_high) by a bootstrap of Poisson weights: any number of rows, one aggregation.

    The weight of a row in a resample comes from a hash of its key and the resample's number.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("b").cast("string"))), 1, 10), 16, 10).cast("double") / float(1 << 40)
    steps, total, term = [], 0.0, 0.36787944117144233  # exp(-1)
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    each = results.select(*group, key, value).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight)
    means = each.groupBy(*group, "b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    tail = (1 - confidence) / 2
    limits = means.groupBy(*group).agg(F.percentile("m", tail).alias("ci_low"), F.percentile("m", 1 - tail).alias("ci_high"))
    return results.groupBy(*group).agg(F.avg(value).alias("mean")).join(limits, group)


def summary(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row a run and one a difficulty of it (null: all): counts and means, by grouping sets."""
    group = group or ["run_name"]
    metrics = [("mean_teds", "teds_struct"), ("mean_span_recall", "span_recall"), ("mean_content_placement", "content_placement"), ("mean_blank_preservation", "blank_preservation")]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(n) for n, c in metrics if c in results.columns]]
    if "schema_cols_correct" in results.columns:
        aggs.append(F.avg(F.col("schema_cols_correct").cast("double")).alias("schema_col_accuracy"))
    if "parse_failed" in results.columns:
        aggs.append(F.count_if("parse_failed").alias("parse_failures"))
    sets = results.groupingSets([[F.col(g) for g in group], [*[F.col(g) for g in group], F.col("difficulty")]], *[F.col(g) for g in group], F.col("difficulty"))
    return sets.agg(*aggs, F.grouping("difficulty").alias("_all")).where((F.col("_all") == 1) | F.col("difficulty").isin(*BINS)).drop("_all")


def summarised(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """summary() with bootstrap intervals of mean_teds, for runs and their bins."""
    group = group or ["run_name"]
    everything = results.withColumn("difficulty", F.lit(None).cast("string")).unionByName(results.where(F.col("difficulty").isin(*BINS)))
    marked = everything.withColumn("_d", F.coalesce("difficulty", F.lit("")))
    ci = intervals(marked, [*group, "_d"], "teds_struct").drop("mean")
    return summary(results, group).withColumn("_d", F.coalesce("difficulty", F.lit(""))).join(ci, [*group, "_d"], "left").drop("_d")


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(difficulty, baseline, candidate, delta, significant, verdict): by bin and over all; significant where
    the intervals are apart."""
    of = lambda d, p: d.select("difficulty", *[F.col(c).alias(f"{p}_{c}") for c in ("n", "mean_teds", "ci_low", "ci_high")])
    a, b = of(baseline, "a"), of(candidate, "b").withColumnRenamed("difficulty", "_d")
    both = a.join(b, F.col("difficulty").eqNullSafe(F.col("_d"))).drop("_d")
    apart = (F.col("a_ci_high") < F.col("b_ci_low")) | (F.col("b_ci_high") < F.col("a_ci_low"))
    delta = F.col("b_mean_teds") - F.col("a_mean_teds")
    verdict = F.when(~apart, "NOT SIGNIFICANT").when(delta > 0, "improves").otherwise("regresses")
    return both.select("difficulty", "a_n", "b_n", F.col("a_mean_teds").alias("baseline"), F.col("b_mean_teds").alias("candidate"), delta.alias("delta"), apart.alias("significant"), verdict.alias("verdict"))


def compare_text(comparison: DataFrame, baseline: str = "baseline", candidate: str = "candidate") -> str:
    """compare() as a report."""
    rows = sorted(comparison.collect(), key=lambda r: (r["difficulty"] is not None, r["difficulty"] or ""))
    lines = [f"{'bin':<8} {baseline:>12} {candidate:>12} {'delta':>9}  verdict"]
    lines += [f"{r['difficulty'] or 'all':<8} {r['baseline']:>12.4f} {r['candidate']:>12.4f} {r['delta']:>+9.4f}  {r['verdict']}" for r in rows]
    return "\n".join(lines)


def cases(results: DataFrame, limit: int | None = None, hardest_first: bool = True) -> DataFrame:
    """Rows for a report, the lowest scores first if asked for; equal scores by uid."""
    out = results.select("uid", "image_path", "pred_html", "true_html", F.col("teds_struct").alias("score"), "difficulty", "n_spanning")
    out = out.orderBy("score", "uid") if hardest_first else out.orderBy("uid")
    return out.limit(limit) if limit else out


def rewards(cells: DataFrame) -> DataFrame:
    """(uid, validity, total_reconciles): self-checks of one table. validity: half for any cell, a quarter for two
    rows and columns, a quarter by the share of filled cells. total_reconciles: 1 - relative error of the last
    total row against the sum of the rows above in the rightmost numeric column; null without one."""
    s = cells.groupBy("uid").agg(F.max(F.col("row") + F.col("rowspan")).alias("rows"), F.max(F.col("col") + F.col("colspan")).alias("cols"), (F.count_if(F.trim("text") != "") / F.count(F.lit(1))).alias("fill"))
    validity = F.lit(0.5) + F.when((F.col("rows") >= 2) & (F.col("cols") >= 2), 0.25).otherwise(0.0) + 0.25 * F.least(F.lit(1.0), "fill")
    v = cells.withColumn("v", number(F.col("text")))
    total = v.where(F.lower("text").rlike(r"\btotal\b")).groupBy("uid").agg(F.max("row").alias("total_row"))
    col = v.join(total, "uid").where("v is not null and row = total_row").groupBy("uid").agg(F.max("col").alias("col"), F.max_by("v", "col").alias("total"))
    above = v.join(total, "uid").join(col, ["uid", "col"]).where("row < total_row and v is not null").groupBy("uid").agg(F.sum("v").alias("above"))
    error = F.abs(F.col("above") - F.col("total")) / F.greatest(F.abs("total"), F.lit(1e-9))
    checked = col.join(above, "uid").select("uid", F.greatest(F.lit(0.0), 1 - error).alias("total_reconciles"))
    return s.select("uid", validity.alias("validity")).join(checked, "uid", "left")


def correctness(answer: Column, true: Column, tag: str = "SOLUTION", points: float = 2.0) -> Column:
    """Points for an answer whose text between the tags is the true one, white space at the ends aside, else none."""
    inside = F.regexp_extract(F.coalesce(answer, F.lit("")), f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when((F.trim(inside) != "") & (F.trim(inside) == F.trim(true)), points).otherwise(0.0)


def totals(cells: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(uid, col, items, subtotal, tax, total, items_reconcile, total_reconciles): whether the lines above a subtotal
    sum up to it, and it and the tax to the total, by column of numbers; null where one of them is missing.

    Rows go by their first text: subtotal, then tax, then total."""
    v = cells.withColumn("v", number(F.col("text")))
    label = cells.where("trim(text) <> ''").groupBy("uid", "row").agg(F.lower(F.min_by("text", "col")).alias("label"))
    kind = F.when(F.col("label").rlike(r"sub-?\s?total"), "subtotal").when(F.col("label").rlike(r"\b(tax|vat|gst)\b"), "tax").when(F.col("label").rlike(r"\btotal\b"), "total").otherwise("item")
    rows = v.where("v is not null").join(label.select("uid", "row", kind.alias("kind")), ["uid", "row"])
    first = rows.where("kind = 'subtotal'").groupBy("uid", "col").agg(F.min("row").alias("_row"))
    rows = rows.join(first, ["uid", "col"])
    one = lambda k: F.min_by("v", F.when(F.col("kind") == k, F.col("row")))
    s = rows.groupBy("uid", "col").agg(F.sum(F.when((F.col("kind") == "item") & (F.col("row") < F.col("_row")), F.col("v"))).alias("items"), *[one(k).alias(k) for k in ("subtotal", "tax", "total")])
    near = lambda a, b: F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return s.withColumn("items_reconcile", near(F.col("items"), F.col("subtotal"))).withColumn("total_reconciles", near(F.col("subtotal") + F.coalesce("tax", F.lit(0.0)), F.col("total")))


def diagnostics(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(uid, row_error, col_error, over_split, under_split, empty_recall): where a structure went wrong."""
    s = schema_match(pred, true)
    n = lambda d, name: d.groupBy("uid").agg(F.count(F.lit(1)).alias(name))
    counts = n(true, "nt").join(n(pred, "np"), "uid", "left").fillna(0, ["np"])
    blanks = placement(pred, true).select("uid", F.col("blank_preservation").alias("empty_recall"))
    out = s.join(counts, "uid").join(blanks, "uid", "left")
    return out.select("uid", F.abs(F.col("true_rows") - F.col("pred_rows")).alias("row_error"), F.abs(F.col("true_cols") - F.col("pred_cols")).alias("col_error"), F.greatest(F.lit(0), F.col("np") - F.col("nt")).alias("over_split"), F.greatest(F.lit(0), F.col("nt") - F.col("np")).alias("under_split"), "empty_recall")


def adjacency(cells: DataFrame) -> DataFrame:
    """(uid, a, b, direction): neighbouring non-blank texts in rows and columns."""
    c = cells.where("trim(text) <> ''").select("uid", "row", "col", "rowspan", "colspan", folded(F.col("text")).alias("t"))
    return _adjacency(c, ["uid"]).select("uid", "a", "b", "direction")


def _adjacency(c: DataFrame, key: list[str]) -> DataFrame:
    """adjacency() of (key, row, col, rowspan, colspan, t). Cells and what looks for them meet by position in one
    grouping, so that rows that lie together by table stay there."""
    at = lambda r, x, d: F.struct(r.alias("r"), x.alias("x"), F.lit(d).alias("direction"))
    row, col = F.col("row"), F.col("col")
    each = c.select(*key, "t", F.explode(F.array(at(row, col, ""), at(row, col + F.col("colspan"), "right"), at(row + F.col("rowspan"), col, "down"))).alias("n"))
    own = F.col("n.direction") == ""
    met = each.groupBy(*key, F.col("n.r").alias("r"), F.col("n.x").alias("x")).agg(F.collect_list(F.when(own, F.col("t"))).alias("here"), F.collect_list(F.when(~own, F.struct(F.col("t").alias("a"), F.col("n.direction").alias("direction")))).alias("near"))
    found = met.where("size(here) > 0 and size(near) > 0").select(*key, "here", F.explode("near").alias("n"))
    return found.select(*key, "n.a", F.explode("here").alias("b"), "n.direction")


def adjacency_f1(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(uid, adjacency_f1): agreement of neighbour relations, as bags."""
    of = lambda d, side: d.where("trim(text) <> ''").select("uid", F.lit(side).alias("side"), "row", "col", "rowspan", "colspan", folded(F.col("text")).alias("t"))
    both = _adjacency(of(true, 1).unionByName(of(pred, 0)), ["uid", "side"]).groupBy("uid", "a", "b", "direction").agg(F.count_if(F.col("side") == 1).alias("t"), F.count_if(F.col("side") == 0).alias("p"))
    s = both.groupBy("uid").agg(F.sum(F.least("t", "p")).alias("hit"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    return s.select("uid", F.when(F.col("t") + F.col("p") == 0, 1.0).otherwise(2 * F.col("hit") / (F.col("t") + F.col("p"))).alias("adjacency_f1"))


def reliability(results: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy, gap): calibration by equal bins of confidence."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    s = results.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return s.withColumn("gap", F.abs(F.col("mean_confidence") - F.col("accuracy")))


def calibration_error(results: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row (n, ece)."""
    return reliability(results, confidence, correct, bins).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


