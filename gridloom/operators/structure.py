"""Structure tokens, routing, and measures of page geometry from the design notes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.cells import positions
from gridloom.operators.folds import Rows, by_page, numbers

# Scores above which a table is accepted, or looked at; share that a fallback may add.
ACCEPT, REVIEW = 0.92, 0.70


def grid_tokens(cells: DataFrame) -> DataFrame:
    """(uid, tokens): one token a grid position, row by row: C a cell, L and U a cell that goes on from the
    left or from above, X from both, E a hole, NL a row's end. cells: (uid, ord, row, col, rowspan, colspan)."""
    c = cells.select(F.col("uid").alias("doc_id"), "ord", F.col("row").alias("r"), F.col("col").alias("c"), F.col("rowspan").alias("rs"), F.col("colspan").alias("cs"))
    token = F.when((F.col("y") == F.col("r")) & (F.col("x") == F.col("c")), "C").when(F.col("y") == F.col("r"), "L").when(F.col("x") == F.col("c"), "U").otherwise("X")
    at = positions(c).select("doc_id", "y", "x", token.alias("t"))
    dim = at.groupBy("doc_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    every = dim.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h")))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w"))))
    full = every.join(at, ["doc_id", "y", "x"], "left").select("doc_id", "y", "x", "w", F.coalesce("t", F.lit("E")).alias("t"))
    part = F.when(F.col("x") == F.col("w"), F.concat("t", F.lit(" NL"))).otherwise(F.col("t"))
    return full.groupBy(F.col("doc_id").alias("uid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", part.alias("t")))), lambda e: e["t"]), " ").alias("tokens"))


def cells_of_tokens(tokens: DataFrame) -> DataFrame:
    """(uid, row, col, rowspan, colspan) of (uid, tokens): the inverse of grid_tokens() for whole grids."""
    lines = tokens.select("uid", F.posexplode(F.split("tokens", " NL ?")).alias("row", "line")).where("line <> ''")
    at = lines.select("uid", "row", F.posexplode(F.split("line", " ")).alias("col", "t"))
    next_ = at.where("t in ('C', 'E')")
    across = Window.partitionBy("uid", "row").orderBy("col")
    down = Window.partitionBy("uid", "col").orderBy("row")
    at = at.withColumn("gap", F.coalesce(F.min(F.when(F.col("t") != "L", F.col("col"))).over(across.rowsBetween(1, Window.unboundedFollowing)), F.max("col").over(Window.partitionBy("uid", "row")) + 1))
    at = at.withColumn("fall", F.coalesce(F.min(F.when(F.col("t") != "U", F.col("row"))).over(down.rowsBetween(1, Window.unboundedFollowing)), F.max("row").over(Window.partitionBy("uid", "col")) + 1))
    return at.join(next_.select("uid", "row", "col"), ["uid", "row", "col"], "left_semi").where("t = 'C'").select("uid", "row", "col", (F.col("fall") - F.col("row")).alias("rowspan"), (F.col("gap") - F.col("col")).alias("colspan"))


def valid_next(token: Column) -> Column:
    """Tokens that may follow one in a row."""
    return F.when(token.isin("C", "L"), F.array(*map(F.lit, ("C", "L", "U", "E", "NL")))).when(token.isin("U", "X"), F.array(*map(F.lit, ("C", "U", "X", "E", "NL")))).otherwise(F.array(*map(F.lit, ("C", "U", "E", "NL"))))


def route(score: Column, lead: Column | None = None) -> Column:
    """accept, review or fallback by a consistency score; a clear lead of the best hypothesis counts 0.1."""
    s = score if lead is None else score + F.when(lead >= 0.1, 0.1).otherwise(0.0)
    return F.when(s >= ACCEPT, "accept").when(s >= REVIEW, "review").otherwise("fallback")


def consistency(terms: dict[str, float]) -> Column:
    """The weighted mean of columns that are shares of 1."""
    total = sum(terms.values())
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in terms.items()), F.lit(0.0)) / total


def best_hypothesis(hypotheses: DataFrame, score: str) -> DataFrame:
    """Of each doc_id the row of the highest score, the first hyp among equals."""
    rest = [c for c in hypotheses.columns if c != "doc_id"]
    return hypotheses.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col("hyp"))).alias("b")).select("doc_id", "b.*")


def overlap_share(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two intervals as a share of the shorter one."""
    short = F.least(a2 - a1, b2 - b1)
    return F.when(short <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1)) / short)


def body_band(words: DataFrame, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """(doc_id, page, low, high): the middle band of the words' heights on the page."""
    cy = F.col("y") + F.col("h") / 2
    return words.groupBy("doc_id", "page").agg(F.percentile(cy, low).alias("low"), F.percentile(cy, high).alias("high"))


def blocks(words: DataFrame, gap: float = 2.0) -> DataFrame:
    """words with block: a new one after an empty band of more than gap median heights, from the top."""
    height = words.groupBy("doc_id", "page").agg(F.percentile("h", 0.5).alias("m"))
    w = Window.partitionBy("doc_id", "page").orderBy("y", "ord")
    seen = words.join(height, ["doc_id", "page"]).withColumn("reach", F.max(F.col("y") + F.col("h")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = (F.col("y") - F.coalesce("reach", F.col("y")) > F.col("m") * gap).cast("int")
    return seen.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("m", "reach", "_new")


def best_skew(words: DataFrame, most: float = 3.0, steps: int = 61) -> DataFrame:
    """(doc_id, page, degrees): the angle that piles the words' centres into the sharpest columns.

    All angles are tried at once: counts by angle and bin, the largest sum of squares wins, the smallest
    turn among equals, to the left of two as small.
    """
    angles = sorted((-most + 2 * most * i / (steps - 1) for i in range(steps)), key=lambda a: (round(abs(a), 9), -a))

    def fold(rows: Rows, at: np.ndarray) -> tuple[np.ndarray, Rows]:
        pages = len(at) - 1
        page = np.repeat(np.arange(pages), np.diff(at))
        x, y, w, h = (numbers(rows[c]) for c in ("x", "y", "w", "h"))
        there = ~np.isnan(h)
        by = np.lexsort((h[there], page[there]))
        n = np.bincount(page[there], minlength=pages)
        tall, first = np.append(h[there][by], np.nan), np.cumsum(n) - n
        middle = (tall[np.where(n > 0, first + (n - 1) // 2, -1)] + tall[np.where(n > 0, first + n // 2, -1)]) / 2
        middle = np.fmax(middle, 1e-9)[page]
        best, degrees = np.full(pages, -1), np.zeros(pages)
        for a in angles:
            t = math.radians(a)
            bins = np.floor(((x + w / 2) * math.cos(t) + (y + h / 2) * math.sin(t)) / middle)
            order = np.lexsort((bins, page))
            p, b = page[order], bins[order]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | ((b[1:] != b[:-1]) & ~(np.isnan(b[1:]) & np.isnan(b[:-1])))
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(p)))
            sharp = np.bincount(p[starts], size * size, pages).astype(np.int64)
            better = sharp > best
            best[better], degrees[better] = sharp[better], a
        return at[:-1], {"degrees": pa.array(degrees)}

    place = words.where("doc_id is not null and page is not null").select("doc_id", "page", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")])
    return by_page(place, ["doc_id", "page"], fold, "degrees double", ("x", "y", "w", "h"))


def edge_accuracy(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(doc_id, edges, edge_accuracy): share of neighbours in the true reading order that are neighbours in the
    predicted one. Both: (doc_id, id, place)."""
    edge = lambda d: d.withColumn("next", F.lead("id").over(Window.partitionBy("doc_id").orderBy("place"))).where("next is not null").select("doc_id", "id", "next")
    hit = edge(true).join(edge(pred).withColumn("hit", F.lit(1)), ["doc_id", "id", "next"], "left")
    return hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"), (F.count("hit") / F.count(F.lit(1))).alias("edge_accuracy"))


def without_repeated_headers(rows: DataFrame) -> DataFrame:
    """rows (doc_id, page, row, cells, kind) of all pages as one table: a header that an earlier page has is left
    out, rows are numbered through."""
    key = F.array_join("cells", "␟")
    w = Window.partitionBy("doc_id", key).orderBy("page", "row")
    kept = rows.withColumn("_n", F.row_number().over(w)).where("kind <> 'header' or _n = 1").drop("_n")
    return kept.withColumn("line", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "row")) - 1)


def line_pairs(rows: DataFrame) -> DataFrame:
    """(doc_id, page, row, ...): what tells whether a row goes on in the next one: distance of the centres in
    pitches, filled columns of both, columns filled in both, whether the next row starts blank."""
    w = Window.partitionBy("doc_id", "page").orderBy("row")
    filled = F.transform(F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda e: F.trim(e["c"]) != ""), lambda e: e["i"])
    seen = rows.withColumn("f", filled).withColumn("g", F.lead("f").over(w)).withColumn("gap", F.lead("cy").over(w) - F.col("cy"))
    middle = F.percentile("gap", 0.5).over(Window.partitionBy("doc_id", "page"))
    seen = seen.withColumn("gap_in_pitches", F.col("gap") / F.greatest(middle, F.lit(1e-9))).where("g is not null")
    return seen.select("doc_id", "page", "row", "gap_in_pitches", F.size("f").alias("filled"), F.size("g").alias("next_filled"), F.size(F.array_intersect("f", "g")).alias("both_filled"), (~F.array_contains("g", 0)).alias("starts_blank"))


def fill_rate(cells: DataFrame, fragments: DataFrame) -> DataFrame:
    """(doc_id, used, once, fill, ok): whether each fragment is in one cell and a sound share of cells is filled."""
    refs = cells.select("doc_id", F.explode("f").alias("id")).groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n"))
    s = fragments.select("doc_id", "id").join(refs, ["doc_id", "id"], "left").groupBy("doc_id").agg(F.count("n").alias("used"), F.count_if(F.col("n") == 1).alias("once"), F.count(F.lit(1)).alias("all"))
    share = cells.groupBy("doc_id").agg(F.avg((F.coalesce(F.size("f"), F.lit(0)) > 0).cast("double")).alias("fill"))
    return s.join(share, "doc_id").select("doc_id", "used", "once", "fill", ((F.col("once") == F.col("all")) & F.col("fill").between(0.3, 1.0)).alias("ok"))
