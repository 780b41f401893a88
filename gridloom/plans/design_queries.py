"""Queries on the operators of the design notes, and rewards, each beside the SQL that it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import design, metrics
from gridloom.plans import fixtures as X
from gridloom.plans.oracle import _PLACED, kind, with_base
from gridloom.plans.queries import _fragments

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def known(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return known


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return X.words(X.cells(spark, sf))


@query(with_base(_PLACED, "r AS (SELECT CASE WHEN content_placement >= 0.92 THEN 'accept' WHEN content_placement >= 0.7 THEN 'review' ELSE 'fallback' END AS route, blank_preservation = 1.0 AS ok FROM m)", last="SELECT route, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS precision FROM r GROUP BY route"))
def triage(spark: SparkSession, sf: str) -> DataFrame:
    true = X.cells(spark, sf)
    s = metrics.placement(X.predicted(true), true).withColumn("ok", F.col("blank_preservation") == 1.0)
    return design.triage(s, "content_placement", "ok").select("route", "n", F.round("share", 6).alias("share"), F.round("precision", 6).alias("precision"))


@query(
    with_base(
        "tp AS (SELECT uid, row AS tr, col AS tc, row + i AS y, col + j AS x FROM tru, (VALUES (0), (1), (2)) a(i), (VALUES (0), (1)) b(j) WHERE i < rowspan AND j < colspan), pp AS (SELECT uid, row AS pr, col AS pc, row + i AS y, col + j AS x FROM pred, (VALUES (0), (1), (2)) a(i), (VALUES (0), (1)) b(j) WHERE i < rowspan AND j < colspan)",
        "mt AS (SELECT DISTINCT uid, tr, tc, pr, pc FROM tp JOIN pp USING (uid, y, x)), ov AS (SELECT uid, count(*) AS n FROM (SELECT uid, tr, tc FROM mt GROUP BY ALL HAVING count(*) > 1) GROUP BY uid), un AS (SELECT uid, count(*) AS n FROM (SELECT uid, pr, pc FROM mt GROUP BY ALL HAVING count(*) > 1) GROUP BY uid)",
        "nt AS (SELECT uid, count(*) AS n, count(*) FILTER (rowspan > 1 OR colspan > 1) AS s FROM tru GROUP BY uid), np AS (SELECT uid, count(*) AS n FROM pred GROUP BY uid), hit AS (SELECT t.uid, count(*) AS n FROM tru t WHERE (rowspan > 1 OR colspan > 1) AND EXISTS (SELECT 1 FROM pred p WHERE p.uid = t.uid AND p.row = t.row AND p.col = t.col AND p.rowspan = t.rowspan AND p.colspan = t.colspan) GROUP BY t.uid)",
        last="SELECT nt.uid, round(coalesce(ov.n, 0) / nt.n::DOUBLE, 9) AS oversplit, round(CASE WHEN coalesce(np.n, 0) = 0 THEN 0.0 ELSE coalesce(un.n, 0) / np.n::DOUBLE END, 9) AS undersplit, round(CASE WHEN s = 0 THEN 0.0 ELSE 1 - coalesce(hit.n, 0) / s::DOUBLE END, 9) AS span_error FROM nt LEFT JOIN np USING (uid) LEFT JOIN ov USING (uid) LEFT JOIN un USING (uid) LEFT JOIN hit USING (uid)",
    )
)
def split_rates(spark: SparkSession, sf: str) -> DataFrame:
    true = X.cells(spark, sf)
    out = design.split_rates(X.predicted(true), true)
    return out.select("uid", *[F.round(c, 9).alias(c) for c in ("oversplit", "undersplit", "span_error")])


@query(with_base("l AS (SELECT doc_id, col, ord, row // 2 AS cell, lead(ord) OVER w AS nx, lead(row // 2) OVER w AS nc FROM words WINDOW w AS (PARTITION BY doc_id, col ORDER BY y, ord))", last="SELECT doc_id, col, ord, nx AS next, cell = nc AS same FROM l WHERE nx IS NOT NULL"))
def same_cell_labels(spark: SparkSession, sf: str) -> DataFrame:
    line = _words(spark, sf).withColumn("cell", F.floor(F.col("row") / 2))
    return design.same_cell(line).select("doc_id", "col", "ord", "next", "same")


@query(with_base(last="SELECT doc_id, row AS r, col AS c, 'cell r=' || row || ' c=' || col || ': its box does not hold fragment ' || ord || ' ''' || substr(text, 1, 30) || '''' AS message FROM words WHERE pk % 6 = 0 AND w > 6 OR pk % 6 = 1"))
def audit(spark: SparkSession, sf: str) -> DataFrame:
    """Cells whose box is cut short on the right, or lies one row too low."""
    b, pk = F.col("b"), F.col("pk")
    box = F.when(pk % 6 == 0, F.array(b[0], b[1], b[0] + (b[2] - b[0]) / 2 + 2, b[3])).when(pk % 6 == 1, F.array(b[0], b[1] + 20, b[2], b[3] + 20)).otherwise(b)
    word = _words(spark, sf)
    return design.audit(X.cell_list(word).withColumn("b", box), _fragments(word)).select("doc_id", "r", "c", "message")


@query(
    with_base(
        "v AS (SELECT doc_id, ord AS id, ord + step AS next, run, ((pk * 31 + ord * 17 + step * 13 + run * 7) % 20)::DOUBLE AS score FROM words, (VALUES (1), (2), (3)) s(step), (VALUES (0), (1), (2), (3)) r(run)), m AS (SELECT doc_id, id, next, avg(score) AS score, stddev_pop(score) AS dispersion, count(*) AS runs FROM v GROUP BY ALL)",
        last="SELECT doc_id, id, next, round(score, 9) AS score, round(dispersion, 6) AS dispersion, runs FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY m.score DESC, next) = 1",
    )
)
def order_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    w = _words(spark, sf)
    v = w.withColumn("step", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("run", F.explode(F.array(*map(F.lit, (0, 1, 2, 3)))))
    v = v.select("doc_id", "run", F.col("ord").alias("id"), (F.col("ord") + F.col("step")).alias("next"), ((F.col("pk") * 31 + F.col("ord") * 17 + F.col("step") * 13 + F.col("run") * 7) % 20).cast("double").alias("score"))
    return design.ensemble(v).select("doc_id", "id", "next", F.round("score", 9).alias("score"), F.round("dispersion", 6).alias("dispersion"), "runs")


@query(
    with_base(
        f"""l AS (SELECT doc_id, col, ord, text, x, y, w, h, {kind('text')} AS k, lead(ord) OVER o AS b_ord, lead(text) OVER o AS b_text, lead(x) OVER o AS b_x, lead(y) OVER o AS b_y, lead(w) OVER o AS b_w, lead(h) OVER o AS b_h, lead({kind('text')}) OVER o AS b_k FROM words WINDOW o AS (PARTITION BY doc_id, col ORDER BY y, ord)),
p AS (SELECT *, b_y - y - h AS gap FROM l WHERE b_ord IS NOT NULL), q AS (SELECT *, median(gap) OVER (PARTITION BY doc_id) AS mid FROM p),
bs AS (SELECT doc_id, col, ord, sum(n) AS others, max(n) AS most FROM (SELECT p.doc_id, p.col, p.ord, z.col AS c, count(*) AS n FROM p JOIN words z ON z.doc_id = p.doc_id AND z.col <> p.col AND z.y + z.h / 2 >= p.y AND z.y + z.h / 2 <= p.b_y + p.b_h GROUP BY ALL) GROUP BY ALL)""",
        last="""SELECT doc_id, col, ord, b_ord AS next, round(gap / 12.0::DOUBLE, 6) AS gap_norm, round(gap / greatest(abs(mid), 1e-9), 6) AS gap_vs_median, round(abs(x - b_x) / 12.0::DOUBLE, 6) AS left_diff, round(abs(x + w - b_x - b_w) / 12.0::DOUBLE, 6) AS right_diff,
 round(greatest(0, least(x + w, b_x + b_w) - greatest(x, b_x)) / greatest(least(w, b_w), 1e-9), 6) AS x_overlap, b_w < 0.9::DOUBLE * w AS bottom_shorter, CAST(coalesce(others, 0) AS BIGINT) AS lines_beside, coalesce(most, 0) <= 1 AS band_is_single_line,
 k IN ('numeric', 'amount', 'percent') AS top_is_number, b_k IN ('numeric', 'amount', 'percent') AS bottom_is_number, k = b_k AS kinds_match, regexp_matches(b_text, '^[a-z]') AS starts_lower, round(length(text) / greatest(length(b_text), 1)::DOUBLE, 6) AS length_ratio FROM q LEFT JOIN bs USING (doc_id, col, ord)""",
    )
)
def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    f = design.pair_features(_words(spark, sf))
    near = [F.round(c, 6).alias(c) for c in ("gap_norm", "gap_vs_median", "left_diff", "right_diff", "x_overlap", "length_ratio")]
    return f.select("doc_id", "col", "ord", "next", *near, "bottom_shorter", "lines_beside", "band_is_single_line", "top_is_number", "bottom_is_number", "kinds_match", "starts_lower")


@query(
    with_base(
        "t AS (SELECT uid, sum(CAST(qty AS DOUBLE)) AS items, max(pk) AS pk FROM lines GROUP BY uid), s AS (SELECT uid, items, items + CASE WHEN pk % 5 = 0 THEN 3 ELSE 0 END AS subtotal, CASE WHEN pk % 3 = 0 THEN NULL ELSE round(items / 10, 2) END AS tax, round(items * 1.1, 2) AS total FROM t)",
        last="SELECT uid, round(items, 6) AS items, round(subtotal, 6) AS subtotal, tax, total, abs(items - subtotal) <= 0.005::DOUBLE * greatest(abs(items), abs(subtotal), 1.0) AS items_reconcile, abs(subtotal + coalesce(tax, 0) - total) <= 0.005::DOUBLE * greatest(abs(subtotal + coalesce(tax, 0)), abs(total), 1.0) AS total_reconciles FROM s",
    )
)
def reconciled_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities with a subtotal, a tax and a total below them; some subtotals are wrong, some taxes are missing."""
    line = X.lines(spark, sf)
    s = line.groupBy("uid").agg(F.sum(F.col("qty").cast("double")).alias("items"), F.max("pk").alias("pk"), F.max("row").alias("last"))
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    sub = F.col("items") + F.when(F.col("pk") % 5 == 0, 3).otherwise(0)
    more = [("Subtotal", two(sub), F.lit(True)), ("VAT", two(F.col("items") / 10), F.col("pk") % 3 != 0), ("Total", two(F.col("items") * 1.1), F.lit(True))]
    cell = lambda col, text: F.struct(F.lit(col).alias("col"), text.alias("text"))
    rows = line.select("uid", "row", F.explode(F.array(cell(0, F.lit("line")), cell(1, F.col("qty")))).alias("c"))
    for i, (name, text, there) in enumerate(more, 1):
        rows = rows.union(s.where(there).select("uid", (F.col("last") + i).alias("row"), F.explode(F.array(cell(0, F.lit(name)), cell(1, text))).alias("c")))
    t = metrics.totals(rows.select("uid", "row", "c.*"))
    return t.select("uid", F.round("items", 6).alias("items"), F.round("subtotal", 6).alias("subtotal"), "tax", "total", "items_reconcile", "total_reconciles")


@query("SELECT conv_id, turn, CASE WHEN trim(text) <> '' AND (conv_id + turn) % 3 < 2 THEN CASE WHEN (conv_id + turn) % 3 = 0 THEN 2.0 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS reward FROM conversations")
def answer_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Right answers, answers with a letter too many, and right ones without tags."""
    s = (F.col("conv_id") + F.col("turn")) % 3
    text = F.coalesce("text", F.lit(""))
    raw = F.when(s == 0, F.concat(F.lit("so <SOLUTION>  "), text, F.lit(" </SOLUTION>"))).when(s == 1, F.concat(F.lit("<SOLUTION>"), text, F.lit("x</SOLUTION>"))).otherwise(text)
    return X.table(spark, sf, "conversations").select("conv_id", "turn", metrics.correctness(raw, text).alias("reward"))
