"""A run as one page of HTML: means by bin, then predicted beside true tables, merged cells marked."""

from __future__ import annotations

import re
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px}.span{background:#fde9a9}.good{color:#177245}.mid{color:#a66b00}.bad{color:#b3261e}.pair{display:flex;gap:2em}"


def grade(score: float) -> str:
    return "good" if score >= 0.90 else "mid" if score >= 0.70 else "bad"


def marked(html: str) -> str:
    """Cells over several rows or columns get a class."""
    return re.sub(r"<(t[dh])((?=[^>]*(?:row|col)span=)[^>]*)>", r'<\1 class="span"\2>', html or "")


def bins(results: DataFrame) -> DataFrame:
    return results.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).orderBy("difficulty")


def page(cases: DataFrame, title: str, limit: int = 50) -> str:
    """The report on the first limit cases, by score; only those come to the driver."""
    rows = cases.orderBy("score", "uid").limit(limit).collect()
    out = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><style>{STYLE}</style><h1>{escape(title)}</h1><table><tr><th>bin<th>n<th>mean</tr>"]
    out += [f"<tr><td>{escape(b['difficulty'] or '')}<td>{b['n']}<td class={grade(b['mean'])}>{b['mean']:.3f}</tr>" for b in bins(cases).collect()]
    out.append("</table>")
    for r in rows:
        out.append(f"<h2>{escape(r['uid'])} <span class={grade(r['score'])}>{r['score']:.3f}</span></h2><div class=pair><div>{marked(r['pred_html'])}</div><div>{marked(r['true_html'])}</div></div>")
    return "".join(out)


def write(cases: DataFrame, path: str, title: str, limit: int = 50) -> None:
    spark = cases.sparkSession
    spark.createDataFrame([(page(cases, title, limit),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def exit_code(results: DataFrame) -> int:
    """1 if a document has problems left, else 0."""
    return int(results.where("n_problems > 0").limit(1).count() > 0)
