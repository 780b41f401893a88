"""Several models on one evaluation set: runs, their ranking, and each against an anchor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import clean_prediction
from gridloom.operators import metrics
from gridloom.plans.models import called
from gridloom.sources.scratch import kept

ANCHOR = "qwen3-vl-30b-a3b"


def run(records: DataFrame, requests: DataFrame, models: dict) -> DataFrame:
    """Results (run_name and evaluate()'s columns) of every model on (uid, prompt, ...) requests. models: by name
    what called() opens, or None for one that has no client here and is passed over."""
    runs = []
    for name, model in models.items():
        if model is not None:
            answers = kept(called(requests, model).select("uid", clean_prediction(F.col("raw")).alias("html")), "answers")
            runs.append(metrics.evaluate(records, answers).withColumn("run_name", F.lit(name)))
    return kept(reduce(DataFrame.unionByName, runs), "bakeoff")


def ranked(results: DataFrame) -> DataFrame:
    """(run_name, n, mean_teds, ci_low, ci_high, ...) over all tables, the best first, equal ones by name."""
    return metrics.summarised(results).where("difficulty is null").drop("difficulty").orderBy(F.desc("mean_teds"), "run_name")


def against(results: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    """(run_name, difficulty, baseline, candidate, delta, significant, verdict): each other run against the anchor's."""
    s = kept(metrics.summarised(results), "summaries")
    base = s.where(F.col("run_name") == anchor).drop("run_name")
    names = [r["run_name"] for r in s.where(F.col("run_name") != anchor).select("run_name").distinct().orderBy("run_name").collect()]
    if not names:
        return metrics.compare(base, base).where("false").withColumn("run_name", F.lit(""))
    return reduce(DataFrame.unionByName, [metrics.compare(base, s.where(F.col("run_name") == n).drop("run_name")).withColumn("run_name", F.lit(n)) for n in names])


def probe(results: DataFrame, uids: DataFrame) -> DataFrame:
    """summary() of the same few tables in every run."""
    return metrics.summary(results.join(uids.select("uid"), "uid", "left_semi"))
