"""Scoring of predictions as they land: an addition to the batch operators, with the same code inside."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.functions.text import clean_prediction
from gridloom.operators import cells as C
from gridloom.operators.metrics import teds_score

LANDED = "uid string, raw string, at timestamp"


def predictions(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_a_batch).json(folder)


def scored(landed: DataFrame, records: DataFrame, late: str = "1 hour") -> DataFrame:
    """(uid, at, html, teds_struct) of the first prediction of each uid; what is later than the watermark and
    seen before is dropped. records: (uid, html), static."""
    once = landed.withWatermark("at", late).dropDuplicatesWithinWatermark(["uid"])
    both = once.join(records.select("uid", F.col("html").alias("true_html")), "uid")
    return both.withColumn("html", clean_prediction(F.col("raw"))).select("uid", "at", "html", teds_score("html", "true_html").alias("teds_struct"))


def scores_by_hour(scores: DataFrame) -> DataFrame:
    """(start, n, mean_teds) by hour of landing; scores keep their watermark."""
    return scores.groupBy(F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("teds_struct").alias("mean_teds")).select(F.col("window.start").alias("start"), "n", "mean_teds")


def run(scores: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet all that has landed, then stops; the next call goes on from the checkpoint."""
    return scores.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def complete(landed: DataFrame, drafts: int = 3) -> DataFrame:
    """(doc_id, draft, raw) of the documents all of whose drafts are there, once: the state holds those that are not."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        done = len(known) >= drafts
        for frame in frames:
            for draft, raw in zip(frame["draft"], frame["raw"], strict=True):
                known.setdefault(int(draft), raw)
        if not done and len(known) >= drafts:
            yield pd.DataFrame({"doc_id": key[0], "draft": list(known), "raw": list(known.values())})
        # Of a document that is done only the numbers stay, so that late copies are known.
        state.update((list(known), list(known.values()) if len(known) < drafts else [""] * len(known)))

    return landed.groupBy("doc_id").applyInPandasWithState(run, "doc_id string, draft int, raw string", "drafts array<int>, raws array<string>", "append", GroupStateTimeout.NoTimeout)


def voted(spark: SparkSession, folder: str, out: str, checkpoint: str, drafts: int = 3) -> StreamingQuery:
    """Votes over the drafts (doc_id, draft, raw) of each document once all of a document's drafts are there.

    A batch reads its own documents only, and one that is run again takes the place of what it wrote.
    """
    landed = spark.readStream.schema("doc_id string, draft int, raw string").json(folder)

    def batch(full: DataFrame, no: int) -> None:
        payloads = full.select("doc_id", "draft", C.payload_of(F.col("raw")).alias("payload"))
        C.vote(payloads)[0].write.mode("overwrite").parquet(f"{out}/batch={no}")

    return complete(landed, drafts).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
