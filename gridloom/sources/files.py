"""Manifests, runs, labels and pictures as files."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLEXITY = "struct<n_rows:int,n_cols:int,n_cells:int,n_spanning:int,max_rowspan:int,max_colspan:int,header_depth:int,hole_ratio:double,span_ratio:double,score:double,bin:string>"
MANIFEST = f"uid string, image_path string, html string, complexity {COMPLEXITY}"
RESULT = "uid string, difficulty string, teds_struct double, span_recall double, span_f1 double, n_spanning int, pred_html string, true_html string, image_path string, parse_failed boolean, content_placement double, blank_preservation double, schema_cols_correct boolean"


def write_manifest(rows: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines in order of uid. single: one file, for small manifests; else as many as the sort makes."""
    rows = rows.orderBy("uid")
    (rows.coalesce(1) if single else rows).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest, with relative image paths under its folder. A missing path raises."""
    rows = spark.read.schema(MANIFEST).json(path)
    image = F.col("image_path")
    full = F.when(image.isNull() | image.startswith("/") | image.rlike("^[a-z0-9+.-]+://"), image).otherwise(F.concat(F.lit(path.rstrip("/") + "/"), image))
    return rows.withColumn("image_path", full)


def write_run(results: DataFrame, summary: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run's results; what older files lack gets its default."""
    rows = spark.read.schema(RESULT).json(f"{path}/results")
    return rows.fillna({"pred_html": "", "true_html": "", "image_path": "", "n_spanning": 0, "parse_failed": False, "content_placement": 0.0, "blank_preservation": 0.0, "schema_cols_correct": False})


def append_labels(new: DataFrame, path: str, known: DataFrame | None = None, tables_only: bool = False) -> None:
    """Adds (uid, html) labels that the file lacks, so that a stopped run can go on."""
    rows = new.where(F.col("html").startswith("<table")) if tables_only else new
    rows = rows if known is None else rows.join(known.select("uid"), "uid", "left_anti")
    rows.write.mode("append").json(path)


def manifest_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def manifest_of(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The manifest at path; where there is none, what build() makes is written there first."""
    if not manifest_exists(spark, path):
        write_manifest(build(), path)
    return read_manifest(spark, path)


def images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, image): pictures decoded by Spark's own source; those it can't decode are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("path"), "image")


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=60) as reply:
        return reply.read()


def downloaded(rows: DataFrame, url: str = "image_url", get: Callable[[str], bytes] = _get) -> DataFrame:
    """rows with content and ok; a download that fails is not ok and fails nothing else."""
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content = []
            for u in frame[url]:
                try:
                    content.append(get(u))
                except (OSError, ValueError):
                    content.append(None)
            yield frame.assign(content=content, ok=[c is not None for c in content])[[*names, "content", "ok"]]

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kind}, content binary, ok boolean")
