"""Tables that cut a long plan in two, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is missing (tests, one machine), a folder under the system's temporary
    folder is used and kept for the session; on a cluster that is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("gridloom.scratch", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
    spark.conf.set("gridloom.scratch", own)
    return own


#: Tables made and not yet deleted; the last list is that of the innermost passing().
_made: list[list[str]] = [[]]


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it is computed once, and what follows starts from files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(left: DataFrame, right: DataFrame, on: str | list[str] = "doc_id", how: str = "inner") -> DataFrame:
    """left joined to right by sorting. Files of rows that are alike are a small part of what they hold; joins that are
    planned by them would collect on the driver, and broadcast, a row for each document or cell."""
    return left.join(right.hint("merge"), on, how)


def kept_parts(parts: list[DataFrame], name: str = "table") -> DataFrame:
    """kept() of the union of parts, which are written one after another: the driver plans and runs one at a time."""
    first, path = parts[0], f"{shared_dir(parts[0].sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    for i, part in enumerate(parts):
        part.select(*first.columns).write.parquet(f"{path}/{i}")
    return first.sparkSession.read.schema(first.schema).parquet(*[f"{path}/{i}" for i in range(len(parts))])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside are deleted at the end: what goes on from there has to be lasting()."""
    _made.append([])
    try:
        yield
    finally:
        _delete(spark, _made.pop())


def lasting(df: DataFrame, name: str = "result") -> DataFrame:
    """kept(), outside of the innermost passing()."""
    own = _made.pop()
    try:
        return kept(df, name)
    finally:
        _made.append(own)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this session has kept: results that read them are done."""
    for paths in _made:
        _delete(spark, paths)
        paths.clear()
