"""What several operators share: scratch tables, distributed ranks and running sums, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.sources.scratch import shared_dir

T = TypeVar("T")
#: What separates words: space and 0x09-0x0D. Fixed values.
SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch on its way to Python and back: batches of long texts stay small in both.
BATCH = "8m"


def lean(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session does so more tightly itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB"):
        spark.conf.set(key, BATCH)


#: Files of scratch tables in a folder mounted as file: have no checksum files beside them, and their modes are set by
#: java.nio. Where Hadoop's native library is absent its own classes start a chmod process for each file and folder made,
#: which shares the JVM's memory until it is that command.
PLAIN = """package gridloom;
public class PlainFiles extends org.apache.hadoop.fs.RawLocalFileSystem {
  public void setPermission(org.apache.hadoop.fs.Path p, org.apache.hadoop.fs.permission.FsPermission mode) throws java.io.IOException {
    String bits = new org.apache.hadoop.fs.permission.FsPermission((short) (mode.toShort() & 511)).toString();
    java.nio.file.Files.setPosixFilePermissions(pathToFile(p).toPath(), java.nio.file.attribute.PosixFilePermissions.fromString(bits));
  }
}"""
SCRATCH = {"fs.file.impl": "gridloom.PlainFiles", "fs.file.impl.disable.cache": "true"}
#: The application that has the class.
_has_plain: list[str | None] = [None]


def plain_files(spark: SparkSession) -> dict[str, str]:
    """Options of a write by PLAIN, compiled once an application by the compiler that Spark's generated code goes through."""
    sc = spark.sparkContext
    if _has_plain[0] != sc.applicationId:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(PLAIN)
        jar = f"{os.path.realpath(tempfile.mkdtemp(prefix='gridloom-'))}/plain.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(jar)  # for the executors
        conf, urls = sc._jsc.hadoopConfiguration(), sc._gateway.new_array(sc._jvm.java.net.URL, 1)
        urls[0] = sc._jvm.java.io.File(jar).toURI().toURL()
        conf.setClassLoader(sc._jvm.java.net.URLClassLoader(urls, conf.getClassLoader()))
        _has_plain[0] = sc.applicationId
    return SCRATCH


#: Scratch tables by owner, in the order they were made.
_made: list[tuple[str | None, str]] = []
_owner: list[str | None] = [None]


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Scratch tables made inside are the owner's, which may release() them."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def release(owner: str, keep: DataFrame) -> None:
    """Deletes the owner's scratch tables but for those that keep reads."""
    mine = [p for o, p in _made if o == owner]
    if not mine:
        return
    used = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()}
    jvm, conf = keep.sparkSession.sparkContext._jvm, keep.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in mine:
        if path.rpartition("/")[2] not in used:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            _made.remove((owner, path))


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors.

    small: rows are few bytes beside what their tasks read; they are brought together into files of the advised
    partition size, where else each task would leave a tiny one.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if small else df
    lean(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**plain_files(spark)).parquet(path)
    if _owner[-1] is not None:
        _made.append((_owner[-1], path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shipped(spark: SparkSession, value: T) -> Iterator[Broadcast[T]]:
    """value as a broadcast for the jobs that end inside; then it goes, on the executors as well."""
    sent = spark.sparkContext.broadcast(value)
    try:
        yield sent
    finally:
        sent.destroy()


def drop_scratch(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def chunked(df: DataFrame, group: list[str], order: list[str], size: Column, chunk: str, key: Column, n_chunks: int) -> DataFrame:
    """Adds before (sum of size over earlier rows of the group) and rank (number of them).

    The order is by key's chunk, then by the order columns, which must start with the value
    that key falls from monotonically. A group of any size is spread over n_chunks windows; only
    one sum for each group and chunk is carried between them. The group's columns hold no null.
    """
    df = df.withColumn(chunk, key)
    sums = df.groupBy(*group, chunk).agg(F.sum(size).alias("_s"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col(chunk).alias("_c"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"))
    cond = F.col(chunk) == F.col("_c")
    for g in group:  # plain equality, so that the windows' partitioning serves the join as well
        cond &= F.col(g) == F.col(f"_g_{g}")
    own = Window.partitionBy(*group, chunk).orderBy(*order)
    inside = df.withColumn("before", F.coalesce(F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rank", F.row_number().over(own) - 1)
    return (
        inside.join(starts, cond)
        .withColumn("before", F.col("before") + F.col("_s0"))
        .withColumn("rank", (F.col("rank") + F.col("_n0")).cast("long"))
        .drop("_s0", "_n0", "_c", chunk, *[f"_g_{g}" for g in group])
    )


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with _at, the number of rows before in the order, and of each of sums its sum over those.

    By ranges of the order: no task holds all rows, and one sum a range is carried between them. The order
    has to tell all rows apart.
    """
    low = written(df.withColumns({f"_v_{c}": v for c, v in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = {"_at": F.count(F.lit(1)), **{c: F.sum(f"_v_{c}") for c in sums}}
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = low.groupBy("_range").agg(*[v.alias(f"_t_{c}") for c, v in totals.items()]).select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_s_{c}") for c in totals])
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = low.withColumns({"_i__at": F.count(F.lit(1)).over(w), **{f"_i_{c}": F.coalesce(F.sum(f"_v_{c}").over(w), F.lit(0)) for c in sums}})
    out = inside.join(F.broadcast(starts), "_range")
    return out.select(*df.columns, *[(F.col(f"_s_{c}") + F.col(f"_i_{c}")).alias(c) for c in totals])


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """Rows of the highest counts, at most limit, found by a histogram rather than by one task's sort.

    Counts below 1024 are cells of their own, above a cell is a 1/64 of an octave; the last cell that
    would go over the limit is left out whole, so that equal counts are treated alike.
    """
    n = F.col(count)
    octave = F.floor(F.log2(F.greatest(n, F.lit(1024)).cast("double")))
    step = F.pow(F.lit(2.0), octave - 6)
    cell = F.when(n < 1024, n).otherwise((F.floor(n / step) * step).cast("long"))
    cells = sorted(((r["c"], r["n"]) for r in df.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = None, 0
    for c, k in cells:
        total += k
        if total > limit:
            break
        least = c
    return df.where(n >= least) if least is not None else df.where("false")


#: Edges of a node above which they are dealt over several tasks; rows of a table that may be broadcast.
HUB, SMALL = 256, 100_000


def dealt_join(rows: DataFrame, other: DataFrame, key: str, by: Column) -> DataFrame:
    """rows joined to other's one row a key, where the rows of a frequent key go to several tasks.

    Keys of more than HUB rows have their row of other once for each of the tasks; they are few beside the
    rows (at most one in HUB), and broadcast only as long as a count says that they are SMALL.
    """
    hubs = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HUB).select(key, F.ceil(F.col("_n") / HUB).cast("int").alias("_salts"))
    hubs = written(hubs, "hubs")
    n = hubs.count()
    if not n:
        return rows.join(other, key)
    hubs = F.broadcast(hubs) if n <= SMALL else hubs
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hubs, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    right = other.join(hubs, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b): the smallest node it reaches.

    Alternates large-star and small-star steps, which end after about log(n) rounds. Each round's
    edges are written to the shared folder. A node of very many edges is spread: by the partial minimum of
    the aggregation, and by dealt_join() where its edges take up that minimum.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, "edges")
    last = None
    for _ in range(max_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = dealt_join(both, least, "a", F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = written(small, "edges")
        stat = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("decimal(20,0)")).alias("h"), F.countDistinct("a").alias("d")).first()
        drop_scratch(edges)
        edges = new
        if last == (stat["n"], stat["h"]) and stat["d"] == stat["n"]:
            break
        last = (stat["n"], stat["h"])
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
