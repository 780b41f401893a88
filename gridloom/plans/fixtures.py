"""Document tables made from the star schema, so that every operator can be run on the given data.

A table is an order, a row a line of it; seven columns. Predictions, drafts and words are the same cells
with errors put in by the part's key. LINES is one text for both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = """
SELECT l_orderkey AS uid, l_partkey AS pk, p_name AS name, CAST(CAST(l_quantity AS INT) AS STRING) AS qty,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) AS price, l_returnflag AS flag,
  CASE WHEN l_tax = 0 THEN '' ELSE CAST(CAST(round(l_tax * 100) AS INT) AS STRING) || '%' END AS tax,
  CASE WHEN l_discount = 0 THEN '' ELSE CAST(CAST(round(l_discount * 100) AS INT) AS STRING) || '%' END AS disc,
  l_linestatus AS status,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS row
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
COLUMNS = ("name", "qty", "price", "flag", "tax", "disc", "status")
KINDS = ("text", "numeric", "amount", "symbol", "percent", "percent", "symbol")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Parts whose names are sent to every executor (the join of more of them is shuffled), and lines that a task sorts without spilling.
NAMES, LINES_A_TASK = 2_000_000, 30_000


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """LINES, its rows dealt out by uid itself: what goes on by table or document needs no further exchange.

    The engine can't tell that LINES' uid is the key that its window dealt out, and deals all that follows out again;
    it also ships the printed values, which here are made of the narrow ones after the exchange.
    """
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("name"))
    rows, keys, apart = part.agg(F.count(F.lit(1)), F.count("pk"), F.count_distinct("pk")).first()
    line = table(spark, sf, "lineitem")
    tasks = line.count() // LINES_A_TASK
    line = line.withColumnsRenamed({"l_orderkey": "uid", "l_partkey": "pk"}).withColumn("l_extendedprice", F.col("l_extendedprice").cast("decimal(12,2)"))
    # Where a name is sent to the executors and there is one for a key, it joins after the exchange; lines without part are numbered no more.
    late = rows <= NAMES and keys == apart
    part = F.broadcast(part) if rows <= NAMES else part
    line = line.join(F.broadcast(part.select("pk")), "pk", "left_semi") if late else line.join(part, "pk")
    line = line.repartition(tasks, "uid") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else line
    place = F.row_number().over(Window.partitionBy("uid").orderBy("l_linenumber", "pk", "l_suppkey", "l_quantity"))
    line = line.withColumn("row", (place - 1).cast("int"))
    line = line.join(part, "pk") if late else line
    share = lambda n, v: f"CASE WHEN {v} = 0 THEN '' ELSE CAST(CAST(round({v} * 100) AS INT) AS STRING) || '%' END AS {n}"
    return line.selectExpr("uid", "pk", "name", "CAST(CAST(l_quantity AS INT) AS STRING) AS qty", "CAST(l_extendedprice AS STRING) AS price", "l_returnflag AS flag", share("tax", "l_tax"), share("disc", "l_discount"), "l_linestatus AS status", "row")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(uid, pk, row, col, text, rowspan, colspan): the true tables."""
    c = lines(spark, sf).select("uid", "pk", "row", F.posexplode(F.array(*COLUMNS)).alias("col", "text"))
    return c.withColumn("colspan", F.when((F.col("col") == 0) & (F.col("pk") % 5 == 0), 2).otherwise(1)).withColumn("rowspan", F.when((F.col("col") == 3) & (F.col("pk") % 9 == 0), 2).otherwise(1))


def predicted(true: DataFrame) -> DataFrame:
    """cells with values shifted left where the part's key is a multiple of 7, prices lost where of 11, spans
    lost where of 10 and too long where of 27."""
    pk, col = F.col("pk"), F.col("col")
    kept = true.where(~((pk % 11 == 0) & (col == 2)) & ~((pk % 7 == 0) & (col == 0)))
    kept = kept.withColumn("col", F.when(pk % 7 == 0, col - 1).otherwise(col))
    return kept.withColumn("colspan", F.when(pk % 10 == 0, 1).otherwise(F.col("colspan"))).withColumn("rowspan", F.when((pk % 27 == 0) & (F.col("rowspan") == 2), 3).otherwise(F.col("rowspan")))


def words(true: DataFrame) -> DataFrame:
    """(doc_id, page, ord, text, x, y, w, h, pk, row, col) of the cells that are not blank."""
    w = true.where("text <> ''")
    return w.select(F.col("uid").alias("doc_id"), F.lit(1).alias("page"), (F.col("row") * 7 + F.col("col")).alias("ord"), "text", (F.col("col") * 100 + F.col("pk") % 13).cast("double").alias("x"), (F.col("row") * 20 + F.col("pk") % 5).cast("double").alias("y"), (F.length("text") * 7).cast("double").alias("w"), F.lit(12.0).alias("h"), "pk", "row", "col")


def reads(word: DataFrame) -> DataFrame:
    """Three reads of each word, each a little to the right; the third misreads where the key is a multiple of 4."""
    each = word.withColumn("read", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    wrong = (F.col("read") == 2) & (F.col("pk") % 4 == 0)
    return each.select("doc_id", "page", (F.col("read") * 100000 + F.col("ord")).alias("ord"), F.when(wrong, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"), (F.col("x") + F.col("read")).alias("x"), "y", "w", "h")


def moved_reads(word: DataFrame) -> DataFrame:
    """Three reads of each word, 20 to 49 hundredths of its width apart by the part's key; rows from the fourth on
    are on a second page, and the third read misreads where the key is a multiple of 4."""
    each = word.withColumn("read", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    wrong = (F.col("read") == 2) & (F.col("pk") % 4 == 0)
    x = F.col("x") + F.col("read") * F.col("w") * (20 + F.col("pk") % 30) / 100.0
    return each.select("doc_id", F.when(F.col("row") >= 3, 2).otherwise(1).alias("page"), (F.col("read") * 100000 + F.col("ord")).alias("ord"), F.when(wrong, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"), x.alias("x"), "y", "w", "h")


def tilted(word: DataFrame) -> DataFrame:
    return word.withColumn("y", (F.col("row") * 20 + (F.col("pk") * 7 + F.col("col") * 5) % 17).cast("double"))


# Shapes of a model's answer around a text (@).
TABLE_ANSWERS = (
    "Here it is:\n```html\n<table><tr><td>@</td></tr></table>\n```\nThat is all.",
    "  <TABLE><tr><td>@</td></tr></Table> and more",
    "```\n@\n```\nthen\n```html\nsee <table><tr><td>@</td></tr></table> </table> end\n```",
    "cut off: <table><tr><td>@ \n",
    "@",
)
THOUGHTS = ("<THINK>first\nthis</think> answer @", "@<think>a</think>b<think>\nc</Think>\n", "<think>never closed @ ", " \t@\r\n", "<think>@</think>")


def cell_list(word: DataFrame) -> DataFrame:
    """(doc_id, ord, r, c, rs, cs, h, t, b, p, f): a cell for each word, citing it."""
    box = F.array(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    return word.select("doc_id", "ord", F.col("row").alias("r"), F.col("col").alias("c"), F.lit(1).alias("rs"), F.lit(1).alias("cs"), F.lit(False).alias("h"), F.col("text").alias("t"), box.alias("b"), F.lit(1).alias("p"), F.array("ord").cast("array<int>").alias("f"), "pk")


def payloads(cell: DataFrame, *keys: str, passed: Column | None = None) -> DataFrame:
    """(keys, payload) with the seven columns declared. passed: the fragments it ignores, an aggregate over its cells."""
    keys = keys or ("doc_id",)
    item = F.struct(*[F.col(x) for x in ("r", "c", "rs", "cs", "h", "t", "b", "p", "f")])
    columns = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in zip(COLUMNS, KINDS, strict=True)])
    lists = cell.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("e")))), lambda x: x["e"]).alias("cells"), *([] if passed is None else [passed.alias("ignored")]))
    none = lambda t: F.lit(None).cast(t)
    return lists.select(*keys, F.struct(columns.alias("columns"), "cells", (none("array<int>") if passed is None else F.col("ignored")).alias("ignored"), none("array<struct<t:string,b:array<double>,p:int>>").alias("ocr_missed")).alias("payload"))


def html(cell: DataFrame, uid: str = "uid") -> DataFrame:
    """(uid, html) of (uid, row, col, text) cells, as plain tables."""
    rows = cell.groupBy(uid, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda e: F.concat(F.lit("<td>"), e["text"], F.lit("</td>"))), "").alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "s"))), lambda e: F.concat(F.lit("<tr>"), e["s"], F.lit("</tr>"))), "")
    return rows.groupBy(uid).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def printed(line: DataFrame) -> DataFrame:
    """(uid, n_rows, html, pred_html): html() of the cells() of lines and of what is predicted() of them, written row by row in one grouping."""
    td = {c: F.concat(F.lit("<td>"), F.col(c), F.lit("</td>")) for c in COLUMNS}
    seen = td | {"name": F.when(F.col("pk") % 7 != 0, td["name"]), "price": F.when(F.col("pk") % 11 != 0, td["price"])}
    tr = lambda cells: F.concat(F.lit("<tr>"), F.concat_ws("", *cells.values()), F.lit("</tr>"))
    rows = line.select("uid", F.struct("row", tr(td).alias("html"), tr(seen).alias("pred_html")).alias("r")).groupBy("uid").agg(F.sort_array(F.collect_list("r")).alias("r"))
    whole = lambda c: F.concat(F.lit("<table>"), F.array_join(F.col(f"r.{c}"), ""), F.lit("</table>")).alias(c)
    return rows.select("uid", (F.element_at("r", -1)["row"] + 1).alias("n_rows"), whole("html"), whole("pred_html"))


def difficulty(rows: Column) -> Column:
    return F.when(rows <= 3, "easy").when(rows <= 5, "medium").otherwise("hard")
