"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are put in a hash-shuffled order and laid end to end as a stream of
words; the stream is cut into blocks of equally many words. A van der Corput sequence, mapped
through the sources' cumulative shares, says which source each slot of the mixture takes its next
block from, so that after any number of slots each source has had its share to within a few
blocks. Slots are ranked within their source and the k-th slot is joined to the k-th block.

Cases: a null or empty text has size 0, is in its source's stream and is never taken; a text of any length is cut
into as many blocks as it reaches; a null source is a source of its own, last in order, and sources may be very many;
repeated rows are rows of their own; ties in the
shuffled order fall by doc_id, size and text digest. An empty table gives an empty mixture.
Other columns of the input are kept as they are; names with a leading `_mix_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, chunked, n_words, running, written

#: Words in a block. Small beside any source worth mixing; a slot moves a share by so much at most.
BLOCK = 512
#: Shares by position in the sources' order, repeating.
WEIGHTS = (3, 1, 2)
#: The mixture's size against the input's, and how often a source may be read at most.
FACTOR, EPOCHS = 1.5, 2
#: Cells of the unit interval by which slots meet the sources' shares.
CELLS = 1024
#: Slots ranked in one window; slots of the mixture that stand in one partition (some 8 million words).
RUN, PART = 1 << 16, 1 << 14


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, epochs: int = EPOCHS) -> DataFrame:
    """(source, _mix_no, source_size, target): one row a source from its words.

    Shares of factor * all words by weight; what lies above epochs * a source's words goes to
    the others by weight until none is above. Sorted by what a source can hold for its weight,
    the sources that are filled up come first: the level is where that stops.
    sizes: (source, size) rows, summed here.
    """
    s = running(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], {}).withColumnRenamed("_at", "_mix_no")
    s = s.withColumn("_mix_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_mix_no") % len(weights) + 1).cast("int")))
    s = s.withColumn("_mix_cap", F.col("source_size") * F.lit(float(epochs))).withColumn("_mix_r", F.col("_mix_cap") / F.col("_mix_w"))
    s = running(s, [F.col("_mix_r"), F.col("_mix_no")], {"_mix_full": F.col("_mix_cap"), "_mix_past": F.col("_mix_w")}).drop("_at")
    every = s.agg((F.sum("source_size") * F.lit(factor)).alias("_mix_all"), F.sum("_mix_w").alias("_mix_ws"))
    s = written(s.crossJoin(F.broadcast(every)), "mix-sources")  # one row beside each
    level = (F.col("_mix_all") - F.col("_mix_full")) / (F.col("_mix_ws") - F.col("_mix_past"))
    at = s.where(level <= F.col("_mix_r")).agg(F.min(F.struct("_mix_r", "_mix_no", level.alias("level")))["level"].alias("_mix_at"))
    return s.crossJoin(F.broadcast(at)).select("source", "_mix_no", "source_size", F.least("_mix_cap", F.col("_mix_at") * F.col("_mix_w")).alias("target"))


def van_der_corput(i: Column, bits: int) -> Column:
    """i's bits in reverse order, as a fraction of 1. Exact below 2**52."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long") / F.lit(float(1 << bits))


def schedule(spark: SparkSession, shares: DataFrame) -> DataFrame:
    """(slot, _mix_no, block): which block of which source each slot of the mixture takes.

    shares: (_mix_no, blocks) rows, one a source. Each source gets just its number of slots: what
    the sequence gives it above that (a few slots a source, by the sequence's discrepancy) goes,
    in order, to the sources that it left short.
    """
    total = shares.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, int(total).bit_length())
    ends = running(shares.where("blocks > 0"), [F.col("_mix_no")], {"_before": F.col("blocks")}).drop("_at")
    arcs = ends.withColumn("_lo", F.col("_before") / F.lit(float(max(total, 1)))).withColumn("_hi", (F.col("_before") + F.col("blocks")) / F.lit(float(max(total, 1)))).drop("_before")
    arcs = arcs.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.floor(F.col("_hi") * CELLS))))
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn("_u", van_der_corput(F.col("slot"), bits)).withColumn("_cell", F.floor(F.col("_u") * CELLS))
    drawn = slots.join(arcs, (slots["_cell"] == arcs["_cell"]) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("slot", "_mix_no", "blocks")
    drawn = chunked(drawn, ["_mix_no"], ["slot"], F.lit(1), "_run", F.floor(F.col("slot") / RUN), RUN).withColumnRenamed("rank", "block").drop("before")
    drawn = written(drawn, "mix-drawn")
    kept = drawn.where("block < blocks")
    got = kept.groupBy("_mix_no").agg(F.count(F.lit(1)).alias("_got"))
    short = shares.join(got, "_mix_no", "left").where("blocks > coalesce(_got, 0)")
    short = short.select("_mix_no", F.explode(F.sequence(F.coalesce("_got", F.lit(0)).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    short = running(short, [F.col("_mix_no"), F.col("block")], {}).withColumnRenamed("_at", "_i")
    spare = running(drawn.where("block >= blocks").select("slot"), [F.col("slot")], {}).withColumnRenamed("_at", "_i")
    return kept.select("slot", "_mix_no", "block").union(spare.join(short, "_i").select("slot", "_mix_no", "block"))


def layout(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, epochs: int = EPOCHS, block: int = BLOCK, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source's stream, and the sources' targets.

    docs: doc_id, text, source and more. Added: size, source_size, target, _mix_no, _mix_need
    (words the mixture takes from the source), before (words ahead of it), rank.
    """
    keep = docs.columns if keep is None else keep
    rows = docs.withColumn("size", n_words(F.col("text")))
    rows = rows.withColumn("_mix_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_mix_text", F.xxhash64("text"))
    rows = rows.select(*keep, "size", "_mix_key", "_mix_text")
    if "text" not in keep:
        rows = written(rows, "mix-sizes", small=True)
    t = written(targets(rows.select("source", "size"), weights, factor, epochs).withColumn("_mix_need", F.floor(F.col("target") + 0.5).cast("long")), "mix-targets")
    n = t.count() and rows.count()
    digits = 1
    while 16**digits * 1000 < n:
        digits += 1
    of = t.withColumnRenamed("source", "_mix_source")
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")
    rows = chunked(rows, ["_mix_no"], ["_mix_key", "doc_id", "size", "_mix_text"], F.col("size"), "_mix_run", F.substring("_mix_key", 1, digits), 16**digits)
    return rows.drop("_mix_key", "_mix_text"), t


def pieces(placed: DataFrame, epochs: int = EPOCHS, block: int = BLOCK, keep_untaken: bool = False) -> DataFrame:
    """A row for each part of a document in a block of its source's stream: block, epoch, begin, end.

    begin, end: words of the document. A stream is read again from its start, at most epochs
    times; the last block ends where the source's target is met.
    """

    def of(epoch: int) -> Column:
        start = F.col("before") + F.lit(epoch) * F.col("source_size")
        end = F.least(start + F.col("size"), F.col("_mix_need"))
        blocks = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
        parts = F.transform(
            blocks,
            lambda k: F.struct(
                k.cast("long").alias("block"),
                F.lit(epoch).alias("epoch"),
                (F.greatest(start, k * block) - start).cast("long").alias("begin"),
                (F.least(end, (k + 1) * block) - start).cast("long").alias("end"),
            ),
        )
        return F.when((F.col("size") > 0) & (start < F.col("_mix_need")), parts).otherwise(F.array().cast("array<struct<block:bigint,epoch:int,begin:bigint,end:bigint>>"))

    put = F.explode_outer if keep_untaken else F.explode
    return placed.withColumn("_p", put(F.concat(*[of(e) for e in range(epochs)]))).select(*placed.columns, "_p.*")


def blocks_of(targets_: DataFrame, block: int = BLOCK) -> DataFrame:
    return targets_.select("_mix_no", F.ceil(F.col("_mix_need") / block).cast("long").alias("blocks"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """The mixture itself: a row for each part of a document that a slot takes.

    Columns: slot (the order of the mixture), block, epoch, begin, end (words of the text), rank, then
    those of docs but for any that has one of these names or of layout()'s. Sort by slot, epoch and rank
    for the stream.
    """
    docs = docs.drop("slot", "block", "epoch", "begin", "end", "rank", "size", "source_size", "target", "before")
    placed, t = layout(docs, weights, factor, epochs, block)
    taken = pieces(placed, epochs, block)
    return taken.join(schedule(docs.sparkSession, blocks_of(t, block)), ["_mix_no", "block"]).select("slot", "block", "epoch", "begin", "end", "rank", *docs.columns)


def taken_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot) of every document, without its text: the words
    that the schedule's slots take of it, and the first of these slots."""
    placed, t = layout(docs, weights, factor, epochs, block, keep=["doc_id", "source"])
    parts = pieces(placed, epochs, block, keep_untaken=True)
    slots = schedule(docs.sparkSession, blocks_of(t, block))
    key = ["doc_id", "source", "size", "source_size", "target", "_mix_no", "rank"]
    joined = parts.join(slots, ["_mix_no", "block"], "left")
    got = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("end") - F.col("begin"))), F.lit(0)).cast("long")
    return joined.groupBy(*key).agg(got.alias("taken"), F.min("slot").alias("first_slot")).drop("_mix_no", "rank")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """docs as the mixture has them: a row for each reading of a document, in docs' columns and in the schedule's
    order, by the slot that takes the reading's first block.

    A document that the mixture does not reach is not there; one that it reads twice is there
    twice; the one at which a source's target is met has its first words only.
    """
    rows = written(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-rows")  # fixes the row numbers
    placed, t = layout(rows, weights, factor, epochs, block, keep=["doc_id", "source", "_mix_row"])
    taken = pieces(placed, epochs, block).join(schedule(docs.sparkSession, blocks_of(t, block)), ["_mix_no", "block"])
    reads = taken.groupBy("_mix_row", "epoch").agg(F.sum(F.col("end") - F.col("begin")).alias("_mix_words"), F.any_value("size").alias("_mix_size"), F.min_by("slot", "block").alias("_mix_slot"), F.min("rank").alias("_mix_rank")).drop("epoch")
    reads = written(reads, "mix-reads")
    slots = (reads.agg(F.max("_mix_slot")).first()[0] or 0) + 1
    out = rows.join(reads, "_mix_row")
    whole = F.col("_mix_words") >= F.col("_mix_size")
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("_mix_words").cast("int")), " ")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    # Slots are of equal size, so that the range a row belongs to is known without a look at the joined rows.
    n = -(-slots // PART)
    part = F.floor(F.col("_mix_slot") / PART).cast("int")
    return out.repartitionById(n, part).sortWithinPartitions("_mix_slot", "_mix_rank", "_mix_row").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = taken_words(docs)
    return out.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), "taken", "first_slot")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][CAST(no % 3 AS INT) + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap,
         (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS everything FROM s),
v AS (
  SELECT *, cap / w AS r FROM w),
x AS (
  SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY r, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY r, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
t AS (
  SELECT source, no, source_size, least(cap, (SELECT level FROM x WHERE level <= r ORDER BY r, no LIMIT 1) * w) AS target FROM x),
p AS (
  SELECT d.doc_id, d.size, t.no, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS need,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
-- the schedule: van der Corput points over the sources' arcs
a0 AS (
  SELECT no, CAST(ceil(floor(target + 0.5) / 512) AS BIGINT) AS blocks FROM t),
a1 AS (
  SELECT no, blocks, coalesce(sum(blocks) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before, (SELECT sum(blocks) FROM a0)::BIGINT AS total FROM a0 WHERE blocks > 0),
a2 AS (
  SELECT no, blocks, total, before / total::DOUBLE AS lo, (before + blocks) / total::DOUBLE AS hi, CAST(floor(log2(total)) + 1 AS INT) AS bits FROM a1),
sl AS (
  SELECT slot, list_sum(list_transform(range(0, bits), lambda j: ((slot >> j) & 1::BIGINT) << (bits - 1 - j)))::DOUBLE / (1::BIGINT << bits)::DOUBLE AS u
  FROM (SELECT unnest(range(0, total)) AS slot, bits FROM (SELECT DISTINCT total, bits FROM a2))),
dr AS (
  SELECT slot, no, blocks, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS block FROM sl JOIN a2 ON u >= lo AND u < hi),
sh AS (
  SELECT a2.no, g.block, row_number() OVER (ORDER BY a2.no, g.block) AS i FROM a2 JOIN (SELECT no, unnest(range(0, blocks)) AS block FROM a2) g ON g.no = a2.no
  WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.no = a2.no AND dr.block = g.block)),
sp AS (
  SELECT slot, row_number() OVER (ORDER BY slot) AS i FROM dr WHERE block >= blocks),
sc AS (
  SELECT slot, no, block FROM dr WHERE block < blocks UNION ALL SELECT slot, no, block FROM sp JOIN sh USING (i)),
e AS (
  SELECT doc_id, size, no, source_size, target, need, b + source_size * k AS low, least(b + source_size * k + size, need) AS high FROM p, (VALUES (0), (1)) v(k)),
q AS (
  SELECT doc_id, no, low, high, unnest(range(low // 512, (high - 1) // 512 + 1)) AS block FROM e WHERE size > 0 AND low < need),
tk AS (
  SELECT q.doc_id, sum(least(q.high, (q.block + 1) * 512) - greatest(q.low, q.block * 512)) AS taken, min(sc.slot) AS first_slot FROM q JOIN sc ON sc.no = q.no AND sc.block = q.block GROUP BY q.doc_id)
SELECT p.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_slot FROM p LEFT JOIN tk ON tk.doc_id = p.doc_id
"""
