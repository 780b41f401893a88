"""A training corpus from raw documents in five stages, each one of gridloom.llm's operators.

Each stage takes what its predecessor kept, as documents (doc_id, text, lang, source, n_chars), and the
folder of the input tables; the last one returns the packed batches.

Cases: null and empty texts are clean, copies of nothing, and repeat nothing, and the mixture, which takes words, does
not take them; texts of any length go through whole. Rows without id stay as they are but for toxicity, repeats and the mixture.
Of rows that share an id each is judged by its own text: exact and near copies go, unlike texts stay. A null source is a
source of its own. Columns beyond the five stay, unless they are called like one that packing adds. An empty table gives an
empty one. What is not in labels, or null there, trains nothing; without labels nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import mixing, ngram_join, packing, suffixes, toxicity
from gridloom.llm.common import owned, release, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage whose scratch tables go when the next stage of the same run starts, but for what that reads."""

    @wraps(f)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(sf_dir, docs)
        with owned(sf_dir):
            return f(spark, docs, sf_dir)

    return run_


#: Bytes of a stage's input to each file of its result, where that gives two files a core at least.
FILE = 32 << 20


def gathered(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out in fewer files: as many as the documents that it was made of need, without a shuffle, in no order."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return out.coalesce(min(max(2 * out.sparkSession.sparkContext.defaultParallelism, -(-size // FILE)), 1 << 20))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labels of rows not held out, does not reject."""
    with owned(sf_dir):
        model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gathered(toxicity.clean(docs, model), docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word Jaccard similarity of 0.8 or more."""
    return gathered(ngram_join.one_of_each(docs, n=5, percent=80), docs)


@stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that stand earlier in the corpus."""
    return gathered(suffixes.deduplicated(docs), docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture of sources reads, as often as it reads them."""
    return mixing.mixed_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their length bucket, batch and place in it."""
    return gathered(packing.pack(docs), docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("suffix_dedup", drop_repeats), ("mixing", mix), ("packing", pack)]

#: Trained scores and dynamic programs are not for SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def then(done: DataFrame, named: tuple[str, Stage]) -> DataFrame:
        with owned(sf_dir):
            kept = written(done, f"before-{named[0]}")
        return named[1](spark, kept, sf_dir)

    return reduce(then, STAGES[1:], STAGES[0][1](spark, docs, sf_dir))
