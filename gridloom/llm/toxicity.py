"""Toxicity by maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled documents: of each token, the log-odds of standing in a toxic
against a clean document under an informative Dirichlet prior (the pooled rates); tokens whose
counts differ surely (by the log-likelihood ratio) keep them, all tokens lose a small drift, so that
clean text scores below 0 on average. A longer word that is not in the model goes by its first bytes. A linear-time scan finds all maximal scoring segments of a text.
Under the clean tokens' distribution their scores follow an extreme-value law, whose scale is
the root of a moment equation and whose constant comes from the number of high segments in clean documents; a segment is
significant by its expected number of equals in clean text as long. A text's significant normalised scores add up,
and a logistic curve fitted on the sample turns the sum into a probability. Constant and curve are fitted across two
folds: each half of the sample is scanned by a model of the other half's tokens.

Tokens are runs of letters and digits, A-Z lower-cased, over the whole text. Labels, language,
source and id are no input of a score. Near copies count once in the fit: sampled documents that
share a minimum hash of their 5-token shingles are one.

Cases: a null or empty text has no segment and gets the score of such texts; texts of any length are scanned whole; ids
repeated in the labels are toxic if any row says so, null labels are as none; without labels every score is the
prior's 0.5; documents without id are scored and are never held out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import lean, shipped, written
from gridloom.llm.textkernel import PUNCTUATION, U, Lookup, mix, slices

#: Most labelled documents that the model is fitted on, taken by a hash of their id.
SAMPLE = 30_000
#: Most tokens in the model, the surest first; the standard deviations that a token's counts must be
#: from the pooled rate's; and the bytes at a word's start that are a token too.
FEATURES, SURE, HEAD = 65_536, 4.0, 5
#: Weight of the prior in documents: so many at least, or this share of the fitted ones; and the
#: least loss of score a token.
PRIOR, PRIOR_SHARE, DRIFT = 50.0, 0.04, 0.05
#: Expected number of clean equals that a significant segment may have.
EXPECTED = 0.05
#: The law's constant is at most 1, and at least this, so that few clean documents do not make every segment significant;
#: it is counted from the segments of a normalised score of HIGH or more.
CONSTANT, HIGH = 1e-3, 1.0
#: Minimum hashes by which near copies in the sample are found.
LOWS = 4
THRESHOLD = 0.7


@dataclass
class Model:
    """What a score needs: token hashes with their scores, the law's scale and constant, the curve."""

    keys: np.ndarray
    scores: np.ndarray
    drift: float
    scale: float
    constant: float
    curve: tuple[float, float]

    def probability(self, strength: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * np.log1p(strength) + b)))


def maximal_segments(before: np.ndarray, after: np.ndarray) -> list[tuple[float, float, int, int]]:
    """All maximal scoring segments from the running sums before and after each positive token.

    Returns (sum before, sum after, first, last token of the input). Each token is put at the end
    of a list of candidates; where an earlier candidate starts lower and ends lower, all from it
    on become one.
    """
    found: list[tuple[float, float, int, int]] = []
    lower: list[int] = []  # of each candidate the nearest earlier one that starts lower
    for i, (left, right) in enumerate(zip(before.tolist(), after.tolist(), strict=True)):
        item = (left, right, i, i)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= item[0]:
                j = lower[j]
            if j < 0 or found[j][1] >= item[1]:
                found.append(item)
                lower.append(j)
                break
            item = (found[j][0], item[1], found[j][2], item[3])
            del found[j:], lower[j:]
    return found


class Scanner:
    def __init__(self, model: Model):
        self.model, self.lookup = model, Lookup(model.keys)

    def scan(self, column: pa.Array, least: float = -np.log(EXPECTED)) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
        """Of each text the summed significant scores, the number of tokens, and the significant
        segments (those of a normalised score over least) as (first token, last token, expected number)."""
        m = self.model
        strength, sizes, segments = [], [], []
        for _, _, words in slices(column, space=PUNCTUATION):
            at = self.lookup.find(words.hash)
            if len(missing := np.flatnonzero(at < 0)):
                at[missing] = self.lookup.find(words.heads(HEAD)[missing])
            score = np.full(len(at), -m.drift)
            hit = at >= 0
            score[hit] += m.scores[at[hit]]
            total = np.concatenate([[0.0], np.cumsum(score)])
            positive = np.flatnonzero(score > 0)
            edge = np.searchsorted(positive, words.doc_first)
            size = words.counts()
            sums = np.zeros(len(size))
            own: list[list[tuple[int, int, float]]] = [[] for _ in size]
            for d in np.flatnonzero(edge[1:] > edge[:-1]):
                p = positive[edge[d] : edge[d + 1]]
                base = np.log(max(m.constant * size[d], 1.0))
                for left, right, i, j in maximal_segments(total[p], total[p + 1]):
                    normal = m.scale * (right - left) - base
                    if normal > least:
                        sums[d] += normal
                        own[d].append((int(p[i] - words.doc_first[d]), int(p[j] - words.doc_first[d]), float(np.exp(-normal))))
            strength.append(sums)
            sizes.append(size)
            segments += own
        if not strength:
            return np.empty(0), np.empty(0, int), []
        return np.concatenate(strength), np.concatenate(sizes), segments


def _law(keys: np.ndarray, scores: np.ndarray, rate: np.ndarray) -> tuple[float, float]:
    """(drift, scale): scale is the positive root of sum(rate * exp(scale * score)) = 1.

    rate: of each model token its share of clean tokens; the rest of the tokens have score 0.
    """
    drift = max(DRIFT, 2 * float((rate * np.maximum(scores, 0)).sum()))
    rest = max(0.0, 1 - rate.sum())

    def moment(x: float) -> float:
        return float((rate * np.exp(np.minimum(x * (scores - drift), 700))).sum()) + rest * np.exp(-x * drift) - 1

    low, high = 1e-6, 1.0
    if not (scores > drift).any():
        return drift, 1.0
    while moment(high) < 0 and high < 1e6:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    return drift, low


def _curve(strength: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic fit on log1p(strength), with smoothed targets so that it stays finite."""
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    if not len(toxic):
        return 0.0, 0.0
    if n1 == 0 or n0 == 0 or not (strength > 0).any():
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = np.log1p(strength)
    y = toxic.astype(float)
    # Two pseudo-documents, one of each label, at each end of the scale.
    x = np.concatenate([x, [0, 0, np.median(x[x > 0])] * 2])
    y = np.concatenate([y, [0, 1, 0.5] * 2])
    a, b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * x).sum() - 1e-3 * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each sampled text some minimum hashes of its shingles and its distinct tokens."""
    kind = pa.struct([("h", pa.int64()), ("n", pa.int32())])
    for batch in batches:
        size, low, tokens, times = [], [], [], []
        for _, _, w in slices(batch.column("text"), space=PUNCTUATION):
            g, heads = w.grams(5), w.heads(HEAD)
            for d, whole in enumerate(w.whole()):
                a, b = w.doc_first[d], w.doc_first[d + 1]
                own = g[a : max(a, b - 4)]
                size.append(int(b - a))
                low.append([int((mix(own ^ U(i + 1)).min() if len(own) else whole).view(np.int64)) for i in range(LOWS)])
                long = heads[a:b] != w.hash[a:b]
                token, n = np.unique(np.concatenate([w.hash[a:b], heads[a:b][long]]), return_counts=True)
                tokens.append(token.view(np.int64))
                times.append(n)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(tokens or [np.empty(0)]), pa.int64()), pa.array(np.concatenate(times or [np.empty(0)]), pa.int32())], fields=list(kind))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "n": pa.array(size, pa.int64()), "low": pa.array(low, pa.list_(pa.int64())), "tokens": pa.ListArray.from_arrays(offsets, pairs)})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic). At most sample labelled documents are used."""
    spark = docs.sparkSession
    lean(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > 2 * sample:  # a first cut by hash, so that the last one sorts little
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 1.5 * sample / n))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of an id and a label, whatever the input: a bounded broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = written(rows.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")), "toxicity-sample")
    kind = dict(docs.dtypes)["doc_id"]
    seen = written(rows.mapInArrow(_features, f"doc_id {kind}, toxic int, n long, low array<long>, tokens array<struct<h:long,n:int>>"), "toxicity-tokens")
    first = seen.select("doc_id", "low")
    for i in range(LOWS):
        first = first.groupBy(F.col("low")[i]).agg(F.min_by("low", "doc_id").alias("low"), F.min("doc_id").alias("doc_id")).select("doc_id", "low")
    first = first.select("doc_id").distinct()
    used = written(seen.join(F.broadcast(first), "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2))), "toxicity-used")
    token = used.select("toxic", "fold", F.explode("tokens").alias("t"))
    sides = (None, 0, 1)  # all, and each fold
    inside = lambda f: F.lit(True) if f is None else F.col("fold") == f
    y = lambda f, t: F.count_if((F.col("toxic") == t) & inside(f))
    of = lambda f: "" if f is None else f"_{f}"
    token = token.groupBy(F.col("t.h").alias("h")).agg(
        *[y(f, t).alias(f"y{t}{of(f)}") for f in sides for t in (0, 1)],
        *[F.sum(F.when((F.col("toxic") == 0) & inside(f), F.col("t.n")).otherwise(0)).alias(f"c0{of(f)}") for f in sides],
    )
    token = written(token, "toxicity-counts")
    totals = used.agg(*[c for f in sides for c in (y(f, 0), y(f, 1), F.coalesce(F.sum(F.when((F.col("toxic") == 0) & inside(f), F.col("n"))), F.lit(0)))]).first()
    models = [_learnt(token, of(f), *totals[3 * i : 3 * i + 3], features) for i, f in enumerate(sides)]
    model = models[0]
    if not len(model.keys):
        return model
    texts = rows.join(F.broadcast(used.select("doc_id", "fold")), "doc_id").dropDuplicates(["doc_id"])
    texts = written(texts, "toxicity-texts")
    with shipped(spark, (models[2], models[1])) as other:
        clean_high = texts.where("toxic = 0").select("text", "fold").mapInArrow(_high(other), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    constant = float(np.clip(clean_high * np.exp(HIGH) / max(totals[0], 1), CONSTANT, 1.0))
    for m in models:
        m.constant = constant
    with shipped(spark, (models[2], models[1])) as other:
        got = texts.select("text", "toxic", "fold").mapInArrow(_strengths(other), "s double, t int").toArrow()
    model.curve = _curve(np.asarray(got["s"]), np.asarray(got["t"]))
    return model


def _learnt(token: DataFrame, of: str, n0: int, n1: int, t0: int, features: int) -> Model:
    """Token scores and their law from the counts (y0, y1, c0) of documents and clean tokens."""
    if n0 == 0 or n1 == 0:
        return Model(np.empty(0, np.uint64), np.empty(0), DRIFT, 1.0, 1.0, (0.0, float(np.log((n1 + 1) / (n0 + 1)))))
    y0, y1 = F.col(f"y0{of}"), F.col(f"y1{of}")
    prior = max(PRIOR, PRIOR_SHARE * (n0 + n1))
    a = F.lit(prior / (n0 + n1)) * (y1 + y0)
    odds = lambda y, n: F.log((y + a) / (F.lit(n + prior) - y - a))
    part = lambda y, n: F.when(y > 0, y * F.log(y * (n0 + n1) / ((y1 + y0) * n))).otherwise(0.0)
    z = F.sqrt(2 * F.greatest(F.lit(0.0), part(y1, n1) + part(y0, n0)))
    top = token.where(y0 + y1 > 0).select("h", (odds(y1, n1) - odds(y0, n0)).alias("delta"), z.alias("z"), F.col(f"c0{of}").alias("c0"))
    top = top.where(F.col("z") >= SURE).orderBy(F.desc("z"), "h").limit(features).toPandas()
    keys, scores = top["h"].to_numpy(np.int64).view(np.uint64), top["delta"].to_numpy(float)
    drift, scale = _law(keys, scores, (top["c0"].to_numpy(float) + 0.5) / max(float(t0), 1.0))
    return Model(keys, scores, drift, scale, 1.0, (0.0, 0.0))


def _by_fold(models: Broadcast[tuple[Model, Model]], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Scanner, pa.RecordBatch]]:
    """Each batch's rows of a fold beside the scanner of the other one's model; models: by fold."""
    scanners = [Scanner(m) for m in models.value]
    for batch in batches:
        fold = np.asarray(batch.column("fold"))
        for f in (0, 1):
            yield scanners[f], batch.filter(pa.array(fold == f))


def _high(models: Broadcast[tuple[Model, Model]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(sum(map(len, scanner.scan(part.column("text"), HIGH)[2])) for scanner, part in _by_fold(models, batches))
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    return run


def _strengths(models: Broadcast[tuple[Model, Model]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scanner, part in _by_fold(models, batches):
            yield pa.record_batch({"s": pa.array(scanner.scan(part.column("text"))[0], pa.float64()), "t": part.column("toxic").cast(pa.int32())})

    return run


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """docs without text, with score, n_passages and, if asked for, the passages found; they take the place of
    columns of these names.

    passages: array of (first, last token of the text, expected number in clean text as long).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name not in ("text", "score", "n_passages", "passages")]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    kind += (", " if kind else "") + "score double, n_passages int" + (", passages array<struct<first:int,last:int,expected:double>>" if passages else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for batch in batches:
            strength, _, found = scanner.scan(batch.column("text"))
            columns = [batch.column(f.name) for f in rest]
            names = [f.name for f in rest] + ["score", "n_passages"]
            columns += [pa.array(scanner.model.probability(strength), pa.float64()), pa.array([len(x) for x in found], pa.int32())]
            if passages:
                names.append("passages")
                columns.append(pa.array([[{"first": a, "last": b, "expected": e} for a, b, e in x] for x in found], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("expected", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, kind)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for batch in batches:
            strength, _, _ = scanner.scan(batch.column("text"))
            yield batch.filter(pa.array(scanner.model.probability(strength) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, parts: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The production model: only labels of rows that are not held out."""
    return fit(docs, labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_passages")
