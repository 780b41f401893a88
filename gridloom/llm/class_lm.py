"""Language-model scores from Brown classes.

Every training word has a class; a word never seen there goes by its shape (length, last byte, letters
beyond ASCII). Exchange clustering puts the most frequent words and the shapes into classes: a unit
moves to the class that most raises the likelihood of the class bigrams, until a sweep moves few. The
next most frequent words are then placed by one such exchange each, from the classes beside them, and all
rarer words likewise from a distributed table of the classes beside each of them, where rarer neighbours stand as their
shapes. A text's probability is the product of class transitions and of the words' shares in their classes,
both smoothed; the text's end is a token in a class of its own.

All counts are over all training documents and whole texts. Words are known by 64-bit hashes; their
counts and classes stay a distributed table. Classes, and with them the words clustered by full exchange and those placed
on the driver, grow with the cube root of the vocabulary, from CLASSES to MOST_CLASSES (a class is a byte). The driver holds what
that bounds, and the counts and classes of the KNOWN most frequent words, which tasks look up themselves; rarer words are joined.

Cases: a null or empty text is the end token alone; texts of any length are scored whole; words never seen in training share the mass of
one unseen word in their shape; without training documents all counts are 0; rows that repeat are
scored as often as they stand there; documents without id are trained on. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import drop_scratch, lean, most_frequent, shipped, written
from gridloom.llm.textkernel import Lookup, Tally, Words, mix, signed, slices

#: Classes besides the end's, at least and at most; words that are clustered by full exchange, and that are placed on
#: the driver, as (so many, and so many a class); words whose counts and classes every task holds; sweeps at most.
CLASSES, MOST_CLASSES, CORE, HEAD, KNOWN, SWEEPS = 64, 255, (512, 8), (4096, 64), 1 << 18, 10
SHAPES = 16
#: Pseudo-count of the unigram class distribution in a class's transitions.
BACKOFF = 10.0


def shapes(w: Words) -> np.ndarray:
    """0..15 of each word: length in four steps, odd last byte, bytes beyond ASCII."""
    size = w.last - w.first
    high = np.concatenate([[0], np.cumsum(w.data >= 128)])
    end = w.data[w.last - 1]
    odd = (end < 48) | ((end > 57) & (end < 97)) | ((end > 122) & (end < 128))
    return (np.digitize(size, [7, 10, 14]) * 4 + odd * 2 + (high[w.last] > high[w.first])).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n) of each word over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def out() -> pa.RecordBatch:
            k, c = tally.take()
            return pa.record_batch({"h": signed(k), "n": pa.array(c[:, 0], pa.int64())})

        for batch in batches:
            for _, _, w in slices(batch.column(0)):
                tally.add(*np.unique(w.hash, return_counts=True))
            if tally.full():
                yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Units:
    """Which unit each word is, and each unit's class so far (-1: none yet).

    Units: the head words by falling count, then the shapes, then the end.
    """

    heads: np.ndarray
    classes: np.ndarray
    lookup: Lookup = field(init=False)

    def __post_init__(self) -> None:
        self.lookup = Lookup(self.heads)

    @property
    def end(self) -> int:
        return len(self.heads) + SHAPES

    def of(self, w: Words) -> np.ndarray:
        unit = self.lookup.find(w.hash).astype(np.int64)
        tail = unit < 0
        unit[tail] = len(self.heads) + shapes(w)[tail]
        return unit

    def sequence(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Units with an end before the first text and after each, and where each text begins."""
        begin = w.doc_first[:-1] + np.arange(1, len(w.doc_first))
        out = np.full(len(w.hash) + len(w.doc_first), self.end, np.int64)
        inside = np.ones(len(out), bool)
        inside[0] = False
        inside[w.doc_first[1:] + np.arange(1, len(w.doc_first))] = False
        out[inside] = self.of(w)
        return out, begin


def _pairs(docs: DataFrame, units: Units, code, n_left: int, n_right: int) -> np.ndarray:
    """Dense (n_left, n_right) counts of code(units of all pairs) -> pairs of small numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_left * n_right, np.int64)
        for batch in batches:
            for _, _, w in slices(batch.column(0)):
                seq, _ = sent.value.sequence(w)
                for a, b in code(sent.value, seq):
                    keep = (a >= 0) & (b >= 0)
                    total += np.bincount(a[keep] * n_right + b[keep], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"k": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    with shipped(docs.sparkSession, units) as sent:
        rows = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_left * n_right, np.int64)
    out[np.asarray(rows["k"])] = np.asarray(rows["n"])
    return out.reshape(n_left, n_right)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gains(n: np.ndarray, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
    """Of each class how much the likelihood rises when a unit with these neighbour counts joins it."""
    base = _f(n)
    rows = _f(n + right[None, :]) - base
    cols = _f(n + left[:, None]) - base
    diag = np.diagonal(n)
    gain = rows.sum(1) - np.diagonal(rows) + cols.sum(0) - np.diagonal(cols) + _f(diag + right + left + own) - _f(diag)
    nl, nr = n.sum(1), n.sum(0)
    return gain - (_f(nl + right.sum() + own) - _f(nl)) - (_f(nr + left.sum() + own) - _f(nr))


def exchange(pairs: np.ndarray, n_classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit by exchange over their bigram counts; the last unit has the last class alone."""
    m = len(pairs)
    pairs = pairs.astype(float)
    weight = pairs.sum(0) + pairs.sum(1)
    cls = np.empty(m, np.int64)
    cls[np.argsort(-weight, kind="stable")] = np.arange(m) % n_classes
    cls[-1] = n_classes
    hot = np.zeros((m, n_classes + 1))
    hot[np.arange(m), cls] = 1
    right, left = pairs @ hot, pairs.T @ hot
    n = hot.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in np.argsort(-weight[:-1], kind="stable"):
            if not weight[w]:
                continue
            a, own = cls[w], pairs[w, w]
            r, p = right[w].copy(), left[w].copy()
            r[a] -= own
            p[a] -= own
            n[a, :] -= r
            n[:, a] -= p
            n[a, a] -= own
            n = np.maximum(n, 0)
            b = int(np.argmax(_gains(n, r, p, own)[:-1]))
            n[b, :] += r
            n[:, b] += p
            n[b, b] += own
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w, :]
                left[:, b] += pairs[w, :]
        if moved <= m // 200:
            break
    return cls


def place(n: np.ndarray, own: np.ndarray, word: np.ndarray, left: np.ndarray, right: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Of each word the class whose _gains() are highest, from its neighbours' classes.

    own: of each word the class that it is counted in; word: ascending, each word at least once; left,
    right, times: the classes beside it and how often. What it gains in its own class is without its own counts.
    """
    c1, size = len(n), len(own)
    r = np.bincount(word * c1 + right, times, size * c1).reshape(size, c1)
    p = np.bincount(word * c1 + left, times, size * c1).reshape(size, c1)
    base, diag = _f(n), np.diagonal(n)
    gain = np.zeros((size, c1))
    # Only the classes that stand beside a word add to its gains.
    for beside, table, logs in ((r, n.T, base.T), (p, n, base)):
        w, j = np.nonzero(beside)
        e, times_ = np.arange(len(j)), beside[w, j]
        more = _f(table[j] + times_[:, None]) - logs[j]
        more[e, own[w]] = logs[j, own[w]] - _f(np.maximum(table[j, own[w]] - times_, 0))
        more[e, j] = 0
        gain += np.add.reduceat(more, np.searchsorted(w, np.arange(size)), axis=0)
    w, j = np.nonzero(r + p)
    both = r[w, j] + p[w, j]
    gain[w, j] += np.where(j == own[w], _f(diag[j]) - _f(np.maximum(diag[j] - both, 0)), _f(diag[j] + both) - _f(diag[j]))
    for edge, total in ((n.sum(1), r.sum(1)), (n.sum(0), p.sum(1))):
        more = _f(edge + total[:, None]) - _f(edge)
        more[np.arange(size), own] = _f(edge[own]) - _f(np.maximum(edge[own] - total, 0))
        gain -= more
    return gain[:, :-1].argmax(1)


def tail_words(docs: DataFrame, units: Units, now: np.ndarray) -> DataFrame:
    """(h, n, class) of every word but the heads; now: counts of the class bigrams of the others."""
    c1 = len(now)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = sent.value[0]
        hashes, pairs, have = [], [], 0

        def counted() -> pa.RecordBatch:
            h, pair = np.concatenate([*hashes, np.empty(0, np.uint64)]), np.concatenate([*pairs, np.empty(0, np.int64)])
            _, first, n = np.unique(mix(h ^ mix(pair.astype(np.uint64))), return_index=True, return_counts=True)
            # One number for the classes and how often: fewer bytes to shuffle.
            return pa.record_batch({"h": signed(h[first]), "k": pa.array(n * c1**3 + pair[first], pa.int64())})

        for batch in batches:
            for _, _, w in slices(batch.column(0)):
                seq, _ = u.sequence(w)
                c = u.classes[seq]
                at = np.flatnonzero((seq >= len(u.heads)) & (seq != u.end))
                hashes.append(w.hash[(np.cumsum(seq != u.end) - 1)[at]])
                pairs.append((c[at] * c1 + c[at - 1]) * c1 + c[at + 1])
                have += len(at)
            if have > 1 << 20:
                yield counted()
                hashes, pairs, have = [], [], 0
        yield counted()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            word = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
            n, own, pair = k // c1**3, k // c1**2 % c1, k % c1**2
            cls = place(sent.value[1], own[first], word, pair // c1, pair % c1, n)
            return pa.record_batch({"h": pa.array(h[first], pa.int64()), "n": pa.array(np.add.reduceat(n, first), pa.int64()), "class": pa.array(cls, pa.int32())})

        h, k = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            h, k = np.concatenate([h, np.asarray(batch.column("h"))]), np.concatenate([k, np.asarray(batch.column("k"))])
            # The last word may go on in the next batch.
            whole = int(np.searchsorted(h, h[-1])) if len(h) else 0
            if whole:
                yield out(h[:whole], k[:whole])
                h, k = h[whole:], k[whole:]
        if len(h):
            yield out(h, k)

    with shipped(docs.sparkSession, (units, now)) as sent:
        found = docs.select("text").mapInArrow(beside, "h long, k long").repartition("h").sortWithinPartitions("h")
        return written(found.mapInArrow(placed, "h long, n long, class int"), "lm-words")


@dataclass
class Model:
    known: Lookup
    known_counts: np.ndarray
    known_class: np.ndarray
    weight: np.ndarray  # log10 of a known word's mass in its class
    shape_class: np.ndarray
    mass: np.ndarray  # log10 of each class's mass
    base_floor: float  # log10 of the base's denominator
    end_count: int
    train_tokens: int
    transition: np.ndarray | None = None  # log10, from class to class

    @property
    def end(self) -> int:
        return len(self.mass) - 1


def n_classes(types: int) -> int:
    return int(np.clip(round(types ** (1 / 3)), CLASSES, MOST_CLASSES))


def learnt(docs: DataFrame, classes: int | None = None, core: int | None = None, head: int | None = None, known: int = KNOWN) -> tuple[Model, DataFrame]:
    """The model from all texts but for its transitions, and the table (h, n, class) of all words but the heads.

    classes, core and head go by the vocabulary unless given.
    """
    lean(docs.sparkSession)
    counts = written(count_words(docs), "lm-counts")
    n_docs = docs.count()
    classes = n_classes(counts.count()) if classes is None else classes
    if classes > MOST_CLASSES:
        raise ValueError("a class is a byte")
    core, head = (a + b * classes if given is None else given for (a, b), given in ((CORE, core), (HEAD, head)))
    # Bounded: the `known` most frequent words.
    top = most_frequent(counts, "n", known).orderBy(F.desc("n"), "h").toArrow()
    hashes, n = np.asarray(top["h"]).view(np.uint64), np.asarray(top["n"])
    heads = hashes[:head]
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, types = sums["n"] + n_docs, sums["v"] + (n_docs > 0)

    m = min(core, len(heads))
    units = Units(heads, np.full(len(heads) + SHAPES + 1, -1))
    k = m + SHAPES + 1

    def core_pairs(u: Units, seq: np.ndarray):
        c = np.where(seq < m, seq, np.where(seq >= len(u.heads), seq - len(u.heads) + m, -1))
        yield c[:-1], c[1:]

    pairs = _pairs(docs, units, core_pairs, k, k).astype(float)
    cls = exchange(pairs, classes)
    units.classes[:m] = cls[:m]
    units.classes[len(heads) :] = cls[m:]
    c1 = classes + 1
    hot = np.eye(c1)[cls]
    now = hot.T @ pairs @ hot
    if len(heads) > m:
        rest = len(heads) - m

        def beside(u: Units, seq: np.ndarray):
            c = u.classes[seq]
            open_ = np.where((seq >= m) & (seq < len(u.heads)), seq - m, -1)
            yield open_[:-1], np.where(c[1:] >= 0, c[1:], -1)
            yield np.where(open_[1:] >= 0, open_[1:] + rest, -1), np.where(c[:-1] >= 0, c[:-1], -1)

        near = _pairs(docs, units, beside, 2 * rest, c1).astype(float)
        for w in range(rest):
            units.classes[m + w] = int(np.argmax(_gains(now, near[w], near[rest + w], 0.0)[:-1]))
        hot = np.eye(c1)[units.classes[m : len(heads)]]
        now = now + hot.T @ near[:rest] + (hot.T @ near[rest:]).T

    words = tail_words(docs, units, now)
    cls = np.zeros(len(hashes), np.int64)
    cls[: len(heads)] = units.classes[: len(heads)]
    lookup = Lookup(hashes)
    if len(hashes) > len(heads):
        more = words.where(F.col("n") >= int(n[-1])).select("h", "class").toArrow()
        at = lookup.find(np.asarray(more["h"]).view(np.uint64))
        cls[at[at >= 0]] = np.asarray(more["class"])[at >= 0]
    # A head counts as often as it stands there, a rarer word half a time more, an unseen one half.
    weight = n + np.where(np.arange(len(n)) < len(heads), 0.0, 0.5)
    mass = np.bincount(cls[: len(heads)], weight[: len(heads)], c1) + np.bincount(units.classes[len(heads) : -1], np.full(SHAPES, 0.5), c1)
    for r in words.groupBy("class").agg(F.sum(F.col("n") + 0.5).cast("double").alias("m")).collect():
        mass[r["class"]] += r["m"]
    mass[-1] = n_docs or 1.0
    model = Model(lookup, n, cls, np.log10(weight), units.classes[len(heads) : -1], np.log10(np.maximum(mass, 1e-300)), float(np.log10(total + 0.5 * (types + 1))), n_docs, total)
    return model, words


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a binary column."""
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.astype(np.uint8))])


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all items, offsets, row of each item) of a list column."""
    at = np.asarray(column.offsets).astype(np.int64)
    return column.values[int(at[0]) : int(at[-1])], at - at[0], np.repeat(np.arange(len(column)), np.diff(at))


def coded(docs: DataFrame, model: Model, words: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns of docs and _seq (a byte a word: its class), _known, _base, _emit (log10 of the words' shares in their classes) of every text."""
    with shipped(docs.sparkSession, model) as sent:
        return _coded(docs, sent, words, keep)


def _coded(docs: DataFrame, sent: Broadcast[Model], words: DataFrame, keep: list[str]) -> DataFrame:
    fields = [docs.schema[c] for c in keep]
    kind = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "_seq binary, _known long, _base double, _emit double"
    half = float(np.log10(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        log_count = np.log10(np.concatenate([m.known_counts, [0]]) + 0.5)
        weight, classes = np.concatenate([m.weight, [half]]), np.concatenate([m.known_class, [0]])
        for batch in batches:
            parts: list[tuple] = []
            rare, which, where = [], [], []
            for _, _, w in slices(batch.column("text")):
                at = m.known.find(w.hash)
                c = np.where(at >= 0, classes[at], m.shape_class[shapes(w)])
                size = w.counts()

                def summed(x: np.ndarray) -> np.ndarray:
                    # Sums of one text only: the differences of long running sums would lose digits.
                    x = np.concatenate([x, [0.0]])
                    return np.where(size > 0, np.add.reduceat(x, np.minimum(w.doc_first[:-1], len(x) - 1)), 0.0)

                missing = np.flatnonzero(at < 0)
                cut = np.searchsorted(missing, w.doc_first)
                for d in range(len(size)):
                    own = missing[cut[d] : cut[d + 1]]
                    h, i = np.unique(w.hash[own], return_inverse=True)
                    rare.append(h.view(np.int64))
                    which.append(i)
                    where.append(own - w.doc_first[d])
                parts.append((c, size, size - np.diff(cut) + (m.end_count > 0), summed(log_count[at]) + np.log10(m.end_count + 0.5) - (size + 1) * m.base_floor, summed(weight[at] - m.mass[c])))
            if not parts:
                continue
            c, size, known, base, emit = (np.concatenate(x) for x in zip(*parts, strict=True))

            def lists(x: list[np.ndarray], t: pa.DataType) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) for i in x])]), pa.int32()), pa.array(np.concatenate(x), t))

            data = [_binary(c, np.r_[0, np.cumsum(size)]), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(emit, pa.float64()), lists(rare, pa.int64()), lists(which, pa.int32()), lists(where, pa.int32())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], *data], [*keep, "_seq", "_known", "_base", "_emit", "_rare", "_which", "_where"])

    out = docs.select(*keep, "text").mapInArrow(run, kind + ", _rare array<long>, _which array<int>, _where array<int>").withColumn("_row", F.monotonically_increasing_id())
    out = written(out, "lm-codes")  # the row numbers are fixed from here on
    # Words outside the `known` most frequent ones; those among them are looked up in the tasks.
    rare = out.select("_row", F.posexplode("_rare").alias("_i", "h")).join(words, "h")
    found = rare.groupBy("_row").agg(F.collect_list(F.struct("_i", "n", "class")).alias("_found"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = sent.value.mass
        for batch in batches:
            seq, at = _bytes(batch.column("_seq"))
            seq = seq.astype(np.int64)
            items, _, row = _lists(batch.column("_found"))
            _, start, _ = _lists(batch.column("_rare"))
            n, cls = np.zeros(start[-1]), np.full(start[-1], -1)
            i = start[row] + np.asarray(items.field("_i"))
            n[i], cls[i] = np.asarray(items.field("n")), np.asarray(items.field("class"))
            which, _, row = _lists(batch.column("_which"))
            where, _, _ = _lists(batch.column("_where"))
            i, place_ = start[row] + np.asarray(which), at[row] + np.asarray(where)
            hit = cls[i] >= 0
            i, place_, row = i[hit], place_[hit], row[hit]
            gain = np.log10(n[i] + 0.5) - half
            emit = gain - mass[cls[i]] + mass[seq[place_]]
            seq[place_] = cls[i]
            k = batch.num_rows
            sums = [np.asarray(batch.column("_known")) + np.bincount(row, minlength=k), np.asarray(batch.column("_base")) + np.bincount(row, gain, k), np.asarray(batch.column("_emit")) + np.bincount(row, emit, k)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], _binary(seq, at), *map(pa.array, sums)], [*keep, "_seq", "_known", "_base", "_emit"])

    full = written(out.join(found, "_row", "left").drop("_row").mapInArrow(fill, kind), "lm-classes")
    drop_scratch(out)
    return full


def _ended(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes with an end before the first text and after each, and where each text begins."""
    seq, at = _bytes(column)
    out = np.full(len(seq) + len(at), end, np.int64)
    inside = np.ones(len(out), bool)
    inside[at + np.arange(len(at))] = False
    out[inside] = seq
    return out, at[:-1] + np.arange(1, len(at))


def transitions(table: DataFrame, c1: int) -> np.ndarray:
    """log10 of the share of each class after each, from the texts' classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(c1 * c1, np.int64)
        for batch in batches:
            c, _ = _ended(batch.column(0), c1 - 1)
            total += np.bincount(c[:-1] * c1 + c[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"k": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = table.select("_seq").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    moves = np.zeros(c1 * c1)
    moves[np.asarray(rows["k"])] = np.asarray(rows["n"])
    moves = moves.reshape(c1, c1)
    seen = moves.sum(0)
    prior = (seen + 1) / (seen.sum() + c1)
    return np.log10((moves + BACKOFF * prior) / (moves.sum(1, keepdims=True) + BACKOFF))


def scored(table: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep's columns and n_tokens, n_known, base_score, score from the texts' classes."""
    sent = table.sparkSession.sparkContext.broadcast((model.transition, model.end))
    fields = [table.schema[c] for c in keep]
    kind = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "n_tokens long, n_known long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, end = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            c, begin = _ended(batch.column("_seq"), end)
            total = np.add.reduceat(transition[c[:-1], c[1:]], begin - 1) + np.asarray(batch.column("_emit"))
            size = np.diff(np.r_[begin, len(c)])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(size, pa.int64()), batch.column("_known"), batch.column("_base"), pa.array(total)], [*keep, "n_tokens", "n_known", "base_score", "score"])

    return table.mapInArrow(run, kind)


def fit(docs: DataFrame, classes: int | None = None, core: int | None = None, head: int | None = None, known: int = KNOWN) -> tuple[Model, DataFrame]:
    """The model from all texts, and the table (h, n, class) of all words but the heads."""
    model, words = learnt(docs, classes, core, head, known)
    model.transition = transitions(coded(docs, model, words, []), model.end + 1)
    return model, words


def score(docs: DataFrame, model: Model, words: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns of docs and n_tokens, n_known, base_score, score of every text."""
    return scored(coded(docs, model, words, keep), model, keep)


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model, words = learnt(docs.where("not held_out"))
    table = coded(docs, model, words, ["doc_id", "held_out"])
    model.transition = transitions(table.where("not held_out"), model.end + 1)
    out = scored(table, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
