"""Exact n-gram Jaccard join over whole texts, by count-vector R-trees.

A text's set is the distinct hashes of its word n-grams. Tokens fall into groups by hash; a set's
counts by group are a point, and two sets share at most the sum of their points' coordinate minima.
An R-tree over points bounds that for a whole node by the node's upper corner.

At a high similarity points of unlike texts are no farther apart than a node is wide, so one tree over
all texts would compare nearly all of them. Trees are therefore planted where texts can meet at all. Sets
of similarity t differ in at most D = (1 - t) / t times the smaller one's tokens, so of more than D
groups some are the same in both, token for token: texts that have a group in common form a block, and
each block has a tree. The number of groups goes by bands of sizes; a text also stands in the bands below
its own that may hold a partner. Groups that are empty are equal without saying anything: a text
with more of them than the number of groups allows for has the tokens of its prefix in addition.

Stages: equal sets become one class; blocks give a spanning forest of the pairs that the bounds
leave (a block of more than HOT rows is one star, which may connect more but misses nothing); its components are cut to
chunks of bounded size (each with its component's leaders), and verified exactly, skipping pairs that are already
connected; where a component was cut, pairs across its parts that the bounds leave are verified one by one, a large block by pairs
of its tiles. So no link between different classes is lost, and no block or component meets in one task.

Cases: a text with fewer words than n is one token, its whole sequence; null and wordless texts have
the empty set, which links with nothing; texts of any length are taken whole; ties at the threshold link; rows that repeat a
text are in one component; a row without id is linked with nothing and names no component; rows
that repeat an id are one document, which links as any of them does. Ids are whole numbers; others raise an error. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import SMALL, components, dealt_join, drop_scratch, lean, shipped, written
from gridloom.llm.filters import Repeated, repeated
from gridloom.llm.graph import Union, local_components
from gridloom.llm.textkernel import mix, signed, slices
from gridloom.llm.textkernel import U as U64

#: Groups of a block's points, by the most tokens that a set of its band has, and of the finer points.
GROUPS, FINE = ((1024, 64), (4096, 256), (1 << 62, 512)), 256
#: Tokens and sets that a verified chunk holds, about; rows of a block that are compared in one task.
CHUNK, SETS, HOT = 1_000_000, 256, 512
#: Sets of a component that are in each of its chunks, about.
LEADERS = 8
#: Documents whose ids may be broadcast to fetch their sets; beyond, they are joined by shuffling.
FETCH = 1_000_000
LEAF = 32
FULL = 255


def needed(n: np.ndarray, m: np.ndarray | int, percent: int) -> np.ndarray:
    """Least intersection of sets of n and m tokens: ceil(p / (100 + p) * (n + m))."""
    return -(-percent * (n + m) // (100 + percent))


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text its sorted distinct n-gram hashes."""
    for _, _, w in slices(column):
        g, whole = w.grams(n), w.whole()
        for d in range(len(whole)):
            a, b = w.doc_first[d], w.doc_first[d + 1]
            if b - a >= n:
                yield np.unique(g[a : b - n + 1])
            else:
                yield whole[d : d + 1] if b > a else whole[:0]


def point(tokens: np.ndarray, groups: int) -> np.ndarray:
    return np.minimum(np.bincount((tokens & U64(groups - 1)).astype(np.int64), minlength=groups), FULL).astype(np.uint8)


def folded(blob: bytes, groups: int) -> bytes:
    """A point of more groups as one of fewer."""
    return np.minimum(np.frombuffer(blob, np.uint8).reshape(-1, groups).astype(int).sum(0), FULL).astype(np.uint8).tobytes()


def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of points x and y (broadcast); a full count may be any."""
    low = np.minimum(x, y).astype(np.int64)
    low[low == FULL] = 1 << 40
    return low.sum(axis=-1)


class Tree:
    """A packed R-tree over count vectors: of each node the upper corner and the least and most tokens."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.arange(len(points))
        runs = [(0, len(order))]
        while runs and runs[0][1] - runs[0][0] > LEAF:
            new = []
            for a, b in runs:
                own = order[a:b]
                if b - a <= LEAF:
                    new.append((a, b))
                    continue
                spread = np.concatenate([points[own].std(axis=0), [sizes[own].std() / points.shape[1] ** 0.5]])
                g = int(spread.argmax())
                key = sizes[own] if g == points.shape[1] else points[own, g]
                order[a:b] = own[np.argsort(key, kind="stable")]
                mid = (a + b) // 2
                new += [(a, mid), (mid, b)]
            runs = new
        self.order, self.points, self.sizes = order, points, sizes
        self.starts = np.array([r[0] for r in runs] + [len(order)])
        self.levels = [(np.maximum.reduceat(points[order], self.starts[:-1]), np.minimum.reduceat(sizes[order], self.starts[:-1]), np.maximum.reduceat(sizes[order], self.starts[:-1]))]
        while len(self.levels[-1][0]) > LEAF:
            high, least, most = self.levels[-1]
            at = np.arange(0, len(high), LEAF)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def near(self, x: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Rows whose bounds allow the similarity with a set of n tokens at point x."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = (a[nodes] for a in self.levels[depth])
            may = (100 * most >= percent * n) & (100 * n >= percent * least)
            may &= shared(x, high) >= needed(np.minimum(np.maximum(least, 1), n * 100), n, percent)
            nodes = nodes[may]
            if depth:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        if not len(nodes):
            return nodes
        rows = np.concatenate([self.order[self.starts[i] : self.starts[i + 1]] for i in nodes])
        m = self.sizes[rows]
        rows = rows[(100 * m >= percent * n) & (100 * n >= percent * m)]
        return rows[shared(x, self.points[rows]) >= needed(self.sizes[rows], n, percent)]


def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band's largest size, groups, empty groups allowed) of the bands that a set of n tokens is in."""
    sizes = [1]
    while sizes[-1] < n:
        sizes.append(max(sizes[-1] + 1, sizes[-1] * 3 // 2))
    out = []
    for size in reversed(sizes):
        if size < n and 100 * size < percent * n:
            break
        differ = (100 - percent) * size // percent
        empty = math.ceil(1.3 * differ * math.exp(-percent / (1.5 * max(1, 100 - percent)))) + 3
        out.append((size, differ + 1 + empty, empty))
    return out


def marks_of(own: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """What a set may share with a similar one, band by band: the band's points' groups, and the hashes of the
    set's groups' tokens."""
    out = []
    for size, groups, empty in bands(len(own), percent) if len(own) else []:
        group = (own >> U64(16)) % U64(groups)
        order = np.argsort(group, kind="stable")
        group, tokens = group[order], mix(own[order])
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        seed = mix(group[at] + U64(size << 32))
        marks = mix(np.add.reduceat(tokens, at) ^ seed)
        if groups - len(at) > empty:
            take = len(own) - -(-percent * len(own) // 100) + 1
            marks = np.concatenate([marks, mix(own[:take] ^ U64(0xC2B2AE3D27D4EB4F ^ size))])
        out.append((next(g for most, g in GROUPS if size <= most), marks))
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, d1, d2): the size of each text's set and a 128-bit digest of it."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, d1, d2 = [], [], []
            for own in sets(batch.column("text"), n):
                size.append(len(own))
                d1.append(mix(own).sum(dtype=np.uint64))
                d2.append(mix(own ^ U64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n": pa.array(size, pa.int64()), "d1": signed(np.array(d1, np.uint64)), "d2": signed(np.array(d2, np.uint64))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long")


def often_marked(docs: DataFrame, n: int, percent: int) -> Repeated:
    """The filter of the marks that more than one document may have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = np.unique(np.concatenate([m for own in sets(batch.column(0), n) for _, m in marks_of(own, percent)] or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.record_batch({"h": signed(h), "n": pa.array(c, pa.int64())})

    return repeated(docs.select("text").mapInArrow(count, "h long, n long"))


def postings(docs: DataFrame, n: int, percent: int, often: Broadcast[Repeated]) -> DataFrame:
    """(s, rep, n, point): a row for each mark of a document that another one may have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, row, size, points, copies = [], [], [], [], []
            for i, own in enumerate(sets(batch.column("text"), n)):
                for groups, marks in marks_of(own, percent):
                    marks = marks[often.value(marks)]
                    if len(marks):
                        s.append(marks)
                        row.append(i)
                        size.append(len(own))
                        points.append(point(own, groups).tobytes())
                        copies.append(len(marks))
            at = np.repeat(np.arange(len(s)), copies)
            s = np.concatenate(s or [np.empty(0, np.uint64)])
            rep = np.asarray(batch.column("doc_id").cast(pa.int64()))[np.array(row, int)]
            size, points = np.array(size, np.int64), pa.array(points, pa.binary())
            for a in range(0, len(s), 1 << 16):
                k = at[a : a + (1 << 16)]
                yield pa.record_batch({"s": signed(s[a : a + (1 << 16)]), "rep": pa.array(rep[k], pa.int64()), "n": pa.array(size[k], pa.int64()), "point": points.take(pa.array(k))})

    return docs.select("doc_id", "text").mapInArrow(run, "s long, rep long, n long, point binary")


def _block(n: np.ndarray, points: np.ndarray, percent: int, part: np.ndarray | None, tile: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block's rows that the bounds leave: a spanning forest, or with part all of unlike parts, and of
    unlike tiles if there are tiles."""

    k = len(n)
    if k <= 48:
        i, j = np.triu_indices(k, 1)
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        keep = 100 * low >= percent * high
        if part is not None:
            keep &= part[i] != part[j]
        if tile is not None:
            keep &= tile[i] != tile[j]
        i, j = i[keep], j[keep]
        keep = shared(points[i], points[j]) >= needed(n[i], n[j], percent)
        i, j = i[keep], j[keep]
        if part is not None:
            return i, j
        root = local_components(i, j, k)
        at = np.flatnonzero(root != np.arange(k))
        return root[at], at
    tree = Tree(points, n)
    out_i, out_j, union, root = [], [], Union(k), np.arange(k)
    for i in range(k):
        found = tree.near(points[i], int(n[i]), percent)
        if part is not None:
            found = found[(found > i) & (part[found] != part[i])]
            found = found if tile is None else found[tile[found] != tile[i]]
        else:
            found = found[root[found] != root[i]]
        if not len(found):
            continue
        if part is None:
            for j in found.tolist():
                if union.join(i, j):
                    out_i.append(i)
                    out_j.append(j)
            joined = np.isin(root, np.unique(np.append(root[found], root[i])))
            root[joined] = root[joined].min()
        else:
            out_i += [i] * len(found)
            out_j += found.tolist()
    return np.array(out_i, int), np.array(out_j, int)


def _compared(rows: DataFrame, percent: int, parts: bool, tiles: bool) -> DataFrame:
    """(a, b) of the rows (s, rep, n, point and, if there, part, i, j, tile) of a key (s, i, j)."""
    key = ["s", "i", "j"] if tiles else ["s"]
    columns = [*key, "rep", "n", "point"] + (["part"] if parts else []) + (["tile"] if tiles else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def edges(t: pa.Table) -> np.ndarray:
            """Where the rows of another key begin, and the end."""
            new = np.zeros(t.num_rows - 1, bool)
            for c in key:
                v = np.asarray(t[c])
                new |= v[1:] != v[:-1]
            return np.flatnonzero(np.r_[True, new, True])

        def pairs(t: pa.Table) -> pa.RecordBatch:
            rep, n = (np.asarray(t[c]) for c in ("rep", "n"))
            blobs = t["point"].to_pylist()
            part = np.asarray(t["part"]) if parts else None
            tile, diagonal = (np.asarray(t["tile"]), np.asarray(t["i"]) == np.asarray(t["j"])) if tiles else (None, None)
            edge = edges(t)
            a, b = [], []
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if y - x > 1:
                    # A mark's band gives its points' length; should marks of two bands be equal, points are folded.
                    own, least = blobs[x:y], min(map(len, blobs[x:y]))
                    own = [folded(p, least) if len(p) > least else p for p in own]
                    apart = tile[x:y] if tiles and not diagonal[x] else None
                    i, j = _block(n[x:y], np.frombuffer(b"".join(own), np.uint8).reshape(y - x, -1), percent, part[x:y] if parts else None, apart)
                    a.append(rep[x:y][i])
                    b.append(rep[x:y][j])
            a, b = (np.concatenate(v or [np.empty(0, np.int64)]) for v in (a, b))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
            return pa.record_batch({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

        for batch in batches:
            t = pa.Table.from_batches([batch]).select(columns)
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            cut = int(edges(t)[-2])  # the last block may go on
            if cut:
                yield pairs(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield pairs(rest.combine_chunks())

    dealt = rows.select(*columns).repartition(*key).sortWithinPartitions(*key, "n", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def hot_marks(rows: DataFrame, hot: int) -> DataFrame:
    """(s, tiles, star) of the marks of more than hot rows: at most a row in hot of those."""
    many = rows.groupBy("s").agg(F.count(F.lit(1)).alias("_n"), F.min("rep").alias("star")).where(F.col("_n") > hot)
    return written(many.select("s", F.ceil(F.col("_n") / hot).cast("int").alias("tiles"), "star"), "ngram-hot")


def block_pairs(rows: DataFrame, percent: int, hot: DataFrame, parts: bool = False) -> DataFrame:
    """(a, b), a < b: without parts pairs that connect what the bounds leave in some block, with parts all
    such pairs of unlike parts; rows as from postings(), hot as from hot_marks().

    A hot block's rows do not meet: without parts all are linked with the block's smallest, and what that connects
    wrongly is told apart by the verification; with parts each pair of its tiles is a task.
    """
    n = hot.count()
    if not n:
        return _compared(rows, percent, parts, False).distinct()
    small = F.broadcast(hot) if n <= SMALL else hot
    some = _compared(rows.join(small.select("s"), "s", "left_anti"), percent, parts, False)
    large = rows.join(small, "s")
    if not parts:
        return some.union(large.where("rep <> star").select(F.col("star").alias("a"), F.col("rep").alias("b"))).distinct()
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    each = large.withColumn("tile", tile).withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    each = each.withColumn("i", F.least("tile", "_u")).withColumn("j", F.greatest("tile", "_u"))
    return some.union(_compared(each, percent, parts, True)).distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct tokens."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links among a chunk's sets."""
    rep = np.asarray(table["rep"])
    own = [np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()]
    n = np.array([len(t) for t in own])
    points = np.stack([point(t, FINE) for t in own])
    tree, union = Tree(points, n), Union(len(rep))
    a, b = [], []
    for i in np.argsort(n, kind="stable").tolist():
        for j in tree.near(points[i], int(n[i]), percent).tolist():
            if j != i and union.find(i) != union.find(j) and similar(own[i], own[j], percent):
                union.join(i, j)
                a.append(rep[i])
                b.append(rep[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _fetch(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(rep, tokens) of the documents whose id is in nodes.rep."""
    count = nodes.count()
    ids = nodes.select(F.col("rep").alias("_rep"))
    found = docs.select("doc_id", "text").join(F.broadcast(ids) if count <= FETCH else ids, F.col("doc_id") == F.col("_rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"rep": batch.column("rep"), "tokens": pa.array([t.tobytes() for t in sets(batch.column("text"), n)], pa.binary())})

    # A repeated id is fetched for each of its rows; rows that share an id are one document here.
    return found.select(F.col("_rep").cast("long").alias("rep"), "text").mapInArrow(run, "rep long, tokens binary")


def _fine(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bounds of finer points leave: points are small beside the sets themselves."""

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
            yield pa.record_batch({"rep": batch.column("rep"), "n": pa.array([len(t) for t in own], pa.int64()), "point": pa.array([point(t, FINE).tobytes() for t in own], pa.binary())})

    p = written(tokens.mapInArrow(points, "rep long, n long, point binary"), "ngram-points")
    both = pairs.join(p.toDF("a", "n", "x"), "a").join(p.toDF("b", "m", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in ("x", "y"))
            n, m = np.asarray(batch.column("n")), np.asarray(batch.column("m"))
            yield batch.select(["a", "b"]).filter(pa.array(shared(x, y) >= needed(n, m, percent), pa.bool_()))

    # A repeated id has a point for each of its rows: a pair passes if any of them does.
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, n: int, percent: int, chunk: int = CHUNK, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, edges): rows doc_id, n, d1, d2; classes d1, d2, rep, copies; edges (a, b) of
    verified links that connect all that links connect."""
    spark = docs.sparkSession
    lean(spark)
    marks = written(signatures(docs, n), "ngram-sets", small=True)
    known = marks.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy("d1", "d2").agg(F.min("doc_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n")), "ngram-classes")
    # Classes of one document are the most; only the others' further documents are left out.
    copies = known.join(classes.where("copies > 1"), ["d1", "d2"]).where("doc_id <> rep").select("doc_id").distinct()
    copies = written(copies.join(classes, F.col("doc_id") == F.col("rep"), "left_anti"), "ngram-copies")
    several = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(copies) if copies.count() <= FETCH else copies, "doc_id", "left_anti")
    with shipped(spark, often_marked(several, n, percent)) as often:
        posted = written(postings(several, n, percent, often), "ngram-postings")
    several_rows = hot_marks(posted, hot)
    may = written(components(block_pairs(posted, percent, several_rows)), "ngram-candidates")
    nodes = may.select(F.col("node").alias("rep"), "component").join(classes.groupBy("rep").agg(F.sum("n").alias("n")), "rep")
    per = nodes.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / chunk), F.ceil(F.count(F.lit(1)) / SETS)).cast("int").alias("parts"), F.ceil(F.count(F.lit(1)) / LEADERS).alias("every"), F.min("rep").alias("first"))
    nodes = written(dealt_join(nodes, per, "component", F.col("rep")), "ngram-nodes")
    tokens = written(_fetch(docs, nodes, n).dropDuplicates(["rep", "tokens"]), "ngram-sets")
    lead = (F.pmod(F.xxhash64("component", "rep"), F.col("every")) == 0) | (F.col("rep") == F.col("first"))
    # A component's leaders, some LEADERS of its rows, go to each of its chunks, which connects the chunks of one family.
    chunks = F.when(lead, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
    dealt = nodes.select("rep", "component", F.explode(chunks).alias("part")).join(tokens, "rep")
    edges = written(dealt.groupBy("component", "part").applyInArrow(lambda t: _verify(t, percent), "a long, b long"), "ngram-links")
    cut = nodes.where("parts > 1")
    if cut.limit(1).count():
        label = components(edges)
        part = cut.select("rep").join(label, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("part"))
        pairs = block_pairs(written(posted.join(part, "rep"), "ngram-parts"), percent, several_rows, parts=True)
        pairs = written(_fine(pairs, tokens, percent), "ngram-pairs")
        x, y = tokens.toDF("a", "x"), tokens.toDF("b", "y")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        both = written(edges.union(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")), "ngram-all-links")
        drop_scratch(pairs)
        drop_scratch(edges)
        edges = both
    for table in (posted, may, nodes, tokens):
        drop_scratch(table)
    return marks.select("doc_id", "n", "d1", "d2"), classes.select("d1", "d2", "rep", "copies"), edges


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id, copies) of every row of (doc_id, text).

    component_id: the smallest doc_id that links reach; copies: rows with an equal set.
    """
    rows, classes, edges = links(docs, n, percent, chunk)
    groups = components(edges)
    classes = classes.join(groups, classes["rep"] == groups["node"], "left").select("d1", "d2", "copies", F.coalesce("component", "rep").alias("component"))
    out = rows.join(classes, ["d1", "d2"], "left")
    own = F.col("n") > 0
    component = F.coalesce(F.when(own & F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id").cast("long"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(own, F.coalesce("copies", F.lit(1))).otherwise(1).cast("long").alias("copies"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (of rows that share it, any one); rows
    without id stay.

    Rows that share an id are rows of their own here: where ids repeat, rows are numbered and joined by number.
    """

    def bounded(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= FETCH else ids

    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        groups = ngram_components(docs, n, percent, chunk)
        gone = written(groups.where("doc_id <> component_id").select("doc_id"), "ngram-gone")
        return docs.join(bounded(gone), "doc_id", "left_anti").select(*docs.columns)
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "ngram-rows")
    named = rows.where("doc_id is not null")
    groups = ngram_components(named.select(F.col("_row").alias("doc_id"), "text"), n, percent, chunk).select(F.col("doc_id").alias("_row"), "component_id")
    first = groups.join(named.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_row"))
    stay = written(first.select("_row"), "ngram-stay")
    return rows.join(bounded(stay), "_row", "left_semi").union(rows.where("doc_id is null").select("_row", *docs.columns)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_components(docs, n=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END) AS g
  FROM w),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (
  SELECT doc_id AS n, doc_id AS c FROM documents
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.n)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM documents d JOIN r ON r.n = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL
"""
