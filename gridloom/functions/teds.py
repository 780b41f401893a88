"""Tree edit distance similarity of tables."""

from __future__ import annotations

import numpy as np

from gridloom.functions.html import CELLS, Node, Table, span_of, table_of

#: What of a table's tree is a node of its own.
PARTS = ("tr", "thead", "tbody", *CELLS)


def levenshtein(a: str, b: str) -> int:
    """Edit distance, one row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Shapes:
    """A tree in postorder, its equal subtrees known as one shape.

    shape: of each node its shape; size: nodes of its subtree; of the shapes by number: label, nodes (the
    shapes in postorder, the root's last) and the sizes beside them.
    """

    def __init__(self, root: Node, structure_only: bool):
        self.shape: list[int] = []
        self.size: list[int] = []
        self.labels: list[tuple] = []
        self.trees: list[tuple[np.ndarray, np.ndarray]] = []
        known: dict[tuple, int] = {}
        stack: list[tuple[Node, list[Node], list[int], int]] = [(root, self._parts(root), [], 0)]
        while stack:
            node, left, done, start = stack[-1]
            if left:
                child = left.pop()
                stack.append((child, self._parts(child), [], len(self.shape)))
                continue
            stack.pop()
            cell = node.tag in CELLS
            spans = (span_of(node, "colspan"), span_of(node, "rowspan")) if cell else (1, 1)
            label = (node.tag, *spans, node.text() if cell and not structure_only else "")
            shape = known.setdefault((label, *done), len(known))
            self.shape.append(shape)
            self.size.append(len(self.shape) - start)
            if shape == len(self.labels):
                self.labels.append(label)
                self.trees.append((np.array(self.shape[start:]), np.array(self.size[start:])))
            if stack:
                stack[-1][2].append(shape)

    @staticmethod
    def _parts(node: Node) -> list[Node]:
        return [] if node.tag in CELLS else [c for c in node.nodes() if c.tag in PARTS][::-1]

    def __len__(self) -> int:
        return len(self.shape)


def rename_cost(a: tuple, b: tuple) -> float:
    if a[:3] != b[:3]:
        return 1.0
    if a[3] == b[3]:
        return 0.0
    return levenshtein(a[3], b[3]) / max(len(a[3]), len(b[3]))


def tree_distance(x: Shapes, y: Shapes) -> float:
    """Least cost to turn one ordered tree into the other by renaming, deleting and inserting nodes.

    Of every pair of shapes, small ones first: the forests are the prefixes of both postorders; a pair of
    nodes either leaves the forests as they are before both subtrees, at the subtrees' own distance, or loses
    one node. A row of the table, one for each node of the smaller tree, is one numpy pass: an insertion's run is a
    running minimum. A single node becomes that of the other tree which it is most like.
    """
    between = np.zeros((len(x.labels), len(y.labels)))
    order = lambda t: sorted(range(len(t.trees)), key=lambda s: len(t.trees[s][0]))
    right = order(y)
    for s in order(x):
        for t in right:
            if min(len(x.trees[s][0]), len(y.trees[t][0])) == 1:
                cost = min(rename_cost(x.labels[i], y.labels[j]) for i in set(x.trees[s][0].tolist()) for j in set(y.trees[t][0].tolist()))
                between[s, t] = max(len(x.trees[s][0]), len(y.trees[t][0])) - 1 + cost
                continue
            small, large, cost = x.trees[s], y.trees[t], between
            if len(small[0]) > len(large[0]):
                small, large, cost = large, small, between.T
            (nodes, sizes), (other, their) = small, large
            n, m = len(nodes), len(other)
            step = np.arange(m + 1.0)
            before = np.arange(m) + 1 - their
            d = np.empty((n + 1, m + 1))
            d[0] = step
            for p in range(1, n + 1):
                both = d[p - sizes[p - 1], before] + cost[nodes[p - 1], other]
                if p == n:
                    both[-1] = d[n - 1, m - 1] + rename_cost(x.labels[s], y.labels[t])
                d[p, 0] = p
                d[p, 1:] = np.minimum(both, d[p - 1, 1:] + 1)
                d[p] = np.minimum.accumulate(d[p] - step) + step
            between[s, t] = d[n, m]
    return float(between[x.shape[-1], y.shape[-1]])


#: Distances of pairs of structures that a process remembers, of trees of so many nodes: most tables of a set are alike.
KNOWN, NODES = 1 << 13, 512
_known: dict[tuple, float] = {}


def _distance(x: Shapes, y: Shapes) -> float:
    """tree_distance() of structures, once for equal ones: a tree is what its nodes' shapes, sizes and labels in postorder say."""
    if len(x) > NODES or len(y) > NODES:
        return tree_distance(x, y)
    key = tuple(tuple(part) for t in (x, y) for part in (t.shape, t.size, t.labels))
    if (found := _known.get(key)) is None:
        if len(_known) >= KNOWN:
            _known.clear()
        found = _known[key] = tree_distance(x, y)
    return found


def similarity(guess: Table | None, truth: Table, structure_only: bool = True) -> float:
    """1 - distance / nodes of the larger tree, at least 0; no table predicted is 0."""
    if guess is None:
        return 0.0
    x, y = Shapes(guess.root, structure_only), Shapes(truth.root, structure_only)
    return max(0.0, 1.0 - (_distance if structure_only else tree_distance)(x, y) / max(len(x), len(y)))


def score(pred: str | None, true: str, structure_only: bool = True) -> float:
    """similarity() of two tables as HTML; no true table raises."""
    truth = table_of(true)
    if truth is None:
        raise ValueError("the true html holds no table")
    return similarity(table_of(pred), truth, structure_only)


def batch(preds: list[str], trues: list[str], structure_only: bool = True) -> list[float]:
    """Scores of pairs; a pair without a true table is 0."""
    truths = map(table_of, trues)
    return [0.0 if t is None else similarity(table_of(p), t, structure_only) for p, t in zip(preds, truths, strict=True)]
