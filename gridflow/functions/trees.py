"""Tree ensembles as flat arrays, walked for whole batches of rows inside tasks.

Node n asks whether x[feature[n]] <= cut[n] and goes on to left[n] or right[n]; a leaf leads
to itself. Trees stand one after the other, `root` has the first node of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CELLS = 1 << 20


@dataclass
class Trees:
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    weight: np.ndarray
    depth: int

    def __len__(self) -> int:
        return len(self.root)


def from_nodes(trees: list[list[tuple]], weights: list[float]) -> Trees:
    """Trees given as lists of (feature, cut, left, right, value); children are places in the list, leaves have feature -1."""
    sizes = [len(t) for t in trees]
    root = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.array([n for t in trees for n in t], dtype=np.float64).reshape(-1, 5)
    own, first = np.arange(len(flat)), np.repeat(root[:-1], sizes)
    leaf = flat[:, 0] < 0
    left, right = (np.where(leaf, own, first + flat[:, k].astype(np.int64)) for k in (2, 3))
    depth, at = 0, root[:-1]
    while len(at := at[~leaf[at]]):
        at, depth = np.concatenate([left[at], right[at]]), depth + 1
    return Trees(
        np.where(leaf, 0, flat[:, 0]).astype(np.int32), np.where(leaf, np.inf, flat[:, 1]), left.astype(np.int32),
        right.astype(np.int32), flat[:, 4], root[:-1], np.array(weights, np.float64), depth,
    )


def from_text(text: str) -> tuple[list[list[tuple]], list[float]]:
    """Nodes and weights of the trees of a model's printed form: one line per question, branch and leaf."""
    trees: list[list[tuple]] = []
    weights: list[float] = []
    asked: list[list] = []  # questions whose second branch is still to come: [place, has its first branch]
    for line in text.splitlines()[1:]:
        part = line.strip()
        if part.startswith("Tree "):
            weights.append(float(part[part.index("weight") + 6 :].rstrip("):")))
            trees.append([])
            continue
        nodes = trees[-1]
        if part.startswith("If ("):
            _, number, sign, cut = part[4:-1].split(" ", 3)
            if sign != "<=":
                raise ValueError(f"not a question about a number: {part}")
            asked.append([len(nodes), False])
            nodes.append((int(number), float(cut), len(nodes) + 1, -1, 0.0))
        elif part.startswith("Else ("):
            place = asked.pop()[0]
            f, cut, left, _, value = nodes[place]
            nodes[place] = (f, cut, left, len(nodes), value)
        elif part.startswith("Predict:"):
            nodes.append((-1, 0.0, 0, 0, float(part[8:])))
    return trees, weights


def blocks(rows: int, trees: int):
    """Slices of rows and of trees that keep a step's matrices small."""
    few = max(1, min(trees, 256))
    many = max(1, CELLS // few)
    for a in range(0, rows, many):
        for b in range(0, trees, few):
            yield slice(a, min(a + many, rows)), slice(b, min(b + few, trees))


def leaves(t: Trees, x: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Leaf of each row in the trees that start at `root`."""
    rows = np.arange(len(x))[:, None]
    node = np.tile(root, (len(x), 1))
    for _ in range(t.depth):
        node = np.where(x[rows, t.feature[node]] <= t.cut[node], t.left[node], t.right[node])
    return node


def values(t: Trees, x: np.ndarray) -> np.ndarray:
    """Value of each tree (column) for each row."""
    out = np.empty((len(x), len(t)))
    for rows, some in blocks(len(x), len(t)):
        out[rows, some] = t.value[leaves(t, x[rows], t.root[some])]
    return out


def sums(t: Trees, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weighted sums of the trees of each member; `first` are the members' first trees."""
    out = np.zeros((len(x), len(first)))
    ends = np.append(first[1:], len(t))
    for k, (a, b) in enumerate(zip(first, ends)):
        for rows, some in blocks(len(x), b - a):
            some = slice(a + some.start, a + some.stop)
            out[rows, k] += t.value[leaves(t, x[rows], t.root[some])] @ t.weight[some]
    return out


def changes(t: Trees, x: np.ndarray, other: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sum of the trees per row, and how it changes when the columns of a group come from `other`.

    Only trees whose way to the row's leaf asks about the group are walked again.
    """
    base, change = np.zeros(len(x)), np.zeros((len(x), groups))
    for rows, some in blocks(len(x), len(t)):
        mine, theirs = x[rows], other[rows]
        at = np.arange(len(mine))[:, None]
        node = np.tile(t.root[some], (len(mine), 1))
        asked = np.full((max(1, t.depth), *node.shape), -1, np.int32)
        for d in range(t.depth):
            question = t.feature[node]
            asked[d] = np.where(t.left[node] == node, -1, group[question])
            node = np.where(mine[at, question] <= t.cut[node], t.left[node], t.right[node])
        old = t.value[node]
        base[rows] += old @ t.weight[some]
        for d in range(t.depth):
            fresh = asked[d] >= 0
            for e in range(d):
                fresh &= asked[d] != asked[e]
            r, k = np.nonzero(fresh)
            g = asked[d][r, k]
            new = t.root[some][k]
            for _ in range(t.depth):
                question = t.feature[new]
                seen = np.where(group[question] == g, theirs[r, question], mine[r, question])
                new = np.where(seen <= t.cut[new], t.left[new], t.right[new])
            gain = (t.value[new] - old[r, k]) * t.weight[some][k]
            change[rows] += np.bincount(r * groups + g, gain, len(mine) * groups).reshape(len(mine), groups)
    return base, change
