"""Classification forests grown inside tasks, by the rules of Spark ML.

A tree sees its rows with Poisson(1) repeats and values in at most 32 bins by Spark's own thresholds; a node takes the first best Gini
gain among its features; a leaf below a parent that predicts the same is merged into it. Draws are hashes of the seed, the tree and the
row or node, so neither tasks nor partitions change a tree. A level sorts its rows by node and bin, feature by feature: the work of
a level follows its rows, however many nodes they are in, where a table of bins per node follows the nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa

from cubeloom.operators.outlier import mixed, unit

# Spark's number of bins, its smallest impurity that is not 0.
BINS = 32
EPSILON = 2.0**-52
#: Pairs of a row and a feature that are sorted together.
SORT_VALUES = 1 << 17
#: Features that all nodes of a level meet.
FIRST_FEATURES = 8
#: Repeats of a row in a tree: the chances of at most 0, 1, ...
REPEATS = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def share_size(share: str, width: int, trees: int) -> int | None:
    """Features of a node, as Spark counts them; None for shares that only Spark knows."""
    share = ("all" if trees == 1 else "sqrt") if share == "auto" else share
    sizes = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(max(width, 1)))), "onethird": math.ceil(width / 3)}
    return sizes.get(share)


def thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cuts of a feature from its ascending distinct values: all midpoints if they are few, else about equal numbers of rows."""
    middles = (values[:-1] + values[1:]) / 2.0
    n = int(counts.sum())
    most = min(BINS, n) - 1
    if len(middles) <= most:
        return middles
    ends, stride = np.cumsum(counts).astype(float), n / (most + 1)
    cuts, target, at = [], stride, 1
    while True:
        # the first value after which the target is passed by more than it lay ahead before
        at = max(at, int(np.searchsorted(ends[1:] + ends[:-1], 2.0 * target, side="right")) + 1)
        if at >= len(ends):
            return np.array(cuts)
        cuts.append(middles[at - 1])
        target, at = target + stride, at + 1


def repeats(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree sees each row, by the row's key."""
    return np.searchsorted(REPEATS, unit(seed, 1, tree, rows), side="right")


def gini(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Impurity per column of class counts (classes first), in Spark's order of operations."""
    left = np.ones(np.shape(total))
    for n in counts:
        share = n / total
        left -= share * share
    return left


class Level:
    """Rows of a tree's open nodes, ordered by node, and what is known of the nodes."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray, stats: np.ndarray, place: np.ndarray):
        self.rows, self.counts, self.stats, self.place = rows, counts, stats, place
        self.starts = np.cumsum(counts) - counts
        self.node = np.repeat(np.arange(len(counts)), counts)

    def only(self, nodes: np.ndarray) -> Level:
        mine = np.zeros(len(self.counts), bool)
        mine[nodes] = True
        return Level(self.rows[mine[self.node]], self.counts[nodes], self.stats[:, nodes], self.place[nodes])


def node_features(level: Level, width: int, size: int, tree: int, seed: int) -> np.ndarray | None:
    """(nodes x size) features of every node, ascending; None stands for all."""
    if size >= width:
        return None
    keys = mixed(seed, 2, tree, level.place[:, None], np.arange(width)[None, :])
    return np.sort(np.argpartition(keys, size - 1, axis=1)[:, :size], axis=1)


def best_splits(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, level: Level, features: np.ndarray | None, leaf: int, classes: int):
    """Per node the gain, feature and bin of its first best split and the class counts left of it (classes x nodes).

    Features are met in growing groups. No gain exceeds the node's impurity, and of equal gains the first counts: a node whose best
    split leaves pure children is done, as most small nodes are after the first few features.
    """
    nodes, size = len(level.counts), len(bins) if features is None else features.shape[1]
    gain, feature, cut = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    left, open_, lo, step = np.zeros((classes, nodes), np.int64), np.arange(nodes), 0, FIRST_FEATURES
    while lo < size and len(open_):
        step = max(1, min(step, SORT_VALUES // len(level.rows)))
        some = range(lo, min(lo + step, size))
        chosen = None if features is None else features[open_, some.start : some.stop]
        g, f, c, below = group_splits(bins, y, weight, level, chosen, some, leaf, classes)
        better = g > gain[open_]
        who = open_[better]
        gain[who], feature[who], cut[who], left[:, who] = g[better], f[better], c[better], below[:, better]
        rest = np.flatnonzero(gain[open_] < gini(level.stats, level.stats.sum(axis=0)))
        if len(rest) < len(open_):
            open_, level = open_[rest], level.only(rest)
        lo, step = some.stop, step * 3
    return gain, feature, cut, left


def group_splits(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, level: Level, features: np.ndarray | None, some: range, leaf: int, classes: int):
    """The same among a group of features: ``features`` of every node, or ``some`` for all."""
    nodes, m = len(level.counts), len(level.rows)
    gain, feature, cut = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    left = np.zeros((classes, nodes), np.int64)
    w, k = weight[level.rows], y[level.rows]
    w_bits, k_bits, bin_bits = int(w.max()).bit_length(), max(1, (classes - 1).bit_length()), (BINS - 1).bit_length()
    tail = w_bits + k_bits
    kind = np.uint32 if (nodes - 1).bit_length() + bin_bits + tail <= 32 else np.uint64
    base = (level.node.astype(kind) << kind(bin_bits + tail)) | (k.astype(kind) << kind(w_bits)) | w.astype(kind)
    total = level.stats.sum(axis=0)
    # counts of several classes share a word, so few running sums are taken
    room = max(1, int(total.sum()).bit_length())
    shares = [range(c, min(c + 63 // room, classes)) for c in range(0, classes, 63 // room)]
    before = [sum((np.cumsum(level.stats[c]) - level.stats[c]) << (room * (c - cs[0])) for c in cs) for cs in shares]
    coded = np.arange(1 << tail)
    words = [np.where(coded >> w_bits < cs.stop, (coded & ((1 << w_bits) - 1)) << (room * np.clip((coded >> w_bits) - cs[0], 0, len(cs) - 1)), 0)
             * (coded >> w_bits >= cs[0]) for cs in shares]
    impurity = gini(level.stats, total)
    last = np.zeros(m, bool)
    last[level.starts + level.counts - 1] = True
    if features is None:
        held = bins[some.start : some.stop].take(level.rows, axis=1)
    else:
        held = bins[features.T.take(level.node, axis=1), level.rows]
    keys = held.astype(kind)
    keys <<= kind(tail)
    keys |= base
    keys.sort(axis=1)
    spot = keys >> kind(tail)
    ends = np.zeros(keys.shape, bool)
    np.not_equal(spot[:, 1:], spot[:, :-1], out=ends[:, :-1])
    ends &= ~last  # a node's last value leaves nothing to its right
    ends = np.flatnonzero(ends)
    of, node = np.divmod(ends, m)
    node = level.node[node]
    keys &= kind((1 << tail) - 1)
    below = np.empty((classes, len(ends)), np.int64)
    for cs, word, ahead in zip(shares, words, before):
        sums = np.cumsum(word.take(keys), axis=1).ravel()[ends] - ahead[node]
        for c in cs:
            below[c] = (sums >> (room * (c - cs[0]))) & ((1 << room) - 1)
    n_left = below.sum(axis=0)
    n_right = total[node] - n_left
    known = np.flatnonzero((n_left >= leaf) & (n_right >= leaf))
    if len(known) < len(ends):
        below, n_left, n_right, of, node, ends = below[:, known], n_left[known], n_right[known], of[known], node[known], ends[known]
    both = n_left + n_right
    found = impurity[node] - n_left / both * gini(below, n_left) - n_right / both * gini(level.stats[:, node] - below, n_right)
    np.maximum.at(gain, node, found)
    ties = np.flatnonzero(found == gain[node])
    who, first = np.unique(node[ties], return_index=True)  # features and bins ascend: the first is Spark's choice
    pick = ties[first]
    left[:, who] = below[:, pick]
    cut[who] = (spot.ravel()[ends[pick]] & kind((1 << bin_bits) - 1)).astype(np.int64)
    feature[who] = some.start + of[pick] if features is None else features[who, of[pick]]
    return gain, feature, cut, left


def grow_tree(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, size: int, leaf: int, depth: int, tree: int = 0, seed: int = 0) -> dict[str, np.ndarray]:
    """Nodes of a tree on the rows with a weight: feature (-1: leaf), cut (bin), left (right follows), stats (nodes x classes).

    ``bins`` is (features x rows). A row goes left where its bin is at most the cut; the root is node 0.
    """
    rows = np.flatnonzero(weight)
    stats = np.bincount(y[rows], weight[rows], classes).astype(np.int64)[:, None]
    level, known, levels = Level(rows, np.array([len(rows)]), stats, np.ones(1, np.uint64)), 1, []
    for at in range(depth + 1):
        nodes = len(level.counts)
        feature, cut, left = np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64), np.full(nodes, -1, np.int64)
        levels.append((feature, cut, left, level.stats))
        total = level.stats.sum(axis=0)
        tried = np.flatnonzero((gini(level.stats, np.maximum(total, 1)) >= EPSILON) & (total >= 2 * leaf)) if at < depth else []
        if len(tried) == 0 or total[0] == 0:
            break
        level = level.only(tried)
        gain, best, at_most, below = best_splits(bins, y, weight, level, node_features(level, len(bins), size, tree, seed), leaf, classes)
        split = np.flatnonzero(gain > 0)
        if len(split) == 0:
            break
        feature[tried[split]], cut[tried[split]] = best[split], at_most[split]
        left[tried[split]] = known + 2 * np.arange(len(split))
        known += 2 * len(split)
        number = np.full(len(tried), -1)
        number[split] = np.arange(len(split))
        kept = np.flatnonzero(number[level.node] >= 0)
        rows, node = level.rows[kept], level.node[kept]
        child = 2 * number[node] + (bins[best[node], rows] > at_most[node])
        order = np.argsort(child.astype(np.uint16) if 2 * len(split) <= 1 << 16 else child, kind="stable")
        stats = np.stack([below[:, split], level.stats[:, split] - below[:, split]], axis=2).reshape(classes, -1)
        place = np.repeat(level.place[split] * np.uint64(2), 2) + np.tile(np.array([0, 1], np.uint64), len(split))
        level = Level(rows[order], np.bincount(child, minlength=2 * len(split)), stats, place)
    feature, cut, left = (np.concatenate([part[i] for part in levels]) for i in range(3))
    stats = np.concatenate([part[3] for part in levels], axis=1).T
    return merged_leaves(feature, cut, left, stats, np.cumsum([len(part[0]) for part in levels]))


def merged_leaves(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, stats: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The tree without pairs of leaves that predict the same; ``ends`` are the numbers of nodes up to every level."""
    says = stats.argmax(axis=1)
    starts = np.append(0, ends[:-1])
    for lo, hi in zip(starts[::-1], ends[::-1]):
        inner = lo + np.flatnonzero(feature[lo:hi] >= 0)
        a, b = left[inner], left[inner] + 1
        feature[inner[(feature[a] < 0) & (feature[b] < 0) & (says[a] == says[b])]] = -1
    alive = np.zeros(len(feature), bool)
    alive[0] = True
    for lo, hi in zip(starts, ends):
        inner = lo + np.flatnonzero(alive[lo:hi] & (feature[lo:hi] >= 0))
        alive[left[inner]] = alive[left[inner] + 1] = True
    number = np.cumsum(alive) - 1
    left = np.where(feature >= 0, number[np.maximum(left, 0)], -1)
    return {"feature": feature[alive].astype(np.int16), "cut": cut[alive].astype(np.uint8), "left": left[alive].astype(np.int32), "stats": stats[alive].astype(np.int32)}


def stops(bins: np.ndarray, tree: dict[str, np.ndarray], depths: Sequence[int], splits: Sequence[int]) -> dict[tuple[int, int], np.ndarray]:
    """Per depth limit and split size the node at which every row (bins: rows x features) stops."""
    rows = len(bins)
    flat, line = bins.ravel(), np.arange(rows) * bins.shape[1]
    feature, cut, left = (tree[c].astype(np.intp) for c in ("feature", "cut", "left"))
    drawn = tree["stats"].sum(axis=1)
    at, stopped = np.zeros(rows, np.intp), {s: np.full(rows, -1, np.intp) for s in splits}
    found = {}
    open_ = np.arange(rows)
    for depth in range(max(depths) + 1):
        here = at[open_]
        for s, node in stopped.items():
            ends = (drawn[here] < s) & (node[open_] < 0)
            node[open_[ends]] = here[ends]
        found |= {(depth, s): np.where(node < 0, at, node) for s, node in stopped.items() if depth in depths}
        inner = feature[here] >= 0
        open_, here = open_[inner], here[inner]
        if len(open_) == 0:
            break
        at[open_] = left[here] + (flat[line[open_] + feature[here]] > cut[here])
    ended = {s: np.where(node < 0, at, node) for s, node in stopped.items()}
    return {(d, s): found.get((d, s), ended[s]) for d in depths for s in splits}


def hits(bins: np.ndarray, label: np.ndarray, trees: Iterable[dict[str, np.ndarray]], classes: int, numbers: Sequence[int], depths: Sequence[int], splits: Sequence[int]) -> dict[tuple, int]:
    """Rows that the first trees, cut at a depth and a split size, classify right, by (trees, depth, split size)."""
    votes = {(d, s): np.zeros((len(bins), classes)) for d in depths for s in splits}
    out = {}
    for n, tree in enumerate(trees, 1):
        share = tree["stats"] / np.maximum(tree["stats"].sum(axis=1, keepdims=True), 1)
        for key, node in stops(bins, tree, depths, splits).items():
            votes[key] += share.take(node, axis=0)
        if n in numbers:
            out |= {(n, *key): int((v.argmax(axis=1) == label).sum()) for key, v in votes.items()}
    return out


def bytes_matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """BINARY column of equal lengths -> (rows, width) matrix of bytes."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for chunk in chunks:
        first = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset] if len(chunk) else 0
        parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[first : first + len(chunk) * width] if len(chunk) else np.empty(0, np.uint8))
    return np.concatenate(parts).reshape(-1, width)
