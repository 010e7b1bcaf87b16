"""Random forests over packed bins (L3): a level of all trees is one scan.

Rows are packed as for boosting (:mod:`canvass.operators.grow`): a few small keys and a
class, about ten bytes, whatever the number of trees. Nothing is kept per row and tree:
how often a tree drew a row is drawn anew in every scan from the tree's, the partition's and the block's
number, and where the row stands in the tree follows from its keys. Each partition counts the draws by tree, node, bin and
class; the counts of a tree meet on an executor, which chooses the splits, so the driver
gets a few numbers a node and the trees, none of which grows with the input.

The rules are MLlib's: draws are Poisson with mean 1, every node looks at its own random
features, the split with the largest Gini gain is taken (ties: the first
feature, the lowest threshold), pure nodes end, and sibling leaves that name the same class become
one. Thresholds come from a bounded sample of rows, the only use that a sample has.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators import grow
from canvass.operators.grow import Layout, Tree
from canvass.session import checkpoint_dir

#: Rows per partition of the packed rows, per block, and unpacked at once.
PARTITION_ROWS = 500_000
BLOCK_ROWS = 131_072
CHUNK_ROWS = 1_000_000
#: Values of a key that several features share, at most.
KEY_VALUES = 2048
#: Bytes of counts that a partition may hold; trees beyond them get a scan of their own.
SCAN_BYTES = 1 << 28
#: Tasks that choose splits.
CHOOSERS = 24
#: 16 random bits are a draw more than k at each of these bars: Poisson with mean 1, shares rounded to 2^-16.
BARS = [np.uint16(c) for k in range(12) if (c := round(65536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)))) < 65536]


@dataclass
class ClassTree(Tree):
    """A tree whose ``value`` is the class with the largest weight; ``votes``: by node the weight of each class."""

    votes: list = field(default_factory=list)

    def add(self, votes: np.ndarray) -> int:
        for name, empty in (("left", -1), ("right", -1), ("feature", -1), ("threshold", 0.0), ("gain", 0.0)):
            getattr(self, name).append(empty)
        self.votes.append(votes)
        self.reached.append(float(votes.sum()))
        self.value.append(float(votes.argmax()))
        return len(self.left) - 1

    def shares(self, i: int) -> list[float]:
        return [float(v) / self.reached[i] if self.reached[i] else 0.0 for v in self.votes[i]]

    def pruned(self) -> ClassTree:
        """Sibling leaves of one class merged, from below."""
        same = [False] * len(self.left)  # whether all leaves under a node name one class
        for i in reversed(range(len(self.left))):  # children come after their parents
            a, b = self.left[i], self.right[i]
            same[i] = a < 0 or (same[a] and same[b] and self.value[a] == self.value[b])
            if a >= 0 and same[i]:
                self.value[i] = self.value[a]
        out = ClassTree()
        todo = [(0, out.add(self.votes[0]))]
        while todo:
            i, at = todo.pop()
            if not same[i]:
                out.feature[at], out.threshold[at], out.gain[at] = self.feature[i], self.threshold[i], self.gain[i]
                out.left[at], out.right[at] = out.add(self.votes[self.left[i]]), out.add(self.votes[self.right[i]])
                todo += [(self.left[i], out.left[at]), (self.right[i], out.right[at])]
            else:
                out.value[at] = self.value[i]
        return out


@dataclass
class Forest:
    """Trees of equal weight over the bins of ``lay``."""

    trees: list
    numClasses: int
    lay: Layout

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * len(self.trees)

    @property
    def featureImportances(self) -> list[float]:
        """Gains times the weight that reached their nodes, as shares of a tree's, then of all (MLlib's rule)."""
        total = np.zeros(len(self.lay.cuts))
        for t in self.trees:
            own = np.zeros(len(total))
            for f, g, n, child in zip(t.feature, t.gain, t.reached, t.left):
                if child >= 0:
                    own[f] += g * n
            if own.sum() > 0:
                total += own / own.sum()
        return [float(g / total.sum()) if total.sum() else 0.0 for g in total]

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``probability``, the mean of the leaves' class shares, and ``prediction``, the (first) largest one's place."""
        lay, classes, trees = self.lay, self.numClasses, self.trees
        made: list = []

        def score(x: pa.Array) -> pa.Array:
            if not made:
                for t in trees:
                    walk = _Leaves(t, lay)
                    made.append((walk, np.array([t.shares(i) for i in walk.nodes])))
            keys = grow.keys_of(lay, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)).astype(np.int64)
            total = np.zeros((len(x), classes))
            for walk, shares in made:
                total += shares[walk.ends(keys)]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * classes, pa.int32()), pa.array((total / len(trees)).ravel()))
        scored = df.withColumn("_shares", F.arrow_udf(score, "array<double>")(vector_to_array(F.col(features))))
        return scored.withColumns({"probability": array_to_vector(F.col("_shares")),
                                   "prediction": (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")}).drop("_shares")


class _Leaves:
    """Which leaf a packed row reaches. Each value of a key leaves some leaves possible, a bit for
    each; what all keys of a row leave possible is one leaf."""

    def __init__(self, tree: Tree, lay: Layout):
        self.nodes = [i for i, left in enumerate(tree.left) if left < 0]
        self.way = grow._Way(tree, lay) if len(self.nodes) > 64 else None
        if self.way:
            self.number = np.zeros(len(tree.left), np.int64)
            self.number[self.nodes] = np.arange(len(self.nodes))
            return
        under = [0] * len(tree.left)
        for number, i in enumerate(self.nodes):
            under[i] = 1 << number
        tables = [None] * len(lay.sizes)
        every = (1 << 64) - 1
        for i in reversed(range(len(tree.left))):  # children come after their parents
            if tree.left[i] < 0:
                continue
            a, b = under[tree.left[i]], under[tree.right[i]]
            under[i] = a | b
            f = tree.feature[i]
            key, unit = lay.place[f]
            right = np.arange(lay.sizes[key]) // unit % lay.bins(f) > np.searchsorted(lay.cuts[f], tree.threshold[i])
            left_open = np.where(right, np.uint64(every ^ a), np.uint64(every ^ b))
            tables[key] = left_open if tables[key] is None else tables[key] & left_open
        self.tables = [(key, t) for key, t in enumerate(tables) if t is not None]
        self.all = np.uint64((1 << len(self.nodes)) - 1)

    def ends(self, keys: np.ndarray) -> np.ndarray:
        """The place in ``nodes`` of each row's leaf, from the rows' keys."""
        if self.way:
            return self.number[self.way.ends(keys)]
        if not self.tables:
            return np.zeros(keys.shape[1], np.int64)
        open_ = self.tables[0][1][keys[self.tables[0][0]]]
        for key, table in self.tables[1:]:
            open_ &= table[keys[key]]
        open_ &= self.all
        return (open_.astype(np.float64).view(np.int64) >> 52) - 1023  # a single bit's number is its exponent


def _packer(lay: Layout):
    def block(x, label):
        keys = grow.keys_of(lay, x)
        order = np.lexsort((keys[0], label))  # counts of neighbouring rows are near each other
        cells = [[keys[:, order].tobytes()], [label[order].astype(np.int32).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], ["keys", "label"])
    return grow.in_blocks(block, BLOCK_ROWS)


def _chunks(blocks: Iterable, lay: Layout, classes: int):
    """Lists of blocks: each one's keys, and where the rows of each class begin and end."""
    held, rows = [], 0
    for keys, label in blocks:
        label = np.frombuffer(label, np.int32)
        keys = np.frombuffer(keys, np.uint16).reshape(len(lay.sizes), -1)
        held.append((keys.astype(np.int64), np.searchsorted(label, np.arange(classes + 1))))
        rows += len(label)
        if rows >= CHUNK_ROWS:
            yield held
            held, rows = [], 0
    if held:
        yield held


def _counts(chunk: list, draws: Iterable, tree: ClassTree, live: Sequence[int], chosen: np.ndarray, lay: Layout, classes: int) -> np.ndarray:
    """Draws by live node, chosen feature, bin and class."""
    walk = _Leaves(tree, lay)
    slots = np.full(len(tree.left), len(live))
    slots[live] = np.arange(len(live))
    slots = slots[walk.nodes]
    summed = [np.zeros((classes, (len(live) + 1) * size)) for size in lay.sizes]
    for (keys, ends), weight in zip(chunk, draws):
        slot = slots[walk.ends(keys)]
        at = np.empty_like(slot)
        for key, size in enumerate(lay.sizes):
            np.multiply(slot, size, out=at)
            at += keys[key]
            for k in range(classes):
                own = slice(ends[k], ends[k + 1])
                summed[key][k] += np.bincount(at[own], weight[own] if weight is not None else None, summed[key].shape[1])
    whole = np.zeros((len(live), len(lay.cuts), max(map(lay.bins, range(len(lay.cuts)))), classes), np.int64)
    for f, (key, unit) in enumerate(lay.place):
        cube = summed[key].reshape(classes, len(live) + 1, -1, lay.bins(f), unit)
        whole[:, f, :lay.bins(f)] = cube.sum(axis=(2, 4))[:, :-1].transpose(1, 2, 0)
    return whole[np.arange(len(live))[:, None], chosen]


def _scan(work: list, lay: Layout, classes: int, seed: int, bootstrap: bool):
    """Of a partition, (tree, counts) for each tree in ``work``."""
    def scan(partition: int, blocks):
        found = {}
        for c, chunk in enumerate(_chunks(blocks, lay, classes)):
            for number, tree, live, chosen in work:
                draws = (_draws([seed, number, partition, c, b], keys.shape[1]) if bootstrap else None for b, (keys, _) in enumerate(chunk))
                counts = _counts(chunk, draws, tree, live, chosen, lay, classes)
                found[number] = found[number] + counts if number in found else counts
        yield from found.items()
    return scan


def _draws(of: list[int], n: int) -> np.ndarray:
    """How often each of ``n`` rows is drawn, the same for the same numbers."""
    bits = np.random.SFC64(of).random_raw(-(-n // 4)).view(np.uint16)[:n]
    drawn = (bits >= BARS[0]).view(np.uint8)
    for bar in BARS[1:]:
        drawn += (bits >= bar).view(np.uint8)
    return drawn.astype(float)


def _gini(votes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return 1.0 - np.square(votes / np.maximum(whole, np.finfo(float).tiny)[..., None]).sum(axis=-1)


def _chooser(weights: np.ndarray):
    def choose(counts: np.ndarray):
        """By node: votes, gain, place of the feature among the chosen ones, cut, votes of the left child."""
        drawn = counts.sum(axis=3).cumsum(axis=2)
        votes = (counts * weights).cumsum(axis=2)
        left, whole = votes[:, :, :-1], votes[:, :, -1:]
        right = whole - left
        n, ln, rn = whole.sum(axis=3), left.sum(axis=3), right.sum(axis=3)
        some = np.maximum(n, np.finfo(float).tiny)
        gain = _gini(whole, n) - ln / some * _gini(left, ln) - rn / some * _gini(right, rn)
        gain = np.where((drawn[:, :, :-1] > 0) & (drawn[:, :, :-1] < drawn[:, :, -1:]), gain, -np.inf)
        nodes, cuts = np.arange(len(gain)), gain.shape[2]
        if not cuts:  # no feature has two values
            return whole[:, 0, 0], np.full(len(nodes), -np.inf), nodes, nodes, whole[:, 0, 0]
        best = gain.reshape(len(gain), -1).argmax(axis=1)
        place, cut = best // cuts, best % cuts
        return whole[:, 0, 0], gain[nodes, place, cut], place, cut, left[nodes, place, cut]
    return choose


def _split(tree: ClassTree, live: Sequence[int], chosen: np.ndarray, found: tuple, lay: Layout) -> list[int]:
    """The level's splits added to the tree; the children that may split again."""
    eps, below = np.finfo(float).eps, []
    for slot, node in enumerate(live):
        votes, gain, place, cut, left = (part[slot] for part in found)
        if node == 0:
            tree.add(votes)
        if gain > 4 * eps:
            f = int(chosen[slot, place])
            tree.feature[node], tree.threshold[node], tree.gain[node] = f, float(lay.cuts[f][cut]), float(gain)
            children = [tree.add(v) for v in (left, votes - left)]
            tree.left[node], tree.right[node] = children
            below += [c for c in children if _gini(tree.votes[c], tree.votes[c].sum()) > 4 * eps]
    return below


def _batches(sizes: Sequence[int]) -> list[list[int]]:
    """Places in order, dealt to scans whose sizes sum to ``SCAN_BYTES`` at most (or that have one tree)."""
    out, held = [], 0
    for i, size in enumerate(sizes):
        if not out or held + size > SCAN_BYTES:
            out.append([])
            held = 0
        out[-1].append(i)
        held += size
    return out


def fit(rows: DataFrame, n_features: int, class_weights: Sequence[float], trees: int, depth: int, seed: int, id_col: str,
        subset: int | None = None, bootstrap: bool = True) -> Forest:
    """A forest on ``rows`` (id, label from 0, features; no gaps), a row weighted by its class.

    ``subset`` features are looked at in a node (by default the square root of their number, rounded up);
    without ``bootstrap`` every tree has each row once. Raises ``ValueError`` without rows or with a label that has no weight."""
    weights, label = np.array(class_weights, float), F.col("label")
    n, good = rows.agg(F.count(F.lit(1)), F.count_if(label.isin(*[float(k) for k in range(len(weights))]))).first()
    if not n:
        raise ValueError("no training rows")
    if good < n:
        raise ValueError("labels without a class weight")
    x = vector_to_array("features")
    of_class = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), label.cast("int") + 1)
    sample = grow._sample(rows, id_col, n, F.concat(x, F.array(of_class)))
    lay = grow.layout([grow.thresholds(sample[:, f], weights=sample[:, -1]) for f in range(n_features)], KEY_VALUES)
    dealt = rows.select(id_col, label.alias("y"), x.alias("x")).repartition(max(grow.PARTITIONS, -(-n // PARTITION_ROWS)), id_col, "x")
    packed = dealt.sortWithinPartitions(id_col, "y", "x").select("x", "y").mapInArrow(_packer(lay), "keys binary, label binary")
    checkpoint_dir(rows.sparkSession)
    state = packed.rdd.map(lambda r: (bytes(r[0]), bytes(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()
    subset = min(n_features, subset or math.ceil(math.sqrt(n_features)))
    # before its root is counted, a tree is a leaf that all rows reach
    grown, live = [ClassTree() for _ in range(trees)], {t: [0] for t in range(trees)}
    widest = max(map(lay.bins, range(n_features)))
    root = ClassTree(left=[-1], right=[-1], feature=[-1])
    for level in range(depth if depth else 1):
        work = [(t, grown[t] if level else root, nodes, np.array([_chosen([seed, t, i], n_features, subset) for i in nodes])) for t, nodes in live.items()]
        below = {}
        for batch in _batches([len(nodes) * n_features * widest * len(weights) * 8 for _, _, nodes, _ in work]):
            own = [work[i] for i in batch]
            counts = state.mapPartitionsWithIndex(_scan(own, lay, len(weights), seed, bootstrap))
            found = dict(counts.reduceByKey(np.add, min(CHOOSERS, len(own))).mapValues(_chooser(weights)).collect())
            for t, _, nodes, chosen in own:
                best = found[t] if depth else (found[t][0], np.full(1, -np.inf), *found[t][2:])
                below[t] = _split(grown[t], nodes, chosen, best, lay)
        live = {t: nodes for t, nodes in below.items() if nodes}
        if not live:
            break
    state.unpersist()
    return Forest([t.pruned() for t in grown], len(weights), lay)


@dataclass
class Estimator:
    """:func:`fit` with its parameters, ``fit(rows)`` as MLlib's estimators have it."""

    n_features: int
    class_weights: Sequence[float]
    trees: int
    depth: int
    seed: int
    id_col: str

    def fit(self, rows: DataFrame) -> Forest:
        return fit(rows, self.n_features, self.class_weights, self.trees, self.depth, self.seed, self.id_col)


def _chosen(of: list[int], n_features: int, subset: int) -> np.ndarray:
    return np.sort(np.random.default_rng(of).permutation(n_features)[:subset])
