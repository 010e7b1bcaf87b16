"""Least-squares boosting over packed bins (R2): every level of a tree is one scan.

Features are cut into at most ``MAX_BINS`` bins once, by MLlib's rules, and a row keeps its
bins, its target and its fitted value. Features with few bins share a key (a number
in mixed radix), so a row is a few small keys. A level sends the tree so far with the task;
each partition sends back, by node and bin, how many rows there are and what their residuals
add up to, which is of the model's size and not of the input's. A round ends with a
scan that adds the tree to the fitted values, kept in memory or on the executors' disks and
checkpointed every ``ROUNDS_PER_CHECKPOINT`` rounds, so a lost executor repeats at
most those.

As in MLlib a split lies between bins, has the largest gain in variance (ties: the first
feature, the lowest threshold), and thresholds come from a bounded sample of rows, the
only use that a sample has: every training row takes part in every level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.session import checkpoint_dir

#: Bins of a feature at most, and rows that thresholds are chosen from (all, if there are fewer).
MAX_BINS = 32
SAMPLE_ROWS = 20_000
#: Values of a key that several features share, at most.
KEY_VALUES = 1024
#: Rows per partition of the packed rows, its least number of partitions, and rows per block.
PARTITION_ROWS = 1_000_000
PARTITIONS = 8
BLOCK_ROWS = 32_768
#: Rounds between two checkpoints of the fitted values.
ROUNDS_PER_CHECKPOINT = 25


@dataclass
class Tree:
    """A regression tree as lists by node, the root first. A leaf has no children (-1)."""

    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    reached: list = field(default_factory=list)
    value: list = field(default_factory=list)

    @property
    def depth(self) -> int:
        def below(i: int) -> int:
            return 0 if self.left[i] < 0 else 1 + max(below(self.left[i]), below(self.right[i]))
        return below(0)

    def transform(self, df: DataFrame, features: str = "features", out: str = "_leaf") -> DataFrame:
        """``df`` with the value of the leaf that each row reaches; a value equal to a threshold goes left."""
        x = vector_to_array(F.col(features))

        def at(i: int) -> Column:
            if self.left[i] < 0:
                return F.lit(self.value[i])
            return F.when(F.get(x, F.lit(self.feature[i])) <= self.threshold[i], at(self.left[i])).otherwise(at(self.right[i]))
        return df.withColumn(out, at(0))


@dataclass
class Boosted:
    """Trees, their weights, the constant start, and the mean squared training error before the first and after each round."""

    trees: list
    treeWeights: list
    start: float
    losses: list
    n_features: int

    @property
    def featureImportances(self) -> list[float]:
        """Gains times the rows that reached their nodes, as shares of all (MLlib's rule for boosting)."""
        gained = [0.0] * self.n_features
        for t in self.trees:
            for f, g, n, child in zip(t.feature, t.gain, t.reached, t.left):
                if child >= 0:
                    gained[f] += g * n
        total = sum(gained)
        return [g / total if total else 0.0 for g in gained]

    def transform(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        """``df`` with the start and the weighted sum of the leaves' values."""
        tables = [(w, np.maximum(t.feature, 0), np.array(t.threshold), *_children(t), np.array(t.value), t.depth) for w, t in zip(self.treeWeights, self.trees)]
        start, width = self.start, self.n_features

        def score(x: pa.Array) -> pa.Array:
            v = x.flatten().to_numpy(zero_copy_only=False)
            base = np.arange(len(x)) * width
            total = np.full(len(x), start)
            for weight, feature, threshold, left, step, value, depth in tables:
                at = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    at = left[at] + step[at] * ~(v[base + feature[at]] <= threshold[at])
                total += weight * value[at]
            return pa.array(total, pa.float64())
        return df.withColumn(out, F.arrow_udf(score, "double")(vector_to_array(F.col(features))))


def _children(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Each node's left child (a leaf: itself) and the way from there to the right one (a leaf: none)."""
    left, right, own = np.array(tree.left), np.array(tree.right), np.arange(len(tree.left))
    return np.where(left < 0, own, left), np.where(left < 0, 0, right - left)


def thresholds(values: np.ndarray, bins: int = MAX_BINS, weights: np.ndarray | None = None) -> np.ndarray:
    """MLlib's rule: the middles between neighbouring values if they are few, else those nearest to equal shares (of the weights)."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < bins:
        return middles
    if weights is not None:
        counts = np.bincount(np.searchsorted(found, values), weights, minlength=len(found))
    stride = counts.sum() / bins
    upto = np.cumsum(counts)
    cuts, target = [], stride
    for i in range(1, len(found)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append(middles[i - 1])
            target += stride
    return np.array(cuts)


@dataclass
class Layout:
    """Thresholds of each feature; ``place``: each feature's key and its unit there; ``sizes``: each key's values."""

    cuts: list
    place: list
    sizes: list

    def bins(self, f: int) -> int:
        return len(self.cuts[f]) + 1


def layout(cuts: Sequence[np.ndarray], values: int = KEY_VALUES) -> Layout:
    place, sizes = [None] * len(cuts), []
    for f in sorted(range(len(cuts)), key=lambda f: (-len(cuts[f]), f)):
        n = len(cuts[f]) + 1
        key = next((k for k, size in enumerate(sizes) if size * n <= values), len(sizes))
        if key == len(sizes):
            sizes.append(1)
        place[f] = (key, sizes[key])
        sizes[key] *= n
    return Layout(list(cuts), place, sizes)


def _sample(rows: DataFrame, id_col: str, n: int, x: Column | None = None) -> np.ndarray:
    """The rows of the smallest id hashes: their features, or the array ``x``."""
    deal = F.pmod(F.xxhash64(F.lit(29), id_col), F.lit(1 << 40))
    bar = 1 << 40 if n <= 2 * SAMPLE_ROWS else int((1 << 40) * 1.5 * SAMPLE_ROWS / n)  # half as many more than wanted pass
    found = rows.where(deal < bar).select(deal.alias("deal"), (vector_to_array("features") if x is None else x).alias("x")).collect()
    return np.array([r["x"] for r in sorted(found, key=lambda r: (r["deal"], r["x"]))[:SAMPLE_ROWS]], float)


def keys_of(lay: Layout, x: np.ndarray) -> np.ndarray:
    """The keys of rows of features, by key."""
    keys = np.zeros((len(lay.sizes), len(x)), np.uint16)
    for f, (key, unit) in enumerate(lay.place):
        keys[key] += (np.searchsorted(lay.cuts[f], x[:, f]) * unit).astype(np.uint16)
    return keys


def _packer(lay: Layout, start: float):
    def block(x, y):
        cells = [[keys_of(lay, x).tobytes()], [y.tobytes()], [np.full(len(y), start).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], ["keys", "y", "fitted"])
    return in_blocks(block)


def in_blocks(block, rows: int = BLOCK_ROWS):
    """Batches of rows (x, y) to a record of ``block(x, y)`` per ``rows`` rows or a few more."""
    def pack(batches):
        xs, ys, held = [], [], 0
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            xs.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1))
            ys.append(y)
            held += len(y)
            if held >= rows:
                yield block(np.concatenate(xs), np.concatenate(ys))
                xs, ys, held = [], [], 0
        if held:
            yield block(np.concatenate(xs), np.concatenate(ys))
    return pack


class _Way:
    """How packed rows walk down a tree: by node the key to look at, and by its values whether to go right."""

    def __init__(self, tree: Tree, lay: Layout):
        self.left, step = _children(tree)
        self.depth = tree.depth
        self.key = np.zeros(len(self.left), np.int64)
        self.values = max(lay.sizes, default=1)
        self.right = np.zeros((len(self.left), self.values), np.int64)
        for i, f in enumerate(tree.feature):
            if tree.left[i] >= 0:
                self.key[i], unit = lay.place[f]
                bin_ = np.arange(self.values) // unit % lay.bins(f)
                self.right[i] = step[i] * (bin_ > np.searchsorted(lay.cuts[f], tree.threshold[i]))

    def ends(self, keys: np.ndarray) -> np.ndarray:
        n = keys.shape[1]
        if not self.depth:
            return np.zeros(n, np.int64)
        at = (self.left[0] + self.right[0])[keys[self.key[0]]]
        flat, base, right = keys.ravel(), np.arange(n), self.right.ravel()
        for _ in range(self.depth - 1):
            at = self.left[at] + right[at * self.values + flat[self.key[at] * n + base]]
        return at


def _read(block, sizes: int):
    return np.frombuffer(block[0], np.uint16).reshape(sizes, -1), np.frombuffer(block[1]), np.frombuffer(block[2])


def _stats(way: _Way, slots: np.ndarray, n_slots: int, lay: Layout):
    """Of a partition, for each slot: (rows, residuals, their squares) and by bin of each feature rows and residuals."""
    def scan(blocks):
        whole = np.zeros((3, n_slots + 1))
        by_key = [np.zeros((2, (n_slots + 1) * size)) for size in lay.sizes]
        for b in blocks:
            keys, y, fitted = _read(b, len(lay.sizes))
            r = y - fitted
            slot = slots[way.ends(keys)]
            whole += [np.bincount(slot, w, minlength=n_slots + 1) for w in (None, r, r * r)]
            for key, size, sums in zip(keys, lay.sizes, by_key):
                at = slot * size + key
                sums[0] += np.bincount(at, minlength=len(sums[0]))
                sums[1] += np.bincount(at, r, minlength=len(sums[1]))
        binned = []
        for f, (key, unit) in enumerate(lay.place):
            cube = by_key[key].reshape(2, n_slots + 1, -1, lay.bins(f), unit)
            binned.append(cube.sum(axis=(2, 4))[:, :n_slots])
        yield np.concatenate([whole[:, :n_slots].T.ravel(), *[b.ravel() for b in binned]])
    return scan


def _split(totals: np.ndarray, binned: list, slot: int, lay: Layout):
    """(gain, feature, cut) of the best split, None without a gain beyond rounding."""
    n, s, q = totals[slot]
    eps = np.finfo(float).eps
    if (q - s * s / n) / n < eps:
        return None
    best = None
    for f, (rows, sums) in enumerate(binned):
        ln, ls = np.cumsum(rows[slot])[:-1], np.cumsum(sums[slot])[:-1]
        rn, rs = n - ln, s - ls
        fits = (ln > 0) & (rn > 0)
        if fits.any():
            gain = np.where(fits, (ls * ls / np.maximum(ln, 1) + rs * rs / np.maximum(rn, 1) - s * s / n) / n, -np.inf)
            cut = int(gain.argmax())
            if gain[cut] > 4 * eps * q / n and (best is None or gain[cut] > best[0]):
                best = float(gain[cut]), f, cut
    return best


def _grow(state, lay: Layout, depth: int, scale: float) -> tuple[Tree, float]:
    """A tree on ``scale`` times the residuals, and the residuals' mean square."""
    tree, live, loss = Tree([-1], [-1], [-1], [0.0], [0.0], [0.0], [0.0]), [0], 0.0
    for level in range(depth + 1):
        slots = np.full(len(tree.left), len(live))
        slots[live] = np.arange(len(live))
        parts = state.mapPartitions(_stats(_Way(tree, lay), slots, len(live), lay)).collect()
        found = np.sum(parts, axis=0)
        totals = found[:3 * len(live)].reshape(len(live), 3)
        binned, lo = [], 3 * len(live)
        for f in range(len(lay.cuts)):
            hi = lo + 2 * len(live) * lay.bins(f)
            binned.append(found[lo:hi].reshape(2, len(live), -1))
            lo = hi
        if level == 0:
            loss = float(totals[0, 2] / totals[0, 0])
        below = []
        for slot, node in enumerate(live):
            n, s, _ = totals[slot]
            tree.reached[node], tree.value[node] = float(n), float(scale * s / n)
            best = _split(totals, binned, slot, lay) if level < depth else None
            if best:
                gain, f, cut = best
                children = [len(tree.left), len(tree.left) + 1]
                tree.left[node], tree.right[node] = children
                tree.feature[node], tree.threshold[node], tree.gain[node] = f, float(lay.cuts[f][cut]), scale * scale * gain
                for name, empty in (("left", -1), ("right", -1), ("feature", -1), ("threshold", 0.0), ("gain", 0.0)):
                    getattr(tree, name).extend([empty, empty])
                # the children's rows and means follow from the split: the last level needs no scan
                ln, ls = binned[f][0][slot][:cut + 1].sum(), binned[f][1][slot][:cut + 1].sum()
                tree.reached += [float(ln), float(n - ln)]
                tree.value += [float(scale * ls / ln), float(scale * (s - ls) / (n - ln))]
                below += children
        live = below
        if not live or level == depth - 1:
            break
    return tree, loss


def boost(rows: DataFrame, n_features: int, rounds: int, step: float, depth: int, id_col: str, from_mean: bool) -> Boosted:
    """Boosting on ``rows`` (id, y, features; no gaps): ``from_mean`` starts at the targets'
    mean and weights every tree by ``step``; otherwise the fit starts at 0, the first tree weighs 1
    and later ones are fitted to twice the residuals (MLlib's gradient).

    Raises ``ValueError`` without rows or with a target that is missing or not finite."""
    spark = rows.sparkSession
    y = F.col("y")
    n, good, mean = rows.agg(F.count(F.lit(1)), F.count_if(y.isNotNull() & (F.abs(y) < float("inf"))), F.avg("y")).first()
    if not n:
        raise ValueError("no training rows")
    if good < n:
        raise ValueError("targets that are missing or not finite")
    sample = _sample(rows, id_col, n)
    lay = layout([thresholds(sample[:, f]) for f in range(n_features)])
    start = float(mean) if from_mean else 0.0
    dealt = rows.select(id_col, "y", vector_to_array("features").alias("x")).repartition(max(PARTITIONS, -(-n // PARTITION_ROWS)), id_col)
    packed = dealt.sortWithinPartitions(id_col, "y", "x").select("x", "y").mapInArrow(_packer(lay, start), "keys binary, y binary, fitted binary")
    checkpoint_dir(spark)
    state = packed.rdd.map(lambda r: (bytes(r[0]), bytes(r[1]), bytes(r[2]))).persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()
    trees, weights, losses, before = [], [], [], None
    for r in range(rounds):
        first = not from_mean and r == 0
        tree, loss = _grow(state, lay, depth, 1.0 if from_mean or first else 2.0)
        if before:  # the first level's scan has made this round's fitted values
            before.unpersist()
        trees.append(tree)
        weights.append(1.0 if first else step)
        losses.append(loss)
        before, state = state, state.map(_added(tree, weights[-1], lay)).persist(StorageLevel.MEMORY_AND_DISK)
        if (r + 1) % ROUNDS_PER_CHECKPOINT == 0:
            state.checkpoint()
    losses.append(state.map(_squares(len(lay.sizes))).sum() / n)
    for held in (before, state):
        if held:
            held.unpersist()
    return Boosted(trees, weights, start, losses, n_features)


def _added(tree: Tree, weight: float, lay: Layout):
    """A block with the tree added to its fitted values."""
    way, value = _Way(tree, lay), weight * np.array(tree.value)

    def add(block):
        keys, _, fitted = _read(block, len(lay.sizes))
        return block[0], block[1], (fitted + value[way.ends(keys)]).tobytes()
    return add


def _squares(sizes: int):
    def of(block):
        _, y, fitted = _read(block, sizes)
        return float(((y - fitted) ** 2).sum())
    return of
