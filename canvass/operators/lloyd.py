"""k-means for many k and starts at once (C2, C6): Lloyd iterations that share a scan.

The matrix is packed into blocks once. An iteration sends the centres of all
models that still move with the task and is one scan: every block is compared with
all centres by matrix products, and what comes back, summed by centre, is
one row per centre (its members, their sum and their cost). A model whose centres
have settled is measured once more at its last centres and leaves, so scans get
cheaper as models finish.

Starts are k-means++ on a hash sample of ``START_ROWS`` rows, by id: they depend
on neither partitions nor cluster. A centre that loses all members stays where it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.session import checkpoint_dir

#: Rows that starts are chosen from (a bounded sample; all rows take part in the iterations).
START_ROWS = 8192
#: Rows per partition of the packed matrix, its least number of partitions, and rows per block.
PARTITION_ROWS = 250_000
PARTITIONS = 8
BLOCK_ROWS = 4096
#: Rows of a block that are compared with the centres at a time.
SCAN_ROWS = 512


@dataclass
class SharedFit:
    """One fitted model; clusters are numbered by size, largest first, ties by centre."""
    k: int
    seed: int
    cost: float
    centers: list
    sizes: list
    features: list
    iterations: int
    settled: bool
    path: list = field(default_factory=list)  # the cost at the start of each iteration


def _pack(batches):
    for batch in batches:
        x = batch.column("x")
        width = len(x[0]) if len(x) else 0
        flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([flat[lo:lo + BLOCK_ROWS].tobytes() for lo in range(0, len(flat), BLOCK_ROWS)], pa.binary())], ["block"])


def packed(vectors: DataFrame, features: Sequence[str], id_col: str, partition_rows: int = PARTITION_ROWS) -> tuple[DataFrame, int]:
    """The rows of ``features`` as blocks of doubles, checkpointed, and their
    number. The layout follows from ids and row count alone."""
    n = vectors.count()
    parts = max(PARTITIONS, -(-n // partition_rows))
    checkpoint_dir(vectors.sparkSession)
    x = vectors.select(id_col, F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    dealt = x.repartition(parts, id_col).sortWithinPartitions(id_col, "x").select("x")
    return dealt.mapInArrow(_pack, "block binary").checkpoint(eager=True), n


def start_sample(vectors: DataFrame, features: Sequence[str], id_col: str, n: int, rows: int = START_ROWS) -> np.ndarray:
    """At most ``rows`` rows, those of the smallest id hashes (all, if there are fewer)."""
    deal = F.pmod(F.xxhash64(F.lit(17), id_col), F.lit(1 << 40))
    bar = 1 << 40 if n <= 2 * rows else int((1 << 40) * 1.5 * rows / n)  # half as many more than wanted pass
    some = vectors.where(deal < bar).select(deal.alias("deal"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    found = sorted(tuple(r) for r in some.collect())[:rows]
    return np.array([r[1:] for r in found], float).reshape(-1, len(features))


def plus_plus(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ starts: each next one drawn by squared distance, the best of a few draws."""
    r = np.random.RandomState(seed)
    sq = (sample * sample).sum(axis=1)
    away = lambda c: np.maximum(sq[:, None] - 2 * sample @ c.T + (c * c).sum(axis=1), 0)
    centers = sample[[r.randint(len(sample))]]
    nearest = away(centers)[:, 0]
    while len(centers) < k:
        weight = nearest.sum()
        drawn = np.searchsorted(np.cumsum(nearest), r.random_sample(2 + int(np.log(k))) * weight) if weight else r.randint(len(sample), size=1)
        drawn = np.minimum(drawn, len(sample) - 1)
        left = np.minimum(nearest[:, None], away(sample[drawn]))
        best = left.sum(axis=0).argmin()
        centers, nearest = np.r_[centers, sample[[drawn[best]]]], left[:, best]
    return centers


def _scan(centers: np.ndarray, bounds: list[int]):
    """One row per centre of all models: members, cost, and the members' sum.

    Models of one k are compared at once, ``SCAN_ROWS`` rows at a time: the distances of
    so few rows stay in the processor's cache, and their products in one thread."""
    groups = {}
    for lo, hi in zip(bounds, bounds[1:]):
        groups.setdefault(hi - lo, []).append(np.arange(lo, hi))
    groups = [np.stack(g) for g in groups.values()]

    def rows(batches):
        width = centers.shape[1]
        n, cost, sums = np.zeros(len(centers)), np.zeros(len(centers)), np.zeros(centers.shape)
        # a centre c beside its squared length, a row x beside 1: one product gives |c|^2 - 2 c.x
        models = [(slots, np.dstack([-2.0 * centers[slots], (centers[slots] ** 2).sum(axis=2)]), np.arange(slots.shape[1])[:, None]) for slots in groups]
        for batch in batches:
            for block in batch.column("block"):
                whole = np.frombuffer(block.as_buffer(), np.float64).reshape(-1, width)
                for lo in range(0, len(whole), SCAN_ROWS):
                    x = whole[lo:lo + SCAN_ROWS]
                    turned, own = np.ones((width + 1, len(x))), np.einsum("ij,ij->i", x, x)
                    turned[:width] = x.T
                    for slots, weights, number in models:
                        away = weights @ turned
                        least = away.min(axis=1)
                        member = away == least[:, None, :]
                        if np.count_nonzero(member) > least.size:  # equally near centres: the first
                            member = away.argmin(axis=1)[:, None, :] == number
                        member = member.astype(np.float64)
                        n[slots] += member.sum(axis=2)
                        cost[slots] += (member @ np.maximum(least + own, 0)[:, :, None])[:, :, 0]
                        sums[slots] += member @ x
        if n.any():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(centers) + 1) * width, pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centers), dtype=np.int32)), pa.array(n), pa.array(cost), lists], ["slot", "n", "cost", "s"])
    return rows


def fit_models(vectors: DataFrame, features: Sequence[str], ks: Sequence[int], seeds: Sequence[int], id_col: str = "respondent_id",
               max_iter: int = 300, rel_tol: float = 1e-4) -> list[SharedFit]:
    """A model for each k and seed. A model settles when the squared shifts of its
    centres sum to at most ``rel_tol`` times the features' mean variance, or after
    ``max_iter`` iterations. Needs at least one row and features without gaps."""
    features = list(features)
    blocks, n = packed(vectors, features, id_col)
    if not n:
        raise ValueError("no rows to cluster")
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    var = vectors.agg(*[F.var_pop(F.col(c).cast("double")) for c in features]).first()
    tol = rel_tol * float(np.mean([v or 0.0 for v in var]))
    sample = start_sample(vectors, features, id_col, n)
    live = [{"k": int(k), "seed": int(s), "c": plus_plus(sample, int(k), int(s)), "path": [], "last": False, "settled": False} for k in ks for s in seeds]
    width, done = len(features), []
    while live:
        bounds = np.r_[0, np.cumsum([m["k"] for m in live])].tolist()
        found = blocks.mapInArrow(_scan(np.concatenate([m["c"] for m in live]), bounds), "slot int, n double, cost double, s array<double>")
        rows = found.groupBy("slot").agg(F.sum("n"), F.sum("cost"), *[F.sum(F.col("s")[i]) for i in range(width)]).collect()
        total = np.zeros((bounds[-1], 2 + width))
        for r in rows:
            total[r[0]] = r[1:]
        going = []
        for m, lo, hi in zip(live, bounds, bounds[1:]):
            size, cost = total[lo:hi, 0], float(total[lo:hi, 1].sum())
            if m["last"]:
                order = sorted(range(m["k"]), key=lambda j: (-size[j], tuple(m["c"][j])))
                done.append(SharedFit(m["k"], m["seed"], cost, [m["c"][j].tolist() for j in order], [int(size[j]) for j in order], features,
                                      len(m["path"]), m["settled"], [*m["path"], cost]))
                continue
            m["path"].append(cost)
            moved = np.where(size[:, None] > 0, total[lo:hi, 2:] / np.maximum(size, 1)[:, None], m["c"])
            m["settled"] = float(((moved - m["c"]) ** 2).sum()) <= tol
            m["c"], m["last"] = moved, m["settled"] or len(m["path"]) >= max_iter
            going.append(m)
        live = going
    blocks.unpersist()
    return sorted(done, key=lambda f: (f.k, f.cost, f.seed))


def best_by_k(fits: Sequence[SharedFit]) -> dict[int, SharedFit]:
    """The model of least cost for each k (ties: the smaller seed)."""
    best: dict[int, SharedFit] = {}
    for f in sorted(fits, key=lambda f: (f.k, f.cost, f.seed)):
        best.setdefault(f.k, f)
    return best


def squared_distances(fit: SharedFit) -> list:
    """Each centre's squared distance, as arithmetic on the feature columns."""
    out = []
    for center in fit.centers:
        total = F.lit(0.0)
        for c, v in zip(fit.features, center):
            total = total + (F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v))
        out.append(total)
    return out


def nearest(fit: SharedFit):
    """The number of the nearest centre (ties: the smallest) as a column."""
    d = F.array(*squared_distances(fit))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")
