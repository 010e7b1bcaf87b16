"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are a hash sample of each label's distinct vectors,
more for larger labels up to ``MOST_PIVOTS``. A vector is described by its
``NEAREST`` nearest pivots in order. Inverted lists by pivot bring together the
vectors that share one; those that share at least ``SHARED`` are compared, by
cosine in double precision. Pivots are numbered from the rarest on: whoever
shares enough of them shares one that is among the first
``NEAREST - SHARED + 1`` of either, so only these are listed, and a pair is
looked at in the list of its first common pivot alone.

Equal vectors of a label are one class with a weight. A list is split into
blocks of bounded size, and each two blocks are one unit of work, which returns
one row per linked vector (its number of links there, and one vector of its
component), never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written
from .components import components

#: Pivots that describe a vector, and how many of them two vectors must share to be compared.
#: At a cosine of 0.93 in 64 dimensions 99.98 % of random pairs do, with 1,024 pivots.
NEAREST = 12
SHARED = 3
#: Members that a pivot's list should have on average, and the least and most pivots of a label.
LIST_ROWS = 256
LEAST_PIVOTS = 32
MOST_PIVOTS = 1024
#: Rows of a block.
BLOCK_ROWS = 2048
#: Pairs that are compared at a time.
SLICE = 1 << 16


def _components(vectors: DataFrame, vector: str):
    """The vector column as floats, if it holds those, else as doubles."""
    floats = vectors.schema[vector].dataType.simpleString() == "array<float>"
    return F.col(vector) if floats else F.col(vector).cast("array<double>")


def _usable():
    """Whether a row (vec_id, label, x) can be linked with others; never null."""
    x = F.col("x")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (F.col("label").isNotNull() & F.col("vec_id").isNotNull()
            & F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda c: c != 0), F.lit(False)))


def classes(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(node, label, dim, x, m, rep): the distinct usable vectors of each label,
    how many rows have them and the smallest vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", _components(vectors, vector).alias("x"))
    found = rows.where(_usable()).groupBy("label", "x").agg(F.count("*").alias("m"), F.min("vec_id").alias("rep"))
    return written(found.select(F.monotonically_increasing_id().alias("node"), "label", F.size("x").alias("dim"), "x", "m", "rep"), "vectors")


def pivots(distinct: DataFrame) -> DataFrame:
    """(label, dim, n, points): the pivots of each label and number of components,
    a sample by hash of at most ``MOST_PIVOTS`` vectors."""
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("n"))
    wanted = F.greatest(F.lit(LEAST_PIVOTS), F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") * F.lit(NEAREST / LIST_ROWS))))
    sizes = written(sizes.withColumn("wanted", wanted), "sizes")
    deal = F.xxhash64(F.lit(11), "x")
    # twice as many as wanted pass the hash; the first of them are taken
    share = F.pmod(deal, F.lit(1 << 30)) < F.lit(2.0 * (1 << 30)) * F.col("wanted") / F.col("n") + 64
    chosen = distinct.join(sized(sizes, 64), ["label", "dim"]).where(share).select("label", "dim", "n", "wanted", "node", "x", deal.alias("deal"))
    first = Window.partitionBy("label", "dim").orderBy("deal", "node")
    chosen = chosen.withColumn("k", F.row_number().over(first)).where(F.col("k") <= F.col("wanted"))
    return written(chosen.groupBy("label", "dim").agg(
        F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("points")), "pivots")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by powers of two first, so that no square overflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    return unit(_matrix(lists, dim).astype(np.float64))


def nearest(x: np.ndarray, p: np.ndarray, k: int = NEAREST) -> np.ndarray:
    """The ``k`` nearest of the unit vectors p to each of the unit vectors x (all, if
    fewer), nearest first; the points are numbered from the one that is near the fewest other points on."""
    k = min(k, len(p))
    seen = np.bincount(np.argsort(-(p @ p.T), axis=1, kind="stable")[:, :k].ravel(), minlength=len(p))
    number = np.argsort(np.argsort(seen, kind="stable"))
    found = np.empty((len(x), k), np.int32)
    for lo in range(0, len(x), 1024):
        found[lo:lo + 1024] = number[np.argsort(-(x[lo:lo + 1024] @ p.T), axis=1, kind="stable")[:, :k]]
    return found


def _described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            dim = batch.column("dim")[row].as_py()
            members, points = batch.column("members")[row].values, batch.column("points")[row].values
            prefix = nearest(_unit(members.field("x"), dim), _unit(points, dim))
            n = len(prefix)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * prefix.shape[1], pa.int32()), pa.array(prefix.ravel()))
            yield pa.RecordBatch.from_arrays([
                members.field("node"), pa.array(np.full(n, batch.column("set")[row].as_py())), members.field("m"), members.field("x"), lists],
                ["node", "set", "m", "x", "prefix"])


def described(distinct: DataFrame, points: DataFrame) -> DataFrame:
    """(node, set, m, x, prefix): each vector with its nearest pivots; ``set``
    numbers the pairs of label and number of components."""
    sets = points.withColumn("set", F.monotonically_increasing_id()).withColumn("deals", F.ceil(F.col("n") / BLOCK_ROWS))
    sets = written(sets, "sets")
    small = sets.select("label", "dim", "set", "deals")
    dealt = distinct.join(sized(small, 64), ["label", "dim"]).withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals")))
    blocks = dealt.groupBy("set", "deal", "dim").agg(F.collect_list(F.struct("node", "m", "x")).alias("members"))
    copies = sets.select("set", "points", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    joined = blocks.join(copies, ["set", "deal"]).select("set", "dim", "members", "points")
    x = distinct.schema["x"].dataType.simpleString()
    return joined.mapInArrow(_described, f"node long, set long, m long, x {x}, prefix array<int>")


def postings(vectors: DataFrame, shared: int) -> DataFrame:
    """(set, pivot, parts, part, node, m, x, prefix): the inverted lists of at
    least two vectors; a list of several blocks has so many ``parts``."""
    listed = F.slice(F.array_sort("prefix"), F.lit(1), F.greatest(F.size("prefix") - (shared - 1), F.lit(1)))
    every = vectors.select("set", F.explode(listed).alias("pivot"), "node", "m", "x", "prefix")
    lists = vectors.select("set", F.explode(listed).alias("pivot")).groupBy("set", "pivot").agg(F.count("*").alias("n")).where("n > 1")
    lists = written(lists.select("set", "pivot", F.ceil(F.col("n") / BLOCK_ROWS).alias("parts")), "lists")
    return every.join(sized(lists, 48), ["set", "pivot"]).withColumn("part", F.pmod(F.xxhash64("node", "pivot"), F.col("parts")))


def linked(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, pivot: int, shared: int, cosine: float,
           same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the links between two blocks of unit vectors with pivots
    px, py whose first common pivot is ``pivot``; each pair once if the blocks are the same."""
    shared, beyond = min(shared, px.shape[1]), px.shape[1] + 1
    known, at = np.unique(np.concatenate([px.ravel(), py.ravel()]), return_inverse=True)
    at = at.reshape(-1, px.shape[1])
    has = np.zeros((len(at), len(known)), np.float32)
    np.put_along_axis(has, at, 1, axis=1)
    mine, theirs = has[:len(px)], has[len(px):] * np.where(known < pivot, beyond, 1).astype(np.float32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(x), 256):
        common = mine[lo:lo + 256] @ theirs.T  # a common pivot before this one counts as too many
        i, j = np.nonzero((common >= shared) & (common < beyond))
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), SLICE):
            a, b = i[k:k + SLICE], j[k:k + SLICE]
            near = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
            found.append((a[near], b[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found))


def grouped(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the links (a, b) lead to."""
    to = np.arange(n)
    while True:
        least = np.minimum(to[a], to[b])
        step = to.copy()
        np.minimum.at(step, a, least)
        np.minimum.at(step, b, least)
        np.minimum.at(step, to[a], least)
        np.minimum.at(step, to[b], least)
        step = step[step]
        if (step == to).all():
            return to
        to = step


def _links(cosine: float, shared: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pivot, one, two = (batch.column(c)[row].as_py() for c in ("pivot", "one", "two"))
                members = batch.column("members")[row].values
                part = members.field("part").to_numpy()
                node, m = members.field("node").to_numpy(), members.field("m").to_numpy()
                prefix = _matrix(members.field("prefix"), len(members.field("prefix")[0]))
                x = _unit(members.field("x"), len(members.field("x")[0]))
                a, b = np.flatnonzero(part == one), np.flatnonzero(part == two)
                i, j = linked(x[a], prefix[a], x[b], prefix[b], pivot, shared, cosine, one == two)
                i, j = a[i], b[j]
                n_links = np.zeros(len(node), np.int64)
                np.add.at(n_links, i, m[j])
                np.add.at(n_links, j, m[i])
                to, some = node[grouped(len(node), i, j)], n_links > 0
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n_links[some]), pa.array(to[some])], ["node", "links", "to"])
    return rows


def links(vectors: DataFrame, cosine: float, shared: int) -> DataFrame:
    """(node, links, to): per unit of work and linked vector, how many rows it is
    linked with there and a vector that its links lead to."""
    held = postings(vectors, shared)
    spread = held.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = spread.groupBy("set", "pivot", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two")).agg(
        F.collect_list(F.struct("part", "node", "m", "x", "prefix")).alias("members")).where(F.size("members") > 1)
    return units.select("pivot", "one", "two", "members").mapInArrow(_links(cosine, shared), "node long, links long, to long")


def near_duplicates(vectors: DataFrame, cosine: float, vector: str = "embedding", shared: int = SHARED) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, label and the vector): n_links
    (other rows of its label with at least that cosine), component_id (the
    smallest vec_id that links lead to, itself included) and kept (vec_id = component_id).

    Only vectors of one label and length are compared. Rows whose vec_id, label or
    vector is null, whose vector is empty or zero or holds a null, NaN or
    infinity, are linked with nothing and kept. Equal rows are linked with
    each other; rows that share a vec_id are vectors of their own. Other columns
    play no part."""
    distinct = classes(vectors, vector)
    about = written(described(distinct, pivots(distinct)), "described")
    found = written(links(about, cosine, shared), "found")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    merged = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    linked_ = distinct.select("node", "rep").join(merged, "node")
    least = linked_.groupBy("component").agg(F.min("rep").alias("least"))
    of = linked_.join(least, "component").select("node", "least")
    whole = written(distinct.join(counted, "node", "left").join(of, "node", "left").select(
        "label", "x", "m", "rep", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("least", "rep").alias("component_id")), "classes")
    result = [F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")]
    single = whole.where("m = 1").withColumn("vec_id", F.col("rep")).select("vec_id", *result)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", _components(vectors, vector).alias("x"))
    several = whole.where("m > 1").drop("m", "rep")
    dim = several.agg(F.max(F.size("x"))).first()[0] or 0
    copies = rows.join(sized(several, 64 + 8 * dim), ["label", "x"]).select("vec_id", *result)
    alone = rows.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return single.unionByName(copies).unionByName(alone)
