"""Euclidean silhouette (C3) by blocked distance sums.

The score averages plain distances, which no per-cluster statistic replaces. A
stated set of points (ids divisible by ``every``; 1 asks all) is scored against
all rows. Rows are packed into blocks; each block of asked points goes to every
block of rows under that block's number, so the rows move once, and each meeting
of two blocks gives one distance sum for each asked point and cluster: never
a row for a pair of points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.plans.joins import join_small, stored

#: Rows of a block, and asked points of one.
BLOCK_ROWS = 8192
ASKED_ROWS = 512
#: Share of the squared lengths below which a squared distance is computed again from differences.
CANCELLED = 1e-6


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, close ones exact too."""
    length = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    sq = length - 2.0 * (a @ b.T)
    i, j = np.nonzero(sq <= CANCELLED * length)
    for lo in range(0, len(i), 1 << 16):
        p, q = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
        sq[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
    return np.sqrt(sq)


def _sums(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            rows, asked = batch.column("rows")[k].values, batch.column("asked")[k].values
            dim = len(asked.field("x")[0])
            a, b = (side.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for side in (asked, rows))
            clusters, of = np.unique(rows.field("c").to_numpy(zero_copy_only=False), return_inverse=True)
            member = np.zeros((len(b), len(clusters)))
            member[np.arange(len(b)), of] = 1.0
            total = np.concatenate([distances(a[lo:lo + 64], b) @ member for lo in range(0, len(a), 64)])
            ids = np.repeat(asked.field("id").to_numpy(zero_copy_only=False), len(clusters))
            own = np.repeat(asked.field("c").to_numpy(zero_copy_only=False), len(clusters))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own), pa.array(np.tile(clusters, len(a))), pa.array(total.ravel())],
                                             ["id", "own", "c", "d"])


def silhouette_points(points: DataFrame, cluster: str = "cluster", vec: str = "vec", id_col: str = "point_id", every: int = 50) -> DataFrame:
    """(id, cluster, a, b, silhouette) of each point whose id is divisible by ``every``.

    a is the mean distance to the other points of its cluster, b the least mean
    distance to those of another one; the silhouette (b - a) / max(a, b), 0 for a
    point alone in its cluster, without another cluster, or with a = b = 0. Rows
    without id, cluster or vector play no part; ids, whole numbers, are unique."""
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array(F.col(vec)) if dict(points.dtypes)[vec] == "vector" else F.col(vec).cast("array<double>")
    rows = stored(points.select(F.col(id_col).cast("long").alias("id"), F.col(cluster).cast("long").alias("c"), x.alias("x")).dropna(), "silhouette-rows")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    n, n_asked = rows.agg(F.count(F.lit(1)), F.count_if(F.pmod("id", F.lit(every)) == 0)).first()
    parts, asked_parts = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_asked // ASKED_ROWS))
    blocks = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("block")).agg(F.collect_list(F.struct("c", "x")).alias("rows"))
    sets = asked.groupBy(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(asked_parts)).alias("set")).agg(F.collect_list(F.struct("id", "c", "x")).alias("asked"))
    sent = sets.select("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("block"))
    sums = blocks.join(sent, "block").select("rows", "asked").mapInArrow(_sums, "id long, own long, c long, d double")
    total = sums.groupBy("id", "own", "c").agg(F.sum("d").alias("d"))
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    mine = F.col("c") == F.col("own")
    near = join_small(total, sizes, "c").groupBy("id", "own").agg(
        F.max(F.when(mine, F.try_divide("d", F.col("n") - 1))).alias("a"), F.min(F.when(~mine, F.col("d") / F.col("n"))).alias("b"))
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return near.select("id", F.col("own").alias("cluster"), "a", "b",
                       F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(score).alias("silhouette"))


def silhouette_euclidean(points: DataFrame, cluster: str = "cluster", vec: str = "vec", id_col: str = "point_id", every: int = 50) -> DataFrame:
    """(silhouette, n_asked): the mean of ``silhouette_points``; no row without an asked point."""
    return silhouette_points(points, cluster, vec, id_col, every).agg(
        F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n_asked")).where("n_asked > 0")
