"""Exact top-k search by inner product with sorted lists and no random access.

Vectors are kept in blocks of rows; each block has one list per component, sorted
by value when it is packed. A query reads a component's list from its top where
its own component is positive and from its bottom where it is negative, all lists
in runs of entries. What a seen row's unread components can add at most follows
from the last entries read, what they add at least from the lists' other ends:
these are the row's upper and lower bound. A row that no list has shown yet can
have no more than the last entries together. Rows whose upper bound is below the
query's bar, the k-th lower bound, are out. A query stops reading once no unseen
row can reach the bar and the few seen ones that can are cheaper to resolve from
their vectors than to read on. The queries of a block share the runs they read,
so their bounds for the rows still in question are one matrix product a run.

A query block first reads one row block, whose k-th best score is the bar that it
brings to all others; while no unseen row is below a brought bar, bounds of rows
need no look. Query blocks are sent to every row block by its number, so rows are
shuffled once; a query's rows of each block are merged by rank at the end. Blocks
hold the narrowest integers that their values fit in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows per block of vectors and per block of queries.
BLOCK_ROWS = 4096
QUERY_ROWS = 512
#: Ends of the runs, as shares of the lists.
RUNS = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1)
#: A query stops reading when at most this share of a block's rows, or so many times k rows, can still qualify.
RESOLVE_SHARE, RESOLVE = 1 / 8, 4

_BLOCK = "block long, dim int, width int, ids binary, data binary"
_LISTS = _BLOCK + ", places binary, sorted binary"
_WIDTHS = (np.int16, np.int32, np.int64)


def integers(vectors: DataFrame, scale: int, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x, as array<long>. Vectors
    that are null or empty or hold a null or non-finite component take no part,
    nor do null ids; a component beyond a long's range is its largest or least value;
    of rows with one id the smallest vector counts."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite)
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _packed(rows: int, lists: bool):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def out(dim, parts):
            nonlocal number
            number += 1
            ids, data = (np.concatenate(x) for x in zip(*parts))
            data = data.astype(next(w for w in _WIDTHS if np.iinfo(w).min <= data.min() and data.max() <= np.iinfo(w).max))
            blobs = [ids, data]
            if lists:
                places = np.argsort(data, axis=0, kind="stable").T.astype(np.int32)
                blobs += [places, np.take_along_axis(data.T, places, axis=1)]
            return pa.RecordBatch.from_arrays([
                pa.array([number - 1], pa.int64()), pa.array([dim], pa.int32()), pa.array([data.itemsize], pa.int32()),
                *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["block", "dim", "width", "ids", "data", "places", "sorted"][:3 + len(blobs)])

        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            sizes = np.diff(ends)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                data = flat[(ends[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                for lo in range(0, len(at), rows):
                    parts = held.setdefault(dim, [])
                    parts.append((ids[at[lo:lo + rows]], data[lo:lo + rows]))
                    while sum(len(p[0]) for p in parts) >= rows:
                        i, d = (np.concatenate(x) for x in zip(*parts))
                        yield out(dim, [(i[:rows], d[:rows])])
                        held[dim] = parts = [(i[rows:], d[rows:])] if len(i) > rows else []
        for dim, parts in held.items():
            if parts:
                yield out(dim, parts)
    return pack


def blocks(vectors: DataFrame, rows: int, lists: bool = False) -> DataFrame:
    """(block, dim, width, ids, data): vectors of one length packed ``rows`` to a
    block; with ``lists`` also places and sorted, one list per component."""
    return vectors.select("vec_id", "v").mapInArrow(_packed(rows, lists), _LISTS if lists else _BLOCK)


def _scores(query: np.ndarray, data: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products, none above ``most``; beyond a long's range they are its largest or least value."""
    if most < 2**62:
        return data.astype(np.int64) @ query
    exact = [sum(int(x) * int(y) for x, y in zip(query, row)) for row in data]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], np.int64)


def block_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, places: np.ndarray, values: np.ndarray,
              k: int, bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score, read): of each query its k best rows of the block,
    highest score first, then smallest id, and the list entries it read; its own
    id is left out. ``places`` and ``values`` are the lists from their bottom, one a
    component. With ``bars``, scores that the queries' k best are known to reach,
    rows below them may be left out.

    Bounds are exact in single or double precision while no sum can pass 2^24 or
    2^53; beyond that they are widened by more than rounding can add up to."""
    n, dim = data.shape
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(values[:, [0, -1]].astype(float)).max(initial=0)) * dim
    kind = np.float32 if most < 2**22 else np.float64
    margin = 0.0 if most < 2**51 else most * dim * 2.0**-48
    asked = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(kind)
    bars = np.full(len(queries), -np.inf) if bars is None else bars.astype(float)
    # what has been read: from the tops in the first half, from the bottoms in the second
    entries, shown = np.zeros((2 * dim, n), kind), np.zeros((2 * dim, n), kind)
    worst = np.concatenate([values[:, 0], values[:, -1]]).astype(kind)[:, None]
    open_ = query_ids[:, None] != ids[None, :]
    column, active, read = np.arange(dim)[:, None], np.arange(len(queries)), 0
    limit = max(RESOLVE * k, int(n * RESOLVE_SHARE))
    found: list[list[np.ndarray]] = [[], [], [], []]

    def clipped(x):
        return np.clip(x, -2.0**63, 2.0**63) if margin else x

    for share in RUNS:
        depth = min(n, max(int(np.ceil(n * share)), read))
        for half, run in ((0, slice(n - depth, n - read)), (dim, slice(read, depth))):
            entries[half + column, places[:, run]] = values[:, run]
            shown[half + column, places[:, run]] = 1
        read = depth
        last = np.concatenate([values[:, n - read], values[:, read - 1]]).astype(kind)[:, None]
        unseen = asked @ last[:, 0]
        due = active[(clipped(unseen[active] + margin) < bars[active]) | np.isneginf(bars[active]) | (read == n)]
        if not len(due):
            continue
        seen = shown.any(axis=0)
        rows = np.flatnonzero(seen & open_[due].any(axis=0))
        mine = open_[np.ix_(due, rows)]
        if len(rows) >= k and np.isneginf(bars[due]).any():
            lower = asked[due] @ (entries[:, rows] - worst * shown[:, rows]) + asked[due] @ worst
            lower = np.where(mine, clipped(lower - margin), -np.inf)
            bars[due] = np.maximum(bars[due], np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k])
        upper = asked[due] @ (entries[:, rows] - last * shown[:, rows]) + unseen[due][:, None]
        mine &= clipped(upper + margin) >= bars[due][:, None]
        open_[np.ix_(due, rows)] = mine
        done = ((clipped(unseen[due] + margin) < bars[due]) & (mine.sum(axis=1) <= limit)) | (read == n)
        for q, left in zip(due[done].tolist(), mine[done]):
            place = rows[left]
            score = _scores(queries[q], data[place], most)
            best = np.lexsort((ids[place], ~score))[:k]  # ~ turns a long's order around
            for out, x in zip(found, (np.full(len(best), q), place[best], score[best], np.full(len(best), read * np.count_nonzero(queries[q])))):
                out.append(x)
        active = np.setdiff1d(active, due[done], assume_unique=True)
        if not len(active):
            break
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in found)


def _pairs(batches):
    """Each joined pair of blocks as arrays: the row's batch and number, query ids
    and vectors, bars or None, then ids, data, places and values of the block."""
    for batch in batches:
        of = {name: batch.column(name) for name in batch.schema.names}
        for r in range(batch.num_rows):
            dim = of["dim"][r].as_py()

            def view(name, kind):
                return np.frombuffer(of[name][r].as_buffer(), kind)

            kind, q_kind = (f"i{of[w][r].as_py()}" for w in ("width", "q_width"))
            bars = view("bars", np.float64) if "bars" in of and of["bars"][r].is_valid else None
            yield {name: of[name][r].as_py() for name in ("block", "q_block")}, (
                view("q_ids", np.int64), view("q_data", q_kind).reshape(-1, dim).astype(np.int64), view("ids", np.int64),
                view("data", kind).reshape(-1, dim), view("places", np.int32).reshape(dim, -1), view("sorted", kind).reshape(dim, -1)), bars


def _first_bars(k: int):
    def rows(batches):
        for number, arrays, _ in _pairs(batches):
            who, _, value, _ = block_top(*arrays, k)
            bars, count = np.full(len(arrays[0]), -np.inf), np.bincount(who, minlength=len(arrays[0]))
            for q in np.flatnonzero(count == k):
                bars[q] = value[who == q].min()
            yield pa.RecordBatch.from_arrays([pa.array([number["q_block"]], pa.int64()), pa.array([bars.tobytes()], pa.binary())], ["q_block", "bars"])
    return rows


def _search(k: int):
    def rows(batches):
        for number, arrays, bars in _pairs(batches):
            who, place, value, read = block_top(*arrays, k, bars)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (arrays[0][who], arrays[2][place], value, np.full(len(who), number["block"]), read)],
                ["query_id", "vec_id", "score", "block", "n_read"])
    return rows


def found_in_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, block, n_read): of every block of vectors of a
    query's length its k best rows there, but for some that cannot be among its k
    best of all, and the list entries it read."""
    stored = written(blocks(vectors, BLOCK_ROWS, lists=True), "vectors")
    n = F.lit(max(1, stored.count())).cast("long")
    numbered = stored.withColumn("place", F.pmod(F.xxhash64("block"), n)).hint("shuffle_merge")
    asked = written(blocks(queries, QUERY_ROWS).select(
        F.col("block").alias("q_block"), "dim", F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "queries")
    # any bar is right, so one of the blocks met will do
    first = numbered.join(asked.withColumn("place", F.pmod(F.xxhash64("q_block"), n)), ["place", "dim"]).mapInArrow(_first_bars(k), "q_block long, bars binary")
    bars = written(first.groupBy("q_block").agg(F.max("bars").alias("bars")), "bars")
    met = asked.join(bars, "q_block", "left").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return numbered.join(met, ["place", "dim"]).mapInArrow(_search(k), "query_id long, vec_id long, score long, block long, n_read long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` (vec_id, v) the k
    rows of ``vectors`` (vec_id, v) with the highest inner products, all if there
    are fewer; ties go to the smaller vec_id, its own row is no candidate.

    Scores beyond a long's range are its largest or least value. Only vectors of the
    query's length are compared. Empty tables give no rows."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found_in_blocks(vectors, queries, k).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
