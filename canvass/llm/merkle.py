"""Merkle manifest of a dataset, computed with lag and lead windows.

Every row is a leaf; the leaves of a group ascend by id, and each two consecutive
nodes of a level have a parent until one node is left. The rows keep their
places: the node of level l over the places p ... p + 2^l - 1 stays at its first
row p, so its sibling is at the fixed offset 2^l. Per level a lead column gives
first children their sibling and a lag column second children theirs, masked by
the node's slot and by the length of its run (the last run may be one node); the
first child's row then hashes the parent.

A window never takes a whole group: it spans an aligned block of 2^BLOCK_BITS
places, in which that many levels need no other row. The blocks' last nodes are
the next round's rows. Places come from a range partitioning and the partitions'
counts, so a group of any size is numbered by all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written

#: Levels that one round climbs; a window spans two to this power rows.
BLOCK_BITS = 10

STEPS = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A leaf's input for one column: ``-`` if null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(columns: Sequence[Column]) -> Column:
    """The leaf of a row: the digest of its columns' inputs, integers as decimals."""
    return digest(*[field(c) for c in columns])


def fold(node: Column, steps: Column) -> Column:
    """The node hashed up along its steps: at each, with what stands left and right of it."""
    return F.aggregate(steps, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with pos, the place in the group ``grp`` by ``order`` (nulls first), and n, the group's rows.

    The range partitioning also deals by a random number, so that rows that are
    equal in all of ``order`` don't share a task; which of them comes first is open."""
    keys = ["grp", *order]
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, F.rand(13))
    at = written(dealt.sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    parts = at.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(parts.select("grp", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
                                  F.sum("rows").over(Window.partitionBy("grp")).alias("n")), "starts")
    return at.withColumn("part", part).join(sized(starts, 96), ["grp", "part"]).withColumn(
        "pos", F.col("start") + F.col("at") - F.col("first")).drop("part", "at", "first", "start")


def climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, pos, n, h and others) after BLOCK_BITS levels: steps, what
    stands left and right of each row's node at these levels; h is the last
    node at the first row of each block. Levels above a group's last node add no step."""
    w = Window.partitionBy("grp", F.shiftright("pos", BLOCK_BITS)).orderBy("pos")
    for level in range(BLOCK_BITS):
        width = 1 << level
        slot = F.shiftright("pos", level).bitwiseAND(F.lit(1))
        nodes = nodes.withColumns({"after": F.lead("h", width).over(w), "before": F.lag("h", width).over(w)})
        own, several = F.col("pos").bitwiseAND(F.lit(width - 1)) == 0, F.col("n") > width
        right = F.when((slot == 0) & (F.col("pos") + width < F.col("n")), F.col("after"))
        left = F.when(slot == 1, F.col("before"))
        nodes = nodes.withColumn(f"step{level}", F.when(own & several, F.struct(
            F.coalesce(left, F.lit("")).alias("left"), F.coalesce(right, F.lit("")).alias("right"))))
        parent = F.when(several, digest(F.col("h"), F.col(f"step{level}.right"))).otherwise(F.col("h"))
        nodes = nodes.withColumn("h", F.when(own & (slot == 0), parent)).drop("after", "before")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)  # a node's step is at its first row
    steps = [F.last(f"step{level}", ignorenulls=True).over(upto) for level in range(BLOCK_BITS)]
    return nodes.withColumn("steps", F.filter(F.array(*steps), lambda s: s.isNotNull())).drop(*[f"step{k}" for k in range(BLOCK_BITS)])


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of all groups, written, and (grp, h): each group's last node."""
    rounds = []
    while True:
        done = written(climbed(nodes), "merkle")
        rounds.append(done)
        tops = done.where(F.col("pos").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == 0).select(
            "grp", F.shiftright("pos", BLOCK_BITS).alias("pos"),
            F.shiftright(F.col("n") + ((1 << BLOCK_BITS) - 1), BLOCK_BITS).alias("n"), "h")
        if tops.where("n > 1").isEmpty():
            return rounds, written(tops.select("grp", "h"), "merkle-tops")
        nodes = tops


def _paths(rounds: list[DataFrame], beyond: DataFrame) -> DataFrame:
    """The first round's rows with all steps up to the root; ``beyond`` has each
    group's (grp, rest): its steps after the group's last node."""
    above = None
    for done in reversed(rounds):
        if above is None:
            joined = done.join(sized(beyond, 4096), "grp")
        else:
            up = above.select("grp", F.col("pos").alias("block"), F.col("steps").alias("rest"), *beyond.columns[2:])
            up = written(up, "merkle-paths")
            joined = done.withColumn("block", F.shiftright("pos", BLOCK_BITS)).join(sized(up, 4096), ["grp", "block"]).drop("block")
        above = joined.withColumn("steps", F.concat("steps", "rest")).drop("rest")
    return above


def manifest(rows: DataFrame, group: str, order: Sequence[str], columns: Sequence[str],
             keep: dict[str, Column] | None = None) -> DataFrame:
    """The Merkle manifest of ``rows``: one row each, with the columns of
    ``order`` and ``keep`` (name -> expression), leaf, subroot (its group's last
    node), root, and steps (array of left and right neighbours from leaf to root;
    the run's other nodes, empty where there is none).

    Leaves are digests of ``columns`` in that order; a group's leaves ascend by
    ``order``, nulls first, rows that are equal in it by their leaf. Groups ascend
    by their text's UTF-8 bytes, the null group first. Equal rows are leaves of
    their own. An empty table has no rows and no root. Other columns of ``rows``
    play no part, whatever their names."""
    kept = dict(keep or {})
    names = {f"_k{k}": c for k, c in enumerate(kept.values())}
    orders = {f"_o{k}": F.col(c) for k, c in enumerate(order)}
    # "0" for the null group, "1" and the text for the others: no join on nulls, and the wanted order
    key = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    leaves = written(rows.select(key.alias("grp"), leaf([F.col(c) for c in columns]).alias("leaf"),
                                 *[c.alias(x) for x, c in {**orders, **names}.items()]), "leaves")
    rounds, subroots = _rounds(numbered(leaves, [*orders, "leaf"]).withColumn("h", F.col("leaf")))
    listed = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("lang"), F.col("h").alias("subroot"))
    upper, root = _rounds(numbered(listed, ["lang"]).withColumn("h", F.col("subroot")))
    ends = root.select("grp", F.array().cast(STEPS).alias("rest"), F.col("h").alias("root"))
    beyond = written(_paths(upper, ends).select(F.col("lang").alias("grp"), F.col("steps").alias("rest"), "subroot", "root"), "beyond")
    done = _paths(rounds, beyond)
    return done.select(*[F.col(x).alias(c) for x, c in zip(orders, order)], *[F.col(x).alias(c) for x, c in zip(names, kept)],
                       "leaf", "subroot", "root", "steps")


def proof(steps: Column) -> Column:
    """Digest of the siblings from leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
