"""Near-duplicates by bottom-k sketches of one hash function.

A document is the set of its distinct word shingles, each a 64-bit hash; its
sketch is the ``SKETCH`` smallest. Documents with equal sets are one class from
the start. Inverted lists of the retained values give the classes that overlap;
of each sketch only as many values are listed, rarest first, as are needed to
meet every class that it could be linked with. For the classes that meet one
there, the same is done with their full sets, where the needed number is exact:
a class with too many shingles of its own leaves, a shingle that many share lists
only those that have no rarer ones to meet by, and two of a list are a pair only if
what each has from that shingle on suffices. The shares of common values
among the smallest of the united sketches estimate the similarity of a pair; what
remains is confirmed on the full sets, made again from the texts.

No list is expanded into all its pairs: a list first links its members to one of
them (in the first round to that with the fewest shingles of its own, the
likeliest centre of its copies, then to others). What is then in one component
needs no further pair; only members of different components of a list are
compared with each other in the last round, so no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_view, chunks, mix64, sized, written
from .components import components

SHINGLE = 5
SKETCH = 64
#: How far an estimate may be below the wanted similarity for the pair to be confirmed:
#: over four standard deviations of an estimate from ``SKETCH`` values.
SLACK = 0.2
#: Rounds that link a list's members to one of them before members are compared.
STAR_ROUNDS = 3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that become sets at a time.
SET_BYTES = 1 << 20
#: What is added to every byte's value when pairs are confirmed, so that two sets
#: of hashes would both have to fail for a wrong link.
CONFIRM_SALT = 0xD6E8FEB86659FD93


def shingle_sets(data: np.ndarray, offsets: np.ndarray, salt: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingles (as int64) of each of n texts, given their
    bytes and n + 1 offsets. A word is the sum of one mixed value for each byte
    and place, so no sum of powers can make words equal; ``salt`` gives another hash. A text of fewer words than a shingle, but not none,
    has one shingle of all its words."""
    n_texts = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.int64)] * n_texts
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(~space & (np.r_[True, space[:-1]] | first[:-1]))
    if not len(starts):
        return [np.zeros(0, np.int64)] * n_texts
    run = np.diff(np.r_[starts, len(data)])
    place = np.arange(starts[0], len(data)) - np.repeat(starts, run)
    value = mix64((_BYTE_VALUE + np.uint64(salt))[_LOWER[data[starts[0]:]]] ^ (place.astype(np.uint64) * _STEP))
    value[space[starts[0]:]] = 0
    word = mix64(np.add.reduceat(value, starts - starts[0]))

    bounds = np.searchsorted(starts, offsets)
    whole = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        whole = whole * _STEP + word[k:k + len(whole)]
    whole = mix64(whole + np.uint64(SHINGLE)).view(np.int64)
    sets = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= SHINGLE:
            sets.append(np.unique(whole[lo:hi - SHINGLE + 1]))
        else:
            h = np.zeros(1, np.uint64)
            for k in range(lo, hi):
                h = h * _STEP + word[k:k + 1]
            sets.append(mix64(h + np.uint64(hi - lo)).view(np.int64) if hi > lo else np.zeros(0, np.int64))
    return sets


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", SET_BYTES):
        sets = shingle_sets(*byte_view(batch.column("text")))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "sketch"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch) of (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _sketches, "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def _of_sketch(percent: int) -> Column:
    """How many of its rarest retained values a class must list: one more than
    it can have without meeting a linked class. A full sketch shares at least
    the share ``percent / 100 - SLACK`` of its values with a linked one's; a set
    that is its own sketch shares what its size demands."""
    n = F.col("n")
    full = F.lit(SKETCH - int(np.ceil((percent / 100 - SLACK) * SKETCH)) + 1)
    beyond = F.greatest(F.floor(n * 100 / percent) - SKETCH, F.lit(0))
    return F.when(n >= SKETCH, full).otherwise(n - F.ceil(n * percent / 100) + beyond + 1)


def _of_set(percent: int) -> Column:
    """How many of its rarest shingles a class must list to meet every linked one."""
    return F.col("n") - F.ceil(F.col("n") * percent / 100) + 1


def postings(classes: DataFrame, held: Column, wanted: Column) -> DataFrame:
    """(value, rep, n, alone, place): the inverted lists, of at least two classes
    each, of the ``wanted`` rarest values of each (rep, n, sketch). ``held`` is the
    number of its values, alone how many of them no other class has, place how
    many are rarer than this one."""
    every = classes.select("rep", "n", F.explode("sketch").alias("value"))
    frequent = every.groupBy("value").agg(F.count("*").alias("uses")).where("uses > 1")
    live = (every.join(frequent, "value").groupBy("rep", "n")
            .agg(F.array_sort(F.collect_list(F.struct("uses", "value"))).alias("listed"))
            .withColumn("alone", held - F.size("listed")))
    take = F.greatest(wanted - F.col("alone"), F.lit(0)).cast("int")
    return (live.select("rep", "n", "alone", F.posexplode(F.slice("listed", F.lit(1), take)).alias("at", "x"))
            .select(F.col("x.value").alias("value"), "rep", "n", "alone", (F.col("alone") + F.col("at")).alias("place")))


def _full_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", SET_BYTES):
        sets = shingle_sets(*byte_view(batch.column("text")))
        yield pa.RecordBatch.from_arrays([
            batch.column("rep"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "n", "sketch"])


def _can_link(percent: int) -> Column:
    """Whether two members of a list can be alike enough if its value is the first
    in order that they share: then they share no more than what each has from
    there on. A linked pair passes in the list of its first common value."""
    most = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    return most * (100 + percent) >= (F.col("n") + F.col("n2")) * percent


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose united sketch doesn't rule the link out."""
    one = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    # beyond the larger of two full sketches' last values nothing is known of either set
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return both.where(common >= F.size(union) * F.lit(percent / 100 - SLACK)).select("a", "b")


def _confirm(percent: int):
    def rows(batches):
        for batch in chunks(batches, "text_b", SET_BYTES):
            b_sets = shingle_sets(*byte_view(batch.column("text_b")), CONFIRM_SALT)
            known: dict[int, np.ndarray] = {}
            links = ([], [])
            for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                if a not in known:
                    known = {a: shingle_sets(*byte_view(batch.column("text_a").slice(k, 1)), CONFIRM_SALT)[0]}
                common = len(np.intersect1d(known[a], b_sets[k], assume_unique=True))
                if 100 * common >= percent * (len(known[a]) + len(b_sets[k]) - common):
                    links[0].append(a)
                    links[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])
    return rows


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar by their full sets."""
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    """One row per document: n_shingles (set size), component_id and kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    shingle sets; component_id is the smallest doc_id reachable, kept is doc_id
    = component_id. Null, empty and blank texts have an empty set and no link;
    rows with a null doc_id are not linked and kept (component_id null); rows
    that share a doc_id count as one document, repeated."""
    sets = written(sketches(docs), "sketches")
    classes = written(
        sets.where("n_shingles > 0 and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    met = written(postings(classes, F.least("n", F.lit(SKETCH)), _of_sketch(percent)).select("rep").distinct(), "met")
    texts = written(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(sized(met, 16), "rep", "left_semi")
                    .groupBy("rep").agg(F.max("text").alias("text")), "texts")
    sets_met = texts.mapInArrow(_full_sets, "rep long, n long, sketch array<long>")
    lists = written(postings(sets_met, F.col("n"), _of_set(percent)), "lists")
    listed = written(lists.select("rep").distinct(), "listed")
    near = written(classes.join(sized(listed, 16), "rep", "left_semi").select("rep", "sketch"), "near")

    links, of = None, listed.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    for number in range(STAR_ROUNDS + 1):
        open_ = lists.join(of, lists["rep"] == of["node"]).drop("node")
        several = open_.groupBy("value").agg(
            F.min_by(F.struct("rep", "n", "place", "component"),
                     F.struct("alone", "rep") if not number else F.struct(F.xxhash64(F.lit(number), "rep", "value"))).alias("middle"),
            F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
        if number < STAR_ROUNDS:
            met = open_.join(several, "value").select(
                "rep", "n", "place", "component", F.col("middle.rep").alias("rep2"), F.col("middle.n").alias("n2"), F.col("middle.place").alias("place2"),
                F.col("middle.component").alias("component2"))
        else:
            other = open_.select("value", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("component").alias("component2"))
            met = open_.join(several.select("value"), "value", "left_semi").join(other, "value").where("rep < rep2")
        pairs = (met.where((F.col("component") != F.col("component2")) & _can_link(percent))
                 .select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct())
        found = written(_confirmed(_estimated(pairs, near, percent), texts, percent), "found")
        links = found if links is None else links.unionByName(found)
        merged = components(links)
        of = listed.join(merged, listed["rep"] == merged["node"], "left").select(
            F.col("rep").alias("node"), F.coalesce("component", "rep").alias("component"))

    whole = classes.join(merged, classes["rep"] == merged["node"], "left").select(
        "set_key", F.coalesce("component", "rep").alias("found_id"))
    # what has no class takes no part in the join: rows of one key would meet in one task
    has_class = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = sets.select("doc_id", "n_shingles", "set_key")
    return own.where(has_class).join(whole, "set_key").select(
        "doc_id", "n_shingles", F.col("found_id").alias("component_id"), (F.col("doc_id") == F.col("found_id")).alias("kept")).unionByName(
        own.where(~has_class).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def deduplicate(docs: DataFrame, percent: int) -> DataFrame:
    """The documents but those that a smaller doc_id of their component stands for."""
    gone = written(near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id")).distinct(), "gone")
    return docs.join(sized(gone, 16), docs["doc_id"] == F.col("_gone_id"), "left_anti")
