"""Removal of repeated passages by merging Burrows-Wheeler transforms of shards.

A byte is removed if a ``LENGTH``-byte string that covers it also starts earlier
(smaller doc_id, or same document, earlier start).

**Segments.** Every window of ``LENGTH`` bytes is owned by its anchor, the
``GRAM``-byte gram in it with the least hash (the leftmost, of equal ones). The
windows of neighbouring starts with one anchor make a segment. Equal windows have
equal anchors, so windows can repeat only inside a collection of segments with
the same anchor gram; each collection is a job of its own. Collections of a single
segment end here, and equal segments enter a collection once, for the earliest of
them (of the others, all windows are repeats).

**Merge.** The segments of many collections are dealt to shards. Each shard sorts
its suffixes and has a Burrows-Wheeler transform. The shards' transforms are
merged by refining their interleave: from depth 0, where all rows are one block
in shard order, each round puts the rows in stable order of their transform's
symbol and steps to the rows of the suffixes one byte longer. Rows that stay in
one block after h rounds have a common prefix of h bytes; after ``LENGTH`` rounds
the blocks are the intervals of repeated windows. Rows alone in their block have
no common prefix that long and leave, as do suffixes that can't become the start
of a window. No suffix is sorted again across shards.

Collections of more than ``COLLECTION`` segments are split; each part is merged on
its own, and the windows that it keeps meet those of the other parts by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, chunks, mix64, sized, written

LENGTH = 100
GRAM = 16
#: Segments that are merged together at most, and bytes of segments at a time.
COLLECTION = 8192
MERGE_BYTES = 1 << 20
SHARDS = 4
#: Bytes whose windows are hashed at a time (positions in a piece have 21 bits).
PIECE = 1 << 20

_BYTE_VALUE = mix64(np.arange(1000, 1256, dtype=np.uint64))
_LEFT, _RIGHT, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 21) - 1)


# --- segments ----------------------------------------------------------------

def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "both" not in _CACHE:
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        up, down = np.full(PIECE + LENGTH, _STEP), np.full(PIECE + LENGTH, inverse)
        up[0] = down[0] = 1
        _CACHE["both"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _CACHE["both"]


_CACHE: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _piece_segments(data: np.ndarray, valid: np.ndarray, content: bool) -> tuple[np.ndarray, ...]:
    """(gram, content hash, first start, number of starts) of the segments of a
    piece; ``valid`` are the starts of windows that lie in one document."""
    gram = _BYTE_VALUE[data]
    size = 1
    while size < GRAM:
        gram = gram[:-size] * _LEFT + gram[size:] * _RIGHT
        size *= 2
    gram = mix64(gram)
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    wanted, size = LENGTH - GRAM + 1, 1
    while size * 2 <= wanted:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wanted:
        least = np.minimum(least[:size - wanted], least[wanted - size:])
    anchor = (least[valid] & _PLACE).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)])
    starts, n = valid[cut], np.diff(np.r_[cut, len(valid)])
    key = gram[anchor[cut]].view(np.int64)
    if not content:
        return key, starts, n
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:len(data)], out=sums[1:])
    text = mix64((sums[starts + n - 1 + LENGTH] - sums[starts]) * down[starts]).view(np.int64)
    return key, starts, n, text


def _segments(content: bool):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = byte_view(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            sizes = np.diff(offsets)
            inside = np.zeros(len(data) + 1, np.int8)
            for lo, hi in zip(offsets[:-1][sizes >= LENGTH], offsets[1:][sizes >= LENGTH]):
                inside[lo] += 1
                inside[hi - LENGTH + 1] -= 1
            inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
            for at in range(0, len(data), PIECE):
                valid = np.flatnonzero(inside[at:at + PIECE])
                if not len(valid):
                    continue
                found = _piece_segments(data[at:at + PIECE + LENGTH - 1], valid, content)
                if not content:
                    key, n = np.unique(found[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.minimum(n, 2).astype(np.int32))], ["key", "n"])
                    continue
                key, starts, n, text = found
                doc = np.searchsorted(offsets, starts + at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(text), pa.array(n.astype(np.int32)), pa.array(ids[doc]), pa.array(starts + at - offsets[doc])],
                    ["key", "content", "n", "doc_id", "start"])
    return rows


# --- the merge ---------------------------------------------------------------

def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The rotations of ``text`` in order of their first ``depth`` bytes at least."""
    n = len(text)
    turned = np.r_[text, text[np.arange(8) % n]].astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= turned[k:n + k] << np.uint64(56 - 8 * k)
    order = np.argsort(word)
    new = np.r_[True, word[order[1:]] != word[order[:-1]]]
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    known = 8
    while known < depth:
        alone = new & np.r_[new[1:], True]
        left = np.flatnonzero(~alone)
        if not len(left):
            break
        at = order[left]
        both = rank[at] << 32 | rank[(at + known) % n]
        again = np.argsort(both)
        order[left], both = at[again], both[again]
        changed = np.r_[True, both[1:] != both[:-1]]
        new[left] = changed
        first = np.flatnonzero(changed)
        rank[order[left]] = np.repeat(left[first], np.diff(np.r_[first, len(left)]))
        known *= 2
    return order


def merge(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, block) of all windows of ``length`` bytes that the strings
    have more than once, block by block."""
    transforms, steps, positions, base = [], [], [], 0
    owner, place = [], []
    for s in range(min(SHARDS, len(strings))):
        own = np.arange(s, len(strings), SHARDS)
        sizes = np.array([len(strings[k]) + 1 for k in own])
        # one symbol up (0xff never occurs in UTF-8), so that 0 ends each string
        text = np.frombuffer(b"\xff".join([*(strings[k] for k in own), b""]), np.uint8) + np.uint8(1)
        order = suffix_order(text, length)
        transform = text[order - 1]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(base, base + len(text))
        step = rank[order - 1]  # the row of the suffix one byte longer (the transform's last-to-first mapping)
        transforms.append(transform)
        steps.append(step)
        positions.append(order + base)
        owner.append(np.repeat(own, sizes))
        place.append(np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        base += len(text)
    if not base:
        return (np.zeros(0, np.int64),) * 3
    transform, step, position = (np.concatenate(x) for x in (transforms, steps, positions))
    owner, place = np.concatenate(owner), np.concatenate(place)

    row = np.flatnonzero(place[position] >= length)  # suffixes that become a start after ``length`` steps
    block = np.zeros(len(row), np.int64)
    for _ in range(length):
        symbol = transform[row]
        order = np.argsort(symbol, kind="stable")
        symbol, block, row = symbol[order], block[order], step[row[order]]
        new = np.r_[True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])]
        several = ~(new & np.r_[new[1:], True])
        block, row = np.cumsum(new)[several], row[several]
        if not len(row):
            break
    at = position[row]
    return owner[at], place[at], block


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, part) to the spans (doc_id, lo, hi) of repeats; of a
    segment of a split collection also the starts of the windows that it keeps
    with their digests, in one row."""
    held: dict[str, list] = {c: [] for c in ("key", "part", "split", "doc_id", "start", "segment")}

    def run(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        strings = rows["segment"]
        doc, start = np.array(rows["doc_id"], np.int64), np.array(rows["start"], np.int64)
        string, place, block = merge(strings)
        order = np.lexsort((start[string] + place, doc[string], block))
        string, place, block = string[order], place[order], block[order]
        later = np.r_[False, block[1:] == block[:-1]] if len(block) else np.zeros(0, bool)
        windows = np.array([max(0, len(s) - LENGTH + 1) for s in strings])
        base = np.cumsum(windows) - windows
        gone = np.zeros(int(windows.sum()) + 1, bool)
        gone[base[string[later]] + place[later]] = True
        owner = np.repeat(np.arange(len(strings)), windows)
        at = np.flatnonzero(gone)
        if len(at):
            first = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]
            lo, hi = at[first], at[np.r_[first[1:], True]]
            k = owner[lo]
            yield _spans(doc[k], start[k] + lo - base[k], start[k] + hi - base[k] + LENGTH, None)
        split = np.flatnonzero(rows["split"])
        if len(split):
            kept = [[{"at": int(start[k] + t), "digest": hashlib.blake2b(strings[k][t:t + LENGTH], digest_size=16).digest()}
                     for t in range(windows[k]) if not gone[base[k] + t]] for k in split.tolist()]
            yield _spans(doc[split], start[split], start[split], kept)

    size = 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in held)):
            if size >= MERGE_BYTES and (r[0], r[1]) != (held["key"][-1], held["part"][-1]):
                yield from run(held)
                held, size = {c: [] for c in held}, 0
            for c, x in zip(held, r):
                held[c].append(x)
            size += len(r[5])
    if size:
        yield from run(held)


def _spans(doc, lo, hi, kept) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("at", pa.int64()), ("digest", pa.binary())]))
    kept = pa.nulls(len(doc), kind) if kept is None else pa.array(kept, kind)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(hi), kept], ["doc_id", "lo", "hi", "kept"])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spots) to the segments' bytes."""
    for batch in chunks(batches, "text"):
        rows = []
        for doc, text, spots in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spots"))):
            data = text.encode()
            rows += [(s["key"], s["part"], s["split"], doc, s["start"], data[s["start"]:s["start"] + s["n"] - 1 + LENGTH]) for s in spots]
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["key", "part", "split", "doc_id", "start", "segment"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): of each document with any the spans [lo, hi) of bytes that
    repeated windows cover, neither merged nor in order."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = written(docs.mapInArrow(_segments(False), "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
                      .where("n > 1").select("key"), "several")
    segments = written(docs.mapInArrow(_segments(True), "key long, content long, n int, doc_id long, start long")
                       .join(several, "key", "left_semi"), "segments")
    distinct = written(segments.groupBy("key", "content", "n").agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("uses")), "distinct")

    copies = segments.join(distinct.where("uses > 1").select("key", "content", "n", "first"), ["key", "content", "n"])
    copies = copies.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).select(
        "doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + LENGTH).alias("hi"))

    sizes = distinct.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / COLLECTION)
    spots = written(distinct.join(sizes, "key").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(
        "key", F.pmod("content", parts).cast("int").alias("part"), (parts > 1).alias("split"), F.col("first.start").alias("start"), "n")).alias("spots")), "spots")
    # documents without a spot leave before their texts are shuffled
    with_spots = docs.join(sized(spots.select("doc_id"), 16), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    cut = with_spots.join(spots, "doc_id").select("doc_id", "text", "spots").mapInArrow(
        _cut, "key long, part int, split boolean, doc_id long, start long, segment binary")
    merged = written(cut.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(
        _merged, "doc_id long, lo long, hi long, kept array<struct<at:long,digest:binary>>"), "merged")

    kept = merged.where("kept is not null").select("doc_id", F.explode("kept").alias("w")).select(
        "doc_id", F.col("w.at").alias("lo"), (F.col("w.at") + LENGTH).alias("hi"), F.col("w.digest").alias("digest"))
    first = kept.groupBy("digest").agg(F.min(F.struct("doc_id", "lo")).alias("first"), F.count("*").alias("uses")).where("uses > 1")
    across = kept.join(first, "digest").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("lo") != F.col("first.lo")))
    spans = copies.unionByName(merged.where("kept is null").select("doc_id", "lo", "hi")).unionByName(across.select("doc_id", "lo", "hi"))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _whole(data: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The span without characters that it covers in part."""
    while lo < hi and data[lo] & 0xC0 == 0x80:
        lo += 1
    while lo < hi < len(data) and data[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def _removed(characters: bool):
    def rows(batches):
        for batch in chunks(batches, "text"):
            yield _without(batch, characters)
    return rows


def _without(batch: pa.RecordBatch, characters: bool) -> pa.RecordBatch:
    kept, removed = [], []
    for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
        data, merged = (text or "").encode(), []
        for lo, hi in sorted((s["lo"], min(s["hi"], len(data))) for s in spans or ()):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            elif lo < hi:
                merged.append((lo, hi))
        if characters:
            merged = [s for s in (_whole(data, *s) for s in merged) if s[0] < s[1]]
        ends = [0, *(x for span in merged for x in span), len(data)]
        kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
        removed.append([{"lo": a, "hi": b} for a, b in merged])
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    at = batch.schema.get_field_index("spans")
    out = batch.set_column(at, pa.field("spans", kind), pa.array(removed, kind))
    return out.append_column("kept", pa.array(kept, pa.binary()))


def remove_repeats(docs: DataFrame, characters: bool = False) -> DataFrame:
    """``docs`` with spans, the maximal runs [lo, hi) of removed bytes in order,
    and kept, the bytes that remain. With ``characters`` a run ends at whole
    characters (one that is covered in part stays), so kept is UTF-8.

    Null texts are empty. Rows with a null doc_id have no place in the order:
    they keep everything and make nothing a repeat. Rows that share a doc_id are
    one document, repeated. Columns of these names in ``docs`` are replaced."""
    docs = docs.drop("spans", "kept")
    found = written(repeats(docs).withColumnRenamed("doc_id", "_found_id"), "spans")
    total = found.agg(F.sum(F.size("spans"))).first()[0] or 0
    found = F.broadcast(found) if total * 24 <= 16 << 20 else found
    span = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
    both = docs.join(found, docs["doc_id"] == found["_found_id"], "left").drop("_found_id")
    return both.mapInArrow(_removed(characters), T.StructType([*docs.schema, T.StructField("spans", span), T.StructField("kept", T.BinaryType())]))
