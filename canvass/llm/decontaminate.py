"""Benchmark decontamination with a positional inverted index.

``build_index`` turns the documents into index shards, one table row each: the
terms of a run of documents in sorted order and, term by term, the ascending
positions of all their occurrences (delta-coded), together with where each
document's words begin. The shards are written to the shared folder; every word
of every document is in exactly one of them, so a shard is searched on its own
and nothing is shuffled for a search.

``search`` takes the windows of the test items. In each shard a window starts
from the list of its rarest term there, moves it by the term's offset and
intersects it with the lists of the other terms in ascending length: exactly
(a phrase), or within ``slop`` words of where the term should be (proximity).
Items come to the tasks in blocks of bounded size, whatever their number.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, sized, written

WINDOW = 10
SLOP = 3
#: Bytes of text per index shard, and of test items sent to the tasks at a time.
SHARD_BYTES = 4 << 20
ITEM_BLOCK_BYTES = 8 << 20

_DELIMIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_INDEX = ("doc_ids array<long>, digests array<binary>, n_words array<int>, starts array<int>, "
          "terms binary, counts binary, positions binary")
_HITS = "doc_id long, digest binary, spans array<struct<lo:int,hi:int>>, items array<string>, near_items array<string>"


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return text.encode().translate(_DELIMIT).split() if text else []


def build_index(docs: DataFrame, gap: int) -> DataFrame:
    """Index shards of (doc_id, text); words of neighbouring documents are
    ``gap`` positions apart. A null text has no words."""
    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHARD_BYTES):
            index: dict[bytes, int] = {}
            term_of, starts, sizes, digests, at = [], [], [], [], 0
            for text in batch.column("text").to_pylist():
                found = words(text)
                for w in found:
                    if w not in index:
                        index[w] = len(index)
                term_of.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
                starts.append(at)
                sizes.append(len(found))
                digests.append(hashlib.sha256(text.encode() if text else b"").digest())
                at += len(found) + gap
            terms = sorted(index)
            rank = np.zeros(len(terms), np.int32)
            rank[[index[t] for t in terms]] = np.arange(len(terms), dtype=np.int32)
            flat = rank[np.concatenate(term_of)]
            places = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)) * gap, sizes)
            order = np.argsort(flat, kind="stable")
            counts = np.bincount(flat, minlength=len(terms))
            places = places[order]
            deltas = np.diff(places, prepend=0)
            first = np.cumsum(counts) - counts
            deltas[first] = places[first]
            row = (batch.column("doc_id").to_pylist(), digests, sizes, starts,
                   b" ".join(terms), counts.astype(np.int32).tobytes(), deltas.astype(np.int32).tobytes())
            kinds = (pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split(" ")[0] for c in _INDEX.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shards, _INDEX)


class Shard:
    """The postings of an index shard, opened for search."""

    def __init__(self, row: dict):
        terms = row["terms"].split(b" ") if row["terms"] else []
        self.index = dict(zip(terms, range(len(terms))))
        self.counts = np.frombuffer(row["counts"], np.int32)
        self.first = np.cumsum(self.counts) - self.counts
        self.deltas = np.frombuffer(row["positions"], np.int32)
        self.starts = np.array(row["starts"], np.int64)
        self.opened: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray:
        if term not in self.opened:
            lo = self.first[term]
            self.opened[term] = np.cumsum(self.deltas[lo:lo + self.counts[term]], dtype=np.int64)
        return self.opened[term]

    def match(self, window: list[int], slop: int) -> np.ndarray:
        """Starts at which every term of the window is within ``slop`` words of its place."""
        order = sorted(range(len(window)), key=lambda k: self.counts[window[k]])
        at = self.positions(window[order[0]]) - order[0]
        for k in order[1:]:
            listed = self.positions(window[k])
            place = np.searchsorted(listed, at + k - slop)
            found = listed[np.minimum(place, len(listed) - 1)]
            at = at[(place < len(listed)) & (found <= at + k + slop)]
            if not len(at):
                break
        return at


def windows(items: Iterable[tuple[object, str | None]], size: int) -> dict[tuple[bytes, ...], list[str]]:
    """Each distinct window of the items and the ids of the items that have it;
    an item of fewer words, but not none, is one window."""
    found: dict[tuple[bytes, ...], list[str]] = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            owners = found.setdefault(tuple(w[k:k + size]), [])
            if item is not None and str(item) not in owners[-1:]:
                owners.append(str(item))
    return found


def _search(test: bytes, slop: int):
    def rows(batches):
        sought = pickle.loads(test)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                spans: dict[int, list[tuple[int, int]]] = {}
                exact: dict[int, set[str]] = {}
                near: dict[int, set[str]] = {}
                for window, owners in sought.items():
                    ids = [shard.index.get(w, -1) for w in window]
                    if -1 in ids or not len(around := shard.match(ids, slop)):
                        continue
                    for d in np.searchsorted(shard.starts, np.maximum(around, 0), side="right") - 1:
                        near.setdefault(int(d), set()).update(owners)
                    for s in shard.match(ids, 0):
                        d = int(np.searchsorted(shard.starts, s, side="right")) - 1
                        lo = int(s - shard.starts[d])
                        spans.setdefault(d, []).append((lo, lo + len(window)))
                        exact.setdefault(d, set()).update(owners)
                if near:
                    hit = sorted(near)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["doc_ids"][d] for d in hit], pa.int64()),
                        pa.array([row["digests"][d] for d in hit], pa.binary()),
                        pa.array([[{"lo": a, "hi": b} for a, b in _merged(spans.get(d, []))] for d in hit],
                                 pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                        pa.array([sorted(exact.get(d, ())) for d in hit], pa.list_(pa.string())),
                        pa.array([sorted(near[d]) for d in hit], pa.list_(pa.string())),
                    ], ["doc_id", "digest", "spans", "items", "near_items"])
    return rows


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Phrase and proximity matches per document with any: the word spans that
    windows of (item_id, text) cover, the items with such windows, and the items
    with a window whose terms are all within ``slop`` words of their places."""
    items = items.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // ITEM_BLOCK_BYTES
    found = None
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        test = pickle.dumps(windows(((r.item_id, r.text) for r in block.toLocalIterator()), window))
        part = index.mapInArrow(_search(test, slop), _HITS)
        found = part if found is None else found.unionByName(part)
    at = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.sequence(s.lo, s.hi - 1))))
    return found.distinct().groupBy("doc_id", "digest").agg(
        F.size(at).cast("long").alias("n_hit"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per document (doc_id, text): n_words, n_hit (words inside any
    occurrence of a window), spans, items, near_items, contaminated.

    Null or empty texts have no words and no hits; repeated rows have a result
    each; an item of null id covers words but isn't listed; no items, no hits."""
    index = written(build_index(docs, window + slop + 1), "postings")
    hits = search(index, items, window, slop)
    listed = (index.select(F.explode(F.arrays_zip("doc_ids", "digests", "n_words")).alias("d"))
              .select(F.col("d.doc_ids").alias("doc_id"), F.col("d.digests").alias("digest"), F.col("d.n_words").cast("long").alias("n_words")))
    key = [listed["doc_id"].eqNullSafe(hits["doc_id"]), listed["digest"] == hits["digest"]]
    none = F.array().cast("array<string>")
    return listed.join(hits, key, "left").select(
        listed["doc_id"], listed["digest"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "spans",
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents (text and any other columns) without a hit word. Whether a
    text is hit depends on it alone, so rows leave by their text's digest."""
    hit = written(matches(docs, items).where("contaminated").select(F.col("digest").alias("_hit")).distinct(), "hits")
    own = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return docs.join(sized(hit, 48), own == F.col("_hit"), "left_anti")
