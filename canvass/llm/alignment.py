"""Alignment of two tokenizers' tokens by the bytes that they cover.

A is a byte-level tokenizer (tokenizers library), B a piece tokenizer
(sentencepiece library) that puts a space in front. A's character offsets and
the spans of B's proto are the coarse cuts. Where several tokens share the
span of one character (parts of a multibyte character, byte-fallback tokens) the
bytes that the tokens stand for refine them. Offsets at which tokens of both
end cut the text into groups; every token of A in a group is linked with every
one of B in it.

Neither tokenizer joins what stands before a space that follows a non-space with
that space (checked on the vocabulary), so a text is the sequence of its
segments, each from such a space to the next. A task encodes every distinct segment once, many to a
call, and remembers it; a text's numbers are sums over its segments. The memory has a bound in bytes:
beyond it, a worker drops the segments that no later chunk had.

How many documents hold an id pair linked is counted in two levels: a chunk of
texts has each pair once, with its documents, so a pair that every document has
is no larger a key than others; the counts return to the chunks' pairs and are
summed over each document's links there. An executor holds a few chunks at a time as rows
in its heap and in Arrow batches beside it, so a chunk's numbers are packed and its groups go as digests.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import chunks, release, written

#: Bytes of text per chunk, bytes of segments that a task remembers, characters that are encoded in one call.
CHUNK_BYTES = 1 << 20
REMEMBERED_BYTES = 80 << 20
LUMP_CHARS = 1 << 14
#: Bytes of a remembered segment in the index and the list, beside its strings and arrays.
SLOT_BYTES = 60
#: Lumps that the libraries get at a time.
LUMPS = 16
#: Pairs that are laid out at a time.
SLICE = 1 << 21

_CUT = re.compile(r"(?<=\S)(?= .)", re.S)  # a last space stays: B adds no space to nothing


class Side:
    """Token bytes of one tokenizer, and the texts of its ids with what follows one inside and at the end of a group."""

    def __init__(self, table: list[bytes], last: str):
        self.table = table
        self.sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.inner = [f"{i}," for i in range(len(table))]
        self.final = [f"{i}{last}" for i in range(len(table))]

    def joined(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


class Segments:
    """What a task knows of segments: tokens with their ends, groups, and linked id pairs.

    Segment k has rows starts[k]:starts[k + 1] of ids and ends of either side (with ``spans`` only), and of
    pairs and times; counts has its n_a, n_b, n_groups and n_links, and whether it is valid;
    again has whether a later chunk had it."""

    def __init__(self, a_path: str, b_path: str, spans: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet, a_table = byte_alphabet(), [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            a_table[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_table = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sides = Side(a_table, "|"), Side(b_table, ";")
        #: Whether texts can be cut: B has no piece over such a place and leaves spaces as they are.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces) and self.b.normalize(" a  b ") == "▁▁a▁▁b▁"
        self.spans = spans
        self.kinds = (0, 1, 2) if spans else (2,)  # of starts
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.string_bytes = 0
        self.again = np.zeros(0, bool)
        self.counts = np.zeros((0, 5), np.int32)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.ends = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts = [np.zeros(1, np.int64) for _ in range(3)]

    def size(self) -> int:
        """Bytes of what is remembered."""
        arrays = (self.again, self.counts, *self.ids, *self.ends, self.pairs, self.times, *self.starts)
        return sum(x.nbytes for x in arrays) + self.string_bytes + SLOT_BYTES * len(self.texts)

    def thin(self) -> None:
        """Forget the segments that no later chunk had; all of them if the others take over half of the bound."""
        kept = np.flatnonzero(self.again)
        names, texts = list(self.index), self.texts
        self.index = {names[k]: at for at, k in enumerate(kept.tolist())}
        self.texts = [texts[k] for k in kept.tolist()]
        self.string_bytes = sum(map(sys.getsizeof, itertools.chain(self.index, self.texts)))
        for k in self.kinds:
            starts = self.starts[k]
            rows = _spread(starts, kept)[0]
            self.starts[k] = np.r_[0, np.cumsum(starts[kept + 1] - starts[kept])]
            if k == 2:
                self.pairs, self.times = self.pairs[rows], self.times[rows]
            else:
                self.ids[k], self.ends[k] = self.ids[k][rows], self.ends[k][rows]
        self.counts, self.again = self.counts[kept], np.zeros(len(kept), bool)
        if 2 * self.size() > REMEMBERED_BYTES:
            self.forget()

    def split(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def places(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's segments; a null or empty text has none."""
        if self.size() > REMEMBERED_BYTES:
            self.thin()
        old = len(self.texts)
        parts = [self.split(" " + t) if t else [] for t in texts]
        new = [s for s in dict.fromkeys(itertools.chain.from_iterable(parts)) if s not in self.index]
        if new:
            self._learn(new)
        places = [np.fromiter(map(self.index.__getitem__, p), np.int64, len(p)) for p in parts]
        for p in places:
            self.again[p] = True
        self.again[old:] = False
        return places

    def _learn(self, new: list[str]) -> None:
        lumps: list[list[str]] = []
        room = 0
        for s in new:
            if len(s) > room or s[-1].isspace():  # what ends in white space could join with what follows
                lumps.append([])
                room = 0 if s[-1].isspace() else LUMP_CHARS
            lumps[-1].append(s)
            room -= len(s)
        self._append([self._known(*lump) for lump in self._encoded(lumps)])

    def _encoded(self, lumps: list[list[str]]) -> Iterator[tuple]:
        """(segments, whether valid, ids and ends of both sides) of runs of segments."""
        for at in range(0, len(lumps), LUMPS):
            some = lumps[at:at + LUMPS]
            texts = ["".join(x) for x in some]
            ours = self.a.encode_batch(texts, add_special_tokens=False)
            theirs = self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)
            for segments, text, x, y in zip(some, texts, ours, theirs):
                a_ids = np.array(x.ids, np.int32)
                b_ids, b_spans = np.fromiter([v for p in y.pieces for v in (p.id, p.end)], np.int64).reshape(-1, 2).T
                whole = text.encode()
                valid = self.sides[0].joined(x.ids) == whole and self.sides[1].joined(b_ids.tolist()) == whole
                if valid or len(segments) == 1:
                    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                    upto = np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))]
                    char_ends = np.fromiter(itertools.chain.from_iterable(x.offsets), np.int64, 2 * len(a_ids))[1::2]
                    yield (segments, valid, (a_ids, self._refined(0, a_ids, upto[char_ends])),
                           (b_ids.astype(np.int32), self._refined(1, b_ids, b_spans + 1)))
                else:  # find out which segments differ
                    yield from self._encoded([[s] for s in segments])

    def _refined(self, side: int, ids: np.ndarray, coarse: np.ndarray) -> np.ndarray:
        """The byte at which each token ends: that of its span, or by the decoded
        bytes where the next token's span or the one before ends at the same place."""
        fine = np.cumsum(self.sides[side].sizes[ids])
        same = coarse[1:] == coarse[:-1]
        return np.where(np.r_[same, False] | np.r_[False, same], fine, coarse)

    def _known(self, segments: list[str], valid: bool, a: tuple, b: tuple) -> tuple:
        """What is remembered of encoded segments."""
        n = len(segments)
        if not valid:
            none = np.zeros(0, np.int64)
            return segments, [""] * n, np.zeros((n, 5), np.int64), [none] * 2, [none] * 2, none, none, [np.zeros(n, np.int64)] * 3
        upto = np.cumsum([len(s.encode()) for s in segments])
        cuts = np.intersect1d(a[1], b[1], assume_unique=True)
        groups = [np.searchsorted(cuts, side[1]) for side in (a, b)]
        of = [np.searchsorted(upto, side[1]) for side in (a, b)]
        in_group = [np.bincount(g, minlength=len(cuts)) for g in groups]
        group_of = np.searchsorted(upto, cuts)
        counts = np.stack([*(np.bincount(x, minlength=n) for x in of), np.bincount(group_of, minlength=n),
                           np.bincount(group_of, weights=in_group[0] * in_group[1], minlength=n).astype(np.int64), np.ones(n, np.int64)], axis=1)
        # the groups as text: A's tokens before B's in each
        texts = [[(side.final if end else side.inner)[i] for i, end in zip(x[0].tolist(), np.r_[g[1:] != g[:-1], True].tolist())]
                 for side, x, g in zip(self.sides, (a, b), groups)]
        order = np.argsort(np.concatenate([groups[0] * 2, groups[1] * 2 + 1]), kind="stable")
        listed = list(map((texts[0] + texts[1]).__getitem__, order.tolist()))
        bounds = np.r_[0, np.cumsum(counts[:, 0] + counts[:, 1])].tolist()
        strings = ["".join(listed[lo:hi])[:-1] for lo, hi in zip(bounds, bounds[1:])]
        owner, pairs, times = self._pairs(groups, a[0], b[0], group_of)
        before = np.r_[0, upto[:-1]]
        return (segments, strings, counts, [a[0], b[0]], [a[1] - before[of[0]], b[1] - before[of[1]]], pairs, times,
                [counts[:, 0], counts[:, 1], np.bincount(owner, minlength=n)])

    @staticmethod
    def _pairs(groups: list[np.ndarray], a: np.ndarray, b: np.ndarray, segment_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, pair, times): the distinct linked id pairs (A's id << 32 | B's) of each segment.
        Equal ids of a group go together first; the rest is laid out in slices."""
        (ga, na), (gb, nb) = (np.unique(g << 32 | ids, return_counts=True) for g, ids in zip(groups, (a.astype(np.int64), b.astype(np.int64))))
        n_groups = len(segment_of)
        b_first = np.searchsorted(gb >> 32, np.arange(n_groups + 1))
        wide = np.diff(b_first)[ga >> 32]  # how many of B each of A's meets
        found: list[np.ndarray] = []
        upto = np.cumsum(wide)
        lo = 0
        while lo < len(ga):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, side="right")))
            size = wide[lo:hi]
            left = np.repeat(np.arange(lo, hi), size)
            right = np.repeat(b_first[ga[lo:hi] >> 32] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rows = np.stack([segment_of[ga[left] >> 32], (ga[left] & 0xFFFFFFFF) << 32 | (gb[right] & 0xFFFFFFFF), na[left] * nb[right]])
            found.append(_summed(rows))
            lo = hi
        rows = _summed(np.concatenate(found, axis=1)) if len(found) > 1 else found[0] if found else np.zeros((3, 0), np.int64)
        return rows[0], rows[1], rows[2]

    def _append(self, found: list[tuple]) -> None:
        """Add what is known of segments to the memory, all of it at once."""
        segments, strings, counts, ids, ends, pairs, times, sizes = zip(*found)
        for some, texts in zip(segments, strings):
            self.index.update(zip(some, range(len(self.texts), len(self.texts) + len(some))))
            self.texts += texts
            self.string_bytes += sum(map(sys.getsizeof, itertools.chain(some, texts)))
        joined = lambda old, new: np.concatenate([old, *(x.astype(old.dtype, copy=False) for x in new)])
        self.counts = joined(self.counts, counts)
        self.again = np.r_[self.again, np.zeros(len(self.texts) - len(self.again), bool)]
        if self.spans:
            self.ids = [joined(x, new) for x, new in zip(self.ids, zip(*ids))]
            self.ends = [joined(x, new) for x, new in zip(self.ends, zip(*ends))]
        self.pairs, self.times = joined(self.pairs, pairs), joined(self.times, times)
        sizes = list(zip(*sizes))
        for k in self.kinds:
            self.starts[k] = np.r_[self.starts[k], self.starts[k][-1] + np.cumsum(np.concatenate(sizes[k]))]


def _order(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order of rows by owner, then key (neither negative): sorted as one number where both fit into it."""
    parts = owner, key >> 32, key & 0xFFFFFFFF
    _, high, low = bits = [int(x.max(initial=0)).bit_length() for x in parts]
    if sum(bits) > 63:
        return np.lexsort((key, owner))
    return np.argsort((parts[0] << high | parts[1]) << low | parts[2])


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (owner, key, number) with the numbers of equal owners and keys added up."""
    rows = rows[:, _order(rows[0], rows[1])]
    first = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]) if rows.shape[1] else np.zeros(0, np.int64)
    return np.stack([rows[0, first], rows[1, first], np.add.reduceat(rows[2], first) if len(first) else rows[2]])


def _spread(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows starts[k]:starts[k + 1] for each k of ``at``, and which of ``at`` each row is of."""
    size = starts[at + 1] - starts[at]
    of = np.repeat(np.arange(len(at)), size)
    return np.repeat(starts[at] - (np.cumsum(size) - size), size) + np.arange(len(of)), of


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest bytes that hold the largest."""
    return x.astype(np.min_scalar_type(x.max(initial=0))).tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"u{len(packed) // max(n, 1) or 1}")


@functools.lru_cache(maxsize=1)
def segments(a_path: str, b_path: str, spans: bool = False) -> Segments:
    """One memory of segments for all tasks of a worker; it is bounded by ``REMEMBERED_BYTES``."""
    return Segments(a_path, b_path, spans)


#: at and times: ``_packed`` numbers, as many as the last of ends.
_CHUNK = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
          "pairs array<long>, uses array<int>, ends array<int>, at binary, times binary")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else text


def _chunk_rows(a_path: str, b_path: str, told: Callable[[str], str]):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = segments(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", CHUNK_BYTES):
            yield _chunk(known, number, batch.column("doc_id"), known.places(batch.column("text").to_pylist()), told)
            number += 1
    return rows


def _chunk(known: Segments, number: int, doc_ids: pa.Array, places: list[np.ndarray], told: Callable[[str], str]) -> pa.RecordBatch:
    counts = np.stack([known.counts[p].sum(axis=0, dtype=np.int64) if len(p) else np.zeros(5, np.int64) for p in places])
    valid = (counts[:, 4] == [len(p) for p in places]) & (counts[:, 4] > 0)
    counts[~valid] = 0
    texts = [told(";".join(map(known.texts.__getitem__, p.tolist())) if ok else "") for ok, p in zip(valid.tolist(), places)]
    doc = np.repeat(np.arange(len(places)), counts[:, 4])
    flat = np.concatenate([p for ok, p in zip(valid.tolist(), places) if ok] or [np.zeros(0, np.int64)])
    # equal segments of a document first, then their pairs
    doc, flat, uses = _summed(np.stack([doc, flat, np.ones(len(flat), np.int64)]))
    row, of = _spread(known.starts[2], flat)
    doc, pair, times = _summed(np.stack([doc[of], known.pairs[row], known.times[row] * uses[of]]))
    distinct, at = np.unique(pair, return_inverse=True)
    ends = np.searchsorted(doc, np.arange(len(places) + 1))
    n_docs = np.bincount(at, minlength=len(distinct))
    whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), whole(doc_ids, pa.int64()), *[whole(counts[:, k], pa.int64()) for k in range(4)], whole(texts, pa.string()),
        whole(distinct, pa.int64()), whole(n_docs, pa.int32()), whole(ends, pa.int32()),
        pa.array([_packed(at)], pa.binary()), pa.array([_packed(times)], pa.binary())],
        ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "uses", "ends", "at", "times"])


def _aligned(docs: DataFrame, a_path: str, b_path: str, told: Callable[[str], str] = str) -> DataFrame:
    """One row per chunk of texts: its documents with what ``told`` makes of their groups as text, its
    distinct id pairs with the number of its documents that have them linked,
    and each document's pairs (places in those) with how often."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunk_rows(a_path, b_path, told), _CHUNK)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups): each document's groups as
    ``a1,a2|b1;a3|b2,b3`` (ids of A and B in order). Null and empty texts, and
    those that either tokenizer's bytes don't give back, have no tokens: zeros and ''."""
    each = F.arrays_zip("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    return _aligned(docs, a_path, b_path).select(F.explode(each).alias("d")).select("d.*")


def _span_rows(a_path: str, b_path: str):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segments(a_path, b_path, True)
        for batch in chunks(batches, "text", CHUNK_BYTES >> 2):
            for doc_id, p in zip(batch.column("doc_id").to_pylist(), known.places(batch.column("text").to_pylist())):
                columns = [pa.array([doc_id], pa.int64())]
                for side in (0, 1):
                    row, of = _spread(known.starts[side], p if known.counts[p, 4].all() else p[:0])
                    ends = known.ends[side][row].astype(np.int64)
                    size = np.zeros(len(p), np.int64)
                    np.maximum.at(size, of, ends)
                    for x, kind in ((known.ids[side][row], pa.int32()), (ends + (np.cumsum(size) - size)[of], pa.int64())):
                        columns.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "a_ends", "b_ids", "b_ends"])
    return rows


def spans(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a_ids, a_ends, b_ids, b_ends): both tokenizers' ids of each
    document and the byte of space + text at which each token ends; empty where ``align`` has no tokens."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _span_rows(a_path, b_path), "doc_id long, a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>")


def pair_counts(chunked: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents of all chunks each id pair is
    linked, and whether that is the most of A's id. A's id has at most as many
    pairs as B has ids, so a window over them is bounded by the vocabulary."""
    counted = chunked.select(F.explode(F.arrays_zip("pairs", "uses")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.uses").alias("n"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32))))


def _score_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    segments.cache_clear()  # the worker may come from the encoding; its memory is of no more use
    release()
    for batch in batches:
        for row in range(batch.num_rows):
            of = lambda c: batch.column(c)[row].values
            ends, scores = of("ends").to_numpy(), of("scores").to_numpy()
            at, times = (_unpacked(batch.column(c)[row].as_py(), int(ends[-1])) for c in ("at", "times"))
            sums = [np.r_[0, np.cumsum(x[at] * times.astype(np.int64))] for x in (scores & 1, scores >> 1)]
            n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            yield pa.RecordBatch.from_arrays([*(of(c) for c in names), pa.array(n_best), pa.array(count_sum), of("groups")],
                                             [*names, "n_best", "count_sum", "groups_sha256"])


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of ``align``.

    n_best is the number of links whose id pair is, of all pairs of A's id, linked
    in the most documents (ties included); count_sum sums that number over the
    links. A row counts as a document, also if its doc_id is null or repeated;
    other columns play no part. groups_sha256 is '' without tokens."""
    chunked = written(_aligned(docs, a_path, b_path, _digest), "aligned")
    counts = written(pair_counts(chunked), "pair-counts")
    each = chunked.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    score = F.col("n") * 2 + F.col("best").cast("long")
    scored = each.join(counts, "pair").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", score.alias("score")))).alias("scores"))
    rows = chunked.drop("pairs", "uses").join(scored.select("chunk", F.col("scores.score").alias("scores")), "chunk", "left").withColumn(
        "scores", F.coalesce("scores", F.array().cast("array<long>")))
    return rows.mapInArrow(_score_rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
