"""Byte-pair encoding and decoding with a pair occurrence index.

A task collects the distinct pre-tokens of a chunk of texts that it hasn't met
yet, lays their bytes out as one array of symbols with links to both
neighbours, and maps each adjacent pair that has a merge rank to all its
positions. Ranks are taken in ascending order: every position of the pair is
merged at once, the neighbours' links are mended, and the pairs that a merge
makes are added to the lists of their ranks. Positions whose pair has meanwhile
gone are skipped when their list's turn comes.

The vocabulary is a byte-level tokenizer file (JSON) at the same path on every
executor.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

#: The byte-level pre-tokenizer's pattern (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text per chunk, and distinct pre-tokens that a task remembers.
ENCODE_BYTES = 1 << 20
REMEMBERED = 200_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable Latin-1 characters for
    themselves, the other bytes by characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        if spec.get("normalizer") or model["type"] != "BPE" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for char, b in alphabet.items():
            self.byte_ids[b] = ids[char]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        codes = self._code(self.left, self.right)
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * len(self.token_bytes) + b

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 without one."""
        codes = self._code(a, b)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes[sizes > 0])
        if n:
            following[ends - 1] = -1
            before[np.r_[0, ends[:-1]]] = -1

        index: dict[int, list[np.ndarray]] = defaultdict(list)
        waiting: list[int] = []

        def add(at: np.ndarray) -> None:
            found = self.ranks(symbols[at], symbols[following[at]])
            at, found = at[found >= 0], found[found >= 0]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            starts = [0, *cuts.tolist(), len(at)]
            for rank, lo, hi in zip(found[np.r_[0, cuts]].tolist(), starts, starts[1:]):
                if rank not in index:
                    heapq.heappush(waiting, rank)
                index[rank].append(at[lo:hi])

        if n:
            add(np.flatnonzero(following >= 0))
        while waiting:
            rank = heapq.heappop(waiting)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[rank], self.right[rank]
            nexts = following[at]
            live = (symbols[at] == a) & (nexts >= 0)
            live &= symbols[nexts] == b
            at, nexts = at[live], nexts[live]
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair goes
                chained = np.r_[False, nexts[:-1] == at[1:]]
                first = np.flatnonzero(~chained)
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
                at, nexts = at[place % 2 == 0], nexts[place % 2 == 0]
            if not len(at):
                continue
            symbols[at], symbols[nexts] = self.made[rank], -1
            after = following[nexts]
            following[at] = after
            before[after[after >= 0]] = at[after >= 0]
            left = before[at]
            add(np.unique(np.concatenate([left[left >= 0], at[after >= 0]])))

        kept = symbols >= 0
        counts = np.zeros(len(words), np.int64)
        if n:
            counts[sizes > 0] = np.add.reduceat(kept, np.r_[0, ends[:-1]])
        return symbols[kept], counts


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes chunks of texts; remembers the tokens of pre-tokens met before."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.pattern = vocab, regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for token, i in self.vocab.special.items():  # pre-tokens of their own; "\0" keeps them apart from text
            self.index["\0" + token]
            self._add(np.array([i], np.int32), np.array([1]))

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, starts])
        self.counts = np.concatenate([self.counts, counts])

    def _words(self, text: str) -> list[str]:
        split = self.vocab.split
        if split is None or not split.search(text):
            return self.pattern.findall(text)
        words, at = [], 0
        for m in split.finditer(text):
            words += [*self.pattern.findall(text[at:m.start()]), "\0" + m[0]]
            at = m.end()
        return words + self.pattern.findall(text[at:])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the n + 1 offsets of the texts."""
        if len(self.index) > REMEMBERED:
            self.forget()
        known = len(self.starts)
        at, ends = [], [0]
        for text in texts:
            words = self._words(text) if text else []
            at.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
            ends.append(ends[-1] + len(words))
        if len(self.index) > known:
            new = list(self.index)[known:]
            self._add(*self.vocab.merge([w.encode() for w in new]))
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        counts = self.counts[at]
        upto = np.r_[0, np.cumsum(counts)]
        flat = self.ids[np.repeat(self.starts[at] - upto[:-1], counts) + np.arange(upto[-1])]
        return flat, upto[np.array(ends)]


def _decoded(lists: pa.Array, vocab: Vocabulary) -> pa.Array:
    of = vocab.token_bytes.__getitem__
    return pa.array([b"".join(map(of, (x.values.to_numpy() if x.is_valid else ()))).decode("utf-8", "replace") for x in lists], pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column of token ids (array<int>) of every whole text, and
    one of the text that they decode to, if ``decoded`` names it (the same as
    ``decode``, without a second worker).

    Null and empty texts have no tokens. The strings of special tokens in a
    text become those tokens. Columns that are already named so are replaced."""
    added = [ids] if decoded is None else [ids, decoded]
    docs = docs.drop(*added)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for batch in chunks(batches, text, ENCODE_BYTES):
            flat, offsets = encoder.encode(batch.column(text).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            new = [lists] if decoded is None else [lists, _decoded(lists, encoder.vocab)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    types = [T.ArrayType(T.IntegerType()), T.StringType()]
    return docs.mapInArrow(rows, T.StructType([*docs.schema, *(T.StructField(c, t) for c, t in zip(added, types))]))


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the text that the ids stand for (special tokens as their
    strings, bytes that are no UTF-8 as U+FFFD; null or no ids: empty), in place
    of a column of that name."""
    tokens = tokens.drop(text)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(ids), vocabulary(path))], [*batch.schema.names, text])

    return tokens.mapInArrow(rows, T.StructType([*tokens.schema, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode and decode."""
    done = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
