"""Language identification of mixed-language text.

A word's script (a range of code points) narrows the languages that it can be
in to those whose training texts use that script. Its score in each of them is
the log-likelihood of its letter n-grams. Viterbi over the words of a text, with
a penalty for each switch of language, then labels spans; the document's
language is the one with the most letters.

The model is a table of n-gram counts by language, counted on the executors
over a bounded hash sample of the labelled documents and sent to every task; its
size depends on its slots and languages alone.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, mix64, sized

#: Documents per language that the model is fitted on (about), n-gram slots and lengths.
SAMPLE_PER_LANGUAGE = 1500
SLOTS = 1 << 17
LENGTHS = (1, 2, 3, 4)
#: Log-probability that a switch of language costs.
SWITCH_PENALTY = 12.0
#: Share of a language's letters that a script must have to count as one of its scripts.
SCRIPT_SHARE = 0.01
#: Bytes of text turned into arrays at a time, and distinct words whose scores a task remembers.
PIECE = 1 << 19
REMEMBERED = 150_000

#: Scripts by ranges of code points (fixed values; 0 is every other script).
SCRIPT_RANGES = [
    (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1),  # Latin
    (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2),  # Greek
    (0x0400, 0x052F, 3),  # Cyrillic
    (0x0530, 0x058F, 4),  # Armenian
    (0x0590, 0x05FF, 5),  # Hebrew
    (0x0600, 0x06FF, 6), (0x0750, 0x077F, 6),  # Arabic
    (0x0900, 0x097F, 7),  # Devanagari
    (0x0980, 0x09FF, 8),  # Bengali
    (0x0E00, 0x0E7F, 9),  # Thai
    (0x1100, 0x11FF, 10), (0xAC00, 0xD7AF, 10),  # Hangul
    (0x3040, 0x30FF, 11),  # Kana
    (0x3400, 0x9FFF, 12), (0x20000, 0x2FA1F, 12),  # Han
]
SCRIPTS = 13


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its script."""
    letter = np.zeros(0x110000, bool)
    letter[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = True
    script = np.zeros(0x110000, np.uint8)
    for lo, hi, s in SCRIPT_RANGES:
        script[lo:hi + 1] = s
    return letter, script


class Words:
    """The words (runs of letters, lower-cased) of a run of texts."""

    def __init__(self, texts: list[str], lower: bool = True):
        letter, script = _tables()
        texts = [t.lower() for t in texts] if lower else texts
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.whole = "\n".join([*texts, ""])
        points = np.frombuffer(self.whole.encode("utf-32-le", "replace"), np.uint32)
        is_letter = letter[points]
        edge = np.diff(np.r_[False, is_letter, False].astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.bases = np.cumsum(sizes + 1) - sizes - 1
        self.text = np.searchsorted(self.bases, self.starts, side="right") - 1
        self.points = points
        self.script = script[points[self.starts]] if len(self.starts) else np.zeros(0, np.uint8)
        self.letters = self.ends - self.starts

    def strings(self) -> Iterator[str]:
        """The words themselves."""
        return (self.whole[lo:hi] for lo, hi in zip(self.starts.tolist(), self.ends.tolist()))

    def grams(self, lengths: tuple[int, ...] = LENGTHS, n_slots: int = SLOTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(slot, word) of all n-grams by length; a word has one blank at each end.
        ``n_slots`` is a power of 2."""
        n = len(self.starts)
        sizes = self.letters + 2
        at = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(n), sizes)
        inside = np.arange(len(word)) - at[word]
        source = self.starts[word] + inside - 1
        blank = (inside == 0) | (inside == sizes[word] - 1)
        symbol = np.where(blank, 32, self.points[np.clip(source, 0, len(self.points) - 1)]).astype(np.uint64)
        code = np.zeros(len(symbol), np.uint64)
        for k in range(max(lengths)):
            code = code[:len(symbol) - k] * np.uint64(0x110003) + symbol[k:] if k else symbol + np.uint64(1)
            fits = inside[:len(code)] + k < sizes[word[:len(code)]]
            if k + 1 in lengths:
                slots = (mix64(code + np.uint64(k)) >> np.uint64(20)).astype(np.int64) & (n_slots - 1)
                yield slots[fits], word[:len(code)][fits]


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """The model of (text, lang) rows: a hash sample of about ``per_language``
    texts of each language (all, if fewer); null texts and languages take no part."""
    docs = docs.select("text", "lang").where("text is not null and lang is not null")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    chosen = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 30)) < F.lit(float(per_language << 30)) / F.col("n")
    sample = docs.join(sized(sizes, 64), "lang").where(chosen).select("text", "lang")
    rows = sample.mapInArrow(_counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()

    languages = sorted({r.lang for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    counts, scripts = np.zeros((SLOTS, len(languages))), np.zeros((SCRIPTS, len(languages)))
    for r in rows:
        if r.slot >= 0:
            counts[r.slot, place[r.lang]] = r.n
        else:
            scripts[-1 - r.slot, place[r.lang]] = r.n
    seen = np.maximum(counts.sum(axis=0), 1)
    used = (counts.sum(axis=1) > 0).sum()
    scores = np.log((counts + 0.5) / (seen + 0.5 * used)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return {"languages": languages, "scores": scores, "allowed": allowed, "prior": int(seen.argmax()) if languages else 0}


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language; slot -1 - s has the letters of script s."""
    total: dict[str, np.ndarray] = {}
    for batch in chunks(batches, "text", PIECE):
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            words = Words([t for t, x in zip(batch.column("text").to_pylist(), langs) if x == lang])
            into = total.setdefault(lang, np.zeros(SLOTS + SCRIPTS, np.int64))
            for slots, _ in words.grams():
                into[:SLOTS] += np.bincount(slots, minlength=SLOTS)
            into[SLOTS:] += np.bincount(words.script, weights=words.letters, minlength=SCRIPTS).astype(np.int64)
    for lang, into in total.items():
        at = np.flatnonzero(into)
        slot = np.where(at < SLOTS, at, SLOTS - 1 - at)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(slot, pa.int32()), pa.array(into[at])], ["lang", "slot", "n"])


def word_scores(model: dict, words: Words) -> np.ndarray:
    """Log-likelihood of each word by language; minus infinity where its script
    rules the language out. A word whose script no language uses scores 0 in all."""
    scores = np.zeros((len(words.starts), len(model["languages"])))
    for slots, word in words.grams():
        found = model["scores"][slots]
        for k in range(scores.shape[1]):
            scores[:, k] += np.bincount(word, weights=found[:, k], minlength=len(scores))
    allowed = model["allowed"][words.script]
    known = allowed.any(axis=1)
    scores[~known] = 0
    return np.where(allowed | ~known[:, None], scores, -np.inf)


class Scorer:
    """Word scores of a model; scores each distinct word once."""

    def __init__(self, model: dict):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model["languages"])))

    def __call__(self, words: Words) -> np.ndarray:
        """``word_scores`` of the words."""
        if len(self.index) > REMEMBERED:
            self.forget()
        strings = list(words.strings())
        new = [w for w in dict.fromkeys(strings) if w not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.scores = np.concatenate([self.scores, word_scores(self.model, Words(["\n".join(new)], lower=False))])
        return self.scores[np.fromiter(map(self.index.__getitem__, strings), np.int64, len(strings))]


def best_paths(scores: np.ndarray, text: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """``viterbi``, which it leaves out for texts that have one language that is the
    best for each of their words: no path is better than to stay in it (in the
    first of such languages, as ``viterbi`` does)."""
    if not len(text):
        return viterbi(scores, text, n_texts, penalty)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    always = np.logical_and.reduceat(scores == scores.max(axis=1)[:, None], first, axis=0)
    plain = np.zeros(n_texts, bool)
    plain[text[first]] = always.any(axis=1)
    stay = np.zeros(n_texts, np.int16)
    stay[text[first]] = always.argmax(axis=1)
    labels, rest = stay[text], ~plain[text]
    if rest.any():
        number = np.cumsum(~plain) - 1
        labels[rest] = viterbi(scores[rest], number[text[rest]], int((~plain).sum()), penalty)
    return labels


def viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """The language of every word: the best path of each text. ``text`` ascends;
    the texts advance word by word side by side."""
    sizes = np.bincount(text, minlength=n_texts)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[order], -np.arange(1, max(sizes, default=0) + 1), side="right")
    best = np.zeros((n_texts, scores.shape[1]))
    switched = np.zeros(scores.shape, bool)
    leader = np.zeros(len(scores), np.int16)
    first = first[order]
    for t, a in enumerate(active.tolist()):
        at, v = first[:a] + t, best[:a]
        if t:
            lead = v.argmax(axis=1)
            other = v[np.arange(a), lead] - penalty
            leader[at], switched[at] = lead, other[:, None] > v
            v = np.maximum(v, other[:, None])
        best[:a] = v + scores[at]
    labels = np.zeros(len(scores), np.int16)
    state = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        labels[at] = state[:a]
        state[:a] = np.where(switched[at, state[:a]], leader[at], state[:a])
    return labels


def _label(scorer: Scorer, texts: list[str], penalty: float) -> tuple[Words, np.ndarray]:
    words = Words(texts)
    if not scorer.model["languages"]:
        return words, np.zeros(len(words.starts), np.int16)
    return words, best_paths(scorer(words), words.text, len(texts), penalty)


def _predict(model: bytes, penalty: float):
    def rows(batches):
        m = pickle.loads(model)
        scorer = Scorer(m)
        for batch in chunks(batches, "text", PIECE):
            texts = batch.column("text").to_pylist()
            words, labels = _label(scorer, [t or "" for t in texts], penalty)
            n_langs = max(1, len(m["languages"]))
            share = np.bincount(words.text * n_langs + labels, weights=words.letters, minlength=len(texts) * n_langs).reshape(len(texts), n_langs)
            total, top = share.sum(axis=1), share.argmax(axis=1)
            none = (total == 0) | (not m["languages"])
            pred = ["und" if n else m["languages"][k] for n, k in zip(none, top)]
            score = np.where(none, 0.0, share[np.arange(len(texts)), top] / np.maximum(total, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [*batch.schema.names, "lang_pred", "score"])
    return rows


def predict(docs: DataFrame, model: dict, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` with lang_pred, the language of most letters of the text, and
    score, that language's share of the letters.

    ``und`` with score 0 for null texts and texts without a letter (and for all
    texts if no language was learned). Ties go to the language first in order.
    Columns that are already named so are replaced."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predict(pickle.dumps(model), penalty), schema)


def _spans(model: bytes, penalty: float):
    def rows(batches):
        m = pickle.loads(model)
        scorer = Scorer(m)
        for batch in chunks(batches, "text", PIECE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            words, labels = _label(scorer, texts, penalty)
            if not len(labels) or not m["languages"]:
                continue
            cut = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1])])
            last = np.r_[cut[1:], len(labels)] - 1
            of, ids = words.text[cut], batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[k] for k in of], pa.int64()), pa.array(words.starts[cut] - words.bases[of]),
                pa.array(words.ends[last] - words.bases[of]), pa.array([m["languages"][k] for k in labels[cut]], pa.string())],
                ["doc_id", "start", "end", "lang"])
    return rows


def label_spans(docs: DataFrame, model: dict, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """(doc_id, start, end, lang): the spans of one language in each (doc_id,
    text), from the first letter of the first word to the last of the last, in
    characters of the lower-cased text. Texts without a letter have no span."""
    schema = "doc_id long, start long, end long, lang string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_spans(pickle.dumps(model), penalty), schema)
