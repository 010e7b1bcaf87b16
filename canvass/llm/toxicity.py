"""Toxicity by a chain of classifiers.

The categories are predicted one after the other; each linear model also gets
the probabilities of the earlier categories. While fitting, those come from
models that haven't seen the document (out of fold), as they will at prediction.

Texts are bags of hashed letter n-grams. Which n-grams a model uses is decided
by a chi-square test on counts by fold and label, summed on the executors;
each fold's models select theirs without that fold. Only the labelled sample's
selected n-grams (a few numbers a document) come to the driver, where the
models are fitted; the sample's size is a parameter. Prediction is a map over
the documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks
from .language import Words

#: The chain: (category, how it follows from the labels), first to last.
CATEGORIES = [("low_quality", "quality = 0"), ("toxic", "toxic = 1")]
#: Labelled documents of each combination of labels that the models are fitted on (about).
SAMPLE_PER_LABELS = 3000
FOLDS = 3
SLOTS = 1 << 19
LENGTHS = (4, 5)
LEVELS = (2, 3, 5)
#: Bytes of text turned into n-grams at a time.
PIECE = 1 << 18
#: n-grams a model selects at most, and the least chi-square value.
SELECTED = 400
LEAST_CHI2 = 20.0
THRESHOLD = 0.5


def _text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, slot) pairs of the texts' n-grams; an n-gram that a
    text repeats has a slot more for each of ``LEVELS`` that its count reaches."""
    words = Words(texts)
    keys = [words.text[word] * SLOTS + slots for slots, word in words.grams(LENGTHS, SLOTS)]
    keys, n = np.unique(np.concatenate(keys), return_counts=True)
    text, slot = keys // SLOTS, keys % SLOTS
    more = [(text[n >= k], (slot[n >= k] * 31 + k * 7919) % SLOTS) for k in LEVELS]
    keys = np.unique(np.concatenate([keys, *(t * SLOTS + s for t, s in more)]))
    return keys // SLOTS, keys % SLOTS


def labelled(docs: DataFrame, labels: DataFrame, per_labels: int = SAMPLE_PER_LABELS) -> DataFrame:
    """(text, fold, y): a hash sample of the documents with labels; bit j of y is
    category j. Repeated labels of a document are merged (any positive counts);
    documents or labels with nulls take no part."""
    y = sum((F.expr(f"int({rule})") * (1 << j) for j, (_, rule) in enumerate(CATEGORIES)), F.lit(0))
    labels = labels.select("doc_id", y.alias("y")).dropna().groupBy("doc_id").agg(F.bit_or("y").alias("y"))
    sizes = {r.y: r.n for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}  # 2 ** categories rows
    h = F.xxhash64(F.lit(11), "doc_id")
    chosen = F.lit(False)
    for value, n in sizes.items():
        chosen = chosen | ((F.col("y") == value) & (F.pmod(h, F.lit(1 << 30)) < F.lit(per_labels / n * (1 << 30))))
    labels = labels.where(chosen).withColumn("fold", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(FOLDS)).cast("int"))
    # about per_labels rows for each combination of labels, whatever the size of the table
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(labels), "doc_id").select("text", "fold", "y")


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in chunks(batches, "text", PIECE):
        group = batch.column("fold").to_numpy() * (1 << len(CATEGORIES)) + batch.column("y").to_numpy()
        text, slot = _text_grams(batch.column("text").to_pylist())
        for g in np.unique(group).tolist():
            into = total.setdefault(g, np.zeros(SLOTS, np.int32))
            into += np.bincount(slot[group[text] == g], minlength=SLOTS).astype(np.int32)
    for g, into in total.items():
        at = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at.astype(np.int32)), pa.array(into[at].astype(np.int64))], ["g", "slot", "n"])


def _select(yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int) -> np.ndarray:
    """The slots whose presence depends most on the label, by chi-square."""
    n, a, b = n_yes + n_no, yes.astype(float), no.astype(float)
    c, d = n_yes - a, n_no - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.nan_to_num(n * np.maximum(np.abs(a * d - b * c) - n / 2, 0) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)))
    top = np.argsort(-chi2, kind="stable")[:SELECTED]
    return np.sort(top[chi2[top] >= LEAST_CHI2])


def _fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 5e-4, steps: int = 200) -> np.ndarray:
    """Logistic regression, both classes with equal weight; Nesterov steps. The
    last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))].astype(np.float32)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)  # the largest eigenvalue, for the step
    for _ in range(15):
        v = x.T @ (weight * (x @ v))
        largest = np.linalg.norm(v)
        v /= largest or 1
    step = 1 / (0.25 * largest + ridge)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        p = _sigmoid(x @ ahead)
        pull = x.T @ (weight * (p - y)) + ridge * np.r_[ahead[:-1], 0]
        before, w = w, (ahead - step * pull).astype(np.float32)
        ahead = w + np.float32(k / (k + 3)) * (w - before)
    return w.astype(float)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gather(selected: np.ndarray):
    """(text) rows to the places in ``selected`` of the n-grams they have."""
    def rows(batches):
        place = np.full(SLOTS, -1, np.int32)
        place[selected] = np.arange(len(selected))
        for batch in chunks(batches, "text", PIECE):
            text, slot = _text_grams(batch.column("text").to_pylist())
            found = place[slot]
            text, found = text[found >= 0], found[found >= 0]
            ends = np.r_[0, np.cumsum(np.bincount(text, minlength=batch.num_rows))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("y"), lists], ["fold", "y", "found"])
    return rows


def fit(docs: DataFrame, labels: DataFrame, per_labels: int = SAMPLE_PER_LABELS) -> list[dict]:
    """The chain's models, first category first: selected slots, weights, and a
    last weight for each earlier category's log-odds and the intercept."""
    sample = labelled(docs, labels, per_labels)
    n_y, n_groups = 1 << len(CATEGORIES), FOLDS << len(CATEGORIES)
    counts = np.zeros((n_groups, SLOTS), np.int32)
    for r in (sample.mapInArrow(_count_grams, "g int, slot int, n long").groupBy("g", "slot").agg(F.sum("n").alias("n"))
              .where("n > 1").toLocalIterator()):
        counts[r.g, r.slot] = r.n
    sizes = np.zeros(n_groups, np.int64)
    for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect():
        sizes[r.fold * n_y + r.y] = r.n

    def chosen(j: int, without: int | None) -> np.ndarray:
        groups = np.array([g for g in range(n_groups) if g // n_y != without])
        yes = groups[(groups % n_y >> j) & 1 == 1]
        no = groups[(groups % n_y >> j) & 1 == 0]
        return _select(counts[yes].sum(axis=0), counts[no].sum(axis=0), int(sizes[yes].sum()), int(sizes[no].sum()))

    picks = {(j, f): chosen(j, f) for j in range(len(CATEGORIES)) for f in [*range(FOLDS), None]}
    every = np.unique(np.concatenate(list(picks.values())))
    rows = sample.mapInArrow(_gather(every), "fold int, y int, found array<int>").collect()
    x = np.zeros((len(rows), len(every)), np.float32)
    for k, r in enumerate(rows):
        x[k, r.found] = 1
    fold, y = np.array([r.fold for r in rows], int), np.array([r.y for r in rows], int)

    models, earlier = [], np.zeros((len(rows), 0))
    for j in range(len(CATEGORIES)):
        label = (y >> j & 1).astype(bool)
        out_of_fold = np.zeros(len(rows))
        for f in [*range(FOLDS), None]:
            columns = np.searchsorted(every, picks[j, f])
            use, inputs = fold != (-1 if f is None else f), np.c_[x[:, columns], earlier]
            weights = _fit_linear(inputs[use], label[use]) if len(rows) else np.zeros(inputs.shape[1] + 1)
            if f is None:
                models.append({"slots": picks[j, f], "weights": weights})
            else:
                out_of_fold[~use] = (np.c_[inputs, np.ones(len(rows))] @ weights)[~use]
        earlier = np.c_[earlier, _sigmoid(out_of_fold)]
    return models


def _predict(model: bytes):
    def rows(batches):
        chain = pickle.loads(model)
        places = []
        for m in chain:
            place = np.full(SLOTS, -1, np.int32)
            place[m["slots"]] = np.arange(len(m["slots"]))
            places.append(place)
        for batch in chunks(batches, "text", PIECE):
            text, slot = _text_grams([t or "" for t in batch.column("text").to_pylist()])
            earlier = np.zeros((batch.num_rows, 0))
            for m, place in zip(chain, places):
                n, found = len(m["slots"]), place[slot]
                hit = found >= 0
                z = earlier @ m["weights"][n:-1] + m["weights"][-1]
                z = z + np.bincount(text[hit], weights=m["weights"][found[hit]], minlength=batch.num_rows)
                earlier = np.c_[earlier, _sigmoid(z)]
            columns = [pa.array(earlier[:, j].copy()) for j in range(len(chain))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f"p_{c}" for c, _ in CATEGORIES)])
    return rows


def predict(docs: DataFrame, models: list[dict], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with p_<category> of each category of the chain and ``is_toxic``:
    the last one's probability is at least ``threshold``.

    Null and empty texts have no n-grams, so they get the chain's intercepts but
    are never toxic. Columns that are already named so are replaced."""
    names = [f"p_{c}" for c, _ in CATEGORIES]
    docs = docs.drop(*names, "is_toxic")
    schema = T.StructType([*docs.schema, *(T.StructField(c, T.DoubleType()) for c in names)])
    out = docs.mapInArrow(_predict(pickle.dumps(models)), schema)
    return out.withColumn("is_toxic", (F.col(names[-1]) >= threshold) & (F.length(F.coalesce("text", F.lit(""))) > 0))
