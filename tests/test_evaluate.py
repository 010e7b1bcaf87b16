import numpy as np
import pytest

from canvass.operators import evaluate


def _preds(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("c", "c"), ("c", "c"), ("a", "a")]
    return rows, spark.createDataFrame(rows, "label string, prediction string")


def test_confusion_full_grid(spark):
    rows, df = _preds(spark)
    got = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(df).collect()}
    assert len(got) == 9 and got[("c", "b")] == 0 and got[("a", "a")] == 2


def test_report_and_macro_f1(spark):
    rows, df = _preds(spark)
    labels = ["a", "b", "c"]
    f1s, sup = [], []
    for c in labels:
        tp = sum(1 for a, p in rows if a == c and p == c)
        pp = sum(1 for _, p in rows if p == c)
        s = sum(1 for a, _ in rows if a == c)
        prec, rec = (tp / pp if pp else 0.0), (tp / s if s else 0.0)
        f1s.append(2 * prec * rec / (prec + rec) if prec + rec else 0.0)
        sup.append(s)
    m = evaluate.macro_f1(df).first()
    assert m["macro_f1"] == pytest.approx(np.mean(f1s))
    assert m["weighted_f1"] == pytest.approx(np.average(f1s, weights=sup))
    rep = {r["label"]: r for r in evaluate.classification_report(df).collect()}
    assert rep["accuracy"]["f1_score"] == pytest.approx(6 / 8)
    assert rep["macro avg"]["support"] == 8


def test_silhouette_closed_form_matches_pairs(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(60, 3)) + np.repeat(np.arange(3), 20)[:, None] * 2.0
    lab = np.repeat(np.arange(3), 20)
    rows = [(int(i), int(lab[i]), int(d), float(pts[i, d])) for i in range(60) for d in range(3)]
    df = spark.createDataFrame(rows, "point_id long, cluster int, dim int, value double")
    arrays = spark.createDataFrame([(int(lab[i]), [float(v) for v in pts[i]]) for i in range(60)],
                                   "cluster int, vec array<double>")
    got = evaluate.silhouette_sq_euclidean(arrays).first()["silhouette"]
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(60):
        own = lab == lab[i]
        a = d2[i, own].sum() / (own.sum() - 1)
        b = min(d2[i, lab == c].mean() for c in range(3) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s), rel=1e-9)
    inert = evaluate.inertia(df).toPandas().set_index("cluster")["inertia"]
    for c in range(3):
        p = pts[lab == c]
        assert inert[c] == pytest.approx(((p - p.mean(0)) ** 2).sum(), rel=1e-9)
