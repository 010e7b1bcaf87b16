"""k-means: a scan's sums by hand, and only the models that a query asks for."""

import numpy as np
import pyarrow as pa

from canvass.operators import cluster, lloyd


def test_scan_by_hand_and_ties():
    r = np.random.RandomState(4)
    x = r.randint(0, 4, (3000, 3)).astype(float)
    bounds, centers = [0, 2, 5, 7], x[:7].copy()
    centers[6] = centers[5]  # equally near: the first
    blocks = pa.RecordBatch.from_arrays([pa.array([x[:2000].tobytes(), x[2000:].tobytes()], pa.binary())], ["block"])
    found = next(lloyd._scan(centers, bounds)([blocks]))
    for lo, hi in zip(bounds, bounds[1:]):
        away = ((x[:, None, :] - centers[lo:hi]) ** 2).sum(axis=2)
        best = away.argmin(axis=1)
        for j in range(hi - lo):
            assert found.column("n")[lo + j].as_py() == (best == j).sum()
            assert np.isclose(found.column("cost")[lo + j].as_py(), away[best == j, j].sum())
            assert np.allclose(found.column("s")[lo + j].as_py(), x[best == j].sum(axis=0))


def test_queries_of_five_clusters_fit_no_others(spark, monkeypatch):
    from canvass.plans import catalog
    asked = []
    monkeypatch.setattr(catalog, "_FITS", {})
    monkeypatch.setattr(catalog, "_cluster_inputs", lambda *a: None)
    monkeypatch.setattr(cluster, "kmeans_shared", lambda vec, ks: asked.append(list(ks)) or {k: f"fit {k}" for k in ks})
    monkeypatch.setattr(catalog, "_inputs", lambda sf_dir: [])
    assert catalog._kmeans(spark, "x")[2] == "fit 5" and asked == [[5]]
    assert sorted(catalog._models(spark, "x")) == list(range(2, 10)) and asked[1:] == [[2, 3, 4, 6, 7, 8, 9]]
    assert catalog._kmeans(spark, "x")[2] == "fit 5" and len(asked) == 2


def test_summed_distances_of_a_batch_with_gaps():
    from canvass.operators import evaluate
    pts = np.array([[0.0, 1.0], [2.0, 2.0], [5.0, 0.0]])
    clusters = [{"n": 3, "q": float((pts ** 2).sum()), "s": pts.sum(axis=0).tolist()}, {"n": 1, "q": None, "s": [0.0, 0.0]}]
    x = [[1.0, 1.0], None, [1.0, None], [1.0], [4.0, -2.0]]
    found = evaluate._summed_distances(clusters)(pa.array(x, pa.list_(pa.float64()))).to_pylist()
    by_hand = [float(((pts - np.array(v)) ** 2).sum()) for v in (x[0], x[4])]
    assert found == [[by_hand[0], None], [None, None], [None, None], [None, None], [by_hand[1], None]]
