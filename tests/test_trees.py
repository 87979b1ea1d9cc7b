import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from lumetra.operators import ml, trees


def _rows(x):
    at = [np.flatnonzero(r) for r in x]
    return trees.Rows(np.array([len(a) for a in at]), np.concatenate(at), np.concatenate([r[a] for r, a in zip(x, at, strict=True)]))


@pytest.mark.parametrize("penalty, least", [(0.0, 0.0), (1.0, 1.0)])
def test_splits_match_all_thresholds(penalty, least):
    r = np.random.default_rng(3)
    x = np.round(r.random((60, 7)), 1) * (r.random((60, 7)) < 0.5)
    g, h = r.normal(size=60), r.random(60) + 0.5
    if not penalty:
        g = h * (r.random(60) < 0.4)
    (feature, threshold, left, worth), leaf = trees.grow(_rows(x).sorted(), g, h, 7, 3, penalty, least)

    def check(node, own, depth):
        gain = lambda own: g[own].sum() ** 2 / (h[own].sum() + penalty) if own.any() else 0.0
        assert worth[node] == pytest.approx(g[own].sum() / (h[own].sum() + penalty)) and (feature[node] >= 0 or (leaf[own] == node).all())
        splits = [(f, t) for f in range(7) for t in np.unique(x[own, f])[:-1]]
        every = [gain(own & (x[:, f] <= t)) + gain(own & (x[:, f] > t)) for f, t in splits if min(h[own & (x[:, f] <= t)].sum(), h[own & (x[:, f] > t)].sum()) >= least]
        if feature[node] < 0:
            assert depth == 3 or not every or max(every) <= gain(own) + 1e-6
            return
        right = own & (x[:, feature[node]] > threshold[node])
        assert gain(right) + gain(own & ~right) == pytest.approx(max(every))
        check(left[node], own & ~right, depth + 1)
        check(left[node] + 1, right, depth + 1)

    check(0, h > 0, 0)
    for s, e, dense in _rows(x).dense(7):
        assert np.allclose(trees.looked_up((feature, threshold, left, worth), dense, [1, 3])[1], worth[leaf[s:e]])


def test_boosting_sees_every_feature(spark):
    """400 features tell the labels apart a little, as many as boosting had once, and one beyond them that few rows have decides the rest."""
    r = np.random.default_rng(5)
    y = np.arange(80) % 2
    x = (r.random((80, 401)) < 0.5 + 0.12 * np.outer(y - 0.5, np.ones(401))) * 1.0
    x[:, 400] = y * (np.arange(80) % 4 == 1)
    rows = spark.createDataFrame([(i, float(y[i]), 1.0, i % 2, Vectors.dense(x[i])) for i in range(80)], ["doc_id", "label", "weight", "fold", "features"])
    model, means, _ = trees.select("gbt", rows, [{"depth": 1, "trees": 30, "rate": 0.3}], 2)
    assert model.getNumTrees == 30 and len(means) == 1 and not hasattr(ml, "BOOSTED_FEATURES")
    assert ml.select_model.__defaults__[-1] is None  # the grid is compared with all rounds
    got = {row.doc_id: row.prediction for row in model.transform(rows).collect()}
    assert sum(got[i] == y[i] for i in range(80)) > 70


def test_a_forest_is_grown_once_for_the_grid(spark):
    r = np.random.default_rng(6)
    x = np.round(r.random((90, 9)), 2) * (r.random((90, 9)) < 0.6)
    y = (x[:, 0] + x[:, 1] > 0.6).astype(float)
    long = list(trees._forest(_rows(x), y, np.ones(90), 9, range(6), 8, 1))
    short = list(trees._forest(_rows(x), y, np.ones(90), 9, range(3, 6), 3, 1))
    for a, b in zip(long[3:], short, strict=True):
        assert np.allclose(trees.looked_up(a, x.astype("float32"), [3, 8])[0], trees.looked_up(b, x.astype("float32"), [3])[0])
    rows = spark.createDataFrame([(i, float(y[i]), 1.0, i % 3, Vectors.dense(x[i])) for i in range(90)], ["doc_id", "label", "weight", "fold", "features"])
    points = [{"depth": d, "trees": n} for d in (1, 8) for n in (5, 30)]
    model, means, spreads = trees.select("rf", rows, points, 3)
    one = [trees.select("rf", rows, [p], 3)[1][0] for p in points]
    assert means == one and len(spreads) == 4 and max(means) > 0.8 and model.getNumTrees in (5, 30)
