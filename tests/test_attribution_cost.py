"""What one row costs in the attributions of a whole model."""

import numpy as np

from moundworks.operators import attribution


class Counted(np.ndarray):
    """Counts the elements that arithmetic on it, or on what is taken from it, makes."""

    made = 0

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **kwargs):
        plain = [np.asarray(i) for i in inputs]
        result = getattr(ufunc, method)(*plain, out=out, **kwargs)
        Counted.made += np.size(result)
        return result


def test_a_value_is_not_compared_with_every_leaf():
    rng = np.random.default_rng(3)
    width, rows = 15, 20
    cuts = np.sort(rng.normal(size=(width, 31)), axis=1)
    leaves = []
    for _ in range(500):
        feats = rng.choice(width, size=4, replace=False)
        leaves.append((rng.normal(), {int(f): (cuts[f, k], cuts[f, k + 9], 0.4) for f, k in zip(feats, rng.integers(0, 22, 4))}))
    x = rng.normal(size=(rows, width))
    x[0], x[1] = cuts[:, 5], cuts[:, 14]  # on the cuts themselves
    Counted.made = 0
    got = attribution.shapley(x.view(Counted), attribution._packed(leaves), width)
    assert Counted.made <= rows * width * 32  # every leaf: 20 x 500 x 4 at least

    base = attribution.base_value(leaves)
    for row, values in zip(x, got):
        prediction = sum(v * all(low < row[f] <= high for f, (low, high, _) in p.items()) for v, p in leaves)
        assert abs(base + values.sum() - prediction) < 1e-9


def test_a_model_without_splits_contributes_nothing():
    leaves = [(0.3, {}), (0.1, {})]
    assert not attribution.shapley(np.ones((3, 4)), attribution._packed(leaves), 4).any()
