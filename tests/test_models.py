import numpy as np
import pytest

from sampleloom.functions import models as mo


@pytest.fixture(scope="module")
def two():
    rng = np.random.default_rng(0)
    y = np.arange(80) % 2
    x = rng.normal(size=(80, 4))
    x[:, 0] += 2 * y
    x[:, 2] -= y
    return x, y


def kkt(k, s, alpha, bias, c, slack=5e-3):
    """The conditions that a dual solution meets."""
    f = s * (k @ (alpha * s) + bias)
    assert ((alpha >= -1e-9) & (alpha <= c + 1e-9)).all() and abs((alpha * s).sum()) < 1e-6
    assert (f[alpha < 1e-9] >= 1 - slack).all() and (f[alpha > c - 1e-9] <= 1 + slack).all()


def test_machines_meet_their_conditions(two):
    x, y = two
    m = mo.SVM(0.7).fit(x, y)
    _, _, at, v, bias = m.pairs[0]
    s = np.where(y == 0, 1.0, -1.0)
    kkt(x @ x.T, s, v * s, bias, 0.7)
    w = mo.SVM(0.7, weights={1: 5.0}).fit(x, y)
    s, v = s, w.pairs[0][3]
    kkt(x @ x.T, s, v * s, w.pairs[0][4], np.where(y == 1, 3.5, 0.7))
    assert (w.predict(x)[y == 1] == 1).mean() >= (m.predict(x)[y == 1] == 1).mean()


def test_nu_bounds_errors_and_support(two):
    x, y = two
    for nu in (0.5, 0.7):
        m = mo.SVM(nu=nu).fit(x, y)
        v, bias = m.pairs[0][3], m.pairs[0][4]
        f = np.where(y == 0, 1, -1) * (x @ x.T @ v + bias)
        assert (f < 1 - 1e-2).mean() <= nu + 0.02 and (np.abs(v) > 1e-9).mean() >= nu - 0.02


def test_support_vector_regression():
    x = np.linspace(-2, 2, 60)[:, None]
    y = np.sin(2 * x[:, 0]) + 3
    m = mo.SVR(10.0, 0.05, gamma=2.0).fit(x, y)
    r = y - m.predict(x)
    assert np.abs(r).max() < 0.06
    # outside the tube the multiplier is at its bound, inside it is 0
    assert (np.abs(m.beta[np.abs(r) < 0.045]) < 1e-9).all()
    n = mo.SVR(10.0, nu=0.3, gamma=2.0).fit(x, y + np.random.default_rng(1).normal(size=60) * 0.1)
    assert 0.15 < (np.abs(n.beta) > 1e-9).mean() < 0.6 and n.epsilon > 0


def test_one_class():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    m = mo.OneClass(0.1, gamma=0.5).fit(x)
    assert 0.02 < (m.predict(x) < 0).mean() < 0.2
    assert (m.predict(np.array([[6.0, 6.0], [-7.0, 0.0]])) == -1).all() and m.predict(np.zeros((1, 2)))[0] == 1
    assert abs(m.alpha.sum() - 1) < 1e-9


def test_not_converged_is_said(two):
    with pytest.warns(RuntimeWarning, match="not converged"):
        mo.SVM(10.0, most=2).fit(*two)


def test_weights_of_composed_models(two):
    x, y = two
    plain = mo.sensitivity_of(mo.SVM().fit(x, y))
    assert plain.shape == (1, 4)
    assert np.allclose(mo.sensitivity_of(mo.Proxy(mo.SVM()).fit(x, y)), plain)
    assert np.allclose(mo.sensitivity_of(mo.Combined(mo.SVM(), mo.SVM()).fit(x, y)), plain)
    sel = mo.Selected(mo.SVM(), lambda a, t: np.abs(a[t == 1].mean(0) - a[t == 0].mean(0)), 2).fit(x, y)
    w = mo.sensitivity_of(sel)
    assert w.shape == (1, 4) and (w[0, [1, 3]] == 0).all() and (w[0, [0, 2]] != 0).all()
    a = np.random.default_rng(3).normal(size=(4, 3))
    mapped = mo.Mapped(mo.SVM(), lambda u, t: lambda v: (v - u.mean(0)) @ a).fit(x, y)
    assert np.allclose(mo.sensitivity_of(mapped), mapped.model.weights @ a.T)
    chained = mo.Chain(lambda u, t: lambda v: v * 2, lambda u, t: lambda v: v @ a, mo.SVM()).fit(x, y)
    assert np.allclose(mo.sensitivity_of(chained), 2 * chained.model.weights @ a.T) and (chained.predict(x) == y).mean() > 0.7
    as_class = mo.RegressionAsClassifier(mo.Ridge()).fit(x, y)
    assert np.allclose(mo.sensitivity_of(as_class), as_class.model.weights)
    split = mo.SplitModel(mo.SVM, lambda n: np.array_split(np.arange(n), 4)).fit(x, y)
    assert np.corrcoef(mo.sensitivity_of(split)[0], plain[0])[0, 1] > 0.99
    with pytest.raises(ValueError):
        mo.sensitivity_of(mo.KNN(3).fit(x, y))
