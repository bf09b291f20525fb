"""Models fitted in memory on a bounded sample: classifiers and regressions on NumPy arrays.

Every model has ``fit(x, y) -> self`` and ``predict(x)``; most have
``estimates(x)`` and ``weights``. They are fitted inside one task per fold and
applied to all rows by Arrow batches.
"""

from __future__ import annotations

import itertools
import math
import warnings

import numpy as np


class Model:
    """Base: labels are kept sorted; ``y`` may be of any type."""

    regression = False
    #: What of all rows' sums settles the fit: ``scatter``, ``covariance`` or ``classes`` (moments of each class), or None.
    sums: str | None = None

    def _labels(self, y) -> np.ndarray:
        if not len(y):
            raise ValueError("nothing to learn from")
        self.labels, code = np.unique(np.asarray(y), return_inverse=True)
        return code

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.labels[np.argmax(self.estimates(x), axis=1)]


class Ridge(Model):
    """Least squares on [X 1] with rows lm * I appended: the penalty is lm squared, the intercept free."""

    regression = True
    sums = "scatter"

    def __init__(self, lm: float | None = None):
        self.lm = lm

    def fit(self, x, y):
        n, f = x.shape
        lm = 0.05 * f if self.lm is None else self.lm
        a = np.vstack([np.column_stack([x, np.ones(n)]), np.column_stack([lm * np.eye(f), np.zeros(f)])])
        w = np.linalg.lstsq(a, np.append(np.asarray(y, float), np.zeros(f)), rcond=None)[0]
        self.weights, self.bias = w[:-1], w[-1]
        return self

    def predict(self, x):
        return x @ self.weights + self.bias


class BLR(Model):
    """Bayesian linear regression: posterior mean, and variance of predictions."""

    regression = True
    sums = "scatter"

    def __init__(self, sigma_p: float = 1.0, sigma_noise: float = 1.0):
        self.sigma_p, self.sigma_noise = sigma_p, sigma_noise

    def fit(self, x, y):
        x = np.column_stack([x, np.ones(len(x))])
        return self._solve(x.T @ x, x.T @ np.asarray(y, float))

    def fit_sums(self, n: float, mean: np.ndarray, scatter: np.ndarray):
        """From the number, mean and scatter matrix of [x y]."""
        total = scatter + n * np.outer(mean, mean)
        xx = np.block([[total[:-1, :-1], n * mean[:-1, None]], [n * mean[None, :-1], np.array([[n]])]])
        return self._solve(xx, np.append(total[:-1, -1], n * mean[-1]))

    def _solve(self, xx: np.ndarray, xy: np.ndarray):
        self.inverse = np.linalg.inv(xx / self.sigma_noise**2 + np.eye(len(xx)) / self.sigma_p)
        w = self.inverse @ xy / self.sigma_noise**2
        self.weights, self.bias = w[:-1], w[-1]
        return self

    def predict(self, x):
        return x @ self.weights + self.bias

    def variance(self, x):
        x = np.column_stack([x, np.ones(len(x))])
        return np.einsum("ij,jk,ik->i", x, self.inverse, x) + self.sigma_noise**2


def kernel(name: str, **p):
    def sq(a, b):
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)

    return {
        "linear": lambda a, b: a @ b.T,
        "rbf": lambda a, b: np.exp(-p.get("gamma", 1.0 / a.shape[1]) * sq(a, b)),
        "poly": lambda a, b: (p.get("gamma", 1.0 / a.shape[1]) * a @ b.T + p.get("coef0", 1.0)) ** p.get("degree", 2),
        "sigmoid": lambda a, b: np.tanh(p.get("gamma", 1.0 / a.shape[1]) * a @ b.T + p.get("coef0", 0.0)),
        "squared_exponential": lambda a, b: p.get("sigma_f", 1.0) ** 2 * np.exp(-0.5 * sq(a, b) / p.get("length_scale", 1.0) ** 2),
    }[name]


class GPR(Model):
    """Gaussian process regression with a kernel; gives the log marginal likelihood."""

    regression = True

    def __init__(self, kernel_name: str = "squared_exponential", sigma_noise: float = 0.1, **params):
        self.kernel, self.noise = (kernel_name, params), sigma_noise

    def fit(self, x, y):
        self.x, y = x, np.asarray(y, float)
        k = kernel(self.kernel[0], **self.kernel[1])(x, x) + self.noise**2 * np.eye(len(x))
        self.chol = np.linalg.cholesky(k + 1e-10 * np.eye(len(x)))
        self.alpha = np.linalg.solve(self.chol.T, np.linalg.solve(self.chol, y))
        self.log_likelihood = float(-0.5 * y @ self.alpha - np.log(np.diag(self.chol)).sum() - len(x) / 2 * math.log(2 * math.pi))
        if self.kernel[0] == "linear":
            self.weights = x.T @ self.alpha
        return self

    def predict(self, x):
        return kernel(self.kernel[0], **self.kernel[1])(x, self.x) @ self.alpha


class LDA(Model):
    """Linear discriminant with pooled covariance over n - k; ``quadratic`` takes each class's own."""

    sums = "classes"

    def __init__(self, quadratic: bool = False):
        self.quadratic = quadratic

    def fit(self, x, y):
        code = self._labels(y)
        parts = [x[code == c] for c in range(len(self.labels))]
        return self.fit_classes(self.labels, np.array([len(p) for p in parts]), np.array([p.mean(0) for p in parts]), [np.cov(p.T, bias=True).reshape(x.shape[1], -1) for p in parts])

    def fit_classes(self, labels: np.ndarray, n: np.ndarray, means: np.ndarray, covs: list[np.ndarray]):
        """From each class's number, mean and population covariance."""
        self.labels, self.means, self.priors = labels, means, np.log(n / n.sum())
        if self.quadratic:
            self.inverse = [np.linalg.pinv(c) for c in covs]
            self.logdet = [np.linalg.slogdet(c)[1] for c in covs]
        else:
            pooled = sum(c * m for c, m in zip(covs, n, strict=True)) / max(n.sum() - len(n), 1)
            self.inverse, self.logdet = [np.linalg.pinv(pooled)] * len(n), [0.0] * len(n)
        return self

    def estimates(self, x):
        out = []
        for m, i, d, p in zip(self.means, self.inverse, self.logdet, self.priors, strict=True):
            e = x - m
            out.append(-0.5 * np.einsum("ij,jk,ik->i", e, i, e) - 0.5 * d + p)
        return np.array(out).T


class SMLR(Model):
    """Sparse multinomial logistic regression by component-wise bound optimisation with a Laplace prior."""

    def __init__(self, lm: float = 0.1, most: int = 500, tolerance: float = 1e-3):
        self.lm, self.most, self.tolerance = lm, most, tolerance

    def fit(self, x, y):
        code = self._labels(y)
        x = np.column_stack([x, np.ones(len(x))])
        k, f = len(self.labels), x.shape[1]
        t = np.eye(k)[code]
        w = np.zeros((f, k - 1))
        bound = -0.5 * (1 - 1 / k) * (x * x).sum(0)
        scores = np.zeros((len(x), k))
        for _ in range(self.most):
            before = w.copy()
            for j in range(f):
                if not bound[j]:
                    continue
                p = np.exp(scores - scores.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                grad = x[:, j] @ (t - p)[:, : k - 1]
                z = w[j] - grad / bound[j]
                new = np.sign(z) * np.maximum(np.abs(z) + self.lm / bound[j], 0)
                if (new != w[j]).any():
                    scores[:, : k - 1] += np.outer(x[:, j], new - w[j])
                    w[j] = new
            if np.abs(w - before).sum() <= self.tolerance * max(np.abs(w).sum(), 1e-12):
                break
        self.full = np.column_stack([w, np.zeros(f)])
        self.weights = w[:-1]
        return self

    def estimates(self, x):
        s = np.column_stack([x, np.ones(len(x))]) @ self.full
        p = np.exp(s - s.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


class PLR(Model):
    """Penalised logistic regression of two classes by iteratively reweighted least squares."""

    def __init__(self, lm: float = 1.0, most: int = 20, criterion: float = 1e-3):
        self.lm, self.most, self.criterion = lm, most, criterion

    def fit(self, x, y):
        code = self._labels(y)
        if len(self.labels) != 2:
            raise ValueError("two labels are needed")
        x = np.column_stack([x, np.ones(len(x))])
        w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * self.lm
        penalty[-1, -1] = 0
        for _ in range(self.most):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), x.T @ (code - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < self.criterion:
                break
        self.weights, self.bias = w[:-1], w[-1]
        return self

    def estimates(self, x):
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))
        return np.column_stack([1 - p, p])


class ElasticNet(Model):
    """Linear regression with mixed penalties by coordinate descent on standardised columns; ``ratio=1`` is the lasso."""

    regression = True
    sums = "covariance"

    def __init__(self, alpha: float = 0.1, ratio: float = 0.5, most: int = 1000, tolerance: float = 1e-6):
        self.alpha, self.ratio, self.most, self.tolerance = alpha, ratio, most, tolerance

    def fit(self, x, y):
        y = np.asarray(y, float)
        self.mean, self.sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        z, my = (x - self.mean) / self.sd, y.mean()
        n, w, r = len(x), np.zeros(x.shape[1]), y - my
        for _ in range(self.most):
            moved = 0.0
            for j in range(x.shape[1]):
                rho = z[:, j] @ r / n + w[j]
                new = np.sign(rho) * max(abs(rho) - self.alpha * self.ratio, 0) / (1 + self.alpha * (1 - self.ratio))
                if new != w[j]:
                    r -= z[:, j] * (new - w[j])
                    moved, w[j] = max(moved, abs(new - w[j])), new
            if moved < self.tolerance:
                break
        self.weights = w / self.sd
        self.bias = my - self.mean @ self.weights
        return self

    def predict(self, x):
        return x @ self.weights + self.bias


class LARS(Model):
    """Least angle regression (``lasso=True`` drops coefficients that cross zero)."""

    regression = True
    sums = "covariance"

    def __init__(self, steps: int | None = None, lasso: bool = True):
        self.steps, self.lasso = steps, lasso

    def fit(self, x, y):
        y = np.asarray(y, float)
        self.mean = x.mean(0)
        norm = np.sqrt(((x - self.mean) ** 2).sum(0))
        norm = np.where(norm > 0, norm, 1)
        z, my = (x - self.mean) / norm, y.mean()
        mu, active, w = np.zeros(len(y)), [], np.zeros(x.shape[1])
        self.path = [w.copy()]
        for _ in range(8 * x.shape[1]):
            if len(active) >= min(self.steps or x.shape[1], len(y) - 1, x.shape[1]) and self.path[-1] is not None and self.steps:
                break
            c = z.T @ (y - my - mu)
            top = np.abs(c).max()
            if top < 1e-10:
                break
            active = [j for j in range(len(c)) if abs(abs(c[j]) - top) < 1e-9 * max(top, 1) or (j in active and w[j] != 0)]
            s = np.sign(c[active])
            g = z[:, active] * s
            inv = np.linalg.pinv(g.T @ g)
            a = 1 / math.sqrt(max(inv.sum(), 1e-300))
            d = a * inv.sum(1)
            u = g @ d
            b = z.T @ u
            rest = [j for j in range(len(c)) if j not in active]
            gammas = [v for j in rest for v in ((top - c[j]) / (a - b[j]) if a != b[j] else np.inf, (top + c[j]) / (a + b[j]) if a != -b[j] else np.inf) if v > 1e-12]
            gamma = min([*gammas, top / a])
            if self.lasso:
                cross = [-w[j] / (s[i] * d[i]) for i, j in enumerate(active) if s[i] * d[i] and -w[j] / (s[i] * d[i]) > 1e-12]
                gamma = min([gamma, *cross])
            mu = mu + gamma * u
            for i, j in enumerate(active):
                w[j] += gamma * s[i] * d[i]
                if abs(w[j]) < 1e-12:
                    w[j] = 0.0
            self.path.append(w.copy())
            if gamma >= top / a - 1e-12:
                break
        self.weights = w / norm
        self.bias = my - self.mean @ self.weights
        return self

    def predict(self, x):
        return x @ self.weights + self.bias


def smo(k: np.ndarray, y: np.ndarray, c: np.ndarray, linear: np.ndarray, tolerance: float = 1e-3, most: int = 200_000, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Multipliers and bias of a support vector dual, always moving the pair that violates its condition most.

    Minimises a' diag(y) K diag(y) a / 2 + linear' a for 0 <= a <= c and a fixed
    y' a; row i of ``k`` belongs to multiplier i modulo its size. A run that
    doesn't reach ``tolerance`` within ``most`` steps warns.
    """
    n, m = len(y), len(k)
    at = np.arange(n) % m
    alpha = np.zeros(n) if start is None else start.astype(float).copy()
    g = linear.astype(float).copy()
    if start is not None:
        g = g + y * (k[np.ix_(at, at)] @ (y * alpha))
    for _ in range(most):
        v = -y * g
        up, low = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0)), ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        if not up.any() or not low.any():
            break
        i, j = int(np.argmax(np.where(up, v, -np.inf))), int(np.argmin(np.where(low, v, np.inf)))
        if v[i] - v[j] < tolerance:
            break
        p, q = i % m, j % m
        step = (v[i] - v[j]) / max(k[p, p] + k[q, q] - 2 * k[p, q], 1e-12)
        step = min(step, c[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c[j] - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        g += y * (k[at, p] - k[at, q]) * step
    else:
        warnings.warn(f"support vector machine not converged in {most} steps", RuntimeWarning, stacklevel=3)
    v = -y * g
    free = (alpha > 0) & (alpha < c)
    return alpha, float(v[free].mean()) if free.any() else float((np.max(v) + np.min(v)) / 2)


def bisect_log(f, low: float, high: float, rounds: int = 40) -> float:
    """Where a falling function of the logarithm of its argument crosses 0."""
    for _ in range(rounds):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return math.sqrt(low * high)


class SVM(Model):
    """Support vector machine: C-SVC by sequential minimal optimisation, one against one with votes.

    ``c`` below 0 is a multiple of the default, the inverse of the mean squared
    norm of the samples. ``weights`` multiplies it for the samples of a class.
    With ``nu`` instead, it is chosen for each pair such that the multipliers
    add up to that share of their bound: a nu-machine's solution.
    """

    def __init__(self, c: float = -1.0, kernel_name: str = "linear", tolerance: float = 1e-3, most: int = 200_000, weights: dict | None = None, nu: float | None = None, **params):
        self.c, self.kernel, self.tolerance, self.most, self.by_class, self.nu = c, (kernel_name, params), tolerance, most, weights or {}, nu

    def fit(self, x, y):
        code = self._labels(y)
        self.x = x
        k = kernel(self.kernel[0], **self.kernel[1])(x, x)
        c = self.c if self.c > 0 else -self.c / max(float(np.mean((x * x).sum(1))), 1e-12)
        factor = np.array([self.by_class.get(v, 1.0) for v in self.labels.tolist()])
        self.pairs = []
        for a, b in itertools.combinations(range(len(self.labels)), 2):
            at = np.flatnonzero((code == a) | (code == b))
            s, kk = np.where(code[at] == a, 1.0, -1.0), k[np.ix_(at, at)]
            solve = lambda c, s=s, kk=kk, at=at: smo(kk, s, c * factor[code[at]], -np.ones(len(s)), self.tolerance, self.most)
            if self.nu is not None:
                c = bisect_log(lambda c, s=s, solve=solve: solve(c)[0].sum() / (c * len(s)) - self.nu, c * 1e-4, c * 1e4, 20)
            alpha, bias = solve(c)
            self.pairs.append((a, b, at, alpha * s, bias))
        if self.kernel[0] == "linear":
            self.weights = np.array([(v[:, None] * x[at]).sum(0) for _, _, at, v, _ in self.pairs])
        return self

    def estimates(self, x):
        k = kernel(self.kernel[0], **self.kernel[1])(x, self.x)
        votes = np.zeros((len(x), len(self.labels)))
        for a, b, at, v, bias in self.pairs:
            first = k[:, at] @ v + bias > 0
            votes[first, a] += 1
            votes[~first, b] += 1
        return votes


class SVR(Model):
    """Kernel regression with an epsilon tube; with ``nu`` the tube is as wide as leaves that share of multipliers."""

    regression = True

    def __init__(self, c: float = 1.0, epsilon: float = 0.1, kernel_name: str = "rbf", tolerance: float = 1e-3, most: int = 200_000, nu: float | None = None, **params):
        self.c, self.epsilon, self.kernel, self.tolerance, self.most, self.nu = c, epsilon, (kernel_name, params), tolerance, most, nu

    def fit(self, x, y):
        y, n = np.asarray(y, float), len(y)
        self.x = x
        k = kernel(self.kernel[0], **self.kernel[1])(x, x)
        sign, c = np.repeat([1.0, -1.0], n), np.full(2 * n, self.c)
        solve = lambda e: smo(k, sign, c, np.append(e - y, e + y), self.tolerance, self.most)
        if self.nu is not None:
            self.epsilon = bisect_log(lambda e: solve(e)[0].sum() / (self.c * n) - self.nu, 1e-6 * max(np.ptp(y), 1e-12), max(np.ptp(y), 1e-12), 20)
        alpha, self.bias = solve(self.epsilon)
        self.beta = alpha[:n] - alpha[n:]
        if self.kernel[0] == "linear":
            self.weights = x.T @ self.beta
        return self

    def predict(self, x):
        return kernel(self.kernel[0], **self.kernel[1])(x, self.x) @ self.beta + self.bias


class OneClass(Model):
    """The region that holds most samples: +1 inside, -1 outside; about ``nu`` of the training samples lie outside."""

    def __init__(self, nu: float = 0.1, kernel_name: str = "rbf", tolerance: float = 1e-6, most: int = 200_000, **params):
        self.nu, self.kernel, self.tolerance, self.most = nu, (kernel_name, params), tolerance, most

    def fit(self, x, y=None):
        n = len(x)
        self.x, c = x, 1 / (self.nu * n)
        k = kernel(self.kernel[0], **self.kernel[1])(x, x)
        full = int(self.nu * n)
        start = np.zeros(n)
        start[:full] = c
        if full < n:
            start[full] = 1 - full * c
        self.alpha, self.bias = smo(k, np.ones(n), np.full(n, c), np.zeros(n), self.tolerance, self.most, start)
        return self

    def decision(self, x):
        return kernel(self.kernel[0], **self.kernel[1])(x, self.x) @ self.alpha + self.bias

    def predict(self, x):
        return np.where(self.decision(x) >= 0, 1, -1)


class GNB(Model):
    """Gaussian naive Bayes with laplacian, uniform or ratio priors, own or common variance."""

    def __init__(self, prior: str = "laplacian_smoothing", common_variance: bool = False):
        self.prior, self.common = prior, common_variance

    def fit(self, x, y):
        code = self._labels(y)
        k, n = len(self.labels), np.bincount(code)
        self.means = np.array([x[code == c].mean(0) for c in range(k)])
        var = np.array([x[code == c].var(0) for c in range(k)])
        self.var = np.broadcast_to((var * n[:, None]).sum(0) / n.sum(), var.shape) if self.common else var
        self.priors = {"laplacian_smoothing": (1 + n) / (n.sum() + k), "uniform": np.full(k, 1 / k), "ratio": n / n.sum()}[self.prior]
        return self

    def estimates(self, x):
        out = []
        for m, v, p in zip(self.means, self.var, self.priors, strict=True):
            with np.errstate(divide="ignore", invalid="ignore"):
                lp = -0.5 * np.log(2 * np.pi * v) - 0.5 * (x - m) ** 2 / v
            lp = np.where(v == 0, np.where(x == m, 0.0, -np.inf), lp)
            out.append(lp.sum(1) + np.log(p))
        return np.array(out).T


class KNN(Model):
    """k nearest neighbours with equal votes; ties go to the class nearest on average."""

    def __init__(self, k: int = 2):
        self.k = k

    def fit(self, x, y):
        self.x, self.code = x, self._labels(y)
        return self

    def estimates(self, x):
        d = np.maximum((x * x).sum(1)[:, None] + (self.x * self.x).sum(1)[None] - 2 * x @ self.x.T, 0)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        out = np.zeros((len(x), len(self.labels)))
        for i, row in enumerate(near):
            for c in set(self.code[row]):
                mine = row[self.code[row] == c]
                out[i, c] = len(mine) - d[i, mine].mean() / (1 + d[i, row].max())
        return out


# --- meta-learners ---------------------------------------------------------
def vote(predictions: np.ndarray) -> np.ndarray:
    """Most frequent prediction of each column; ties give the smallest label."""
    out = []
    for column in predictions.T:
        value, count = np.unique(column, return_counts=True)
        out.append(value[np.argmax(count)])
    return np.array(out)


class Combined(Model):
    """Members trained on the same data; voted on, or averaged if they are regressions."""

    def __init__(self, *members: Model):
        self.members, self.regression = members, members[0].regression

    def fit(self, x, y):
        for m in self.members:
            m.fit(x, y)
        return self

    def predict(self, x):
        p = np.array([m.predict(x) for m in self.members])
        return p.mean(0) if self.regression else vote(p)


class Multiclass(Model):
    """One against one: a clone of a two-class model per pair, voted on."""

    def __init__(self, make, kind: str = "1-vs-1"):
        if kind != "1-vs-1":
            raise NotImplementedError(kind)
        self.make = make

    def fit(self, x, y):
        y = np.asarray(y)
        self.members = [self.make().fit(x[np.isin(y, p)], y[np.isin(y, p)]) for p in itertools.combinations(np.unique(y), 2)]
        return self

    def predict(self, x):
        return vote(np.array([m.predict(x) for m in self.members]))


class Binary(Model):
    """Two sets of labels as +1 and -1; predictions are the sets' labels as text, joined by ``+``."""

    def __init__(self, model: Model, positive: list, negative: list):
        self.model, self.positive, self.negative = model, positive, negative

    def fit(self, x, y):
        use = np.isin(y, [*self.positive, *self.negative])
        self.model.fit(x[use], np.where(np.isin(np.asarray(y)[use], self.positive), 1, -1))
        return self

    def predict(self, x):
        name = lambda s: "+".join(map(str, sorted(s)))
        return np.where(self.model.predict(x) > 0, name(self.positive), name(self.negative))


class Tree(Model):
    """Groups of labels first, then each group's own model."""

    def __init__(self, root: Model, groups: dict[str, tuple[list, Model | None]]):
        self.root, self.groups = root, groups

    def fit(self, x, y):
        y = np.asarray(y)
        of = {v: g for g, (labels, _) in self.groups.items() for v in labels}
        use = np.isin(y, list(of))
        self.root.fit(x[use], np.array([of[v] for v in y[use]]))
        for labels, model in self.groups.values():
            if model is not None:
                part = np.isin(y, labels)
                model.fit(x[part], y[part])
        return self

    def predict(self, x):
        first = self.root.predict(x)
        out = np.empty(len(x), object)
        for g, (labels, model) in self.groups.items():
            at = first == g
            if at.any():
                out[at] = model.predict(x[at]) if model is not None else labels[0]
        return np.array(out.tolist())


class RegressionAsClassifier(Model):
    """A regression to class numbers; the nearest class centre wins."""

    def __init__(self, model: Model, centres: dict | None = None):
        self.model, self.centres = model, centres

    def fit(self, x, y):
        code = self._labels(y)
        self.values = np.array([self.centres[v] for v in self.labels], float) if self.centres else np.arange(len(self.labels), dtype=float)
        self.model.fit(x, self.values[code])
        return self

    def estimates(self, x):
        return -np.abs(self.model.predict(x)[:, None] - self.values[None])


class Mapped(Model):
    """A mapping fitted on the training data in front of a model; ``fit_map(x, y)`` gives a function of x."""

    def __init__(self, model: Model, fit_map):
        self.model, self.fit_map, self.regression = model, fit_map, model.regression

    def fit(self, x, y):
        self.inputs = x.shape[1]
        self.map = self.fit_map(x, np.asarray(y))
        self.model.fit(self.map(x), y)
        return self

    def predict(self, x):
        return self.model.predict(self.map(x))


class Proxy(Model):
    """A model that stands for another: the same training and predictions, to be built upon."""

    def __init__(self, model: Model):
        self.model, self.regression = model, model.regression

    def fit(self, x, y):
        self.model.fit(x, y)
        return self

    def predict(self, x):
        return self.model.predict(x)


class Chain(Model):
    """Maps fitted one after the other, each on what the one before gives, and a model at the end."""

    def __init__(self, *steps):
        *self.fits, self.model = steps
        self.regression = self.model.regression

    def fit(self, x, y):
        self.maps, self.inputs = [], x.shape[1]
        for fit_map in self.fits:
            self.maps.append(fit_map(x, np.asarray(y)))
            x = self.maps[-1](x)
        self.model.fit(x, y)
        return self

    def predict(self, x):
        for m in self.maps:
            x = m(x)
        return self.model.predict(x)


class Selected(Model):
    """A model on the features that score highest in the training data: ``score(x, y)`` gives a number for each."""

    def __init__(self, model: Model, score, count: int):
        self.model, self.score, self.count, self.regression = model, score, count, model.regression

    def fit(self, x, y):
        self.features = np.sort(np.argsort(-self.score(x, np.asarray(y)), kind="stable")[: self.count])
        self.total = x.shape[1]
        self.model.fit(x[:, self.features], y)
        return self

    def predict(self, x):
        return self.model.predict(x[:, self.features])


def sensitivity_of(model: Model, combine=lambda parts: np.mean(parts, axis=0)) -> np.ndarray:
    """Weights (components x features) of any model that has them or is made of models that do.

    Ensembles combine their members' (the mean by default), proxies and
    regressions in place of classifiers give those of the model inside, selected
    features are put back among all (0 elsewhere), and weights behind linear
    maps are taken back through these by finite differences.
    """
    if hasattr(model, "weights") and model.weights is not None:
        w = np.asarray(model.weights, float)
        return w[None] if w.ndim == 1 else w.T if isinstance(model, SMLR) else w
    if hasattr(model, "members"):
        return np.asarray(combine(np.array([sensitivity_of(m, combine) for m in model.members])))
    if isinstance(model, Selected):
        inner = sensitivity_of(model.model, combine)
        out = np.zeros((len(inner), model.total))
        out[:, model.features] = inner
        return out
    if isinstance(model, Mapped | Chain):
        maps = [model.map] if isinstance(model, Mapped) else model.maps
        inner = sensitivity_of(model.model, combine)
        size = getattr(model, "inputs", None)
        if size is None:
            raise ValueError("set model.inputs, the number of features before the maps")
        whole = np.vstack([np.zeros(size), np.eye(size)])
        for m in maps:
            whole = m(whole)
        return inner @ (whole[1:] - whole[0]).T
    for name in ("model", "root"):
        if hasattr(model, name):
            return sensitivity_of(getattr(model, name), combine)
    raise ValueError(f"{type(model).__name__} has no weights")


class SplitModel(Model):
    """A clone per part of the training data (given by ``parts(n)`` as index arrays left out), voted on."""

    def __init__(self, make, parts):
        self.make, self.parts = make, parts

    def fit(self, x, y):
        y = np.asarray(y)
        self.members = []
        for out in self.parts(len(y)):
            keep = np.setdiff1d(np.arange(len(y)), out)
            self.members.append(self.make().fit(x[keep], y[keep]))
        return self

    def predict(self, x):
        return vote(np.array([m.predict(x) for m in self.members]))


class SameSign(Model):
    """+1 if the first two values share a sign (0 counts as positive), else -1."""

    def fit(self, x, y):
        return self

    def predict(self, x):
        return np.where((x[:, 0] >= 0) == (x[:, 1] >= 0), 1, -1)


class Less1(Model):
    """+1 if the largest value is at most 1, else -1."""

    def fit(self, x, y):
        return self

    def predict(self, x):
        return np.where(x.max(1) <= 1, 1, -1)


class RandomModel(Model):
    """Random labels, the same for equal input."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def fit(self, x, y):
        self._labels(y)
        return self

    def predict(self, x):
        return self.labels[np.random.default_rng(self.seed).integers(len(self.labels), size=len(x))]


def fit_sums(model: Model, n: float, mean: np.ndarray, scatter: np.ndarray) -> Model:
    """A regression fitted to the number, mean and scatter matrix of [x y] of any number of rows.

    Models that depend on the rows through these alone are given few rows with
    the same mean and the same scatter matrix, or the same covariance.
    """
    if hasattr(model, "fit_sums"):
        return model.fit_sums(n, mean, scatter)
    w, v = np.linalg.eigh(scatter)
    half = (v * np.sqrt(np.maximum(w, 0) / 2)).T
    rows = np.vstack([half, -half])
    if model.sums == "covariance":
        rows = rows * np.sqrt(len(rows) / n)
    rows = rows + mean
    return model.fit(rows[:, :-1], rows[:, -1])


#: Configured models by name, with tags.
REGISTRY = {
    "gnb": ({"gnb", "multiclass", "linear"}, GNB),
    "gnb(common)": ({"gnb", "multiclass"}, lambda: GNB(common_variance=True)),
    "knn": ({"knn", "multiclass", "non-linear"}, lambda: KNN(5)),
    "lda": ({"lda", "multiclass", "linear"}, LDA),
    "qda": ({"qda", "multiclass", "non-linear"}, lambda: LDA(True)),
    "smlr": ({"smlr", "multiclass", "linear", "has_sensitivity"}, SMLR),
    "plr": ({"plr", "binary", "linear", "has_sensitivity"}, PLR),
    "svm": ({"svm", "multiclass", "linear", "has_sensitivity"}, SVM),
    "svm(rbf)": ({"svm", "multiclass", "non-linear"}, lambda: SVM(1.0, "rbf")),
    "ridge": ({"ridge", "regression", "linear", "has_sensitivity"}, Ridge),
    "blr": ({"blr", "regression", "linear", "has_sensitivity"}, BLR),
    "gpr": ({"gpr", "regression", "non-linear"}, GPR),
    "nu-svm": ({"svm", "multiclass", "linear", "has_sensitivity"}, lambda: SVM(nu=0.5)),
    "nu-svr": ({"svm", "regression", "non-linear"}, lambda: SVR(nu=0.5)),
    "one-class": ({"svm", "oneclass", "non-linear"}, OneClass),
    "svr": ({"svm", "regression", "non-linear"}, SVR),
    "enet": ({"enet", "regression", "linear", "has_sensitivity"}, ElasticNet),
    "lars": ({"lars", "regression", "linear", "has_sensitivity"}, LARS),
}


def find_models(*tags: str) -> list[str]:
    """Names of the models that have all tags; ``!tag`` excludes."""
    return [n for n, (has, _) in REGISTRY.items() if all((t[1:] not in has) if t.startswith("!") else (t in has) for t in tags)]


def select_model(candidates: list[GPR], x: np.ndarray, y: np.ndarray) -> GPR:
    """The candidate with the highest marginal likelihood."""
    return max((c.fit(x, y) for c in candidates), key=lambda m: m.log_likelihood)
