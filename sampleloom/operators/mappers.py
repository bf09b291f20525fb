"""Mappers: fitted, often invertible transformations of samples or features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.dataset import ID, VALUES
from sampleloom.operators.measures import symmetric


def flatten(values: str, depth: int = 2) -> Column:
    """Nested arrays to one, in C order."""
    out = F.col(values)
    for _ in range(depth - 1):
        out = F.flatten(out)
    return out


def add_axis(values: str, place: int = 0, depth: int = 1) -> Column:
    """A further axis of length one at ``place`` of an array nested ``depth`` deep."""
    if place == 0:
        return F.array(F.col(values))
    wrap = lambda c, p: F.transform(c, (lambda x: F.array(x)) if p == 1 else (lambda x: wrap(x, p - 1)))
    return wrap(F.col(values), min(place, depth))


def flat_coordinates(spark, shape: tuple[int, ...], names: list[str] | None = None, factors: dict[str, list] | None = None) -> DataFrame:
    """feature_id, its coordinates, and the factor values these stand for."""
    names = names or [f"dim{i}" for i in range(len(shape))]
    rows = [(i, *map(int, c)) for i, c in enumerate(np.ndindex(*shape))]
    df = spark.createDataFrame(rows, ", ".join(["feature_id int", *(f"{n}_indices int" for n in names)]))
    for n, values in (factors or {}).items():
        df = df.withColumn(n, F.array(*map(F.lit, values))[F.col(f"{n}_indices")])
    return df


def channels(df: DataFrame, key: str, values: str, t0: float, dt: float, names: list[str]) -> DataFrame:
    """Trials x channels x time to cells (key, channel, timepoint, value)."""
    ch = df.select(key, F.posexplode(values).alias("_c", "_row"))
    cells = ch.select(key, "_c", F.posexplode("_row").alias("_t", "value"))
    return cells.select(key, F.array(*map(F.lit, names))[F.col("_c")].alias("channel"), (F.lit(t0) + F.col("_t") * dt).alias("timepoint"), "value")


def transpose(long: DataFrame) -> DataFrame:
    """Samples and features swapped."""
    return long.select(F.col("feature_id").cast("long").alias(ID), F.col(ID).alias("feature_id"), "value")


def project(df: DataFrame, matrix: np.ndarray, offset: np.ndarray | None = None, values: str = VALUES) -> DataFrame:
    """Each sample's values, less an offset, times a matrix (features x components), in Arrow batches."""
    schema = df.schema
    m, o = np.asarray(matrix, float), np.zeros(len(matrix)) if offset is None else np.asarray(offset, float)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf[values].tolist(), float)
                pdf = pdf.assign(**{values: list((x - o) @ m)})
            yield pdf

    return df.mapInPandas(run, schema)


class Projection:
    """y = (x - offset) P; the way back by the pseudo-inverse or a given matrix."""

    def __init__(self, matrix: np.ndarray, offset: np.ndarray | None = None, recon: np.ndarray | None = None):
        self.matrix = np.asarray(matrix, float)
        self.offset = np.zeros(len(self.matrix)) if offset is None else np.asarray(offset, float)
        self.recon = np.linalg.pinv(self.matrix) if recon is None else np.asarray(recon, float)

    def forward(self, df: DataFrame, values: str = VALUES) -> DataFrame:
        return project(df, self.matrix, self.offset, values)

    def reverse(self, df: DataFrame, values: str = VALUES) -> DataFrame:
        return project(df, self.recon, -self.offset @ np.linalg.pinv(self.recon) if self.offset.any() else None, values)


def moments(df: DataFrame, values: str = VALUES) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and scatter matrix of the samples: each partition gives one small matrix, merged on the driver."""

    def run(batches):
        n, s, q = 0, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf[values].tolist(), float)
            n, s, q = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            k = len(s)
            yield pd.DataFrame({"x": [[float(n), *s, *q[np.triu_indices(k)]]]})

    # numbers, sums and products in one row of numbers, summed in Spark before the driver sees one
    parts = df.select(values).mapInPandas(run, "x array<double>").select(F.posexplode("x").alias("i", "v"))
    v = np.array([r["v"] for r in parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
    if not len(v):
        return 0, np.zeros(0), np.zeros((0, 0))
    n, k = int(v[0]), int((np.sqrt(8 * len(v) + 1) - 3) / 2)
    mean = v[1 : k + 1] / n
    return n, mean, symmetric(v[k + 1 :], k) - n * np.outer(mean, mean)


def svd(df: DataFrame, values: str = VALUES) -> tuple[Projection, np.ndarray]:
    """Principal axes of the demeaned samples as a projection, and the singular values; the largest weight of an axis is positive."""
    _, mean, scatter = moments(df, values)
    w, v = np.linalg.eigh(scatter)
    order = np.argsort(-w)
    w, v = np.maximum(w[order], 0), v[:, order]
    v = v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])
    return Projection(v, mean, v.T), np.sqrt(w)


def ica(x: np.ndarray, k: int, seed: int = 0, rounds: int = 200) -> np.ndarray:
    """Unmixing matrix of FastICA (symmetric, log cosh) of whitened data: (features x k). Fitted on a bounded sample."""
    x = x - x.mean(0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    white = vt[:k].T / np.maximum(s[:k], 1e-12) * np.sqrt(len(x))
    z = x @ white
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w)
        new = z.T @ g / len(z) - w * (1 - g * g).mean(0)
        a, _, b = np.linalg.svd(new)
        new = a @ b
        done = np.max(np.abs(np.abs((new * w).sum(0)) - 1)) < 1e-6
        w = new
        if done:
            break
    return white @ w


def lle(x: np.ndarray, k: int, dims: int) -> np.ndarray:
    """Locally linear embedding of a bounded sample."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = np.argsort(d, axis=1)[:, 1 : k + 1]
    w = np.zeros((n, n))
    for i in range(n):
        z = x[near[i]] - x[i]
        g = z @ z.T
        c = np.linalg.solve(g + np.eye(k) * 1e-3 * max(np.trace(g), 1e-12), np.ones(k))
        w[i, near[i]] = c / c.sum()
    m = np.eye(n) - w
    return np.linalg.eigh(m.T @ m)[1][:, 1 : dims + 1]


class Procrustes:
    """Orthogonal map from a source to a target space: demeaned, scaled, rotated, or by least squares (oblique)."""

    def __init__(self, scaling: bool = True, reflection: bool = True, oblique: bool = False):
        self.scaling, self.reflection, self.oblique = scaling, reflection, oblique

    def fit(self, source: np.ndarray, target: np.ndarray) -> Procrustes:
        self.source_mean, self.target_mean = source.mean(0), target.mean(0)
        s, t = source - self.source_mean, target - self.target_mean
        k = max(s.shape[1], t.shape[1])
        s0, t0 = np.pad(s, ((0, 0), (0, k - s.shape[1]))), np.pad(t, ((0, 0), (0, k - t.shape[1])))
        ns, nt = np.linalg.norm(s0) or 1.0, np.linalg.norm(t0) or 1.0
        if self.oblique:
            m = np.linalg.lstsq(s0 / ns, t0 / nt, rcond=None)[0]
            scale = nt / ns
        else:
            u, sv, vt = np.linalg.svd((t0 / nt).T @ (s0 / ns))
            if not self.reflection and np.linalg.det(u @ vt) < 0:
                u[:, -1] *= -1
                sv[-1] *= -1
            m = (u @ vt).T
            scale = sv.sum() * nt / ns if self.scaling else 1.0
        self.matrix = (scale * m)[: s.shape[1], : t.shape[1]]
        return self

    def forward(self, x: np.ndarray) -> np.ndarray:
        return (x - self.source_mean) @ self.matrix + self.target_mean

    def reverse(self, y: np.ndarray) -> np.ndarray:
        return (y - self.target_mean) @ np.linalg.pinv(self.matrix) + self.source_mean


def prototype_similarities(df: DataFrame, prototypes: list[list[float]], similarity, values: str = VALUES) -> DataFrame:
    """Each sample's similarities with given prototypes, as its new values; prototypes are literals of the plan."""
    each = [similarity(F.col(values), F.array(*map(F.lit, map(float, p)))) for p in prototypes]
    return df.withColumn(values, F.array(*each))


class SOM:
    """Self-organising map: trained online on the rows of one machine, or in batches by :meth:`fit_rows` on all rows of a table; mapping to the best unit runs everywhere."""

    def __init__(self, shape: tuple[int, int], rounds: int, rate: float = 0.005, radius: float | None = None, seed: int = 0):
        self.shape, self.rounds, self.rate, self.radius, self.seed = shape, rounds, rate, radius or max(shape), seed

    def fit(self, x: np.ndarray) -> SOM:
        rng = np.random.default_rng(self.seed)
        self.units = rng.normal(size=(*self.shape, x.shape[1])) * x.std(0) + x.mean(0)
        grid = np.stack(np.meshgrid(*map(np.arange, self.shape), indexing="ij"), -1)
        tau = self.rounds / max(np.log(self.radius), 1e-9)
        for t in range(self.rounds):
            rate, radius = self.rate * np.exp(-t / self.rounds), self.radius * np.exp(-t / tau)
            for v in x:
                at = np.unravel_index(np.argmin(((self.units - v) ** 2).sum(-1)), self.shape)
                d = ((grid - at) ** 2).sum(-1)
                self.units += (rate * np.exp(-d / (2 * max(radius, 1e-9) ** 2)) * (d <= radius**2))[..., None] * (v - self.units)
        return self

    def fit_rows(self, df: DataFrame, values: str = VALUES) -> SOM:
        """Batch training on all rows: in each round every partition sums its rows by best unit, and each unit becomes the mean of the rows of the units around it.

        The units begin as a grid along the first two principal axes.
        """
        n, mean, scatter = moments(df, values)
        spread, axes = np.linalg.eigh(scatter / max(n, 1))
        axes = axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(axes.shape[1])])
        grid = np.stack(np.meshgrid(*map(np.arange, self.shape), indexing="ij"), -1).reshape(-1, 2)
        along = (grid / np.maximum(np.array(self.shape) - 1, 1) - 0.5) * 4 * np.sqrt(np.maximum(spread[[-1, -2]], 0))
        units = mean + along @ axes[:, [-1, -2]].T
        tau = self.rounds / max(np.log(self.radius), 1e-9)
        for t in range(self.rounds):

            def run(batches, units=units):
                total = np.zeros((len(units), units.shape[1] + 1))
                for pdf in batches:
                    if len(pdf):
                        x = np.array(pdf[values].tolist(), float)
                        best = np.argmin((units * units).sum(1)[None] - 2 * x @ units.T, axis=1)
                        np.add.at(total, best, np.column_stack([np.ones(len(x)), x]))
                yield pd.DataFrame({"u": np.arange(len(units)), "v": total.tolist()})

            sums = df.select(values).mapInPandas(run, "u int, v array<double>").select("u", F.posexplode("v").alias("c", "v")).groupBy("u", "c").agg(F.sum("v").alias("v")).toPandas()
            v = sums.pivot(index="u", columns="c", values="v").sort_index().to_numpy()
            radius = max(self.radius * np.exp(-t / tau), 1e-9)
            h = np.exp(-((grid[:, None] - grid[None]) ** 2).sum(-1) / (2 * radius**2)) @ v
            units = np.where(h[:, :1] > 0, h[:, 1:] / np.maximum(h[:, :1], 1e-300), units)
        self.units = units.reshape(*self.shape, -1)
        return self

    def forward(self, df: DataFrame, key: str = ID, values: str = VALUES) -> DataFrame:
        """(key, row, col) of each sample's best unit."""
        units, width = self.units.reshape(-1, self.units.shape[-1]), self.shape[1]

        def run(batches):
            for pdf in batches:
                x = np.array(pdf[values].tolist(), float).reshape(len(pdf), -1)
                best = np.argmin((units * units).sum(1)[None] - 2 * x @ units.T, axis=1) if len(pdf) else np.zeros(0, int)
                yield pd.DataFrame({key: pdf[key], "row": best // width, "col": best % width})

        return df.select(key, values).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, row int, col int")


# --- alignment -------------------------------------------------------------
def zscored(x: np.ndarray) -> np.ndarray:
    s = x.std(0)
    return (x - x.mean(0)) / np.where(s > 0, s, 1)


class Alignment:
    """One dataset's way to the common space: z-scored and whitened if asked for, Procrustes, reduced if asked for."""

    def __init__(self, mean: np.ndarray, linear: np.ndarray, final: Procrustes, reduce: np.ndarray | None = None):
        self.mean, self.linear, self.final, self.reduce = mean, linear, final, reduce

    def forward(self, x: np.ndarray) -> np.ndarray:
        y = self.final.forward((x - self.mean) @ self.linear)
        return y if self.reduce is None else y @ self.reduce

    @property
    def matrix(self) -> np.ndarray:
        m = self.linear @ self.final.matrix
        return m if self.reduce is None else m @ self.reduce


def hyperalign(data: list[np.ndarray], reference: int | None = None, rounds: int = 1, alpha: float = 1.0, dims: int | None = None, zscore_all: bool = False, zscore_common: bool = True, equal_weight: bool = False) -> tuple[list[Alignment], np.ndarray]:
    """Maps of several datasets to one common space, in three levels.

    First each dataset is mapped to the space so far, which moves halfway to it
    (``equal_weight``: by the share of those seen before); then ``rounds`` times each is mapped to the
    mean of the others; last each is mapped from scratch to the final mean.
    ``alpha`` below 1 shrinks a whitening of each dataset, ``dims`` keeps leading
    components of the space. The first level is sequential by definition;
    datasets are subjects, each held as a matrix.
    """
    norm = zscored if zscore_common else (lambda v: v)
    pre = []
    for x in data:
        mean, linear = np.zeros(x.shape[1]), np.eye(x.shape[1])
        if zscore_all:
            sd = x.std(0)
            mean, linear = x.mean(0), np.diag(1 / np.where(sd > 0, sd, 1))
        if alpha < 1:
            _, s, vt = np.linalg.svd((x - mean) @ linear, full_matrices=False)
            linear = linear @ (vt.T * (1 / np.sqrt((1 - alpha) * s**2 + alpha))) @ vt
        pre.append((mean, linear))
    data = [(x - m) @ w for x, (m, w) in zip(data, pre, strict=True)]
    n = len(data)
    ref = int(np.argmax([x.shape[1] for x in data])) if reference is None else reference
    common = norm(data[ref]) if not zscore_all else data[ref]
    if n > 1:
        mapped, seen = list(data), 1
        for i, x in enumerate(data):
            if i == ref:
                continue
            mapped[i] = norm(Procrustes().fit(x, common).forward(x))
            share = seen / (seen + 1) if equal_weight else 0.5
            common = norm((1 - share) * common + share * mapped[i])
            seen += 1
        width = common.shape[1]
        mapped = [m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in mapped]
        for _ in range(rounds):
            every = np.sum(mapped, axis=0)
            means = [norm((every - own) / (n - 1)) for own in mapped]
            mapped = [norm(Procrustes().fit(x, m).forward(x)) for x, m in zip(data, means, strict=True)]
        common = norm(np.mean(mapped, axis=0))
    final = [Procrustes().fit(x, common) for x in data]
    reduce = None
    if dims is not None:
        mean = sum(f.forward(x) for f, x in zip(final, data, strict=True)) / n
        reduce = np.linalg.svd(mean - mean.mean(0), full_matrices=False)[2][:dims].T
    return [Alignment(m, w, f, reduce) for (m, w), f in zip(pre, final, strict=True)], common


def hyperalign_groups(cells: DataFrame, group: str, subject: str = "subject", values: str = VALUES, key: str = ID, dims: int | None = None) -> DataFrame:
    """Hyperalignment inside every group (a neighbourhood): (group, subject, i, j, w), the local projections.

    ``cells`` has one row for each group, subject and sample with the values of
    the group's features. Local projections of all groups are summed by the
    caller into one sparse projection a subject.
    """
    kind, sub = dict(cells.dtypes)[group], dict(cells.dtypes)[subject]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        subjects = sorted(pdf[subject].unique())
        data = [np.array(pdf[pdf[subject] == s].sort_values(key)[values].tolist(), float) for s in subjects]
        maps, _ = hyperalign(data, dims=dims)
        rows = [(pdf[group].iloc[0], s, i, j, float(m.matrix[i, j])) for s, m in zip(subjects, maps, strict=True) for i in range(m.matrix.shape[0]) for j in range(m.matrix.shape[1])]
        return pd.DataFrame(rows, columns=[group, subject, "i", "j", "w"])

    return cells.groupBy(group).applyInPandas(run, f"{group} {kind}, {subject} {sub}, i int, j int, w double")


def connectivity(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Correlation of every feature with seed time series: what connectivity alignment aligns."""
    return zscored(seeds).T @ zscored(x) / len(x)


def feature_scores(data: list[np.ndarray]) -> list[np.ndarray]:
    """Per dataset and feature the sum, over the others, of the largest product of z-scored series: n times the correlation."""
    z = [zscored(x) for x in data]
    out = [np.zeros(x.shape[1]) for x in z]
    for i, a in enumerate(z):
        for j, b in enumerate(z):
            if i != j:
                out[i] += (a.T @ b).max(1)
    return out


def off_diagonal(a: np.ndarray, width: int, value: float = np.inf) -> np.ndarray:
    """A band about the diagonal masked: columns r - w .. r - 1 and r + 1 .. r + w - 1; the diagonal stays."""
    out = a.copy()
    for r in range(len(a)):
        for c in range(max(0, r - width), min(a.shape[1], r + width)):
            if c != r:
                out[r, c] = value
    return out


def segment_accuracy(data: list[np.ndarray], width: int = 6, overlapping: bool = True) -> list[float]:
    """Between-subject matching of time segments by correlation with the others' mean; overlapping segments excluded."""
    out = []
    for i, x in enumerate(data):
        y = sum(d for j, d in enumerate(data) if j != i) / (len(data) - 1)
        step = 1 if overlapping else width
        at = range(0, len(x) - width + 1, step)
        a, b = (np.array([v[s : s + width].ravel() for s in at]) for v in (x, y))
        a, b = (v - v.mean(1, keepdims=True) for v in (a, b))
        r = (a @ b.T) / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None], 1e-300)
        r = off_diagonal(-r, width if overlapping else 1)
        out.append(float(np.mean(np.argmin(r, axis=1) == np.arange(len(r)))))
    return out


def hyperalign_selected(data: list[np.ndarray], share: float = 1.0, same: bool = False, reference: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Alignment on the features that correlate best across datasets: (projections over all features, chosen features of each).

    ``share`` of the features are chosen by :func:`feature_scores`, the same ones
    for all datasets if asked for; unchosen features have no weight.
    """
    scores = feature_scores(data)
    if same:
        scores = [np.sum(scores, axis=0)] * len(data)
    chosen = [np.sort(np.argsort(-s, kind="stable")[: max(1, int(round(share * len(s))))]) for s in scores]
    maps, _ = hyperalign([x[:, c] for x, c in zip(data, chosen, strict=True)], reference=reference)
    out = []
    for x, c, m in zip(data, chosen, maps, strict=True):
        full = np.zeros((x.shape[1], m.matrix.shape[1]))
        full[c] = m.matrix
        out.append(full)
    return out, chosen
