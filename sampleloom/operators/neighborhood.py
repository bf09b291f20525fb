"""Neighbourhoods on grids and meshes, and measures evaluated around every feature.

A range join is turned into an equality join: the offsets within the radius are
enumerated once, each centre is expanded to the coordinates it reaches, and the
features are joined on these.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sampleloom.operators.generators import uniques
from sampleloom.operators.learners import LOG_2PI, gnb_model


def sphere_offsets(radius: float, dims: int, sizes: list[float] | None = None, distance: Callable | None = None, inner: float | None = None, centre: bool = True) -> list[tuple[int, ...]]:
    """Integer offsets within the radius (inclusive); with ``inner`` those with inner < d <= radius, and the centre if asked for."""
    sizes = sizes or [1.0] * dims
    distance = distance or (lambda v: math.sqrt(sum(x * x for x in v)))
    reach = [int(radius / s) + 1 for s in sizes]
    out = []
    for o in itertools.product(*(range(-r, r + 1) for r in reach)):
        d = distance([x * s for x, s in zip(o, sizes, strict=True)])
        if d <= radius + 1e-12 and (inner is None or d > inner or (centre and not any(o))):
            out.append(o)
    return out


def neighbours(features: DataFrame, coords: list[str], radius: float, inner: float | None = None, centre: bool = True, sizes: list[float] | None = None, centres: DataFrame | None = None) -> DataFrame:
    """(center_id, feature_id) of all features within the radius around each centre."""
    offsets = sphere_offsets(radius, len(coords), sizes, None, inner, centre)
    # bounded by the volume of the sphere, not by the data
    each = F.array(*(F.struct(*(F.lit(x).alias(f"o{i}") for i, x in enumerate(o))) for o in offsets))
    seeds = features if centres is None else features.join(centres, "feature_id", "left_semi")
    reach = seeds.select(F.col("feature_id").alias("center_id"), *coords, F.explode(each).alias("o"))
    reach = reach.select("center_id", *((F.col(c) + F.col(f"o.o{i}")).alias(c) for i, c in enumerate(coords)))
    return reach.join(features.select("feature_id", *coords), coords).select("center_id", "feature_id")


def unique_coordinates(features: DataFrame, coords: list[str]) -> None:
    """Raises if two features share their coordinates."""
    if features.groupBy(*coords).count().where("count > 1").limit(1).count():
        raise ValueError("coordinates are not unique")


def scatter(coords: list[tuple], offsets: list[tuple], deterministic: bool = True, seed: int = 0) -> list[int]:
    """Seeds such that none lies in another's neighbourhood, greedily from the last coordinate on (one small list of coordinates)."""
    at = {tuple(c): i for i, c in enumerate(coords)}
    order = list(range(len(coords)))[::-1]
    if not deterministic:
        np.random.default_rng(seed).shuffle(order)
    gone: set[int] = set()
    out = []
    for i in order:
        if i in gone:
            continue
        out.append(i)
        gone |= {at[t] for o in offsets if (t := tuple(a + b for a, b in zip(coords[i], o, strict=True))) in at}
    return out


def searchlight(long: DataFrame, near: DataFrame, measure: Callable[[np.ndarray, pd.DataFrame], float], attrs: list[str], most: int = 1_000_000) -> DataFrame:
    """(center_id, value, roi_size): any measure of (samples x features, sample attributes) around each centre.

    For measures that can't be put together from sums (see
    :func:`row_searchlight`); one task holds the samples of one neighbourhood.
    More than ``most`` samples raise an error: nothing is drawn.
    """
    most_seen = long.groupBy("feature_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most_seen > most:
        raise ValueError(f"{most_seen} samples are more than one task holds ({most}); use a measure that adds up over samples")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="sample_id", columns="feature_id", values="value").sort_index()
        a = pdf.drop_duplicates("sample_id").set_index("sample_id").loc[x.index, attrs]
        return pd.DataFrame({"center_id": [pdf["center_id"].iloc[0]], "value": [float(measure(x.to_numpy(), a))], "roi_size": [x.shape[1]]})

    return long.join(near, "feature_id").groupBy("center_id").applyInPandas(run, "center_id int, value double, roi_size int")


def stored_neighbours(spark, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Neighbourhoods read from ``path``; made and written there the first time."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


def mean_searchlight(long: DataFrame, near: DataFrame) -> DataFrame:
    """Mean over all samples and neighbours around each centre: feature means first, then joined."""
    means = long.groupBy("feature_id").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return near.join(means, "feature_id").groupBy("center_id").agg((F.sum("s") / F.sum("n")).alias("value"), F.count("*").cast("int").alias("roi_size"))


#: Scores of samples, features and classes that one step of a task holds.
STEP = 4_000_000


def row_searchlight(long: DataFrame, near: DataFrame, target: str, fold: str | None, tables: dict, labels: list, larger: bool) -> DataFrame:
    """(center_id, fold, wrong, n): errors of a rule whose score adds up over features, around every centre.

    ``tables`` has, for each fold, classes x features of means, weights and
    constants and the classes' priors: a feature's score is weight (x - mean)^2 +
    constant, or, where the weight is NaN, 0 at the mean and minus infinity
    elsewhere. A sample's values are one array and its scores are summed over
    neighbourhoods where they are, so only errors by centre and fold are
    shuffled. The neighbourhoods and tables are of the size of the feature axis.
    Of equal classes the ``larger`` or smaller label is taken.
    """
    around = near.groupBy("center_id").agg(F.array_sort(F.collect_list("feature_id")).alias("ids")).orderBy("center_id").toPandas()
    ids = sorted({int(f) for x in around["ids"] for f in x})
    at = {f: i for i, f in enumerate(ids)}
    flat = np.array([at[int(f)] for x in around["ids"] for f in x], int)
    begin = np.append(0, np.cumsum([len(x) for x in around["ids"]])[:-1]).astype(int)
    centers = around["center_id"].to_numpy()
    code = {x: i for i, x in enumerate(labels)}
    cells = F.array_sort(F.collect_list(F.struct("feature_id", F.col("value").cast("double").alias("value"))))
    part = F.col(fold).cast("string") if fold else F.lit("")
    rows = long.where(F.col("feature_id").isin(ids)).groupBy("sample_id", F.col(target).alias("target"), part.alias("fold")).agg(cells.alias("c"))
    complete = F.size("c") == len(ids)
    rows = rows.select("target", "fold", F.transform("c", lambda c: c["value"]).alias("x"), F.when(~complete, F.transform("c", lambda c: c["feature_id"])).alias("which"))

    def run(batches):
        for pdf in batches:
            for name, group in pdf.groupby("fold"):
                mean, weight, const, prior = tables[name]
                x = np.full((len(group), len(ids)), np.nan)
                for i, (v, which) in enumerate(zip(group["x"], group["which"], strict=True)):
                    x[i, slice(None) if which is None else [at[f] for f in which]] = v
                true = np.array([code.get(t, -1) for t in group["target"]])
                wrong, step = np.zeros(len(centers), np.int64), max(1, STEP // (max(len(flat), len(ids)) * len(labels)))
                for a in range(0, len(x), step):
                    d = x[a : a + step, None, :] - mean[None]
                    s = weight * d * d + const
                    s = np.where(np.isnan(weight), np.where(d == 0, 0.0, -np.inf), s)
                    s[np.isnan(d)] = 0
                    s = np.add.reduceat(s[:, :, flat], begin, axis=2) + prior[None, :, None]
                    best = len(labels) - 1 - np.argmax(s[:, ::-1], axis=1) if larger else np.argmax(s, axis=1)
                    wrong += (best != true[a : a + step, None]).sum(0)
                yield pd.DataFrame({"center_id": centers, "fold": name, "wrong": wrong, "n": len(x)})

    counts = rows.mapInPandas(run, f"center_id {dict(near.dtypes)['center_id']}, fold string, wrong long, n long")
    return counts.groupBy("center_id", "fold").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n"))


def _tables(model: pd.DataFrame, ids: list[int], k: int, variances: bool) -> dict[str, tuple]:
    """By fold: means, weights and constants (classes x features) of rows (fold, feature_id, m0, v0, m1, ...)."""
    out = {}
    for name, part in model.groupby("fold"):
        part = part.set_index("feature_id").reindex(ids)
        mean = part[[f"m{i}" for i in range(k)]].to_numpy(float).T
        if variances:
            v = part[[f"v{i}" for i in range(k)]].to_numpy(float).T
            with np.errstate(divide="ignore", invalid="ignore"):
                weight, const = np.where(v == 0, np.nan, -0.5 / v), np.where(v == 0, 0.0, -0.5 * (LOG_2PI + np.log(v)))
        else:
            weight, const = np.full(mean.shape, -1.0), np.zeros(mean.shape)
        out[str(name)] = (mean, weight, const)
    return out


def gnb_searchlight(long: DataFrame, near: DataFrame, target: str, chunk: str) -> DataFrame:
    """Error of naive Bayes around each centre, leaving out one chunk at a time: (center_id, fold, error).

    Statistics per (chunk, class, feature) are taken once; see :func:`row_searchlight`.
    """
    labels = uniques(long, target)
    model, priors = gnb_model(long, target, chunk, labels)
    ids = sorted(r[0] for r in near.select("feature_id").distinct().collect())
    tables = _tables(model.toPandas(), ids, len(labels), True)
    lp = priors.toPandas()
    for name, row in zip(lp["fold"], lp[[f"lp{i}" for i in range(len(labels))]].to_numpy(float), strict=True):
        tables[str(name)] += (np.where(np.isnan(row), -np.inf, row),)
    tables = {f: (np.nan_to_num(m), np.where(np.isneginf(p)[:, None], 0, w), np.nan_to_num(c), p) for f, (m, w, c, p) in tables.items()}
    counts = row_searchlight(long, near, target, chunk, tables, labels, True)
    kind = dict(long.dtypes)[chunk]
    return counts.select("center_id", F.col("fold").cast(kind).alias("fold"), F.try_divide("wrong", "n").alias("error"))


def nearest_mean_in_place(long: DataFrame, near: DataFrame, target: str) -> DataFrame:
    """(center_id, value, n): share of samples around each centre that lie nearer to another class's mean than to their own's."""
    labels = uniques(long, target)
    t = F.col(target)
    means = long.groupBy("feature_id").agg(*(F.avg(F.when(t == F.lit(y), F.col("value"))).alias(f"m{i}") for i, y in enumerate(labels)))
    ids = sorted(r[0] for r in near.select("feature_id").distinct().collect())
    tables = {f: (*x, np.zeros(len(labels))) for f, x in _tables(means.withColumn("fold", F.lit("")).toPandas(), ids, len(labels), False).items()}
    counts = row_searchlight(long, near, target, None, tables, labels, False)
    return counts.select("center_id", F.try_divide("wrong", "n").alias("value"), "n")


def m1nn_searchlight(long: DataFrame, near: DataFrame, target: str, chunk: str) -> DataFrame:
    """Error of the nearest class mean around each centre: (center_id, fold, error); class means of the held-out chunk are what is predicted."""
    labels = uniques(long, target)
    t = F.col(target)
    sums = long.groupBy(F.col(chunk).alias("fold"), "feature_id").agg(*(c for i, y in enumerate(labels) for c in (F.count_if(t == F.lit(y)).cast("double").alias(f"n{i}"), F.coalesce(F.sum(F.when(t == F.lit(y), F.col("value"))), F.lit(0.0)).alias(f"s{i}"))))
    # chunks x features rows: training means are the total less the own chunk
    every = W.partitionBy("feature_id")
    means = [F.try_divide(F.sum(f"s{i}").over(every) - F.col(f"s{i}"), F.sum(f"n{i}").over(every) - F.col(f"n{i}")).alias(f"m{i}") for i in range(len(labels))]
    own = [F.struct(F.lit(y).alias("target"), F.try_divide(F.col(f"s{i}"), F.col(f"n{i}")).alias("value")) for i, y in enumerate(labels)]
    cells = sums.select("fold", "feature_id", *means, F.array(*own).alias("own"))
    test = cells.select("fold", "feature_id", *(f"m{i}" for i in range(len(labels))), F.explode("own").alias("o")).where("o.value is not null")
    sq = test.select("fold", "feature_id", F.col("o.target").alias("target"), *(F.pow(F.col("o.value") - F.col(f"m{i}"), 2).alias(f"d{i}") for i in range(len(labels))))
    around = sq.join(near, "feature_id").groupBy("center_id", "fold", "target").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(len(labels))))
    each = F.array_sort(F.filter(F.array(*(F.struct(F.col(f"d{i}").alias("d"), F.lit(y).alias("label")) for i, y in enumerate(labels))), lambda x: x["d"].isNotNull()))
    best = around.select("center_id", "fold", "target", each[0]["label"].alias("prediction"))
    return best.groupBy("center_id", "fold").agg(F.avg((F.col("prediction") != F.col("target")).cast("double")).alias("error"))


def fill_scattered(results: DataFrame, near: DataFrame) -> DataFrame:
    """Mean of the results of all neighbourhoods that cover a feature."""
    return near.join(results, "center_id").groupBy("feature_id").agg(F.avg("value").alias("value"))


# --- meshes ----------------------------------------------------------------
class Surface:
    """A triangle mesh: vertices (n x 3) and faces (m x 3), as a dimension that one machine holds."""

    def __init__(self, vertices: np.ndarray, faces: np.ndarray | None = None):
        self.v = np.asarray(vertices, float)
        self.f = np.zeros((0, 3), int) if faces is None else np.asarray(faces, int)
        if self.f.size and (self.f.min() < 0 or self.f.max() >= len(self.v)):
            raise ValueError("a face names a vertex that isn't there")

    @property
    def edges(self) -> np.ndarray:
        e = np.concatenate([self.f[:, [0, 1]], self.f[:, [1, 2]], self.f[:, [2, 0]]]) if self.f.size else np.zeros((0, 2), int)
        return np.unique(np.sort(e, axis=1), axis=0)

    def neighbors(self) -> dict[int, dict[int, float]]:
        out: dict[int, dict[int, float]] = {i: {} for i in range(len(self.v))}
        for a, b in self.edges:
            out[a][b] = out[b][a] = float(np.linalg.norm(self.v[a] - self.v[b]))
        return out

    def dijkstra(self, source: int, radius: float = math.inf) -> dict[int, float]:
        """Distance along edges to every vertex within the radius."""
        near, done, heap = self.neighbors() if not hasattr(self, "_n") else self._n, {}, [(0.0, source)]
        self._n = near
        while heap:
            d, i = heapq.heappop(heap)
            if i in done or d > radius:
                continue
            done[i] = d
            for j, w in near[i].items():
                if j not in done:
                    heapq.heappush(heap, (d + w, j))
        return done

    def euclidean(self, source: int, radius: float = math.inf) -> dict[int, float]:
        d = np.linalg.norm(self.v - self.v[source], axis=1)
        return {int(i): float(d[i]) for i in np.flatnonzero(d <= radius)}

    def face_areas(self) -> np.ndarray:
        a, b, c = (self.v[self.f[:, i]] for i in range(3))
        return 0.5 * np.linalg.norm(np.cross(b - a, c - a), axis=1)

    def node_areas(self) -> np.ndarray:
        out = np.zeros(len(self.v))
        np.add.at(out, self.f.ravel(), np.repeat(self.face_areas() / 3, 3))
        return out

    def face_normals(self) -> np.ndarray:
        a, b, c = (self.v[self.f[:, i]] for i in range(3))
        n = np.cross(b - a, c - a)
        return n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)

    def node_normals(self) -> np.ndarray:
        out = np.zeros_like(self.v)
        for k in range(3):
            np.add.at(out, self.f[:, k], self.face_normals())
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    def nearest(self, points: np.ndarray) -> np.ndarray:
        return np.array([int(np.argmin(((self.v - p) ** 2).sum(1))) for p in np.atleast_2d(points)])

    def merge(self, *others: Surface) -> Surface:
        v, f = [self.v], [self.f]
        for o in others:
            f.append(o.f + sum(map(len, v)))
            v.append(o.v)
        return Surface(np.concatenate(v), np.concatenate(f))

    def split(self) -> list[np.ndarray]:
        """Vertices of each connected part."""
        left, out = set(range(len(self.v))), []
        while left:
            part = set(self.dijkstra(min(left)))
            out.append(np.array(sorted(part)))
            left -= part
        return out


def surface_neighbours(spark, surface: Surface, radius: float, inner: float | None = None, include_centre: bool = True, metric: str = "dijkstra", centres: list[int] | None = None) -> DataFrame:
    """(center_id, feature_id, distance) on a mesh: centres in parallel, the mesh broadcast (its size is that of the mesh)."""
    mesh = spark.sparkContext.broadcast(surface)

    def run(batches):
        for pdf in batches:
            rows = []
            for c in pdf["center_id"]:
                found = getattr(mesh.value, metric)(int(c), radius)
                rows += [(c, i, d) for i, d in found.items() if inner is None or d > inner or (include_centre and i == c)]
            yield pd.DataFrame(rows, columns=["center_id", "feature_id", "distance"])

    seeds = spark.range(len(surface.v)).select(F.col("id").cast("int").alias("center_id"))
    if centres is not None:
        seeds = spark.createDataFrame([(int(c),) for c in centres], "center_id int")
    return seeds.mapInPandas(run, "center_id int, feature_id int, distance double")


# --- volumes ---------------------------------------------------------------
def linear_index(i, j, k, shape: tuple[int, int, int]):
    return (i * shape[1] + j) * shape[2] + k


def voxel_columns(df: DataFrame, index: str, shape: tuple[int, int, int]) -> DataFrame:
    """Linear index to i, j, k by whole-number arithmetic."""
    return df.selectExpr("*", f"cast({index} div {shape[1] * shape[2]} as int) i", f"cast(({index} div {shape[2]}) % {shape[1]} as int) j", f"cast({index} % {shape[2]} as int) k")


def affine(df: DataFrame, source: list[str], target: list[str], matrix: np.ndarray) -> DataFrame:
    """Coordinates through a 4 x 4 matrix."""
    out = df
    for r, t in enumerate(target):
        e = F.lit(float(matrix[r][3]))
        for c, s in enumerate(source):
            e = e + float(matrix[r][c]) * F.col(s)
        out = out.withColumn(t, e)
    return out


def mni_to_talairach(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Piecewise affine by the sign of z (a published approximation; fixed values)."""
    up, down = ([0.9900, 0, 0], [0, 0.9688, 0.0460], [0, -0.0485, 0.9189]), ([0.9900, 0, 0], [0, 0.9688, 0.0420], [0, -0.0485, 0.8390])
    at = [F.col(c) for c in (x, y, z)]
    row = lambda m: sum((float(w) * c for w, c in zip(m, at, strict=True) if w), F.lit(0.0))
    return df.select("*", *(F.when(at[2] >= 0, row(u)).otherwise(row(d)).alias(f"tal_{n}") for n, u, d in zip("xyz", up, down, strict=True)))


def surface_voxels(inner: Surface, outer: Surface, shape: tuple[int, int, int], matrix: np.ndarray, steps: int = 10, start: float = 0.0, stop: float = 1.0) -> list[tuple[int, int, float]]:
    """(node, voxel, share of the way): voxels met along the lines between two surfaces."""
    inverse, out = np.linalg.inv(matrix), set()
    for s in np.linspace(start, stop, steps):
        p = inner.v + s * (outer.v - inner.v)
        ijk = np.round((inverse @ np.column_stack([p, np.ones(len(p))]).T).T[:, :3]).astype(int)
        ok = ((ijk >= 0) & (ijk < shape)).all(1)
        out |= {(int(n), int(linear_index(*ijk[n], shape)), round(float(s), 6)) for n in np.flatnonzero(ok)}
    return sorted(out)


def minimal_mapping(pairs: DataFrame) -> DataFrame:
    """Of (node, voxel, share) the node nearest the middle for every voxel."""
    return pairs.groupBy("voxel").agg(F.min_by("node", F.struct(F.abs(F.col("share") - 0.5), F.col("node"))).alias("node"))


def select_voxels(node_distance: DataFrame, pairs: DataFrame, radius: float | None = None, count: int | None = None) -> DataFrame:
    """(center_id, voxel, distance): voxels of the nodes around each centre, within a radius or the nearest ``count``."""
    near = node_distance.join(pairs.withColumnRenamed("node", "feature_id"), "feature_id").groupBy("center_id", "voxel").agg(F.min("distance").alias("distance"))
    if radius is not None:
        return near.where(F.col("distance") <= radius)
    return near.withColumn("_r", F.row_number().over(W.partitionBy("center_id").orderBy("distance", "voxel"))).where(F.col("_r") <= count).drop("_r")


# --- atlases ---------------------------------------------------------------
def label_points(points: DataFrame, atlas: DataFrame, coords: list[str], label: str = "label") -> DataFrame:
    """Label of each coordinate, NULL outside the atlas."""
    return points.join(atlas.select(*coords, label), coords, "left")


def nearest_reference(points: DataFrame, references: DataFrame, coords: list[str], distance: float, key: str, label: str = "label") -> DataFrame:
    """Nearest reference within ``distance`` of each point, by cells of that size: an equality join on 3^d cells.

    Only distinct coordinates are paired: references of equal ones stand by
    their least label, and each point takes the answer of its coordinates, so
    the ``key`` plays no part. Spark sizes exploded rows as if they were not
    exploded, so the join is a merge and no such side is ever broadcast.
    """
    own = [f"_{c}" for c in coords]
    places = points.select(*coords).distinct().withColumn("_cell", F.array(*(F.floor(F.col(c) / distance) for c in coords)))
    least = references.groupBy(*(F.col(c).alias(o) for c, o in zip(coords, own, strict=True))).agg(F.min(F.struct(F.col(label).alias("l")))["l"].alias("_label"))
    around = itertools.product((-1, 0, 1), repeat=len(coords))
    # infinite coordinates lie at the end of the range: NULL beyond it
    each = F.array(*(F.array(*(F.try_add(F.floor(F.col(c) / distance), F.lit(o)) for c, o in zip(own, offset, strict=True))) for offset in around))
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(o), 2) for c, o in zip(coords, own, strict=True)), F.lit(0.0)))
    hit = places.join(least.withColumn("_cell", F.explode(each)).hint("merge"), "_cell").withColumn("_d", d).where(F.col("_d") <= distance)
    best = hit.groupBy(*coords).agg(F.min_by(F.struct(F.col("_label").alias("label"), F.col("_d").alias("d")), F.struct("_d", "_label")).alias("_b"))
    return points.join(best, coords, "left").select(points["*"], F.col("_b.label").alias(label), F.col("_b.d").alias("distance"))


def probable_labels(points: DataFrame, atlas: DataFrame, coords: list[str], threshold: float = 0.0, strategy: str = "all", key: str = "point_id") -> DataFrame:
    """Labels (label, probability) above a threshold at each point; ``max`` keeps the likeliest."""
    hit = points.join(atlas, coords).where(F.col("probability") > threshold)
    if strategy == "max":
        best = hit.groupBy(key).agg(F.max_by("label", F.struct("probability", "label")).alias("label"), F.max("probability").alias("probability"))
        return points.join(best, key, "left")
    return hit


def masked_volumes(voxels: DataFrame, mask: DataFrame | None = None, tr: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Voxel values (t, i, j, k, value) as cells and features: (sample_id, time_coords, feature_id, value) and (feature_id, i, j, k).

    ``mask`` (i, j, k) keeps its voxels. Features are numbered in order of
    coordinates, by a rank that no single task computes.
    """
    from sampleloom.operators.select import ranked

    kept = voxels if mask is None else voxels.join(mask.select("i", "j", "k").distinct(), ["i", "j", "k"], "left_semi")
    features = ranked(kept.select("i", "j", "k").distinct(), [], ["i", "j", "k"]).select(F.col("pos").cast("int").alias("feature_id"), "i", "j", "k")
    cells = kept.join(features, ["i", "j", "k"]).select(F.col("t").cast("long").alias("sample_id"), (F.col("t") * F.lit(tr or 1.0)).alias("time_coords"), "feature_id", "value")
    return cells, features
