"""Synthetic datasets, made in parallel from ranges and seeded noise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def normal_features(spark: SparkSession, per_label: int = 50, labels: int = 2, features: int = 4, chunks: int = 5, snr: float = 3.0, nonbogus: list[int] | None = None, seed: int = 0, partitions: int | None = None, normalize: bool = False) -> DataFrame:
    """Classes L0, L1, ... with one shifted feature each and normal noise of variance 1 / snr; ``normalize`` scales to a largest size of 1."""
    nonbogus = nonbogus if nonbogus is not None else list(range(min(labels, features)))
    base = spark.range(0, per_label * labels, 1, partitions)
    label = F.floor(F.col("id") / per_label).cast("int")
    shift = F.array(*(F.array(*(F.lit(1.0 if l < len(nonbogus) and nonbogus[l] == f else 0.0) for f in range(features))) for l in range(labels)))
    values = F.array(*(shift[label][f] + F.randn(seed + f) / float(np.sqrt(snr)) for f in range(features)))
    chunk = F.floor(F.col("id") % per_label * chunks / per_label).cast("int")
    out = base.select(F.col("id").alias("sample_id"), F.concat(F.lit("L"), label.cast("string")).alias("targets"), chunk.alias("chunks"), values.alias("features"))
    if not normalize:
        return out
    top = out.agg(F.max(F.array_max(F.transform("features", F.abs)))).first()[0]
    return out.withColumn("features", F.transform("features", lambda x: x / F.lit(top)))


def multiple_chunks(make, n: int) -> DataFrame:
    """A generator's output repeated over chunks."""
    out = None
    for c in range(n):
        part = make(c).withColumn("chunks", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


def dumb(spark: SparkSession, classes: int = 3) -> DataFrame:
    """The toy set of 24 samples: 1 to 12 twice, and 0 or 1; targets by thirds (from 1) or halves (from 0), chunks by row."""
    n = 24
    rows = [(i, [float(i // 2 + 1), float(i % 2)], i * classes // n + (classes == 3), i) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, features array<double>, targets int, chunks int")


def pure_multivariate(spark: SparkSession, patterns: int, snr: float = 1.5, seed: int = 0) -> DataFrame:
    """Four clouds, two features that tell the classes apart only together."""
    cloud = F.floor(F.col("id") / patterns)
    a = F.when(cloud % 2 == 0, -snr).otherwise(snr) + F.randn(seed)
    b = F.when(cloud < 2, snr).otherwise(-snr) + F.randn(seed + 1)
    return spark.range(4 * patterns).select(F.col("id").alias("sample_id"), F.array(a, b).alias("features"), F.when((cloud == 1) | (cloud == 2), 1).otherwise(0).alias("targets"))


def wr1996(spark: SparkSession, n: int = 200, seed: int = 0) -> DataFrame:
    """A regression with two used inputs, two noisy copies of them and two useless ones; targets have mean 0."""
    # fixed values: the inputs' intervals, the two lengths and the noise
    (a0, a1), (b0, b1), (r1, r2), (sd, copy) = (-1.932, -0.453), (0.534, 3.142), (2.0, 1.3), (0.05, 0.02)
    x = spark.range(n).select(F.col("id").alias("sample_id"), (F.rand(seed) * (a1 - a0) + a0).alias("a"), (F.rand(seed + 1) * (b1 - b0) + b0).alias("b"), *(F.randn(seed + 2 + i).alias(f"n{i}") for i in range(5)))
    y = r1 * F.cos(F.col("a") + r2 * F.cos(F.col("a") + F.col("b"))) + sd * F.col("n4")
    out = x.select("sample_id", F.array("a", "b", F.col("a") + copy * F.col("n0"), F.col("b") + copy * F.col("n1"), "n2", "n3").alias("features"), y.alias("targets"))
    mean = out.agg(F.avg("targets")).first()[0]
    return out.withColumn("targets", F.col("targets") - F.lit(mean))


def sine(spark: SparkSession, n: int, features: int, flat: bool = False, noise: float = 0.4, seed: int = 0) -> DataFrame:
    """Rounded sine of the sum of squares, with uniform noise; ``flat`` takes inputs in order instead of at random."""
    grid = [F.when(F.col("id") * features + f < n, (F.col("id") * features + f) / n).otherwise(0.0) if flat else F.rand(seed + 1 + f) for f in range(features)]
    base = spark.range(n).select(F.col("id").alias("sample_id"), F.array(*(g * float(np.pi) for g in grid)).alias("features"))
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v)
    return base.withColumn("targets", F.round(F.sin(total)) + noise * F.rand(seed))


def chirp(spark: SparkSession, n: int, features: int = 4, used: int = 2, data_noise: float = 0.4, noise: float = 0.1, seed: int = 0) -> DataFrame:
    t = F.col("id") / max(n - 1, 1)
    wave = F.sin(10 * float(np.pi) * t * t)
    values = F.array(*((wave if f < used else F.lit(0.0)) + data_noise * F.randn(seed + f) for f in range(features)))
    return spark.range(n).select(F.col("id").alias("sample_id"), values.alias("features"), (wave + noise * F.randn(seed + 99)).alias("targets"))


def linear(spark: SparkSession, n: int = 100, intercept: float = 1.0, slope: float = 0.5, low: float = -2.0, high: float = 3.0, sigma: float = 0.2, seed: int = 0) -> DataFrame:
    x = low + (high - low) * F.col("id") / max(n - 1, 1)
    return spark.range(n).select(F.col("id").alias("sample_id"), F.array(x).alias("features"), (intercept + slope * x + sigma * F.randn(seed)).alias("targets"))


def plane_points(spark: SparkSession, per_fx: int, functions: list, centre: tuple[float, float] = (0.0, 0.0), noise: float = 1.0, seed: int = 0) -> DataFrame:
    """Samples about given curves in the plane; the curve's number is the target."""
    base = spark.range(per_fx * len(functions)).select(F.col("id").alias("sample_id"), F.floor(F.col("id") / per_fx).cast("int").alias("targets"), F.randn(seed).alias("x"), (noise * F.randn(seed + 1)).alias("e"))
    y = F.lit(0.0)
    for i, f in enumerate(functions):
        y = F.when(F.col("targets") == i, f(F.col("x"))).otherwise(y)
    return base.select("sample_id", "targets", F.array(F.col("x") + centre[0], y + F.col("e") + centre[1]).alias("features"))


def autocorrelated_noise(x: np.ndarray, rate: float, cutoff: float, low: float = 3.0, high: float | None = None, seed: int = 0) -> np.ndarray:
    """A series with slow noise (cut in the frequency domain) and fast noise added."""
    rng = np.random.default_rng(seed)
    n = len(x)
    f = np.fft.rfft(rng.normal(size=n))
    f[np.fft.rfftfreq(n, 1 / rate) > cutoff] = 0
    slow = np.fft.irfft(f, n)
    return x + low * slow / (slow.std() or 1) + (high or 0.0) * rng.normal(size=n)


def random_rotation(n: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    q = q * np.sign(np.diag(r))
    if np.linalg.det(q) < 0:
        q[:, 0] *= -1
    return q


def random_affine(df: DataFrame, n: int, scale: float = 100.0, shift: float = 10.0, seed: int = 0) -> DataFrame:
    """A dataset rotated, scaled and shifted at random."""
    from sampleloom.operators.mappers import project

    rng = np.random.default_rng(seed)
    m = random_rotation(n, seed) * float(rng.uniform(0.1, scale))
    moved = project(df, m)
    s = [float(v) for v in rng.uniform(-shift, shift, n)]
    return moved.withColumn("features", F.zip_with("features", F.array(*map(F.lit, s)), lambda x, o: x + o))


def least_squares(fx, params: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Parameters of ``fx(params, x)`` by damped Gauss-Newton steps with numeric derivatives."""
    p, damp = np.asarray(params, float), 1e-3
    r = y - fx(p, x)
    for _ in range(rounds):
        j = np.column_stack([(fx(p + h, x) - fx(p - h, x)) / (2 * np.abs(h).max()) for h in np.diag(1e-6 * np.maximum(1, np.abs(p)))])
        step = np.linalg.solve(j.T @ j + damp * np.diag(np.diag(j.T @ j) + 1e-12), j.T @ r)
        new = y - fx(p + step, x)
        if new @ new < r @ r:
            done = np.abs(step).max() < 1e-10
            p, r, damp = p + step, new, damp / 3
            if done:
                break
        else:
            damp *= 5
    return p


def linear_noise(spark: SparkSession, n: int = 10, intercept: float = 0.0, slope: float | list[float] = 0.4, sigma: float = 0.01, flat: bool = False, seed: int = 0) -> DataFrame:
    """A linear function of one or more inputs in [0, 1] with normal noise; ``flat`` spaces one input evenly."""
    slopes = [slope] if isinstance(slope, int | float) else list(slope)
    x = [F.col("id") / max(n - 1, 1)] if flat and len(slopes) == 1 else [F.rand(seed + i) for i in range(len(slopes))]
    base = spark.range(n).select(F.col("id").alias("sample_id"), F.array(*x).alias("features"))
    y = F.lit(intercept) + F.randn(seed + 99) * sigma
    for i, s in enumerate(slopes):
        y = y + s * F.col("features")[i]
    return base.withColumn("targets", y)


def local_random_affine(df: DataFrame, near: DataFrame, n: int, scale: float = 1.0, shift: float = 1.0, seed: int = 0) -> DataFrame:
    """Each neighbourhood's features rotated, scaled and shifted at random and the overlapping results averaged.

    ``near`` (center_id, feature_id) is of the size of the feature axis; the
    transforms add up to one matrix that all samples go through.
    """
    from sampleloom.operators.mappers import project

    rows = near.groupBy("center_id").agg(F.array_sort(F.collect_list("feature_id")).alias("ids")).orderBy("center_id").collect()
    total, offset, hits = np.zeros((n, n)), np.zeros(n), np.zeros(n)
    for r in rows:
        ids, rng = list(r["ids"]), np.random.default_rng([seed, int(r["center_id"])])
        m = random_rotation(len(ids), int(rng.integers(1 << 31))) * float(rng.uniform(0.5, 1.0) * scale)
        total[np.ix_(ids, ids)] += m
        offset[ids] += rng.uniform(-shift, shift, len(ids))
        hits[ids] += 1
    hits = np.maximum(hits, 1)
    moved = project(df, total / hits[None])
    return moved.withColumn("features", F.zip_with("features", F.array(*(F.lit(float(v)) for v in offset / hits)), lambda x, o: x + o))


def response_dataset(spark: SparkSession, events: DataFrame, by: list[str], tr: float = 2.0, length: float = 100.0, base: float = 800.0, signal: float = 1.0, noise: float = 1.0, seed: int = 0) -> DataFrame:
    """(by, time_coords, value, noise): a series of responses to events (onset, duration, condition) on a baseline, and noise alone beside it."""
    from sampleloom.operators.ordered import hrf_design

    steps = int(round(length / tr))
    times = events.select(*by).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("time_coords", F.col("_i") * float(tr))
    x = hrf_design(times, events, by, "time_coords", "condition").groupBy(*by, "time_coords").agg(F.sum("x").alias("_x"))
    random = lambda k: (F.pmod(F.xxhash64(*by, "_i", F.lit(seed + k)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    normal = F.sqrt(-2 * F.log(random(0))) * F.cos(2 * float(np.pi) * random(1))
    j = times.join(x, [*by, "time_coords"], "left").na.fill(0.0, ["_x"])
    return j.select(*by, "time_coords", (base + signal * F.col("_x") + noise * normal).alias("value"), (base + noise * normal).alias("noise"))
