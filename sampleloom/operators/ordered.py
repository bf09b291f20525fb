"""Order-aware operators: normalisation by group, detrending, runs, events, windows and as-of lookups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sampleloom.operators.select import marked_changes, ranked
from sampleloom.session import materialised


# --- normalisation ---------------------------------------------------------
def zscore(df: DataFrame, columns: list[str], chunk: str | None = None, baseline: Column | None = None) -> DataFrame:
    """Each column less its mean, over its population deviation, by chunk or overall.

    ``baseline`` restricts what the mean and deviation are taken from. Where
    the deviation is 0 the value is demeaned only. The statistics are one
    aggregate joined back, so that a chunk of any size is never one task's.
    """
    pick = (lambda c: F.when(baseline, F.col(c))) if baseline is not None else F.col
    stats = [f(pick(c)).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    if chunk is None:
        one = df.agg(F.struct(*stats)).scalar()
        joined = df.withColumn("_one", one).select("*", "_one.*").drop("_one")
    else:
        by = df.groupBy(F.col(chunk).alias("_chunk")).agg(*stats)
        joined = df.join(by, F.col(chunk).eqNullSafe(F.col("_chunk"))).drop("_chunk")
    done = joined
    for i, c in enumerate(columns):
        m, s = F.col(f"_m{i}"), F.col(f"_s{i}")
        done = done.withColumn(c, F.when(s != 0, (F.col(c) - m) / s).otherwise(F.col(c) - m))
    return done.drop(*(f"_{n}{i}" for i in range(len(columns)) for n in "ms"))


def zscore_long(long: DataFrame, chunk: str | None = None) -> DataFrame:
    """The same for (sample_id, feature_id, value)."""
    by = ["feature_id"] + ([chunk] if chunk else [])
    stats = long.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    centred = F.col("value") - F.col("_m")
    return long.join(stats, by).withColumn("value", F.when(F.col("_s") != 0, centred / F.col("_s")).otherwise(centred)).drop("_m", "_s")


def detrend_linear(df: DataFrame, value: str, position: str, by: list[str]) -> DataFrame:
    """Residual of a straight line over ``position`` within each group, from sums: no group is gathered."""
    x, y = F.col(position).cast("double"), F.col(value)
    base = df.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"))
    fit = F.col("_my") + F.coalesce(F.try_divide("_c", "_v"), F.lit(0.0)) * (x - F.col("_mx"))
    return df.join(base, by).withColumn(value, y - fit).drop("_mx", "_my", "_c", "_v")


def legendre(n: int, order: int) -> np.ndarray:
    """Legendre polynomials of degree 0 to ``order`` at ``n`` places scaled to [-1, 1]."""
    return np.polynomial.legendre.legvander(np.linspace(-1, 1, n), order)


def legendre_columns(x: Column, order: int) -> list[Column]:
    """The same at a coordinate in [-1, 1], as expressions."""
    out = [F.lit(1.0), x]
    for k in range(1, order):
        out.append(((2 * k + 1) * x * out[k] - k * out[k - 1]) / (k + 1))
    return out[: order + 1]


def detrend(df: DataFrame, columns: list[str], order_by: str, by: list[str], order: int = 1, regressors: list[str] | None = None) -> DataFrame:
    """Residuals of polynomials of any degree and further regressors, fitted in each group.

    The coordinate is the place in the group, scaled to [-1, 1]. Sums of products
    of the basis are one aggregate; a group's coefficients are solved from them
    and joined back, so that a group of any size is shared among tasks.
    """
    at = ranked(df, by, [order_by], "_i", "_n").drop("_part")
    x = F.coalesce(F.try_divide(2 * F.col("_i"), F.col("_n") - 1) - 1, F.lit(0.0))
    # a fixed reference to the coordinate keeps the expressions small
    at = at.withColumn("_x", x)
    basis = [*legendre_columns(F.col("_x"), order), *(F.col(c).cast("double") for c in regressors or [])]
    k = len(basis)
    sums = [F.sum(basis[i] * basis[j]) for i in range(k) for j in range(i, k)]
    sums += [F.sum(b * F.col(c)) for c in columns for b in basis]
    types = dict(df.dtypes)

    def solve(batches):
        for pdf in batches:
            rows = []
            for s in pdf["s"]:
                g = np.zeros((k, k))
                g[np.triu_indices(k)] = s[: k * (k + 1) // 2]
                g = g + np.triu(g, 1).T
                rows.append((np.linalg.pinv(g) @ np.asarray(s[k * (k + 1) // 2 :]).reshape(len(columns), k).T).T.ravel().tolist())
            yield pdf[by].assign(_w=rows)

    fit = at.groupBy(*by).agg(F.array(*sums).alias("s")).mapInPandas(solve, ", ".join([*(f"{c} {types[c]}" for c in by), "_w array<double>"]))
    j = at.join(fit, by)
    for n, c in enumerate(columns):
        j = j.withColumn(c, F.col(c) - sum((F.col("_w")[n * k + i] * b for i, b in enumerate(basis[1:], 1)), F.col("_w")[n * k] * basis[0]))
    return j.select(*df.columns)


# --- signal filters --------------------------------------------------------
def per_series(df: DataFrame, by: list[str], order_by: str, value: str, fx: Callable[[np.ndarray], np.ndarray], out: str = "pos int, value double") -> DataFrame:
    """``fx`` over each series in order; a series is one channel of one chunk and bounded by its recording."""
    types = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in by)
    names = [c.split()[0] for c in out.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.asarray(fx(pdf.sort_values(order_by)[value].to_numpy(float)), float)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(y) for c in by}, names[0]: np.arange(len(y)), names[1]: y})

    return df.select(*by, order_by, value).groupBy(*by).applyInPandas(run, f"{types}, {out}" if by else out)


def fft_resample(x: np.ndarray, num: int, window: np.ndarray | None = None) -> np.ndarray:
    """Series resampled to ``num`` points in the frequency domain."""
    n = len(x)
    f = np.fft.rfft(x)
    if window is not None:
        f = f * window[: len(f)]
    out = np.zeros(num // 2 + 1, complex)
    k = min(len(f), len(out))
    out[:k] = f[:k]
    m = min(n, num)
    if m % 2 == 0 and num != n:
        out[m // 2] *= 2 if num < n else 0.5
        if num < n:
            out[m // 2] = out[m // 2].real
    return np.fft.irfft(out, num) * (num / n)


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct-form filter with initial state."""
    b, a = b / a[0], a / a[0]
    y, z = np.empty(len(x)), state.astype(float).copy()
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * y[i]
        z[-1] = b[-1] * v - a[-1] * y[i]
    return y


def filtfilt(b, a, x: np.ndarray) -> np.ndarray:
    """Zero-phase filter: forward and backward, with odd extension and settled initial state."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    n = max(len(a), len(b), 2)
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    companion = np.zeros((n - 1, n - 1))
    companion[:, 0] = -a[1:] / a[0]
    companion[:-1, 1:] = np.eye(n - 2)
    zi = np.linalg.solve(np.eye(n - 1) - companion, (b[1:] - a[1:] * b[0] / a[0]) / a[0])
    pad = min(3 * n, len(x) - 1)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    y = lfilter(b, a, ext, zi * ext[0])
    y = lfilter(b, a, y[::-1], zi * y[-1])[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def zero_phase_fir(df: DataFrame, by: list[str], order_by: str, value: str, taps: list[float], block: int = 65_536) -> DataFrame:
    """(by, pos, value): each series through ``taps`` forward and backward, ends continued oddly; what :func:`filtfilt` gives for them.

    The two passes are one symmetric kernel. Series are cut by place into blocks
    that see the kernel's reach on either side, so one of any length is shared
    among tasks. Series no longer than the kernel are left as they are.
    """
    kernel = np.convolve(taps, taps[::-1])
    h = len(kernel) // 2
    at = ranked(df.select(*by, order_by, F.col(value).cast("double").alias("value")), by, [order_by], "pos", "_n").drop("_part", order_by)
    ends = at.where((F.col("pos") == 0) | (F.col("pos") == F.col("_n") - 1)).groupBy(*by).agg(F.min_by("value", "pos").alias("_0"), F.max_by("value", "pos").alias("_1"))
    last = F.col("_n") - 1
    edge = at.where((F.col("pos") <= h) | (F.col("pos") >= last - h)).join(ends, by)
    before = edge.where((F.col("pos") > 0) & (F.col("pos") <= h)).select(*by, (2 * F.col("_0") - F.col("value")).alias("value"), (-F.col("pos")).alias("pos"), "_n")
    after = edge.where((F.col("pos") < last) & (F.col("pos") >= last - h)).select(*by, (2 * F.col("_1") - F.col("value")).alias("value"), (2 * last - F.col("pos")).alias("pos"), "_n")
    every = at.select(*by, "value", "pos", "_n").unionByName(before).unionByName(after)
    cell = lambda c: F.floor(c / block)
    spread = every.withColumn("_b", F.explode(F.array_distinct(F.array(cell(F.col("pos") - h), cell(F.col("pos")), cell(F.col("pos") + h)))))
    w = W.partitionBy(*by, "_b").orderBy("pos")
    total = sum((F.lit(float(c)) * (F.lag("value", h - i).over(w) if i < h else F.lead("value", i - h).over(w)) for i, c in enumerate(kernel) if i != h), F.lit(float(kernel[h])) * F.col("value"))
    out = spread.withColumn("_y", F.when(F.col("_n") > 2 * h, total).otherwise(F.col("value")))
    return out.where((F.col("pos") >= 0) & (F.col("pos") <= last) & (cell(F.col("pos")) == F.col("_b"))).select(*by, F.col("pos").cast("int").alias("pos"), F.col("_y").alias("value"))


#: Scaling filters of the wavelets of Haar and Daubechies with two and three vanishing moments.
SCALING = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "db2": [0.48296291314469025, 0.836516303737469, 0.22414386804185735, -0.12940952255092145],
    "db3": [0.332670552950082616, 0.806891509311092576, 0.45987750211849157, -0.135011020010254589, -0.0854412738820266617, 0.0352262918857095366],
}


def dwt_step(x: np.ndarray, wavelet: str) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail of one level, the series continued periodically (an odd one by its last value)."""
    low = np.array(SCALING[wavelet])
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    x = np.append(x, x[-1]) if len(x) % 2 else np.asarray(x, float)
    at = (2 * np.arange(len(x) // 2)[:, None] + np.arange(len(low))[None]) % len(x)
    return x[at] @ low, x[at] @ high


def idwt_step(approx: np.ndarray, detail: np.ndarray, wavelet: str) -> np.ndarray:
    """The series that one level was made from."""
    low = np.array(SCALING[wavelet])
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    n = 2 * len(approx)
    at = (2 * np.arange(len(approx))[:, None] + np.arange(len(low))[None]) % n
    out = np.zeros(n)
    np.add.at(out, at, approx[:, None] * low[None] + detail[:, None] * high[None])
    return out


def wavelet_transform(x: np.ndarray, wavelet: str = "db2", levels: int = 1) -> list[np.ndarray]:
    """The coarsest approximation, then details from coarse to fine."""
    out: list[np.ndarray] = []
    for _ in range(levels):
        x, d = dwt_step(x, wavelet)
        out.insert(0, d)
    return [x, *out]


def wavelet_inverse(parts: list[np.ndarray], wavelet: str = "db2") -> np.ndarray:
    x = parts[0]
    for d in parts[1:]:
        x = idwt_step(x, d, wavelet)
    return x


def wavelet_packet(x: np.ndarray, wavelet: str = "db2", level: int = 1) -> np.ndarray:
    """Coefficients of all nodes of one level of the full tree, in order."""
    nodes = [np.asarray(x, float)]
    for _ in range(level):
        nodes = [part for n in nodes for part in dwt_step(n, wavelet)]
    return np.concatenate(nodes)


def haar_dwt(x: np.ndarray, levels: int | None = None) -> list[np.ndarray]:
    """Multi-level Haar transform: the coarsest approximation, then details from coarse to fine."""
    out, top = [], int(np.log2(len(x))) if len(x) > 1 else 0
    for _ in range(min(levels or top, top)):
        if len(x) % 2:
            x = np.append(x, x[-1])
        out.insert(0, (x[::2] - x[1::2]) / np.sqrt(2))
        x = (x[::2] + x[1::2]) / np.sqrt(2)
    return [x, *out]


def haar_packet(x: np.ndarray, level: int) -> np.ndarray:
    """Wavelet packet coefficients of one level, all nodes in order."""
    nodes = [np.asarray(x, float)]
    for _ in range(level):
        nodes = [part for n in nodes for n in [np.append(n, n[-1]) if len(n) % 2 else n] for part in ((n[::2] + n[1::2]) / np.sqrt(2), (n[::2] - n[1::2]) / np.sqrt(2))]
    return np.concatenate(nodes)


# --- runs and chunks -------------------------------------------------------
def find_events(df: DataFrame, attrs: list[str], order: list[str], by: list[str]) -> DataFrame:
    """Runs of equal attribute values as events: run (``run_no`` if that name is taken), onset (place from 0), duration, and the values."""
    name = "run_no" if "run" in (*by, *attrs) else "run"
    runs = marked_changes(df, attrs, order, by)
    return runs.groupBy(*by, F.col("_run").alias(name), *attrs).agg(F.min("_pos").alias("onset"), F.count("*").alias("duration"))


def break_points(df: DataFrame, attr: str, order: list[str], by: list[str], contiguous: bool = False) -> DataFrame:
    """Places where an attribute changes; ``contiguous`` raises if a value comes again."""
    events = find_events(df, [attr], order, by)
    if contiguous and events.groupBy(*by, attr).count().where("count > 1").limit(1).count():
        raise ValueError(f"{attr} is not contiguous")
    return events.select(*by, "onset", attr)


def labels_to_chunks(labels: list, ignore: set | None = None) -> list[int]:
    """Chunk number of each place: a new chunk begins with the first change of label after all labels were seen.

    An incomplete last chunk joins the one before.
    """
    wanted = set(labels) - (ignore or set())
    seen, chunk, out, last = set(), 0, [], object()
    for x in labels:
        if x != last and wanted and seen == wanted:
            chunk, seen = chunk + 1, set()
        last = x
        seen |= {x} & wanted
        out.append(chunk)
    return [min(c, max(chunk - 1, 0)) for c in out] if seen != wanted else out


def label_chunks(df: DataFrame, label: str, order: list[str], by: list[str], ignore: set | None = None) -> DataFrame:
    """``chunk`` by :func:`labels_to_chunks`, within each sequence (a sequential rule: one task a sequence)."""
    schema = df.schema.add("chunk", IntegerType())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(chunk=np.array(labels_to_chunks(list(pdf[label]), ignore), np.int32))

    return df.groupBy(*by).applyInPandas(run, schema)


def coarse_groups(counts: list[tuple], groups: int) -> dict:
    """Sorted chunks merged into at most ``groups``: one ends once the count so far reaches its share."""
    total = sum(n for _, n in counts)
    share, so_far, g, out = total / groups, 0, 0, {}
    for c, n in sorted(counts):
        out[c] = g
        so_far += n
        if so_far >= (g + 1) * share and g < groups - 1:
            g += 1
    return out


def coarsen_chunks(df: DataFrame, chunk: str, groups: int = 4) -> DataFrame:
    """With ``coarse``: the group of each sample's chunk."""
    # distinct chunks with counts: the size of the chunk axis
    counts = [(r[0], r[1]) for r in df.groupBy(chunk).count().collect()]
    if len(counts) < groups:
        raise ValueError("fewer chunks than groups")
    table = df.sparkSession.createDataFrame(list(coarse_groups(counts, groups).items()), df.select(chunk).schema.add("coarse", IntegerType()))
    return df.join(F.broadcast(table), chunk)


def rank_order(df: DataFrame, by: list[str], value: str, tie: str, reverse: bool = False, name: str = "rank") -> DataFrame:
    """Rank from 0 within each group: highest first (later of equals first), or lowest first; shared among tasks."""
    order = [F.col(value).asc(), F.col(tie).asc()] if reverse else [F.col(value).desc(), F.col(tie).desc()]
    return ranked(df, by, order, name).drop("_part")


def is_sorted(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_ok", F.coalesce(F.lag(value).over(w) <= F.col(value), F.lit(True))).groupBy(*by).agg(F.bool_and("_ok").alias("is_sorted"))


# --- events ----------------------------------------------------------------
def discrete_events(df: DataFrame, dt: float, offset: str | None = None) -> DataFrame:
    """Onset and duration in whole steps of ``dt``, with the onset's remainder if asked for."""
    on = F.floor(F.col("onset") / dt)
    end = F.ceil((F.col("onset") + F.col("duration")) / dt)
    out = df.withColumn("_on", on).withColumn("_dur", end - on)
    if offset:
        out = out.withColumn(offset, F.col("onset") - F.col("_on") * dt)
    return out.drop("onset", "duration").withColumnRenamed("_on", "onset").withColumnRenamed("_dur", "duration")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str, how: str = "prev", slot: float | None = None) -> DataFrame:
    """``value`` of the right row nearest in time: last at or before (prev), first at or after (next) or closest.

    A union sorted by time and running first/last values, so no pair of rows is
    formed. NULL where there is no candidate. With ``slot`` the sequences are
    cut into slots of that length: each slot is scanned by itself and takes the
    last (first) value of the slots before (after) it from a summary of one row
    a slot, so that one long sequence is shared among tasks.
    """
    t, key = F.col("_t"), [*by]
    both = left.select(*left.columns, F.col(left_time).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[right_time].dataType).alias("_rt"), F.lit(1).alias("_side")).unionByName(
        right.select(*by, F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.col(right_time).alias("_rt"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    if slot:
        both = both.withColumn("_slot", F.floor(t / slot))
        key = [*by, "_slot"]
    hit = F.when(F.col("_side") == 0, F.struct(F.col("_rt").alias("t"), F.col("_v").alias("v")))
    back = W.partitionBy(*key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*key).orderBy(t.desc(), F.col("_side")).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_p", F.last(hit, ignorenulls=True).over(back)).withColumn("_n", F.last(hit, ignorenulls=True).over(ahead))
    if slot:
        ends = both.where("_side = 0").groupBy(*key).agg(F.max_by(F.struct(F.col("_rt").alias("t"), F.col("_v").alias("v")), "_t").alias("_last"), F.min_by(F.struct(F.col("_rt").alias("t"), F.col("_v").alias("v")), "_t").alias("_first"))
        slots = both.select(*key).distinct().join(ends, key, "left")
        w = W.partitionBy(*by).orderBy("_slot")
        slots = slots.withColumn("_lp", F.last("_last", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_fn", F.first("_first", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
        both = both.join(slots.select(*key, "_lp", "_fn"), key).withColumn("_p", F.coalesce("_p", "_lp")).withColumn("_n", F.coalesce("_n", "_fn"))
    p, n = F.col("_p"), F.col("_n")
    closer = F.when(p.isNull(), n).when(n.isNull(), p).when(t - p["t"] <= n["t"] - t, p).otherwise(n)
    got = {"prev": p, "next": n, "closest": closer}[how]
    return both.where("_side = 1").select(*left.columns, got["v"].alias(value), got["t"].alias(f"matched_{right_time}"))


#: Slots that an interval may touch before it is put on the next level of wider ones.
SPREAD = 16


def covering(points: DataFrame, spans: DataFrame, by: list[str], time: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of a point and a span of the same ``by`` with start <= time < end.

    An equality join with a residual: spans touch slots of ``width``, those that
    would touch more than ``SPREAD`` slots of wider ones, level by level, so that
    a span of any length gives a bounded number of rows; a point looks on each
    level that is in use.
    """
    ratio = (F.col(end) - F.col(start)) / width
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(ratio, F.lit(1.0))) / float(np.log(SPREAD))).cast("int") - 1)
    size = F.lit(float(width)) * F.pow(F.lit(float(SPREAD)), F.col("_level"))
    spans = materialised(spans.where(F.col(end) > F.col(start)).withColumn("_level", level))
    # levels are few: the logarithm of the longest span
    used = sorted(r[0] for r in spans.select("_level").distinct().collect())
    slots = spans.withColumn("_slot", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    at = points.withColumn("_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("_slot", F.floor(F.col(time) / size))
    return at.join(slots, [*by, "_level", "_slot"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_level", "_slot")


def label_samples(samples: DataFrame, events: DataFrame, by: list[str], time: str, condition: str, default: str | None = None, shift: float = 0.0, width: float = 60.0, key: str = "sample_id") -> DataFrame:
    """Condition of the event that covers each sample; of several, the later in order of ``event_id``.

    An event begins at the last sample at or before its onset and reaches while
    time < onset + duration; found by :func:`covering`.
    """
    begin = as_of(events.withColumn("_on", F.col("onset") + F.lit(shift)), samples, by, "_on", time, key, "prev", slot=50 * width)
    begin = begin.withColumn("_from", F.col(f"matched_{time}")).withColumn("_to", F.col("_on") + F.col("duration"))
    begin = begin.where("_from is not null and duration > 0").select(*by, "_from", "_to", "event_id", F.col(condition).alias("_c"))
    hits = covering(samples, begin, by, time, "_from", "_to", width)
    label = hits.groupBy(*by, key).agg(F.max_by("_c", "event_id").alias(condition))
    return samples.join(label, [*by, key], "left").withColumn(condition, F.coalesce(condition, F.lit(default)))


def boxcar(df: DataFrame, starts: DataFrame, length: int, by: list[str], pos: str = "pos", offset: int = 0) -> DataFrame:
    """Rows of fixed windows at given start places: (by, box, start, step) and the rows' columns.

    Every start is expanded to the places it covers, an equality join. Windows
    that leave the data give fewer rows; callers that want an error count them.
    """
    wanted = starts.select(*by, F.col("box"), F.col("start"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step"))
    wanted = wanted.withColumn(pos, F.col("start") + F.lit(offset) + F.col("step"))
    return df.join(wanted, [*by, pos])


def boxcar_mean(df: DataFrame, starts: DataFrame, length: int, by: list[str], value: str, pos: str = "pos", offset: int = 0) -> DataFrame:
    """Mean of each window."""
    return boxcar(df, starts, length, by, pos, offset).groupBy(*by, "box", "start").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def event_samples(df: DataFrame, events: DataFrame, by: list[str], pos: str, values: str, duration: int, prefix: str = "event") -> DataFrame:
    """One sample an event: the values of its window, in order of time, in one array, and the event's attributes, prefixed where names clash."""
    clash = {c: f"{prefix}_{c}" if c in df.columns else c for c in events.columns if c not in (*by, "box", "start")}
    named = events.select(*by, "box", "start", *(F.col(c).alias(n) for c, n in clash.items()))
    cells = boxcar(df, named, duration, by, pos).groupBy(*by, "box").agg(F.array_sort(F.collect_list(F.struct("step", F.col(values).alias("v")))).alias("cells"))
    flat = F.flatten(F.transform("cells", lambda c: c["v"])) if dict(df.dtypes)[values].startswith("array") else F.transform("cells", lambda c: c["v"])
    return named.join(cells, [*by, "box"]).where(F.size("cells") == duration).select(*by, "box", *clash.values(), flat.alias("features"))


# --- haemodynamic response -------------------------------------------------
#: Time to peak, width at half height and size of the response and of its undershoot.
RESPONSE, UNDERSHOOT = (5.4, 5.2, 1.0), (10.8, 7.35, 0.35)


def single_gamma(t: Column, peak: float = RESPONSE[0], width: float = RESPONSE[1], size: float = RESPONSE[2]) -> Column:
    """Gamma density scaled to ``size`` at its ``peak``, with the curvature of a Gaussian of that ``width`` there.

    A gamma density u^s e^(-s u), u = t / peak, has its maximum at u = 1 and the
    second derivative -s of its logarithm there; a Gaussian of width w at half
    height has -8 ln 2 (peak / w)^2.
    """
    shape, u = 8 * np.log(2) * (peak / width) ** 2, t / peak
    return F.when(t > 0, size * F.exp(shape * (F.log(u) + 1 - u))).otherwise(0.0)


def double_gamma(t: Column, response: tuple = RESPONSE, undershoot: tuple = UNDERSHOOT) -> Column:
    """A response less its later undershoot."""
    return single_gamma(t, *response) - single_gamma(t, *undershoot)


def dual_gaussian(x: Column, amp1=1.0, mean1=0.0, std1=1.0, amp2=1.0, mean2=0.0, std2=1.0, positive: bool = False) -> Column:
    """Sum of two Gaussians; ``positive`` takes negative amplitudes as 0."""
    g = lambda a, m, s: F.lit(max(a, 0.0) if positive else a) * F.exp(-F.pow((x - m) / s, 2) / 2)
    return g(amp1, mean1, std1) + g(amp2, mean2, std2)


def hrf_design(times: DataFrame, events: DataFrame, by: list[str], time: str, condition: str, reach: float = 30.0, step: float = 0.5) -> DataFrame:
    """Regressor of each condition at each time: the events' boxes convolved with the response, summed.

    An event gives ``duration / step`` impulses, each felt for ``reach``. Events
    are joined to the times that feel any of them; of these impulses, at most
    ``reach / step`` at one time, the responses are summed in place.
    """
    n = F.ceil(F.col("duration") / step)
    felt = events.select(*by, condition, "onset", n.alias("_n"), (F.col("onset") + (n - 1) * step + reach).alias("_end")).where("_n > 0")
    near = covering(times, felt, by, time, "onset", "_end", reach)
    since = F.col(time) - F.col("onset")
    first = F.greatest(F.lit(0).cast("long"), F.floor((since - reach) / step) + 1)
    last = F.least(F.col("_n") - 1, F.floor(since / step))
    pulses = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    height = F.aggregate(pulses, F.lit(0.0), lambda total, i: total + double_gamma(since - i * step))
    return near.groupBy(*by, time, condition).agg((F.sum(height) * step).alias("x"))
