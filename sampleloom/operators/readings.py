"""Implausible readings of measuring channels, judged by what each channel normally shows.

Per source a robust seasonal-trend decomposition (running medians, a period
found by autocorrelation, medians by phase) leaves a residual. The generalised
extreme studentised deviate test, studentised by a robust scatter, tells which
residuals are outliers, up to half of them; its unit is chosen so that its limit
is a given number of usual scatters for 100 readings, and it grows with their
number as the test's limits do. The scatter is taken again from what the test
keeps, so that many spikes don't hide others. Runs of equal
readings and readings beyond the physical range are checked separately. Long
sources are shared among tasks in blocks; what a source normally shows is then
put together from summaries of all its blocks before any block is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sampleloom.functions.distributions import t_isf
from sampleloom.session import materialised

#: MAD of a normal distribution with scatter 1, inverted.
MAD = 1.4826
#: Readings of one source that are judged together, and those seen on either side of them.
BLOCK, HALO = 16_384, 256
#: Share of spikes from which on the level is taken again without them, and how often at most.
DENSE, PASSES = 0.05, 3
#: Level of the ESD test: small, so that its limit grows slowly with the number of readings (8 scatters at 100, about 11 at a million).
ALPHA = 1e-9
#: Distinct values up to which a block's values are counted one by one, and the groups of equal size that sum up more.
DISTINCT, GROUPS = 1024, 256


class Usual(NamedTuple):
    """What a source that is judged in blocks normally shows: whether it varies outside long runs, its period, scatter and least size of a spike, whether it holds levels and their middle; the period of the block at hand."""

    varies: bool
    period: int
    scale: float
    least: float
    held: bool
    middle: float
    near: int


def running_median(x: np.ndarray, width: int) -> np.ndarray:
    """Centred running median; at the ends, of the part of the window that is there; NaN counts as missing."""
    n, half = len(x), min(width, len(x)) // 2
    if n <= 2 * half or np.isnan(x).any():
        return pd.Series(x).rolling(2 * half + 1, center=True, min_periods=1).median().to_numpy()
    out = np.empty(n)
    out[half : n - half] = np.partition(sliding_window_view(x, 2 * half + 1), half, axis=1)[:, half]
    if half:
        # windows that reach beyond an end: what is missing sorts last
        beyond = np.full(half, np.inf)
        ends = np.vstack([sliding_window_view(np.append(beyond, x[: 2 * half]), 2 * half + 1), sliding_window_view(np.append(x[n - 2 * half :], beyond), 2 * half + 1)])
        there = np.append(np.arange(half + 1, 2 * half + 1), np.arange(2 * half, half, -1))
        medians = middle(ends, there)
        out[:half], out[n - half :] = medians[:half], medians[half:]
    return out


def middle(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the ``n`` smallest values of each row."""
    rows, at = np.sort(rows, axis=1), np.arange(len(rows))
    return (rows[at, (n - 1) // 2] + rows[at, n // 2]) / 2


def scatter(res: np.ndarray) -> float:
    """Robust standard deviation of residuals; 0 if most of them are 0."""
    return MAD * float(np.median(np.abs(res - np.median(res)))) if len(res) else 0.0


def period(x: np.ndarray, least: float = 0.3) -> int:
    """The dominating period of ``x``, 0 if none recurs about three times or more."""
    n = len(x)
    if n < 24:
        return 0
    # clipped low: what recurs is still seen, single spikes hardly count
    s = 6 * scatter(x)
    y = np.clip(x, -s, s) if s else x
    y = y - y.mean()
    f = np.fft.rfft(y, 1 << (2 * n - 1).bit_length())
    acf = np.fft.irfft(f * np.conj(f))[: n // 3 + 1]
    if acf[0] <= 0:
        return 0
    acf = acf / acf[0] * n / (n - np.arange(len(acf)))
    peak = np.flatnonzero((acf[1:-1] >= acf[:-2]) & (acf[1:-1] > acf[2:])) + 1
    peak = peak[peak >= 5]
    if not len(peak) or acf[peak].max() < least:
        return 0
    # the shortest lag that is about as good as the best: multiples of a period are peaks as well
    return int(peak[acf[peak] >= 0.85 * acf[peak].max()][0])


def recurring(x: np.ndarray, at: np.ndarray, p: int) -> np.ndarray:
    """The shape that recurs every ``p`` readings: the median of each phase."""
    phase = at % p
    order = np.argsort(phase, kind="stable")
    n = np.bincount(phase, minlength=p)
    rows = np.full((p, int(n.max())), np.inf)
    rows[phase[order], np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)] = x[order]
    shape, enough = np.zeros(p), n >= 3
    shape[enough] = middle(rows[enough], n[enough])
    return shape - np.median(shape)


@lru_cache(maxsize=4096)
def _limits(n: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Limits of some of the 1st to n/2-th deviation of ``n``; they are smooth in their number, so others lie between."""
    i = np.unique(np.round(np.geomspace(1, max(1, n // 2), 24)))
    left = n - i
    df = np.maximum(left - 1, 1)
    t = t_isf(alpha / (2 * (left + 1)), df)
    return i, left * t / np.sqrt((df + t * t) * (left + 1))


def gesd(size: np.ndarray, scale: float, alpha: float, counts: np.ndarray | None = None) -> float:
    """The size from which on residuals are outliers, by the generalised ESD test in its robust form.

    Deviations are studentised by ``scale``, which outliers do not inflate. The
    largest i, up to half of them, at which the i-th largest deviation exceeds
    its limit gives the number of outliers; infinity if there are none.
    ``counts`` are the numbers of residuals of each size, one if not given.
    """
    counts = np.ones(len(size)) if counts is None else np.asarray(counts, float)
    n = int(counts.sum())
    if n < 10 or scale <= 0:
        return np.inf
    order = np.argsort(-np.abs(size), kind="stable")
    top, number = np.abs(size)[order] / scale, np.cumsum(counts[order])
    use = number <= max(1, n // 2)
    # limits change little from n to n: a table by n rounded up keeps the cache small
    grid = 1 << max(4, n.bit_length() - 4)
    over = np.flatnonzero(top[use] > np.interp(number[use], *_limits(-(-n // grid) * grid, alpha)))
    return top[over[-1]] * scale * (1 - 1e-12) if len(over) else np.inf


def cleaned(size: np.ndarray, counts: np.ndarray, scale: float, limit: float, alpha: float, again) -> float:
    """The size from which on residuals are spikes: outliers by the ESD test, in units that put its limit at ``limit`` scatters for 100 readings.

    The scatter is first that of all residuals, then (``again``) that of those
    the test keeps, until it keeps as many as before.
    """
    unit, least = limit / float(_limits(100, alpha)[1][0]), np.inf
    for _ in range(PASSES):
        least = gesd(size, scale * unit, alpha, counts)
        kept = size < least
        smaller = again(kept) if kept.any() else 0
        if not 0 < smaller < scale:
            break
        scale = smaller
    return least


def runs(x: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each reading: whether it differs from the one before; whether it belongs to ``run`` or more equal ones."""
    new = np.append(True, x[1:] != x[:-1])
    length = np.diff(np.append(np.flatnonzero(new), len(x)))
    return new, np.repeat(length >= run, length)


def residuals(x: np.ndarray, at: np.ndarray, p: int | None = None, spiky: np.ndarray | None = None) -> tuple[np.ndarray, int, float]:
    """What trend and recurring shape leave of ``x``, the period used and the scatter (before shapes are met early or late).

    ``p`` is looked for if None; 0 stands for no period, -1 for a trend alone.
    Readings that are ``spiky`` say nothing about trend, shape and scatter.
    """
    fine = np.ones(len(x), bool) if spiky is None else ~spiky
    seen = np.where(fine, x, np.nan)
    rough = x - running_median(seen, 31)
    rough = np.where(np.isnan(rough), x - np.median(x[fine]), rough)
    if p is None:
        # rows of numbers with gaps above three quarters have no place in a row for most phases
        p = period(np.interp(np.arange(at[-1] + 1), at[fine], rough[fine])) if at[-1] < 4 * len(at) else 0
    if p < 0:
        return rough, p, scatter(rough[fine])
    shape = recurring(rough[fine], at[fine], p) if p else np.zeros(1)
    season = shape[at % len(shape)]
    res = x - season - running_median(seen - season, 9)
    res = np.where(np.isnan(res), rough - season, res)
    s = scatter(res[fine])
    if p and scatter(rough[fine]) < s:
        return rough, -1, scatter(rough[fine])
    if p:
        # periods are rarely whole: a reading may meet the shape one place early or late
        for late in (-1, 1):
            other = res - (shape[(at + late) % p] - season)
            res = np.where(np.abs(other) < np.abs(res), other, res)
    return res, p, s


def judge(number: np.ndarray, data: np.ndarray, limit: float = 8.0, run: int = 10, most: float = 9e7, alpha: float = ALPHA, usual: Usual | None = None) -> np.ndarray:
    """Flags of one source's readings, in order of ``number``: 1 spike, 2 stuck, 4 out of range, added up.

    With ``usual`` the readings are a part of the source and judged by what the whole of it shows.
    """
    flags = np.zeros(len(data), np.int32)
    with np.errstate(invalid="ignore"):
        wild = np.abs(data) > most
    flags[wild] |= 4
    there = np.flatnonzero(~np.isnan(data))
    x = data[there]
    if len(x) >= run:
        new, long = runs(x, run)
        short = ~long[1:] | new[1:]
        # a channel that holds its levels anyway has no stuck runs
        if usual.varies if usual else short.any() and (~new[1:][short]).mean() < 0.5 and long.mean() < 0.9:
            flags[there[long]] |= 2
    fine = np.flatnonzero(~np.isnan(data) & ~wild & (flags == 0))
    if len(fine) < (1 if usual else 10):
        return flags
    x, at = data[fine], number[fine] - number[fine[0]]
    if usual:
        held = usual.held
        if held:
            res, s = x - usual.middle, usual.scale
        else:
            # shapes change slowly: the block's own period or the source's, whichever leaves less
            res, p, s = min((residuals(x, at, p) for p in {usual.near, usual.period}), key=lambda r: r[2])
    else:
        res, p, s = residuals(x, at)
        held = (x[1:] == x[:-1]).mean() > 0.5
        if s <= 0 or held:
            # held levels: what the channel normally shows is the spread of its levels
            res = x - np.median(x)
            s = max(scatter(x), float(np.mean(np.abs(res))), 1e-300)

    def outliers(res: np.ndarray, s: float) -> np.ndarray:
        size = np.abs(res)
        if usual:
            return size >= usual.least
        whole = scatter(res)
        return size >= cleaned(size, np.ones(len(size)), s, limit, alpha, lambda kept: 0 if held or not whole else s * scatter(res[kept]) / whole)

    spike = outliers(res, s)
    if not held and spike.mean() > DENSE:
        # so many spikes reach into short medians: trend and shape are taken again without what stands out from long ones
        rough, _, s = residuals(x, at, -1)
        spike = outliers(rough, s)
        for _ in range(PASSES):
            res, _, s = residuals(x, at, p, spike)
            before, spike = spike, outliers(res, s)
            if (before == spike).all():
                break
    flags[fine[spike]] |= 1
    return flags


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and their numbers; of many distinct values the means of ``GROUPS`` groups in order of size."""
    values, n = np.unique(x, return_counts=True)
    if len(values) <= DISTINCT:
        return values, n
    at = np.arange(GROUPS) * len(x) // GROUPS
    n = np.diff(np.append(at, len(x)))
    return np.add.reduceat(np.sort(x), at) / n, n


def counted_sizes(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes by their first bits, as means of values within 1.6 % of each other, and their numbers; equal sizes stay exact."""
    size = np.sort(size)
    _, at, n = np.unique(size.view(np.int64) >> 46, return_index=True, return_counts=True)
    low, high = size[at], size[at + n - 1]
    return np.where(low == high, low, np.add.reduceat(size, at) / n if len(at) else low), n


def summary(number: np.ndarray, x: np.ndarray, own: np.ndarray, run: int, most: float) -> list[dict]:
    """Sums of a block over its ``own`` readings, with those in long runs (``free`` false) and without."""
    new, long = runs(x, run)
    pair = own & (~long | new)
    pair[0] = False  # the block's first reading has none before it, or is not its own
    base = {"n": own.sum(), "n_long": (own & long).sum(), "pairs": pair.sum(), "same": (pair & ~new).sum()}
    out = []
    for free in (False, True):
        if free and not long.any():
            out.append(out[0] | {"free": True})
            continue
        fine = np.flatnonzero((np.abs(x) <= most) & ~(long & free))
        part = {"m": 0, "m_pairs": 0, "m_same": 0, "p": 0, "early": 0.0, "res": [], "res_n": [], "x": [], "x_n": []}
        if len(fine) >= 10:
            y, mine = x[fine], own[fine]
            res, p, early = residuals(y, number[fine] - number[fine[0]])
            (size, size_n), (value, value_n) = counted_sizes(np.abs(res - np.median(res))[mine]), counted(y[mine])
            part = {"m": mine.sum(), "m_pairs": mine[1:].sum(), "m_same": ((y[1:] == y[:-1]) & mine[1:]).sum(), "p": p, "early": early, "res": size, "res_n": size_n, "x": value, "x_n": value_n}
        out.append(base | part | {"free": free})
    return out


def weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    total = np.cumsum(w[order])
    return float(x[order][np.searchsorted(total, total[-1] / 2)])


def usual_of(blocks: pd.DataFrame, limit: float = 8.0, alpha: float = ALPHA) -> list[Usual]:
    """What a source normally shows, from the summaries of all its blocks; one for each block, in order of blocks."""
    once = blocks[~blocks["free"]]
    n, pairs = int(once["n"].sum()), once["pairs"].sum()
    varies = bool(pairs > 0 and once["same"].sum() < 0.5 * pairs and once["n_long"].sum() < 0.9 * n)
    part = blocks[blocks["free"] == varies].sort_values("block")
    some = part[part["m"] > 0]
    p, s, least, held, middle = 0, 1e-300, np.inf, False, 0.0
    if len(some):
        p = int(some.groupby("p")["m"].sum().idxmax())
        joined = lambda c: np.concatenate([np.asarray(v, float) for v in some[c]])
        size, w = joined("res"), joined("res_n")
        # the scatter is that before shapes are met early or late, as in sources judged at once
        s = weighted_median(some["early"].to_numpy(float), some["m"].to_numpy(float))
        whole = weighted_median(size, w)
        held = bool(s <= 0 or some["m_same"].sum() > 0.5 * some["m_pairs"].sum())
        if held:
            x, w = joined("x"), joined("x_n")
            middle = weighted_median(x, w)
            size = np.abs(x - middle)
            s = max(MAD * weighted_median(size, w), float((size * w).sum() / w.sum()), 1e-300)
        least = cleaned(size, w, s, limit, alpha, lambda kept: 0 if held or not whole else s * weighted_median(size[kept], w[kept]) / whole)
    return [Usual(varies, p, s, least, held, middle, int(near)) for near in part["p"]]


def implausible(df: DataFrame, source: list[str], number: str, value: str, limit: float = 8.0, run: int = 10, most: float = 9e7, alpha: float = ALPHA) -> DataFrame:
    """The implausible readings (source, number, spike, stuck, out_of_range) of ``df``.

    Sources of more than ``BLOCK`` readings are cut by rank into blocks of about
    the same size, every block seen with ``HALO`` readings on either side, so
    that a source of any size is judged by many tasks and a run across a cut is
    still whole. Whether the source varies, its scatter and its period come from
    summaries of all its blocks. ``limit`` is the
    multiple of the source's usual scatter at which the ESD test at ``alpha`` has
    its limit for 100 readings, ``run`` the length of a stuck stretch, ``most`` the
    size that no sensor gives.

    Cases: NULL and NaN readings are missing and never flagged; rows without a
    source or number are left out; of repeated rows one counts; infinite
    readings are out of range; sources with fewer than ten readings are only
    checked for range; a constant source is not flagged; empty tables give an
    empty result; further columns are ignored.
    """
    names = [f"k{i}" for i in range(len(source))]
    plain = df.select(*(F.col(c).alias(n) for c, n in zip(source, names, strict=True)), F.col(number).cast("long").alias("n"), F.col(value).cast("double").alias("x")).dropna(subset=[*names, "n"])
    plain = plain.where("x is not null and not isnan(x)").withColumn("part", F.floor(F.col("n") / BLOCK))
    once = materialised(plain.groupBy(*names, "part", "n").agg(F.min("x").alias("x")))
    count = once.groupBy(*names, "part").agg(F.count("*").alias("c"))
    before, every = W.partitionBy(*names).orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*names)
    # written, so that its size is known when the joins are planned
    count = materialised(count.select(*names, "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(every).alias("all")))
    known = once.join(count, [*names, "part"])
    single = known.where(F.col("all") <= BLOCK).select(*names, F.lit(0).cast("long").alias("block"), "n", "x", F.lit(True).alias("own"))
    # only sources of several blocks need ranks: those within a stretch of numbers, and the count before it
    halo = max(HALO, run)
    cuts = F.ceil(F.col("all") / BLOCK)
    block = lambda r: F.floor(r * F.col("cuts") / F.col("all"))
    rank = F.row_number().over(W.partitionBy(*names, "part").orderBy("n")) - 1 + F.col("before")
    ranked = known.where(F.col("all") > BLOCK).select(*names, "n", "x", "all", cuts.alias("cuts"), rank.alias("rank")).withColumn("own", block(F.col("rank")))
    first, last = block(F.greatest(F.col("rank") - halo, F.lit(0))), block(F.least(F.col("rank") + halo, F.col("all") - 1))
    several = materialised(ranked.withColumn("block", F.explode(F.sequence(first, last))).select(*names, "block", "n", "x", (F.col("own") == F.col("block")).alias("own")))
    types = ", ".join(f"{n} {t}" for n, t in plain.dtypes if n in names)

    def ordered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("n")
        return pdf["n"].to_numpy(np.int64), pdf["x"].to_numpy(float), pdf["own"].to_numpy(bool)

    def keyed(pdf: pd.DataFrame, rows: int) -> pd.DataFrame:
        return pdf[names].iloc[np.zeros(rows, int)].reset_index(drop=True)

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(summary(*ordered(pdf), run, most))
        return keyed(pdf, len(out)).assign(block=pdf["block"].iloc[0], **{c: out[c] for c in out})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        known = [[float(v) for v in u] for u in usual_of(pdf, limit, alpha)]
        return keyed(pdf, len(known)).assign(block=np.sort(pdf["block"].unique()), usual=known)

    def run_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = pdf["usual"].notna()
            rows, numbers, found = [], [], []
            for i, (n, x, own, v, known) in enumerate(zip(pdf["n"], pdf["x"], pdf["own"], pdf["usual"], told, strict=True)):
                if n is None or not len(n):
                    continue
                order = np.argsort(n, kind="stable")
                n, x, own = n[order], x[order], own[order].astype(bool)
                usual = Usual(bool(v[0]), int(v[1]), v[2], v[3], bool(v[4]), v[5], int(v[6])) if known else None
                flags = judge(n, x, limit, run, most, alpha, usual)
                hit = own & (flags > 0)
                rows.append(np.full(hit.sum(), i))
                numbers.append(n[hit])
                found.append(flags[hit])
            if rows:
                at, flags = np.concatenate(rows), np.concatenate(found)
                yield pdf[names].iloc[at].reset_index(drop=True).assign(n=np.concatenate(numbers), spike=(flags & 1) > 0, stuck=(flags & 2) > 0, out_of_range=(flags & 4) > 0)

    sums = "n long, n_long long, pairs long, same long, m long, m_pairs long, m_same long, p long, early double, res array<double>, res_n array<long>, x array<double>, x_n array<long>, free boolean"
    usual = several.groupBy(*names, "block").applyInPandas(sum_up, f"{types}, block long, {sums}")
    usual = usual.groupBy(*names).applyInPandas(combine, f"{types}, block long, usual array<double>")
    both = single.unionByName(several).unionByName(usual, allowMissingColumns=True)
    # a block, which is of bounded size, becomes one row: row by row, moving readings to Python would cost more than judging them
    lists = [F.collect_list(c).alias(c) for c in ("n", "x", "own")]
    both = both.groupBy(*names, "block").agg(*lists, F.first("usual", ignorenulls=True).alias("usual"))
    found = both.mapInPandas(run_blocks, f"{types}, n long, spike boolean, stuck boolean, out_of_range boolean")
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, source, strict=True)), F.col("n").alias(number), "spike", "stuck", "out_of_range")
