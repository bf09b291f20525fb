import numpy as np
import pandas as pd

from sampleloom.operators.readings import ALPHA, BLOCK, _limits, cleaned, gesd, implausible, judge, period, residuals, running_median, scatter, summary, usual_of


def test_spikes_runs_and_range():
    rng = np.random.default_rng(0)
    n = np.arange(1000)
    x = 100 + 3 * np.sin(n / 80) + rng.normal(size=1000)
    x[200] += 15
    x[300:303] -= 20
    x[400:415] = x[400]
    x[500], x[501], x[600] = np.inf, -1e9, np.nan
    f = judge(n, x)
    assert set(np.flatnonzero(f & 1)) == {200, 300, 301, 302}
    assert set(np.flatnonzero(f & 2)) == set(range(400, 415))
    assert set(np.flatnonzero(f & 4)) == {500, 501}


def test_recurring_shapes_and_held_levels_are_normal():
    rng = np.random.default_rng(1)
    n = np.arange(900)
    beat = rng.normal(size=900) + np.where(n % 36 == 1, 15, 0) + np.where(n % 36 == 2, 7, 0)
    assert period(beat - running_median(beat, 31)) == 36
    beat[500] += 40
    assert set(np.flatnonzero(judge(n, beat))) == {500}
    levels = np.repeat(rng.integers(0, 6, 60), 15).astype(float)
    assert not judge(n, levels).any()
    assert not judge(n, np.full(900, 5.0)).any()


def test_missing_within_a_run():
    x = np.random.default_rng(2).normal(size=200)
    x[50:62] = 1.5
    x[55] = np.nan
    assert set(np.flatnonzero(judge(np.arange(200), x))) == set(range(50, 62)) - {55}


def test_gesd_finds_the_number():
    x = np.random.default_rng(3).normal(size=500)
    x[:4] = [9, -10, 11, 12]
    bound = gesd(x, 1.0, 0.05)
    assert (np.abs(x) >= bound).sum() == 4
    assert gesd(np.random.default_rng(4).normal(size=500), 1.0, 1e-9) == np.inf


def test_blocks_edges_and_nulls(spark):
    rng = np.random.default_rng(5)
    n = BLOCK + 400
    x = rng.normal(size=n)
    x[BLOCK - 1] += 50
    x[BLOCK - 6 : BLOCK - 2] = 0.25  # too short a run
    x[BLOCK + 10 : BLOCK + 25] = 7.5
    x[BLOCK - 40 : BLOCK - 30] = -3.25
    rows = [("r", "c", i, float(v), 1) for i, v in enumerate(x)] + [("r", "c", 3, None, 1), (None, "c", 1, 1e9, 1), ("r", None, 1, 1e9, 1), ("q", "c", 0, 1e9, 1), ("q", "c", 1, None, 1), ("q", "c", 0, 1e9, 1)]
    rows += [("quiet", "c", i, float(v), 1) for i, v in enumerate(rng.normal(size=50))]
    df = spark.createDataFrame(rows, "rec string, chan string, num long, data double, block int")
    got = {(r.rec, r.num): r for r in implausible(df, ["rec", "chan"], "num", "data").collect()}
    want = {("r", BLOCK - 1), ("q", 0)} | {("r", i) for i in [*range(BLOCK + 10, BLOCK + 25), *range(BLOCK - 40, BLOCK - 30)]}
    assert set(got) == want and got["q", 0].out_of_range and got["r", BLOCK - 1].spike and got["r", BLOCK + 10].stuck
    assert implausible(df.limit(0), ["rec", "chan"], "num", "data").count() == 0


def test_stuck_stretch_longer_than_blocks(spark):
    rng = np.random.default_rng(6)
    n = 5 * BLOCK + 100
    x = rng.normal(size=n)
    x[BLOCK // 2 : 3 * BLOCK + 77] = 1.25  # fills blocks
    x[-253:] = -0.5  # runs into the end
    x[10], x[4 * BLOCK] = 30, -30
    df = spark.createDataFrame(pd.DataFrame({"rec": "r", "num": np.arange(n), "data": x}))
    got = implausible(df, ["rec"], "num", "data").toPandas()
    assert set(got.num[got.stuck]) == {*range(BLOCK // 2, 3 * BLOCK + 77), *range(n - 253, n)}
    assert set(got.num[got.spike]) == {10, 4 * BLOCK}


def test_missing_readings_between_blocks(spark):
    x = np.random.default_rng(7).normal(size=3 * BLOCK)
    at = np.arange(3 * BLOCK) + np.where(np.arange(3 * BLOCK) >= BLOCK, 1000, 0)  # a gap longer than the halo
    x[BLOCK - 5 : BLOCK + 5] = 0.75
    df = spark.createDataFrame(pd.DataFrame({"rec": "r", "num": at, "data": x}))
    got = implausible(df, ["rec"], "num", "data").toPandas()
    assert set(got.num) == set(at[BLOCK - 5 : BLOCK + 5].tolist()) and got.stuck.all()


def test_usual_scatter_of_coarse_steps():
    x = np.round(np.random.default_rng(8).normal(size=4000) * 3) * 0.146
    n = np.arange(4000)
    rows = [r | {"block": b} for b in range(2) for r in summary(n[b * 2000 :][:2000], x[b * 2000 :][:2000], np.ones(2000, bool), 10, 9e7)]
    want = np.median([scatter(residuals(x[b * 2000 :][:2000], n[:2000])[0]) for b in range(2)])
    assert np.isclose(usual_of(pd.DataFrame(rows))[0].scale, want)


def test_many_spikes_are_all_found():
    for seed, n in ((9, 4000), (10, 400)):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=n) + 20 * np.sin(np.arange(n) / 300)
        at = rng.choice(n, n // 4, replace=False)
        x[at] += rng.uniform(12, 40, len(at)) * rng.choice([-1, 1, 1], len(at))
        got = set(np.flatnonzero(judge(np.arange(n), x) & 1))
        assert len(got & set(at)) >= 0.99 * len(at) and len(got - set(at)) <= 0.005 * n


def test_many_spikes_in_blocks(spark):
    rng = np.random.default_rng(11)
    n = 2 * BLOCK + 50
    x = rng.normal(size=n)
    at = rng.choice(n, n // 4, replace=False)
    x[at] += rng.uniform(12, 40, len(at)) * rng.choice([-1, 1], len(at))
    got = set(implausible(spark.createDataFrame(pd.DataFrame({"rec": "r", "num": np.arange(n), "data": x})), ["rec"], "num", "data").toPandas().num)
    assert len(got & set(at)) >= 0.99 * len(at) and len(got - set(at)) <= 0.005 * n


def test_outliers_decide_the_usual_scatter():
    """Spikes of thirteen scatters beside a quarter of larger ones: the scatter is that of the readings the test keeps."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=6000)
    at = rng.choice(6000, 1515, replace=False)
    x[at[:1500]] += 60
    x[at[1500:]] = 13.0
    s = scatter(x)
    assert cleaned(np.abs(x), np.ones(6000), s, 8.0, ALPHA, lambda kept: 0) > 13
    found = set(np.flatnonzero(judge(np.arange(6000), x) & 1))
    assert len(found & set(at)) >= 1500 and len(found & set(at[1500:])) >= 13 and len(found) <= 1515 + 20


def test_limit_grows_with_readings():
    at = {n: _limits(n, ALPHA)[1][0] / _limits(100, ALPHA)[1][0] * 8 for n in (30, 100, 1000, 1 << 20)}
    assert at[30] < at[100] == 8 < at[1000] < at[1 << 20] < 11.5


def test_running_median_equals_windows():
    x = np.random.default_rng(13).normal(size=57)
    for w in (9, 31, 80):
        half = min(w, 57) // 2
        want = [np.median(x[max(0, i - half) : i + half + 1]) for i in range(57)]
        assert np.allclose(running_median(x, w), want)


def test_coarse_channel_in_blocks(spark):
    """Steps so coarse that half of the residuals of some blocks are 0: spikes are found all the same."""
    rng = np.random.default_rng(14)
    n = 4 * BLOCK + 100
    x = np.round(rng.normal(size=n) * 1.4 + np.where(np.arange(n) % 24 < 3, 6, 0)) * 0.146
    at = rng.choice(n, 250, replace=False)
    x[at] += rng.uniform(4, 12, 250)
    got = set(implausible(spark.createDataFrame(pd.DataFrame({"rec": "r", "num": np.arange(n), "data": x})), ["rec"], "num", "data").where("spike").toPandas().num)
    assert got == set(at.tolist())
