"""Queries that SQL can't express, against NumPy over all rows of the smallest tables."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sampleloom.functions import models as mo
from sampleloom.operators import learners as le
from sampleloom.operators import mappers as ma
from sampleloom.operators import ordered as od
from sampleloom.plans import pipelines as pl
from sampleloom.plans import problems, reference

SMALL = "/root/testdata/sf0.001"


def frame(name):
    return pd.read_parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="module")
def vectors():
    e = frame("embeddings").sort_values("vec_id")
    return np.array(e["embedding"].tolist(), float), e["label"].to_numpy(), (e["vec_id"] % 5).to_numpy(), e["vec_id"].to_numpy()


def run(spark, name):
    return {**reference.QUERIES, **problems.QUERIES}[name](spark, SMALL).toPandas()


@pytest.mark.parametrize("name", ["lda", "qda", "smlr", "svm", "svm(rbf)"])
def test_cross_validated_classifiers(spark, vectors, name):
    x, t, chunk, _ = vectors
    got = run(spark, name.replace("(", "_").replace(")", "") + "_cv").set_index("fold")
    for f in np.unique(chunk):
        m = mo.REGISTRY[name][1]().fit(x[chunk != f], t[chunk != f])
        want = np.mean(m.predict(x[chunk == f]) != t[chunk == f])
        # iterative fits see the rows in another order; a class of 40 rows has no regular covariance in 64 dimensions
        assert abs(got.loc[f, "error"] - want) < {"lda": 1e-5, "qda": 0.05}.get(name, 0.03) and got.loc[f, "n"] == (chunk == f).sum()


def test_sums_settle_the_same_models(spark):
    rng = np.random.default_rng(0)
    t, chunk = rng.integers(0, 3, 600), rng.integers(0, 4, 600)
    x = rng.normal(size=(600, 5)) * (1 + t[:, None]) + t[:, None] * [0, 1, 2, 0, 0] + 3
    df = spark.createDataFrame([(i, int(t[i]), int(chunk[i]), x[i].tolist()) for i in range(600)], "sample_id long, target int, chunk int, features array<double>").repartition(7)
    for make in (mo.LDA, lambda: mo.LDA(True)):
        models = le.fit_folds_exactly(df, make, "target", "chunk")
        for f in range(4):
            m = make().fit(x[chunk != f], t[chunk != f])
            assert np.allclose(m.estimates(x), models[f].estimates(x))
    p = le.predict_folds(df, le.fit_folds_exactly(df, mo.Ridge, "target", "chunk"), "target", "chunk", kind="double").toPandas().set_index("sample_id")["prediction"]
    for f in range(4):
        m = mo.Ridge().fit(x[chunk != f], t[chunk != f].astype(float))
        assert np.allclose(p[np.flatnonzero(chunk == f)], m.predict(x[chunk == f]))
    from pyspark.ml.classification import LogisticRegression

    easy = df.where("target < 2").withColumn("features", F.transform("features", lambda v: v / 100 + F.col("target")))
    e = pl.ml_cross_validate(easy, LogisticRegression(maxIter=50), "target", "chunk").where("prediction <> target").count()
    assert e <= 0.02 * easy.count()


def test_weights_of_pairwise_machines(spark, vectors):
    x, t, chunk, _ = vectors
    got = run(spark, "svm_sensitivities")
    labels = np.unique(t)
    for f in (0, 3):
        m = mo.SVM().fit(x[chunk != f], t[chunk != f])
        part = got[got["fold"] == f].pivot(index="pair", columns="feature_id", values="weight")
        pairs = [f"{a}|{b}" for i, a in enumerate(labels) for b in labels[i + 1 :]]
        w = part.loc[pairs].to_numpy()
        r = (w * m.weights).sum(1) / np.sqrt((w**2).sum(1) * (np.asarray(m.weights) ** 2).sum(1))
        assert (r > 0.98).all()


def test_cross_validated_regressions(spark, vectors):
    x, t, chunk, _ = vectors
    got = run(spark, "regression_cv").set_index(["model", "fold"])
    for name in ("ridge", "blr", "enet", "lars", "gpr"):
        for f in np.unique(chunk):
            p = mo.REGISTRY[name][1]().fit(x[chunk != f], t[chunk != f].astype(float)).predict(x[chunk == f])
            assert abs(got.loc[(name, f), "rmse"] - np.sqrt(np.mean((p - t[chunk == f]) ** 2))) < 2e-3
    assert np.isfinite(got.loc["svr", "rmse"]).all()


def test_principal_axes(spark, vectors):
    x, _, _, ids = vectors
    z = x - x.mean(0)
    s = np.linalg.svd(z, compute_uv=False)
    assert np.allclose(run(spark, "svd_energy").sort_values("component")["energy"], s**2, rtol=1e-3, atol=1e-3)
    p = run(spark, "svd_projected").sort_values("sample_id")
    y = np.array(p["features"].tolist())
    assert (p["sample_id"].to_numpy() == ids).all() and np.allclose((y**2).sum(0), s[:4] ** 2, rtol=1e-6) and np.allclose(y.T @ y, np.diag((y**2).sum(0)), atol=1e-6)


def test_relief(spark, vectors):
    x, t, _, ids = vectors
    w, q = np.ones(64) / 64, np.flatnonzero(ids % 100 == 0)
    for _ in range(5):
        nu = np.zeros(64)
        for i in q:
            d = np.abs(x - x[i])
            k = np.where((d @ w < 1e-15) | (np.arange(len(x)) == i), 0, np.exp(-(d @ w)))
            hit, miss = k * (t == t[i]), k * (t != t[i])
            nu += (1 - miss.sum() / k.sum()) * (miss @ d / miss.sum() - hit @ d / max(hit.sum(), 1e-300))
        new = np.maximum(nu / len(q), 0)
        new /= np.linalg.norm(new) or 1
        done, w = np.abs(new - w).sum() < 1e-2, new
        if done:
            break
    assert np.allclose(run(spark, "irelief_weights").sort_values("feature_id")["weight"], w, atol=2e-6)


def test_map_of_all_rows(spark, vectors):
    x, *_ = vectors
    m = ma.SOM((4, 4), 5, 0.1).fit_rows(reference.vectors(spark, SMALL))
    units = m.units.reshape(16, -1)
    got = run(spark, "som_units").sort_values("sample_id")
    best = np.argmin(((x[:, None] - units[None]) ** 2).sum(-1), axis=1)
    assert (got["row"].to_numpy() * 4 + got["col"].to_numpy() == best).mean() > 0.995
    random = np.random.default_rng(0).normal(size=units.shape) * x.std(0) + x.mean(0)
    error = lambda u: np.sqrt(((x[:, None] - u[None]) ** 2).sum(-1)).min(1).mean()
    assert error(units) < error(random) and len(np.unique(best)) > 4


def fine():
    m = frame("meg_data")
    m = m[np.isfinite(m["data"]) & (m["data"].abs() < 9e7)]
    return m.groupby(["recording_id", "channel_id", "sample_number"], as_index=False)["data"].min().sort_values("sample_number")


def test_resampled_series(spark):
    got = run(spark, "resampled_series")
    got = {k: g.sort_values("pos")["value"].to_numpy() for k, g in got.groupby(["recording_id", "channel_id"])}
    series = {k: g["data"].to_numpy() for k, g in fine().groupby(["recording_id", "channel_id"])}
    assert set(got) == set(series) and all(len(v) == 100 for v in got.values())
    for k, y in series.items():
        assert abs(got[k].mean() - y.mean()) < 1e-4 * max(1, abs(y).max())
    n = np.arange(400)
    wave = np.sin(2 * np.pi * n / 80)
    assert np.allclose(od.fft_resample(wave, 100), np.sin(2 * np.pi * np.arange(100) / 20), atol=1e-9)


def test_least_squares(spark):
    x = frame("lineitem")
    got = run(spark, "glm_features").set_index(["l_linestatus", "name"])
    for g, part in x.groupby("l_linestatus"):
        a = np.column_stack([np.ones(len(part)), part[["l_quantity", "l_discount", "l_tax"]].to_numpy(float)])
        y = part["l_extendedprice"].to_numpy(float)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        s2 = ((y - a @ beta) ** 2).sum() / (len(y) - 4)
        t = beta / np.sqrt(s2 * np.diag(np.linalg.inv(a.T @ a)))
        for i, n in enumerate(["intercept", "l_quantity", "l_discount", "l_tax"]):
            row = got.loc[(g, n)]
            assert np.isclose(row["beta"], beta[i], rtol=1e-6, atol=1e-3) and np.isclose(row["t"], t[i], rtol=1e-5, atol=1e-4)
            assert abs(row["p"] - math.erfc(abs(t[i]) / math.sqrt(2))) < 1e-2


def test_generic_searchlight(spark, vectors):
    x, t, *_ = vectors
    got = run(spark, "searchlight_generic").set_index("center_id")
    for c in range(64):
        near = [f for f in range(64) if (f // 8 - c // 8) ** 2 + (f % 8 - c % 8) ** 2 <= 1]
        means = np.array([x[t == k][:, near].mean(0) for k in np.unique(t)])
        best = np.unique(t)[np.argmin(((x[:, None, near] - means[None]) ** 2).sum(-1), axis=1)]
        assert abs(got.loc[c, "value"] - np.mean(best != t)) < 0.006 and got.loc[c, "roi_size"] == len(near)


def test_alignments(spark, vectors):
    x, t, chunk, _ = vectors
    means = {s: np.array([x[(chunk == s) & (t == k)].mean(0) for k in np.unique(t)]) for s in range(5)}
    got = run(spark, "hyperalignment")
    for row in range(8):
        maps, _ = ma.hyperalign([means[s][:, row * 8 : row * 8 + 8] for s in range(5)])
        for s in range(5):
            w = got[(got["x"] == row) & (got["chunk"] == s)].pivot(index="i", columns="j", values="w").to_numpy()
            assert np.allclose(w, maps[s].matrix, atol=1e-3)
    total = {s: np.zeros((64, 64)) for s in range(5)}
    for c in range(64):
        near = sorted(f for f in range(64) if (f // 8 - c // 8) ** 2 + (f % 8 - c % 8) ** 2 <= 1)
        maps, _ = ma.hyperalign([means[s][:, near] for s in range(5)])
        for s in range(5):
            total[s][np.ix_(near, near)] += maps[s].matrix
    local = run(spark, "searchlight_alignment")
    for s in range(5):
        part = local[local["subject"] == s]
        assert np.allclose(part["w"], total[s][part["feature_in"], part["feature_out"]], atol=2e-3)


def test_dissimilarity_regression(spark, vectors):
    x, t, chunk, _ = vectors
    k = np.unique(t)
    i, j = np.triu_indices(len(k), 1)
    dsm = lambda keep: (lambda m: ((m[i] - m[j]) ** 2).sum(1))(np.array([x[keep & (t == c)].mean(0) for c in k]))
    z = lambda v: (v - v.mean()) / v.std()
    a = np.column_stack([z(np.abs(k[i] - k[j]).astype(float)), z(dsm(chunk < 2))])
    beta = np.linalg.lstsq(a, z(dsm(chunk >= 0)), rcond=None)[0]
    got = run(spark, "dsm_regression").set_index("name")["beta"]
    assert np.allclose([got["label"], got["half"]], beta, atol=1e-4)


def test_amplitudes_come_back(spark):
    got = run(spark, "event_amplitudes")
    mid = got[got["name"] == "intercept"]
    assert np.allclose(mid["beta"], 5, atol=1e-3)
    # 2 is the amplitude that made the signal; a type that a run lacks has no regressor there
    b = frame("bold_events").dropna(subset=["onset", "duration", "trial_type"])
    b = b[(b["duration"] > 0)]
    there = set(zip(b["run_id"], b["trial_type"].str.strip().str.lower(), strict=True))
    for row in got[got["name"] != "intercept"].itertuples():
        assert np.isclose(row.beta, 2 if (row.run_id, row.name) in there else 0, atol=1e-3), row


def test_bootstrapped_thresholds(spark, vectors):
    x, _, chunk, _ = vectors
    got = run(spark, "bootstrap_null").sort_values("feature_id")
    low = sum(x[chunk == c].min(0) for c in range(5)) / 5
    high = sum(x[chunk == c].max(0) for c in range(5)) / 5
    assert len(got) == 64 and (got["threshold"] >= low - 1e-6).all() and (got["threshold"] <= high + 1e-6).all()
    assert (got["threshold"].to_numpy() > x.mean(0)).mean() > 0.9


def test_permuted_and_balanced_errors(spark):
    e = run(spark, "permutation_test").iloc[0]
    assert 0 < e["error"] < 1 and 1 / 12 <= e["p"] <= 11 / 12
    assert run(spark, "permutation_test").iloc[0].tolist() == e.tolist()
    b = run(spark, "balanced_cv")
    # three classes of equal size can't be told apart by price and date alone
    assert len(b) == 20 and b["error"].between(0.2, 0.9).all()


def test_clusters_above_thresholds(spark):
    got = run(spark, "cluster_threshold")
    assert got["p"].between(0, 1).all() and (got["p_corrected"] >= got["p"] - 1e-9).all() and (got["min"] <= got["median"]).all() and (got["median"] <= got["max"]).all()
    assert got["cluster"].is_unique and (got["size"] >= 1).all()


def test_any_estimator(spark):
    got = run(spark, "ml_logistic_cv").set_index("fold")["error"]
    assert sorted(got.index) == [0, 1, 2, 3, 4] and got.between(0, 1).all()


def test_proportion_bounds(spark):
    got = run(spark, "ci_jeffreys")
    x = frame("lineitem")
    for row in got.itertuples():
        part = x[x["l_linestatus"] == row.l_linestatus]
        n, k = len(part), (part["l_returnflag"] == "R").sum()
        if not 0 < k < n:
            continue
        p = np.linspace(1e-9, 1 - 1e-9, 400_001)
        log = (k - 0.5) * np.log(p) + (n - k - 0.5) * np.log1p(-p)
        c = np.cumsum(np.exp(log - log.max()))
        assert np.allclose([row.low, row.high], [p[np.searchsorted(c / c[-1], q)] for q in (0.025, 0.975)], atol=1e-4)


# --- problems against plain parsers ------------------------------------------------
def plain_reason(line, sep, header, at):
    """One line read sign by sign, without any of the operator's buffers."""
    x = line.strip(" \t\r\n\f\v")
    fields, i, n = [], 0, len(x)
    while True:
        while i < n and x[i] in " \t" and x[i] != sep:
            i += 1
        if i < n and x[i] == '"':
            i, out = i + 1, ""
            while True:
                if i >= n:
                    return "quoting"
                if x[i] == '"':
                    if x[i + 1 : i + 2] == '"':
                        out, i = out + '"', i + 2
                        continue
                    break
                out, i = out + x[i], i + 1
            i += 1
            k = i
            while k < n and x[k] in " \t" and x[k] != sep:
                k += 1
            if k < n and not (x[k] == sep if sep else k > i):
                return "quoting"
            i = k if sep else i
        else:
            k = i
            while k < n and not (x[k] == sep if sep else x[k] in " \t"):
                k += 1
            out = x[i:k].strip(" \t")
            if '"' in out:
                return "quoting"
            i = k
        fields.append(out)
        if sep is None:
            while i < n and x[i] in " \t":
                i += 1
            if i >= n:
                break
        elif i < n:
            i += 1
        else:
            break
    if len(fields) != len(header):
        return "columns"
    for name in ("onset", "duration"):
        v = fields[at[name]]
        if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v, re.ASCII) or not math.isfinite(float(v)) or (name == "duration" and float(v) < 0):
            return "value"
    return None


def test_failing_lines(spark):
    files, lines = frame("column_files"), frame("column_lines").drop_duplicates(["file_id", "line_no"]).sort_values(["file_id", "line_no"])
    want = set()
    for f in files.itertuples():
        body = lines[(lines["file_id"] == f.file_id) & (lines["line_no"] > f.skiplines)]
        header = f.header
        for row in body.itertuples():
            line = row.line.strip(" \t\r\n\f\v")
            if header is None:
                header = re.split(r"[ \t]+", line) if f.sep is None else [h.strip() for h in line.split(f.sep)]
                header = ",".join(header)
                continue
            if not line or line.startswith("#"):
                continue
            names = [h.strip().strip('"') for h in header.split(",")]
            reason = plain_reason(row.line, f.sep, names, {k: names.index(k) for k in ("onset", "duration")})
            if reason:
                want.add((row.file_id, row.line_no, reason))
    got = {tuple(r) for r in run(spark, "p1_found")[["file_id", "line_no", "reason"]].itertuples(index=False)}
    assert got == want and len(want) > 10
    good = run(spark, "p1_records")
    assert not {(r.file_id, r.line_no) for r in good.itertuples()} & {x[:2] for x in want}


def plain_values(text):
    """A packed field without open signs, read sign by sign."""
    import html

    x = text.strip(" \r\f\v") if text.strip() else ""
    if x.strip()[:1] == "[" and x.strip()[-1:] == "]":
        x = x.strip()[1:-1]
    out, cur, i, depth, quote = [], "", 0, 0, None
    while i < len(x):
        c = x[i]
        if quote:
            cur += c
            if c == quote:
                if x[i + 1 : i + 2] == quote:
                    cur, i = cur + quote, i + 1
                else:
                    quote = None
        elif c in "\"'" and not cur.strip() and depth == 0:
            quote, cur = c, cur + c
        elif c == "(":
            depth, cur = depth + 1, cur + c
        elif c == ")":
            depth, cur = max(depth - 1, 0), cur + c
        elif c == "&" and (m := re.match(r"&(#\d+|#[xX][0-9a-fA-F]+|\w+);", x[i:])) and html.unescape(m.group()) != m.group():
            cur, i = cur + m.group(), i + len(m.group()) - 1
        elif c in ";,|\t\n" and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    out.append(cur)
    done = []
    for v in out:
        v = v.strip()
        if len(v) > 1 and v[0] in "\"'" and v[-1] == v[0]:
            v = v[1:-1].replace(v[0] * 2, v[0])
        done.append(html.unescape(v).strip() if re.search(r"&(#\d+|#[xX][0-9a-fA-F]+|\w+);", v) else v.strip())
    return done


def test_packed_values(spark):
    d = frame("niml_dsets")
    want = {(r.dset_id, f, i, v) for r in d.itertuples() for f in ("labels", "stats") if getattr(r, f) is not None for i, v in enumerate(plain_values(getattr(r, f))) if v}
    got = {tuple(r) for r in run(spark, "p3_found")[["dset_id", "field_name", "pos", "value"]].itertuples(index=False)}
    assert len(got ^ want) <= 0.002 * len(want), sorted(got ^ want)[:10]


def test_flags_name_what_is_found(spark):
    flags, found = run(spark, "p5_flags"), run(spark, "p5_found")
    key = ["recording_id", "channel_id", "sample_number"]
    assert set(map(tuple, flags[key].to_numpy().tolist())) == set(map(tuple, found[key].to_numpy().tolist()))
    m = frame("meg_data").drop_duplicates(key).merge(flags, on=key)
    assert (m.loc[m["out_of_range"], "data"].abs() > 9e7).all() and not (m.loc[~m["out_of_range"], "data"].abs() > 9e7).any() and m[["spike", "stuck", "out_of_range"]].any(axis=1).all()
