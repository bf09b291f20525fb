import numpy as np
from pyspark.sql import functions as F

from sampleloom.functions import models as mo
from sampleloom.operators import inference as inf
from sampleloom.operators import learners as le
from sampleloom.operators import mappers as ma
from sampleloom.operators import neighborhood as ne
from sampleloom.operators import select as se
from sampleloom.sources import sinks
from sampleloom.sources import text as tx


def test_ranked_with_a_hot_group_and_nulls(spark):
    rows = [("hot", i % 50, i) for i in range(900)] + [(None, 1, i) for i in range(1000, 1005)] + [("x", 0, 2000)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = se.ranked(df, ["g"], ["v", "k"], total="n").collect()
    assert len(got) == len(rows)
    for g in ("hot", None, "x"):
        mine = sorted((r.v, r.k, r.pos, r.n) for r in got if r.g == g)
        assert [m[2] for m in mine] == list(range(len(mine))) and {m[3] for m in mine} == {len(mine)}
    assert se.ranked(df.limit(0), ["g"], ["v"]).count() == 0


def test_sensitivities(spark):
    rng = np.random.default_rng(0)
    x, t = rng.normal(size=(90, 3)), np.arange(90) % 3
    x[:, 1] += 2 * t
    df = spark.createDataFrame([(i, int(t[i]), i // 30, x[i].tolist()) for i in range(90)], "sample_id long, target int, chunk int, features array<double>")
    for make, components in ((mo.SVM, 3), (mo.SMLR, 2)):
        s = le.sensitivities(le.fit_folds(df, make, "target", "chunk"))
        assert s.count() == 3 * components * 3
        top = s.groupBy("feature_id").agg(F.sum(F.abs("weight")).alias("w")).orderBy(F.desc("w")).first()
        assert top.feature_id == 1
    assert {r.pair for r in le.binary_labels(le.sensitivities(le.fit_folds(df, mo.SVM, "target", "chunk")), [0, 1, 2]).collect()} == {"0|1", "0|2", "1|2"}


def test_probabilities_without_positives():
    rng = np.random.default_rng(1)
    x = np.append(rng.normal(size=400), [8.0] * 20)
    p = inf.dist_pvalues(x, 400, 0.01)
    assert (p[-20:] < 1e-6).all() and (p[:400] < 0.001).mean() < 0.02


def test_alignment_of_chosen_features():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 4))
    data = [np.column_stack([base + 0.05 * rng.normal(size=base.shape), rng.normal(size=(60, 4))]) for _ in range(3)]
    proj, chosen = ma.hyperalign_selected(data, 0.5)
    assert all(set(c) == {0, 1, 2, 3} for c in chosen) and proj[0].shape == (8, 4) and not proj[0][4:].any()


def test_masked_volumes(spark):
    v = spark.createDataFrame([(t, i, j, 0, float(t * 10 + i * 2 + j)) for t in range(2) for i in range(2) for j in range(2)], "t int, i int, j int, k int, value double")
    mask = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 0, 0)], "i int, j int, k int")
    cells, features = ne.masked_volumes(v, mask, 2.5)
    assert features.count() == 2 and cells.count() == 4
    assert [(r.sample_id, r.feature_id, r.value, r.time_coords) for r in cells.orderBy("sample_id", "feature_id").collect()][2:] == [(1, 0, 11.0, 2.5), (1, 1, 12.0, 2.5)]


def test_niml_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(4, [1.0, 2.5]), (2, [3.0, -1.0])], "node int, values array<double>")
    (tmp_path / "a.niml.dset").write_text(sinks.niml_text(df, ["x", "y"], ["none", "Ttest(3)"]))
    got = tx.niml_datasets(spark, str(tmp_path / "a.niml.dset")).orderBy("row").collect()
    assert [(r.node, r["values"]) for r in got] == [(2, [3.0, -1.0]), (4, [1.0, 2.5])] and got[0].labels == "x;y" and got[0].stats == "none;Ttest(3)"
