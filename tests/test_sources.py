import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.sources import sinks
from sampleloom.sources import text as tx


def put(tmp_path, name, content, mode="w"):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    with open(p, mode) as f:
        f.write(content)
    return str(p)


def test_columns_and_attributes(spark, tmp_path):
    p = put(tmp_path, "a.txt", "junk\nx  y\tlabel\n# note\n1 2.5 a\n\n 3\t4   b \n")
    df = tx.columns(spark, p, types={"x": "int", "y": "double"}, skip=1).orderBy("x")
    assert [(r.x, r.y, r.label) for r in df.collect()] == [(1, 2.5, "a"), (3, 4.0, "b")]
    p = put(tmp_path, "attr.txt", "rest 0\nface 1\n")
    assert [(r.targets, r.chunks) for r in tx.sample_attributes(spark, p).orderBy("chunks").collect()] == [("rest", 0.0), ("face", 1.0)]
    p = put(tmp_path, "ev3.txt", "0.0 2.0 1\n5 1 0.5\n")
    assert tx.ev3_events(spark, p).agg(F.sum("onset")).first()[0] == 5
    p = put(tmp_path, "s.dat", "C1 3 0.1 0.2 0.3\n")
    assert tx.xavr_sensors(spark, p).first().pos_z == 0.3
    p = put(tmp_path, "s.xyz", "M1 1 2 3 4 5 6\n")
    assert tx.meg_sensors(spark, p).first().pos_x == 2
    p = put(tmp_path, "m.par", "1 2 3 4 5 6\n")
    assert tx.motion_parameters(spark, p).first().z == 6
    p = put(tmp_path, "e.tsv", "onset\tduration\ttrial_type\n1.5\t2\tface\n")
    assert tx.tsv_events(spark, p).first().trial_type == "face"
    p = put(tmp_path, "x.1D", "# c\n1 2\n3 4\n")
    assert sorted(r["values"] for r in tx.numeric_rows(spark, p).collect()) == [[1, 2], [3, 4]]


def test_designs(spark, tmp_path):
    p = put(tmp_path, "g.mat", "/NumWaves 2\n/NumPoints 2\n/Matrix\n1 2\n3 4\n")
    assert [r["values"] for r in tx.glm_design(spark, p).orderBy("row").collect()] == [[1, 2], [3, 4]]
    p = put(tmp_path, "d.fsf", '# c\nset fmri(tr) 2.5\nset name "x y"\n')
    assert tx.design_settings(spark, p).first().settings == {"fmri(tr)": "2.5", "name": "x y"}
    p = put(tmp_path, "r.rtc", 'Type: DesignMatrix\n\n"l B" "r B"\n0 1\n2 3\n')
    assert [r.predictors for r in tx.rtc_design(spark, p).orderBy("row").collect()] == [{"l B": 0, "r B": 1}, {"l B": 2, "r B": 3}]


def test_recordings(spark, tmp_path):
    p = put(tmp_path, "m.txt", "Sample Number:0\t1\t0\t1\nTime:0.0\t0.1\t0.0\t0.1\nM1:1\t2\t3\t4\nno id\n")
    rows = tx.meg_recording(spark, p).orderBy("trial", "timepoint").collect()
    assert [(r.trial, r.timepoint, r.value) for r in rows] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    p = put(tmp_path, "e.txt", "Cz Pz\n0 1 2\n1 3 4\n0 5 6\n1 7 8\n")
    rows = tx.eeg_export(spark, p).orderBy("sample", "timepoint", "channel").collect()
    assert [(r["sample"], r.timepoint, r.channel, r.value) for r in rows][:3] == [(0, 0.0, "Cz", 1.0), (0, 0.0, "Pz", 2.0), (0, 1.0, "Cz", 3.0)] and len(rows) == 8
    body = np.arange(8, dtype="<f4").tobytes()
    p = put(tmp_path, "b.bin", b";2 2 2 -0.5 0.1\n;channels: A B\n;EOH;\n" + body, "wb")
    rows = tx.eep_binary(spark, p).orderBy("trial", "channel", "timepoint").collect()
    assert [r.value for r in rows] == list(range(8)) and rows[2].channel == "B" and rows[1].timepoint == -0.4


def test_light_svm_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.5, 4.0])], "t string, features array<double>")
    codes = sinks.write_light_svm(df, str(tmp_path / "svm"), "t")
    assert codes == {"a": -1, "b": 1}
    assert {(r.label, tuple(r.features)) for r in tx.light_svm(spark, str(tmp_path / "svm")).collect()} == {("-1", (1.0, 2.0)), ("1", (3.5, 4.0))}
    p = put(tmp_path, "bad.svm", "1 1:2 3:4\n")
    with pytest.raises(Exception):  # noqa: B017
        tx.light_svm(spark, p).collect()


def test_surfaces_and_headers(spark, tmp_path):
    p = put(tmp_path, "m.asc", "#!ascii\n3 1\n0 0 0 0\n1 0 0 0\n0 1 0 0\n0 1 2 0\n")
    assert abs(tx.ascii_surface(p).face_areas()[0] - 0.5) < 1e-12
    p = put(tmp_path, "r.roi", '# <Node_ROI\n# Label = "x"\n# >\n0 4 2 5 6\n0 1 3 1 2 3\n# </Node_ROI>\n')
    assert {(r.kind, tuple(r.nodes)) for r in tx.roi_file(spark, p).collect()} == {("edges", (5, 6)), ("areas", (1, 2, 3))}
    p = put(tmp_path, "x.spec", "Group = all\nNewSurface\nSurfaceName = lh.asc\nNewSurface\nSurfaceName = rh.asc\n")
    assert {r.properties["SurfaceName"] for r in tx.surface_spec(spark, p).collect()} == {"lh.asc", "rh.asc"}
    p = put(tmp_path, "n.niml", '# <AFNI_dataset\n# dset_type = "Node_Bucket"\n# ni_form = "ni_group" >\n# <SPARSE_DATA ni_type = "2*float" >\n1 2\n# </SPARSE_DATA>\n')
    got = {r.element: r.attributes for r in tx.niml_headers(spark, p).collect()}
    assert got["AFNI_dataset"]["dset_type"] == "Node_Bucket" and got["SPARSE_DATA"]["ni_type"] == "2*float"


def test_study_layout(spark, tmp_path):
    put(tmp_path, "sub001/model/model001/onsets/task001_run001/cond001.txt", "0\t1\t1\n5\t1\t1\n")
    put(tmp_path, "sub002/model/model001/onsets/task001_run002/cond002.txt", "3\t1\t1\n")
    put(tmp_path, "models/model001/condition_key.txt", "task001 cond001 face\ntask001 cond002 two words\n")
    e = tx.study(spark, str(tmp_path))["events"].orderBy("onset").collect()
    assert [(r.subject, r.run, r.condition, r.onset) for r in e] == [("sub001", "001", "face", 0.0), ("sub002", "002", "two words", 3.0), ("sub001", "001", "face", 5.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False)], "k int, balanced_set boolean")
    assert sinks.log_exclusions(df, str(tmp_path / "log")).count() == 2
    assert [r.k for r in spark.read.json(str(tmp_path / "log")).collect()] == [2]
    v = spark.createDataFrame([(0, 1, 1, 5.0)], "i int, j int, k int, value double")
    g = sinks.full_grid(v, (2, 2, 2))
    assert g.count() == 8 and g.agg(F.sum("value")).first()[0] == 5.0
    sinks.write_columns(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), sep=" ", header=True).count() == 2
    np.save(tmp_path / "v.npy", np.array([1.0, 2.0]))
    assert tx.npy(spark, str(tmp_path / "v.npy")).count() == 2
