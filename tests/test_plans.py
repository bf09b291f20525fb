"""Properties that the plans must keep: pruned scans, pushed filters, no products of data."""

import re

import pytest

from __spark_entry__ import queries
from sampleloom.plans import problems, reference, survey

SMALL = "/root/testdata/sf0.001"
#: Results that are pairs by definition: of class means.
PAIRS = {"pdist_euclidean", "pdist_correlation", "cdist", "target_similarity", "kernels", "dsm_regression", "kernels_stationary", "distances", "streamlines", "stored_kernel"}
#: One side is one row: how many to keep.
ONE_ROW = {"stack_by_sample_attribute"}


def plan(spark, name):
    return queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(problems.QUERIES) | set(reference.QUERIES) | set(survey.QUERIES)))
def test_no_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    if name not in PAIRS | ONE_ROW:
        assert "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_used(spark):
    for name, columns in (("mean_group_sample", 6), ("zscore_chunk", 3), ("anova", 3), ("select_match", 3)):
        for schema in re.findall(r"ReadSchema: struct<([^>]*(?:<[^>]*>)?[^>]*)>", plan(spark, name)):
            assert len(re.findall(r"\w+:", schema)) <= columns, (name, schema)


def test_filters_reach_the_scan(spark):
    assert "In(o_orderpriority" in plan(spark, "select_match") and "EqualTo(o_orderstatus,O)" in plan(spark, "select_match").replace("'", "")


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Round|Single)", text))


def test_ranks_exchange_no_row_twice(spark):
    from sampleloom.operators.select import ranked

    df = spark.range(1000).selectExpr("id % 3 as g", "id as k", "cast(hash(id) as double) as v")
    # the one exchange of rows lies before the checkpoint; what follows joins a small table
    assert exchanges(ranked(df, ["g"], ["v", "k"])) == 0


def test_models_are_no_column_of_rows(spark):
    from sampleloom.functions import models as mo
    from sampleloom.operators import learners as le

    df = reference.vectors(spark, SMALL)
    predicted = le.predict_folds(df, le.fit_folds(df, mo.LDA, "target", "chunk", most=50), "target", "chunk")
    text = predicted._jdf.queryExecution().executedPlan().toString()
    assert "model" not in text and "Join" not in text and exchanges(predicted) == 0


def test_searchlights_exchange_errors_only(spark):
    from sampleloom.operators import neighborhood as ne

    near = ne.neighbours(reference.feature_grid(spark), ["x", "y"], 1.0)
    # cells to one array a sample, and errors by centre and fold
    assert exchanges(ne.gnb_searchlight(reference.cells(spark, SMALL), near, "target", "chunk")) == 2


def test_nearest_references_pair_places_and_broadcast_no_cells(spark):
    lines = plan(spark, "nearest_references").splitlines()
    depth = [len(re.match(r"[ :+*-]*", x)[0]) for x in lines]
    joins = [i for i, x in enumerate(lines) if "SortMergeJoin [_cell" in x]
    (spread,) = (i for i, x in enumerate(lines) if "Generate explode" in x)
    # by the tables' sizes Spark would broadcast the exploded rows, however many they are
    assert len(joins) == 1 and joins[0] < spread
    assert not any("Broadcast" in lines[i] for i in range(joins[0], spread) if depth[i] < depth[spread])
    # distinct coordinates on either side
    assert sum("HashAggregate" in x or "SortAggregate" in x for x in lines[joins[0] :]) >= 4


def test_nearest_reference_of_repeated_coordinates(spark):
    from sampleloom.operators import neighborhood as ne

    inf = float("inf")
    at = [(0.0, 0.0), (-0.0, 0.0), (5.0, 5.0), (inf, 0.0), (None, 0.0), (0.4, 0.0)]
    points = spark.createDataFrame([(i, *at[i % 6]) for i in range(600)], "k int, x double, y double")
    ref = [("c", 0.5, 0.0), ("b", 0.5, 0.0), ("a", 0.0, 0.9), ("e", -inf, 0.0), ("d", -0.5, 0.0)] * 40
    got = ne.nearest_reference(points, spark.createDataFrame(ref, "label string, x double, y double"), ["x", "y"], 1.0, "k").collect()
    want = [("b", 0.5), ("b", 0.5), (None, None), (None, None), (None, None), ("b", 0.1)]
    assert len(got) == 600 and all((r.label, r.distance and round(r.distance, 9)) == want[r.k % 6] and (r.x, r.y) == at[r.k % 6] for r in got)
