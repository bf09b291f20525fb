"""Further queries of the engine's own operators, each with its SQL: kernels and distances, curves, chunks, selections, volumes, round trips through files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.dataset import Dataset
from sampleloom.functions import distance as dist
from sampleloom.functions import small
from sampleloom.operators import aggregate as ag
from sampleloom.operators import choose as ch
from sampleloom.operators import errors as er
from sampleloom.operators import featsel as fs
from sampleloom.operators import generators as ge
from sampleloom.operators import learners as le
from sampleloom.operators import mappers as ma
from sampleloom.operators import measures as me
from sampleloom.operators import neighborhood as ne
from sampleloom.operators import ordered as od
from sampleloom.operators import select as se
from sampleloom.operators import stack as st
from sampleloom.plans import pipelines as pl
from sampleloom.plans.reference import GRID_SQL, KNN, LONG, MEANS, NEAR, PRED, cells, feature_grid, predictions, r, rounded, vectors
from sampleloom.plans.reference import SQL as REFERENCE
from sampleloom.session import table
from sampleloom.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- kernels and distances of class means -------------------------------------
PAIRS = MEANS + """, p AS (SELECT a.target AS id_a, b.target AS id_b, sum(a.m * b.m) AS dot, sum(pow(a.m - b.m, 2)) AS sq, sum(pow(a.m - b.m, 2) * CASE WHEN feature_id % 2 = 0 THEN 1 ELSE 4 END) AS sq2,
 sum(a.m * b.m * (1 + feature_id % 3)) AS wdot, sum(abs(a.m - b.m)) AS l1, max(abs(a.m - b.m)) AS top, sum(pow(abs(a.m - b.m) * (1 + feature_id % 3), 3)) AS cube, sum(a.m - b.m) AS diff, sum(pow(a.m - b.m, 2) / (1 + feature_id)) AS over,
 max(CASE WHEN feature_id = 0 THEN abs(a.m - b.m) END) AS d0, sqrt(sum(pow(a.m - b.m, 2))) AS l2 FROM m a JOIN m b USING (feature_id) GROUP BY ALL) """


def _pairs(spark, d, measures: dict) -> DataFrame:
    means = me.group_means(vectors(spark, d), ["target"])
    whole = dist.pairwise(means, means, "target", "features", lambda a, b: F.struct(*(fx(a, b).alias(n) for n, fx in measures.items())))
    return whole.select("id_a", "id_b", *(r(F.col(f"value.{n}"), 7).alias(n) for n in measures))


SCALES = [1.0 if f % 2 == 0 else 0.5 for f in range(64)]


@query(PAIRS + """SELECT id_a, id_b, round(exp(-0.5 * sq), 7) AS rbf_gamma, round(tanh(0.5 * dot + 0.1), 7) AS sigmoid, round(pow(0.5 * dot + 2, 3), 7) AS poly, 4.0 AS constant, round(wdot + 2.25, 7) AS generalized,
 round(1.44 * exp(-sqrt(sq) / 2), 7) AS exponential, round(exp(-0.5 * sq2), 7) AS squared, round((1 + sqrt(1.5 * sq)) * exp(-sqrt(1.5 * sq)), 7) AS matern_3_2, round((1 + sqrt(2.5 * sq) + 2.5 * sq / 3) * exp(-sqrt(2.5 * sq)), 7) AS matern_5_2, round(pow(1 + sq / 3, -1.5), 7) AS rational FROM p""")
def kernels_stationary(spark, d):
    """All kernels that are not in ``kernels``, between class means."""
    weight = [1.0 + f % 3 for f in range(64)]
    return _pairs(spark, d, {
        "rbf_gamma": lambda a, b: dist.rbf_gamma(a, b, 0.5), "sigmoid": lambda a, b: dist.sigmoid(a, b, 0.5, 0.1), "poly": lambda a, b: dist.polynomial(a, b, 0.5, 3, 2.0), "constant": lambda a, b: dist.constant(2.0),
        "generalized": lambda a, b: dist.generalized_linear(a, b, 1.5, weight), "exponential": lambda a, b: dist.exponential(a, b, 2.0, 1.2), "squared": lambda a, b: dist.squared_exponential(a, b, SCALES),
        "matern_3_2": dist.matern_3_2, "matern_5_2": dist.matern_5_2, "rational": lambda a, b: dist.rational_quadratic(a, b, 1.0, 1.0, 1.5),
    })


@query(PAIRS + "SELECT id_a, id_b, round(top, 7) AS chebyshev, round(l1, 7) AS manhattan, round(sqrt(over + 0.01 * diff * diff), 7) AS mahalanobis, round(pow(cube, 1.0 / 3), 7) AS pnorm, round(l2, 7) AS euclidean, round(exp(-d0), 7) AS similarity FROM p")
def distances(spark, d):
    """Distances and a one-dimensional similarity between class means."""
    w = (np.diag(1 / (1 + np.arange(64))) + 0.01).tolist()
    return _pairs(spark, d, {
        "chebyshev": dist.chebyshev, "manhattan": dist.manhattan, "mahalanobis": lambda a, b: dist.mahalanobis(a, b, w), "pnorm": lambda a, b: dist.pnorm(a, b, 3, [1.0 + f % 3 for f in range(64)]),
        "euclidean": dist.euclidean, "similarity": dist.single_dimension_similarity,
    })


LINES = MEANS + """, q AS (SELECT target AS t, feature_id // 8 AS i, feature_id % 8 AS k, m FROM m), g AS (SELECT a.t AS id_a, b.t AS id_b, a.i AS i, b.i AS j, sqrt(sum(pow(a.m - b.m, 2))) AS d FROM q a JOIN q b USING (k) GROUP BY ALL),
 f AS (SELECT id_a, id_b, avg(d) AS there FROM (SELECT id_a, id_b, i, min(d) AS d FROM g GROUP BY ALL) GROUP BY ALL), c AS (SELECT x.id_a, x.id_b, x.there, y.there AS back FROM f x JOIN f y ON x.id_a = y.id_b AND x.id_b = y.id_a) """


@query(LINES + "SELECT id_a, id_b, round(there, 7) AS there, round(back, 7) AS back, round((there + back) / 2, 7) AS corouge, round(exp(-0.5 * (there + back) / 2), 7) AS similarity FROM c")
def streamlines(spark, d):
    """Class means seen as lines of eight points: mean nearest distances both ways, their mean, and the similarity."""
    means = me.group_means(vectors(spark, d), ["target"])
    lines = means.select("target", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("features", i * 8 + 1, 8)).alias("features"))
    both = dist.pairwise(lines, lines, "target", "features", lambda a, b: F.struct(dist.mean_min(a, b).alias("m"), dist.corouge(a, b).alias("c"), dist.streamline_similarity(a, b, 0.5).alias("s")))
    return rounded(both.select("id_a", "id_b", F.col("value.m")[0].alias("there"), F.col("value.m")[1].alias("back"), F.col("value.c").alias("corouge"), F.col("value.s").alias("similarity")), 7)


@query(PAIRS + "SELECT id_a, id_b, round(dot, 6) AS value FROM p WHERE id_a % 2 = 0 AND id_b % 2 = 1")
def stored_kernel(spark, d):
    """A kernel computed once and read by slices of ids."""
    means = me.group_means(vectors(spark, d), ["target"])
    k = pl.kernel_matrix(means, "target", dist.linear)
    return rounded(pl.kernel_slice(k, means.where("target % 2 = 0"), means.where("target % 2 = 1"), "target").select("id_a", "id_b", "value"))


# --- curves and small functions ---------------------------------------------------
def _gamma(t: str, a: float, w: float, k: float) -> str:
    return f"CASE WHEN {t} > 0 THEN {k} * pow({t} / {a}, {a * a / (w * w)} * 8 * ln(2)) * exp(({a} - {t}) / ({w * w / a} / (8 * ln(2)))) ELSE 0 END"


@query(f"""SELECT CAST(i AS BIGINT) AS i, round({_gamma('t', 5.4, 5.2, 1.0)}, 8) + 0 AS single, round({_gamma('t', 5.4, 5.2, 1.0)} - {_gamma('t', 10.8, 7.35, 0.35)}, 8) + 0 AS double,
 round(exp(-pow(t - 1, 2) / 2) - 0.5 * exp(-pow((t - 4) / 2, 2) / 2), 8) + 0 AS dual, round(exp(-pow(t - 1, 2) / 2), 8) + 0 AS positive FROM (SELECT i, i * 0.25 - 1 AS t FROM generate_series(0, 159) AS g(i))""")
def response_curves(spark, d):
    """Response functions and sums of Gaussians over time."""
    t = F.col("id") * 0.25 - 1
    return rounded(spark.range(160).select(F.col("id").alias("i"), od.single_gamma(t).alias("single"), od.double_gamma(t).alias("double"), od.dual_gaussian(t, 1.0, 1.0, 1.0, -0.5, 4.0, 2.0).alias("dual"), od.dual_gaussian(t, 1.0, 1.0, 1.0, -0.5, 4.0, 2.0, positive=True).alias("positive")), 8)


@query(f"""SELECT round(avg(value), 8) AS grand_mean, round(avg(1 - value), 8) AS one_minus, round(sum(value), 5) AS total FROM ({LONG})""")
def transformers(spark, d):
    """Grand mean, one minus each value, and the values as they are."""
    v = vectors(spark, d)
    other = small.grand_mean(v.select(small.one_minus_each("features").alias("features"))).withColumnRenamed("grand_mean", "one_minus")
    total = v.select(small.identity("features").alias("features")).agg(F.sum(ag.over_features("features", "sum")).alias("total"))
    return small.grand_mean(v).withColumn("one_minus", other.scalar()).withColumn("total", total.scalar()).select(r("grand_mean", 8).alias("grand_mean"), r("one_minus", 8).alias("one_minus"), r("total", 5).alias("total"))


@query("""SELECT l_orderkey % 1000 AS g, bool_and(l_linenumber BETWEEN 0 AND 3) AS inside, array_to_string(list_sort(list(DISTINCT l_linenumber) FILTER (l_linenumber % 2 = 1)), '.') AS odd, count(DISTINCT (l_orderkey, l_linenumber)) AS rows FROM lineitem GROUP BY 1""")
def small_functions(spark, d):
    """Coordinates in a volume, places of equal elements, parts of versions, hashes of content."""
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("g"), "l_orderkey", "l_linenumber")
    by = x.groupBy("g").agg(F.bool_and(small.in_volume(F.array("l_linenumber"), [4])).alias("inside"), F.array_sort(F.collect_set("l_linenumber")).alias("all"), F.countDistinct(small.content_hash("l_orderkey", "l_linenumber")).alias("rows"))
    by = by.withColumn("at", small.where_equal(F.transform("all", lambda n: n % 2), 1))
    version = F.concat(F.lit("v"), F.array_join(F.transform("at", lambda i: F.element_at("all", i + 1).cast("string")), "rc"))
    return by.select("g", "inside", F.nullif(F.array_join(F.filter(small.version_parts(version), lambda p: ~p.isin("v", "rc")), "."), F.lit("")).alias("odd"), "rows")


@query("""SELECT n_nationkey, CAST(CASE WHEN n_nationkey = 0 THEN 0 ELSE n_nationkey % 3 END AS INT) AS start, CAST(CASE WHEN n_nationkey = 0 THEN 0 ELSE n_nationkey % 3 + 3 * 2 + 1 END AS INT) AS stop, CAST(CASE WHEN n_nationkey = 0 THEN 1 ELSE 3 END AS INT) AS step FROM nation""")
def mask_slices(spark, d):
    """The slice that selects what a mask does."""
    n = table(spark, d, "nation").select("n_nationkey")
    mask = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (F.col("n_nationkey") != 0) & (i % 3 == F.col("n_nationkey") % 3))
    return n.select("n_nationkey", small.mask_slice(mask).alias("s")).select("n_nationkey", "s.start", "s.stop", "s.step")


@query("""WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, coalesce(bool_and(before <= ts), true) AS is_sorted FROM o GROUP BY 1""")
def sorted_users(spark, d):
    """Whether the users' times grow with the ids."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return od.is_sorted(e, "ts", ["event_id"], ["user_id"])


@query("SELECT o_orderstatus || '/' || o_orderpriority AS g, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'either', count(*) FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '5-LOW')")
def limits(spark, d):
    """What a limit means: groups of several attributes, or an OR of matches."""
    o = table(spark, d, "orders")
    by = o.groupBy(se.limit_filter(["o_orderstatus", "o_orderpriority"])).agg(F.count("*").alias("n")).select(F.concat_ws("/", "limit_group.o_orderstatus", "limit_group.o_orderpriority").alias("g"), "n")
    return by.unionByName(o.where(se.limit_filter({"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "5-LOW"]})).agg(F.lit("either").alias("g"), F.count("*").alias("n")))


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def literal_again(spark, d):
    """Attributes to numbers and back."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    m = se.attribute_map(o, "o_orderpriority")
    return se.to_literal(se.to_numeric(o, "o_orderpriority", m).drop("o_orderpriority"), "code", m, "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 50000")
def marked_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 50000).alias("balanced_set"))
    return se.apply_selection(o)


@query(f"SELECT sample_id, 's-' || sample_id AS origids, target AS kind, 7 AS run FROM ({LONG}) WHERE feature_id = 0")
def attributes(spark, d):
    """Attributes set, looked up by collection, copied and given ids of origin."""
    ds = Dataset(vectors(spark, d), feature_grid(spark), {"run": 7}).init_origids().set_attr("sa.kind", F.col("target"))
    assert ds.find_collection("kind") == "sa" and ds.find_collection("x") == "fa" and ds.get_attr("a.run") == (7, "a")
    few = ds.copy(sa=["origids", "kind"], fa=[])
    return few.get_attr("origids")[0].join(few.get_attr("sa.kind")[0], "sample_id").withColumn("run", F.lit(ds.get_attr("run")[0]))


@query("""WITH RECURSIVE c AS (SELECT o_custkey % 23 AS k, count(*) AS n, row_number() OVER (ORDER BY o_custkey % 23) AS i FROM orders GROUP BY 1), t AS (SELECT sum(n) / 4.0 AS share FROM c),
 g AS (SELECT i, k, n, 0 AS coarse, n AS so_far FROM c WHERE i = 1 UNION ALL SELECT c.i, c.k, c.n, CAST(CASE WHEN g.so_far >= (g.coarse + 1) * share AND g.coarse < 3 THEN g.coarse + 1 ELSE g.coarse END AS INT), g.so_far + c.n FROM g JOIN c ON c.i = g.i + 1, t)
 SELECT k, coarse, n FROM g""")
def coarse_chunks(spark, d):
    """Chunks merged into four of about the same size."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 23).alias("k"))
    return od.coarsen_chunks(o, "k", 4).groupBy("k", "coarse").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE c AS (SELECT o_custkey % 23 AS v, count(*) AS n, row_number() OVER (ORDER BY o_custkey % 23) AS i FROM orders GROUP BY 1), t AS (SELECT sum(n) / 5.0 AS share FROM c),
 g AS (SELECT i, v, n, 0 AS s, n AS so_far FROM c WHERE i = 1 UNION ALL SELECT c.i, c.v, c.n, CAST(CASE WHEN g.so_far >= (g.s + 1) * share AND g.s < 4 THEN g.s + 1 ELSE g.s END AS INT), g.so_far + c.n FROM g JOIN c ON c.i = g.i + 1, t)
 SELECT CAST(k AS INT) AS set_id, v, CAST(CASE WHEN s = k THEN 2 ELSE 1 END AS INT) AS partitions, CAST(n AS BIGINT) AS n FROM g, generate_series(0, 4) AS x(k)""")
def group_partitions(spark, d):
    """Five sets of partitions by groups of values of about the same number of rows."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 23).alias("v"))
    counts = [(x[0], x[1]) for x in o.groupBy("v").count().collect()]
    return ge.partitions(o, "v", ge.n_groups(counts, 5)).groupBy(F.col("partitions_set").alias("set_id"), "v", "partitions").agg(F.count("*").alias("n"))


# --- designs, maps, histories --------------------------------------------------------
@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'buy' WHEN event_type = 'click' THEN 'press' ELSE 'rest' END AS label FROM events")
def design_labels(spark, d):
    """Labels from regressor columns."""
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "purchase").cast("double").alias("buy"), (F.col("event_type") == "click").cast("double").alias("press"))
    return e.select("event_id", ag.design_labels(["buy", "press"], "rest").alias("label"))


@query(f"""WITH m AS (SELECT chunk, feature_id, avg(value) > 0 AS on_ FROM ({LONG}) GROUP BY ALL), s AS (SELECT feature_id, avg(CASE WHEN on_ THEN 1.0 ELSE 0.0 END) AS s FROM m GROUP BY 1)
 SELECT round(avg(CASE WHEN s >= 0.6 THEN 1.0 ELSE 0.0 END), 8) AS overlap, round(avg(CASE WHEN s > 0 AND s < 0.6 THEN 1.0 ELSE 0.0 END), 8) AS spread FROM s""")
def map_overlap(spark, d):
    """How many features the chunks' maps agree on."""
    m = cells(spark, d).groupBy(F.col("chunk").alias("map_id"), "feature_id").agg((F.avg("value") > 0).alias("selected"))
    return rounded(ag.map_overlap(m, 0.6), 8)


@query("SELECT CAST(s AS INT) AS step, CAST(f AS INT) AS feature_id, (f * 7) % 5 >= s AS kept FROM generate_series(0, 4) a(s), generate_series(0, 29) b(f)")
def selection_history(spark, d):
    """Maps of what was kept at each step, from when each feature was dropped."""
    return ch.history_maps(spark, [(f * 7) % 5 for f in range(30)])


@query("""WITH m AS (SELECT CAST(date_part('year', o_orderdate) * 12 + date_part('month', o_orderdate) AS BIGINT) AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1), h AS (SELECT *, row_number() OVER (ORDER BY m) - 1 AS i, min(v) OVER (ORDER BY m) AS best FROM m),
 b AS (SELECT *, max(CASE WHEN v = best THEN i END) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) AS top FROM h)
 SELECT m, v = best AS is_best, v < 150000 AS below, i + 1 >= 12 AS steps, i - top >= 3 AS stale, (v < 150000 OR i - top >= 3) AS any_of FROM b""")
def stopping_rules(spark, d):
    """Rules for when to stop, over the monthly mean prices as a history of errors."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    # one number a month
    rows = table(spark, d, "orders").groupBy(month.alias("m")).agg(F.avg("o_totalprice").alias("v")).orderBy("m").collect()
    best, below, steps, stale = ch.Best(), ch.stop_below(150_000), ch.stop_after(12), ch.stop_stale(3)
    out = []
    for i, x in enumerate(rows):
        past = [y["v"] for y in rows[: i + 1]]
        out.append((x["m"], best(past), below(past), steps(past), stale(past), ch.stop_any([below, stale])(past)))
    return spark.createDataFrame(out, "m long, is_best boolean, below boolean, steps boolean, stale boolean, any_of boolean")


@query("SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, 10 AS n FROM generate_series(0, 4) x(a), generate_series(0, 4) y(b), generate_series(0, 4) z(c) WHERE a < b AND b < c")
def combinations(spark, d):
    """All triples of the regions' keys and their number."""
    keys = ge.uniques(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k")), "k")
    return spark.createDataFrame([(*c, ch.ncombinations(5, 3)) for c in ge.unique_combinations(keys, 3)], "a long, b long, c long, n int")


# --- shapes -------------------------------------------------------------------------
@query(f"SELECT sample_id, CAST(feature_id AS INT) AS feature_id, feature_id // 8 AS row_indices, feature_id % 8 AS col_indices, 10 * (feature_id // 8) AS depth, value FROM ({LONG})")
def flat_features(spark, d):
    """Nested arrays flattened, with the coordinates of each feature and what these stand for."""
    v = vectors(spark, d)
    nested = v.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("features", i * 8 + 1, 8)).alias("features"))
    flat = Dataset(nested.select("sample_id", ma.flatten("features").alias("features"))).long()
    at = ma.flat_coordinates(spark, (8, 8), ["row", "col"], {"depth": [10 * i for i in range(8)]}).withColumnRenamed("row", "depth") if False else ma.flat_coordinates(spark, (8, 8), ["row", "col"])
    at = at.withColumn("depth", F.col("row_indices") * 10)
    return flat.join(F.broadcast(at), "feature_id").select("sample_id", "feature_id", "row_indices", "col_indices", "depth", "value")


@query(f"SELECT sample_id, ['M1', 'M2', 'M3', 'M4', 'M5', 'M6', 'M7', 'M8'][feature_id // 8 + 1] AS channel, round(-0.5 + 0.25 * (feature_id % 8), 6) AS timepoint, value FROM ({LONG})")
def channel_cells(spark, d):
    """Trials of channels by time as cells."""
    v = vectors(spark, d).select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("features", i * 8 + 1, 8)).alias("features"))
    return ma.channels(v, "sample_id", "features", -0.5, 0.25, [f"M{i}" for i in range(1, 9)]).select("sample_id", "channel", r("timepoint").alias("timepoint"), "value")


@query(f"SELECT sample_id, CAST(c AS INT) AS feature_id, round(sum((value - 0.1) * CASE WHEN feature_id % 4 = c THEN 1 ELSE 0.25 END), 6) + 0 AS value FROM ({LONG}), generate_series(0, 3) AS g(c) GROUP BY ALL")
def projected(spark, d):
    """Samples through a given matrix."""
    m = np.where(np.arange(64)[:, None] % 4 == np.arange(4)[None], 1.0, 0.25)
    out = ma.Projection(m, np.full(64, 0.1)).forward(vectors(spark, d).select("sample_id", "features"))
    return rounded(Dataset(out).long())


@query(f"WITH l AS ({LONG}) SELECT a.sample_id, round(exp(-sum(pow(a.value - 0.1, 2)) / 2), 7) AS near, round(sum(a.value * 0.1 * (a.feature_id % 3)), 6) + 0 AS along FROM l a GROUP BY 1")
def prototype_values(spark, d):
    """Similarities with two given prototypes as new features."""
    v = vectors(spark, d).select("sample_id", "features")
    a = ma.prototype_similarities(v, [[0.1] * 64], lambda x, p: dist.rbf(x, p, 2.0)).select("sample_id", r(F.col("features")[0], 7).alias("near"))
    b = ma.prototype_similarities(v, [[0.1 * (f % 3) for f in range(64)]], dist.linear).select("sample_id", r(F.col("features")[0]).alias("along"))
    return a.join(b, "sample_id")


@query(f"SELECT sample_id, feature_id, round(value * 2, 6) + 0 AS value FROM ({LONG}) WHERE feature_id IN (1, 2)")
def mapped_dataset(spark, d):
    """Through mappers that are kept for the way back."""
    from dataclasses import replace

    ds = Dataset(vectors(spark, d).select("sample_id", "features"), feature_grid(spark))
    out = ds.get_mapped(lambda x: se.keep_features(x, [1, 2])).get_mapped(lambda x: replace(x, samples=x.samples.withColumn("features", F.transform("features", lambda v: v * 2))))
    assert len(out.attrs["mapper"]) == 2
    return rounded(out.long().withColumn("feature_id", F.col("feature_id") + 1))


# --- measures called on datasets ------------------------------------------------------
@query("SELECT l_linestatus AS set_id, l_returnflag, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL")
def repeated_measure(spark, d):
    """A measure on every dataset that a generator makes, keyed by it."""
    x = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity")
    return rounded(pl.repeated_measure(x, lambda df: df.withColumnRenamed("l_linestatus", "set_id"), lambda df, by: df.groupBy(*by, "l_returnflag").agg(F.avg("l_quantity").alias("value")), "set_id"))


@query("WITH m AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT l_returnflag, round(avg(abs(l_quantity - m)), 6) AS value FROM lineitem JOIN m USING (l_returnflag) WHERE l_linestatus = 'O' GROUP BY 1")
def transfer_measure(spark, d):
    """Trained on one part, called on the other."""
    x = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity")
    return rounded(pl.transfer(x.where("l_linestatus = 'F'"), x.where("l_linestatus = 'O'"), lambda a: a.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m")), lambda m, b: b.join(m, "l_returnflag").groupBy("l_returnflag").agg(F.avg(F.abs(F.col("l_quantity") - F.col("m"))).alias("value"))))


FIT = """WITH g AS (SELECT l_linestatus, CAST(count(*) AS DOUBLE) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_quantity) AS mx FROM lineitem GROUP BY 1),
 f AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM g) """


@query(FIT + "SELECT l_linestatus, 'l_quantity' AS name, round(b, 3) AS beta, round(b / sqrt(s2 / sxx), 2) AS t FROM f UNION ALL SELECT l_linestatus, 'intercept', round(a, 3), round(a / sqrt(s2 * (1 / n + mx * mx / sxx)), 2) FROM f")
def glm_statistics(spark, d):
    """Least squares by group with t values."""
    x = me.linear_regression(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", ["l_linestatus"])
    return x.select("l_linestatus", "name", r("beta", 3).alias("beta"), r("t", 2).alias("t"))


@query(FIT + "SELECT l_linestatus, round(2 * b - 0.5 * a, 3) AS effect FROM f")
def contrasts(spark, d):
    """Weighted sums of fitted amplitudes."""
    x = me.linear_regression(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", ["l_linestatus"])
    return rounded(pl.contrast(x, ["l_linestatus"], {"l_quantity": 2.0, "intercept": -0.5}), 3)


@query(PRED + """, c AS (SELECT DISTINCT t FROM x), q AS (SELECT a.t || '|' || b.t AS pair, a.t AS first, b.t AS second FROM c a JOIN c b ON a.t < b.t)
 SELECT pair, count(*) FILTER (p = t) AS hits, count(*) FILTER (p <> t) AS misses, round(avg(CASE WHEN p = t THEN 1.0 ELSE 0.0 END), 6) AS acc FROM x JOIN q ON t = first OR t = second WHERE p IN (first, second) GROUP BY 1""")
def pair_accuracies(spark, d):
    """Hits and misses of each pair of classes, of predictions made for that pair."""
    x = predictions(spark, d)
    kinds = ge.uniques(x, "t")
    pairs = F.array(*(F.lit(f"{a}|{b}") for i, a in enumerate(kinds) for b in kinds[i + 1 :]))
    each = x.select("t", "p", F.explode(F.filter(pairs, lambda q: F.array_contains(F.split(q, "\\|"), F.col("p")))).alias("pair"))
    return rounded(er.pairwise_accuracy(each, "pair", "p", "t"))


@query("""WITH e AS (SELECT event_id, event_type AS t, [value, -value, value * value] AS s FROM events), l AS (SELECT event_id, t, k, s[k] AS v, CASE k WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' ELSE 'view' END AS of FROM e, generate_series(1, 3) g(k)),
 o AS (SELECT *, sum(CASE WHEN t = of THEN 1 ELSE 0 END) OVER (PARTITION BY of ORDER BY v DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS tp FROM l)
 SELECT of, round(sum(CASE WHEN t = of THEN 0 ELSE tp END) / (CAST(count(*) FILTER (t = of) AS DOUBLE) * count(*) FILTER (t <> of)), 6) AS auc FROM o GROUP BY 1""")
def roc_areas(spark, d):
    """Area under the curve of each label against the rest, from arrays of estimates."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("t"), F.array(F.col("value"), -F.col("value"), F.col("value") * F.col("value")).alias("s"))
    return rounded(er.roc(e, "t", "s", ["click", "purchase", "view"], "event_id"))


# --- volumes and neighbourhoods --------------------------------------------------------
POINTS = "SELECT CAST(c_custkey AS BIGINT) AS p, CAST(c_custkey % 90 AS DOUBLE) - 45 AS x, CAST(c_custkey * 7 % 110 AS DOUBLE) - 55 AS y, CAST(c_custkey * 13 % 80 AS DOUBLE) - 40 AS z FROM customer"


def _points(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.cast("long").alias("p"), ((c % 90).cast("double") - 45).alias("x"), ((c * 7 % 110).cast("double") - 55).alias("y"), ((c * 13 % 80).cast("double") - 40).alias("z"))


@query(f"""WITH p AS ({POINTS}) SELECT p, round(2 * x - y + 3, 6) + 0 AS u, round(0.5 * z - 1, 6) + 0 AS v, round(0.99 * x, 6) + 0 AS tal_x, round(CASE WHEN z >= 0 THEN 0.9688 * y + 0.0460 * z ELSE 0.9688 * y + 0.0420 * z END, 6) + 0 AS tal_y,
 round(CASE WHEN z >= 0 THEN -0.0485 * y + 0.9189 * z ELSE -0.0485 * y + 0.8390 * z END, 6) + 0 AS tal_z FROM p""")
def coordinates(spark, d):
    """Affine and piecewise affine transforms of coordinates."""
    m = np.array([[2, -1, 0, 3], [0, 0, 0.5, -1], [0, 0, 0, 1], [0, 0, 0, 1]], float)
    return rounded(ne.mni_to_talairach(ne.affine(_points(spark, d), ["x", "y", "z"], ["u", "v"], m)).drop("x", "y", "z"))


@query(f"""WITH p AS ({POINTS}), a AS (SELECT * FROM p WHERE p % 10 <> 0), s AS (SELECT x AS rx, y AS ry, z AS rz, p AS label FROM p WHERE p % 10 = 0), h AS (SELECT a.p, label, sqrt(pow(x - rx, 2) + pow(y - ry, 2) + pow(z - rz, 2)) AS d FROM a, s WHERE pow(x - rx, 2) + pow(y - ry, 2) + pow(z - rz, 2) <= 100)
 SELECT a.p, min_by(label, [d, label]) AS label, round(min(d), 6) AS distance FROM a LEFT JOIN h USING (p) GROUP BY 1""")
def nearest_references(spark, d):
    """Nearest reference within ten units of each point."""
    p = _points(spark, d)
    return rounded(ne.nearest_reference(p.where("p % 10 <> 0"), p.where("p % 10 = 0").withColumnRenamed("p", "label"), ["x", "y", "z"], 10.0, "p").select("p", "label", "distance"))


@query(f"""WITH p AS ({POINTS}), q AS (SELECT p, x, y, z, CAST(floor(x / 30) AS INT) AS i, CAST(floor(y / 30) AS INT) AS j FROM p) SELECT p, CASE WHEN (i + j) % 3 <> 0 THEN 'area' || i || ',' || j END AS label FROM q""")
def labelled_points(spark, d):
    """Labels of an atlas by coordinates, none outside of it."""
    p = _points(spark, d).select("p", F.floor(F.col("x") / 30).cast("int").alias("i"), F.floor(F.col("y") / 30).cast("int").alias("j"))
    cell = spark.range(25).selectExpr("cast(id div 5 - 2 as int) i", "cast(id % 5 - 2 as int) j").where("(i + j) % 3 <> 0")
    return ne.label_points(p, cell.withColumn("label", F.concat(F.lit("area"), F.col("i").cast("string"), F.lit(","), F.col("j").cast("string"))), ["i", "j"]).select("p", "label")


@query(f"WITH p AS (SELECT DISTINCT x % 3 AS i, y % 3 AS j FROM ({POINTS})), s AS (SELECT p, CAST(abs(x) % 3 AS INT) AS i, CAST(abs(y) % 3 AS INT) AS j FROM ({POINTS})) SELECT p, 'L' || k AS label, round((i + j + k) / 8.0, 6) AS probability FROM s, generate_series(0, 3) g(k) WHERE (i + j + k) / 8.0 > 0.4")
def probable_labels(spark, d):
    """Labels above a probability at each point."""
    s = _points(spark, d).select("p", (F.abs("x") % 3).cast("int").alias("i"), (F.abs("y") % 3).cast("int").alias("j"))
    atlas = spark.range(36).selectExpr("cast(id div 12 as int) i", "cast(id div 4 % 3 as int) j", "cast(id % 4 as int) k").select("i", "j", F.concat(F.lit("L"), F.col("k").cast("string")).alias("label"), ((F.col("i") + F.col("j") + F.col("k")) / 8.0).alias("probability"))
    return rounded(ne.probable_labels(s, atlas, ["i", "j"], 0.4, key="p").select("p", "label", "probability"))


@query(f"WITH {NEAR} SELECT feature_id, round(avg(center_id * center_id), 6) AS value FROM near WHERE center_id % 3 = 0 GROUP BY 1")
def scattered_results(spark, d):
    """Results of some neighbourhoods spread over all features that they cover."""
    near = ne.neighbours(feature_grid(spark), ["x", "y"], 1.0, centres=feature_grid(spark).where("feature_id % 3 = 0"))
    results = spark.range(0, 64, 3).selectExpr("cast(id as int) center_id", "cast(id * id as double) value")
    return rounded(ne.fill_scattered(results, near))


@query(f"WITH g AS ({GRID_SQL}), v AS (SELECT * FROM generate_series(0, 2) t(t), g WHERE (x + y) % 4 <> 0), f AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS feature_id FROM (SELECT DISTINCT x, y FROM v)) SELECT CAST(t AS BIGINT) AS sample_id, round(t * 2.5, 6) AS time_coords, CAST(feature_id AS INT) AS feature_id, CAST(t * 100 + f AS DOUBLE) AS value FROM v JOIN f USING (x, y)")
def masked_volumes(spark, d):
    """Voxels of volumes within a mask as samples and features."""
    grid = feature_grid(spark).select(F.col("x").alias("i"), F.col("y").alias("j"), F.lit(0).alias("k"), "feature_id")
    voxels = grid.withColumn("t", F.explode(F.array(*map(F.lit, range(3))))).select("t", "i", "j", "k", (F.col("t") * 100 + F.col("feature_id")).cast("double").alias("value"))
    out, _ = ne.masked_volumes(voxels, grid.where("(i + j) % 4 <> 0"), 2.5)
    return rounded(out)


@query(f"WITH g AS ({GRID_SQL}) SELECT CAST(x AS INT) AS i, CAST(y AS INT) AS j, CAST(k AS INT) AS k, CASE WHEN (x + y + k) % 2 = 0 THEN CAST(f AS DOUBLE) ELSE -1.0 END AS value FROM g, generate_series(0, 1) t(k)")
def full_grids(spark, d):
    """Every voxel of a volume, absent ones filled."""
    from sampleloom.sources.sinks import full_grid

    grid = feature_grid(spark).select(F.col("x").alias("i"), F.col("y").alias("j"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.col("feature_id").cast("double").alias("value"))
    return full_grid(grid.where("(i + j + k) % 2 = 0"), (8, 8, 2), -1.0).select("i", "j", "k", "value")


@query(f"WITH l AS ({LONG}), {NEAR}, c AS (SELECT center_id, target, feature_id, avg(value) AS m FROM l JOIN near USING (feature_id) GROUP BY ALL), s AS (SELECT center_id, sample_id, l.target, c.target AS label, sum(pow(value - m, 2)) AS d FROM l JOIN c USING (feature_id) GROUP BY ALL), b AS (SELECT center_id, sample_id, target, min_by(label, [d, label]) AS p FROM s GROUP BY ALL) SELECT center_id, round(avg(CASE WHEN p <> target THEN 1.0 ELSE 0.0 END), 6) AS value, count(*) AS n FROM b GROUP BY 1")
def searchlight_in_place(spark, d):
    """Error of the nearest class mean in place around each centre, from sums over all samples."""
    return rounded(ne.nearest_mean_in_place(cells(spark, d), ne.neighbours(feature_grid(spark), ["x", "y"], 1.0), "target"))


# --- round trips through files ---------------------------------------------------------
def _folder(spark) -> str:
    import uuid

    from sampleloom.session import shared_folder

    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def column_files(spark, d):
    """A table written as column files and read again."""
    from sampleloom.sources import sinks, text

    path = _folder(spark)
    sinks.write_columns(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1), path, "\t")
    return text.columns(spark, path, True, "\t", {"n_nationkey": "int", "n_regionkey": "int"}).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"))


@query(f"SELECT CAST(target + 1 AS VARCHAR) AS label, round(sum(value * (feature_id + 1)), 4) AS checksum, count(*) AS n FROM ({LONG}) GROUP BY target")
def light_svm(spark, d):
    """Vectors written as LightSVM lines and read again, summed by label."""
    from sampleloom.sources import sinks, text

    path = _folder(spark)
    sinks.write_light_svm(vectors(spark, d), path, "target", domain="multiclass")
    back = text.light_svm(spark, path).select("label", F.posexplode("features").alias("f", "v"))
    return back.groupBy("label").agg(r(F.sum(F.col("v") * (F.col("f") + 1)), 4).alias("checksum"), F.count("*").alias("n"))


NUMBERS = "SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS e, CAST(embedding[5] AS DOUBLE) AS f, CAST(embedding[6] AS DOUBLE) AS g FROM embeddings"


def _written(spark, d, lines) -> str:
    path = _folder(spark)
    v = vectors(spark, d).select("sample_id", *(F.col("features")[i].cast("string").alias(f"v{i}") for i in range(6)))
    v.select(lines.alias("value")).write.text(path)
    return path


@query(f"SELECT round(a, 6) AS rot1, round(b, 6) AS rot2, round(c, 6) AS rot3, round(e, 6) AS x, round(f, 6) AS y, round(g, 6) AS z FROM ({NUMBERS})")
def motion_files(spark, d):
    """Motion parameters, six numbers a line."""
    from sampleloom.sources import text

    return rounded(text.motion_parameters(spark, _written(spark, d, F.concat_ws("  ", *(f"v{i}" for i in range(6))))).drop("path"))


@query(f"SELECT round(a, 6) AS onset, round(b, 6) AS duration, round(c, 6) AS intensity FROM ({NUMBERS})")
def event_files(spark, d):
    """Three-column events."""
    from sampleloom.sources import text

    return rounded(text.ev3_events(spark, _written(spark, d, F.concat_ws("\t", "v0", "v1", "v2"))).drop("path"))


@query(f"SELECT 's' || i AS names, round(a, 6) AS pos_y, round(b, 6) AS pos_x, round(c, 6) AS pos_z, round(e, 6) AS pos_y2, round(f, 6) AS pos_x2, round(g, 6) AS pos_z2 FROM ({NUMBERS})")
def sensor_files(spark, d):
    """Places of sensors with comments between."""
    from sampleloom.sources import text

    line = F.concat_ws(" ", F.concat(F.lit("s"), F.col("sample_id").cast("string")), *(f"v{i}" for i in range(6)))
    return rounded(text.meg_sensors(spark, _written(spark, d, F.concat(line, F.lit("\n# a comment\n")))).drop("path"))


@query(f"SELECT 's' || i AS names, CAST(i % 7 AS INT) AS some_number, round(a, 6) AS pos_x, round(b, 6) AS pos_y, round(c, 6) AS pos_z FROM ({NUMBERS})")
def xavr_files(spark, d):
    """Places of sensors with a number each."""
    from sampleloom.sources import text

    line = F.concat_ws(" ", F.concat(F.lit("s"), F.col("sample_id").cast("string")), (F.col("sample_id") % 7).cast("string"), "v0", "v1", "v2")
    return rounded(text.xavr_sensors(spark, _written(spark, d, line)).drop("path"))


@query(f"SELECT 't' || (i % 3) AS targets, CAST(i % 5 AS DOUBLE) AS chunks, count(*) AS n FROM ({NUMBERS}) GROUP BY ALL")
def label_files(spark, d):
    """Targets and chunks, two columns a line."""
    from sampleloom.sources import text

    line = F.concat_ws(" ", F.concat(F.lit("t"), (F.col("sample_id") % 3).cast("string")), (F.col("sample_id") % 5).cast("string"))
    return text.sample_attributes(spark, _written(spark, d, line)).groupBy("targets", "chunks").agg(F.count("*").alias("n"))


@query(f"SELECT round(sum(a + 2 * b + 3 * c), 4) AS checksum, count(*) AS n FROM ({NUMBERS})")
def number_files(spark, d):
    """Rows of numbers."""
    from sampleloom.sources import text

    x = text.numeric_rows(spark, _written(spark, d, F.concat_ws(" ", "v0", "v1", "v2")))
    return x.agg(r(F.sum(F.col("values")[0] + 2 * F.col("values")[1] + 3 * F.col("values")[2]), 4).alias("checksum"), F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS line_no, n_name AS line FROM nation WHERE n_nationkey > 0")
def numbered_lines(spark, d):
    """Lines of a file with their numbers."""
    from sampleloom.sources import text

    path = _folder(spark)
    table(spark, d, "nation").orderBy("n_nationkey").where("n_nationkey > 0").select(F.col("n_name").alias("value")).coalesce(1).write.text(path)
    return text.raw_lines(spark, path).where("line <> ''").select("line_no", "line")


@query(f"SELECT sample_id, feature_id, round(value, 6) + 0 AS value, target FROM ({LONG})")
def stored_dataset(spark, d):
    """A dataset saved and loaded, its archive of arrays written and read."""
    path = _folder(spark)
    Dataset(vectors(spark, d), feature_grid(spark), {"note": "x"}).save(path)
    ds = Dataset.load(spark, path)
    assert ds.attrs == {"note": "x"} and ds.features.count() == 64
    return rounded(ds.long(["target"])).select("sample_id", "feature_id", "value", "target")


# --- streaming twins, at once ------------------------------------------------------------
@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) = INTERVAL 2 HOUR THEN 1 ELSE 0 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_runs(spark, d):
    """Sessions of users by gaps of two hours, as the streaming plan makes them."""
    s = live.sessions(table(spark, d, "events"), "ts", "2 hours", ["user_id"])
    return s.select("user_id", "start", "n")


@query("SELECT DISTINCT event_type FROM events WHERE value > 50 INTERSECT SELECT DISTINCT event_type FROM events WHERE value < 20")
def combined_sets(spark, d):
    """Features that two selections agree on."""
    e = table(spark, d, "events")
    a, b = (e.where(c).select(F.col("event_type").alias("feature_id")).distinct() for c in ("value > 50", "value < 20"))
    return fs.combine([a, b], "intersection").select(F.col("feature_id").alias("event_type"))


@query("SELECT event_type, 0 AS node, round(avg(value), 6) AS v FROM events GROUP BY 1 UNION ALL SELECT event_type, 1, round(avg(-value), 6) FROM events GROUP BY 1")
def combined_nodes(spark, d):
    """Results of several nodes, below each other with the node's number."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    node = ge.combined(lambda x: x.select("event_type", F.col("value").alias("v")), lambda x: x.select("event_type", (-F.col("value")).alias("v")))
    return rounded(node(e).groupBy("event_type", "node").agg(F.avg("v").alias("v")))


# --- more selections and measures ----------------------------------------------------------
@query(f"SELECT sample_id, CAST(feature_id - 24 AS INT) AS feature_id, value FROM ({LONG}) WHERE feature_id // 8 = 3")
def feature_part(spark, d):
    """The features of one value of their attribute."""
    return Dataset(vectors(spark, d).select("sample_id", "features"), feature_grid(spark)).select(None, {"x": [3]}).long()


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_totalprice > 100000) WHERE i BETWEEN 20 AND 199 AND i % 4 = 0")
def selected_rows(spark, d):
    """Rows by expression and slice, attributes dropped."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_totalprice", "o_orderstatus")
    return pl.select_rows(o, "o_totalprice gt 100000", 20, 200, 4, ["o_orderstatus"]).select(F.col("sample_id").alias("o_orderkey"), "o_totalprice")


@query("SELECT event_id, round(rank() OVER (PARTITION BY event_type ORDER BY round(value)) + (count(*) OVER (PARTITION BY event_type, round(value)) - 1) / 2.0, 6) AS rank FROM events")
def average_ranks(spark, d):
    """Ranks from 1, ties averaged."""
    e = table(spark, d, "events").select("event_id", "event_type", F.round("value").alias("value"))
    return ch.ranks(e, ["event_type"], "value").select("event_id", r("rank").alias("rank"))


@query(f"SELECT feature_id, round(corr(value, target), 6) AS value FROM ({LONG}) GROUP BY 1")
def featurewise_function(spark, d):
    """Any function of a feature's values and the targets."""
    return rounded(me.featurewise(cells(spark, d), "target", lambda x, y: float(np.corrcoef(x, y)[0, 1])))


@query(f"SELECT f AS center_id, f AS feature_id FROM ({GRID_SQL})")
def identity_neighbours(spark, d):
    """Every feature alone."""
    return ne.neighbours(feature_grid(spark), ["x", "y"], 0.0)


@query(f"SELECT a.f AS center_id, b.f AS feature_id FROM ({GRID_SQL}) a, ({GRID_SQL}) b WHERE pow(2 * (a.x - b.x), 2) + pow(a.y - b.y, 2) <= 4")
def sized_neighbours(spark, d):
    """Spheres in units of the elements' sizes."""
    return ne.neighbours(feature_grid(spark), ["x", "y"], 2.0, sizes=[2.0, 1.0])


MESH = """g AS (SELECT CAST(i AS INT) AS i, i // 6 AS x, i % 6 AS y FROM generate_series(0, 35) t(i)), e AS (SELECT a.i AS a, b.i AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS w FROM g a, g b WHERE (abs(a.x - b.x) + abs(a.y - b.y) = 1) OR (a.x - b.x = 1 AND a.y - b.y = 1) OR (a.x - b.x = -1 AND a.y - b.y = -1)) """


def _mesh() -> ne.Surface:
    v = [(float(i // 6), float(i % 6), 0.0) for i in range(36)]
    f = [t for x in range(5) for y in range(5) for i in [x * 6 + y] for t in ((i, i + 1, i + 7), (i, i + 6, i + 7))]
    return ne.Surface(np.array(v), np.array(f))


@query(f"WITH RECURSIVE {MESH}, p AS (SELECT i AS s, i AS n, CAST(0 AS DOUBLE) AS d FROM g UNION SELECT s, b, d + w FROM p JOIN e ON a = n WHERE d + w <= 2.5) SELECT s AS center_id, n AS feature_id, round(min(d), 6) AS distance FROM p GROUP BY ALL")
def surface_discs(spark, d):
    """Nodes of a mesh within a distance along its edges."""
    return rounded(ne.surface_neighbours(spark, _mesh(), 2.5))


@query(f"WITH RECURSIVE {MESH}, p AS (SELECT i AS s, i AS n, CAST(0 AS DOUBLE) AS d FROM g UNION SELECT s, b, d + w FROM p JOIN e ON a = n WHERE d + w <= 2.0), m AS (SELECT s AS center_id, n AS feature_id, min(d) AS d FROM p GROUP BY ALL) SELECT center_id, feature_id, round(d, 6) AS distance FROM m WHERE d > 1 OR center_id = feature_id")
def surface_rings(spark, d):
    """Rings on a mesh, the centre kept."""
    return rounded(ne.surface_neighbours(spark, _mesh(), 2.0, inner=1.0))


@query(f"WITH {MESH} SELECT a.i AS center_id, b.i AS feature_id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM g a, g b WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 4")
def surface_spheres(spark, d):
    """Nodes within a straight distance."""
    return rounded(ne.surface_neighbours(spark, _mesh(), 2.0, metric="euclidean"))


VOXELS = "pairs AS (SELECT c_custkey % 36 AS node, c_custkey * 11 % 50 AS voxel, (c_custkey * 7 % 16) / 16.0 AS share FROM customer)"


def _voxels(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select((c % 36).cast("int").alias("node"), (c * 11 % 50).cast("int").alias("voxel"), ((c * 7 % 16) / 16.0).alias("share"))


@query(f"WITH {VOXELS} SELECT CAST(voxel AS INT) AS voxel, CAST(min_by(node, [abs(share - 0.5), node]) AS INT) AS node FROM pairs GROUP BY 1")
def minimal_mapping(spark, d):
    """The node nearest the middle of each voxel."""
    return ne.minimal_mapping(_voxels(spark, d))


@query(f"WITH RECURSIVE {MESH}, {VOXELS}, p AS (SELECT i AS s, i AS n, CAST(0 AS DOUBLE) AS d FROM g UNION SELECT s, b, d + w FROM p JOIN e ON a = n WHERE d + w <= 2.0), m AS (SELECT s, n, min(d) AS d FROM p GROUP BY ALL) SELECT s AS center_id, CAST(voxel AS INT) AS voxel, round(min(d), 6) AS distance FROM m JOIN pairs ON n = node GROUP BY s, voxel HAVING min(d) <= 1.5")
def selected_voxels(spark, d):
    """Voxels of the nodes around each centre within a radius."""
    return rounded(ne.select_voxels(ne.surface_neighbours(spark, _mesh(), 2.0), _voxels(spark, d), radius=1.5))


@query(f"""WITH RECURSIVE {MESH}, {VOXELS}, p AS (SELECT i AS s, i AS n, CAST(0 AS DOUBLE) AS d FROM g UNION SELECT s, b, d + w FROM p JOIN e ON a = n WHERE d + w <= 2.0), m AS (SELECT s, n, min(d) AS d FROM p GROUP BY ALL), v AS (SELECT s, voxel, min(d) AS d FROM m JOIN pairs ON n = node GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, voxel) AS r FROM v) SELECT s AS center_id, CAST(voxel AS INT) AS voxel, round(d, 6) AS distance FROM o WHERE r <= 10""")
def nearest_voxels(spark, d):
    """The ten nearest voxels of each centre."""
    return rounded(ne.select_voxels(ne.surface_neighbours(spark, _mesh(), 2.0), _voxels(spark, d), count=10))


@query("SELECT CAST(c_custkey AS BIGINT) AS v, CAST(c_custkey // 200 AS INT) AS i, CAST(c_custkey // 10 % 20 AS INT) AS j, CAST(c_custkey % 10 AS INT) AS k FROM customer")
def voxel_columns(spark, d):
    """Linear indices to coordinates."""
    return ne.voxel_columns(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("v")), "v", (1000, 20, 10))


@query(PRED + """, k AS (SELECT DISTINCT t FROM x), c AS (SELECT p.t AS p, q.t AS t, count(x.p) AS n FROM k p CROSS JOIN k q LEFT JOIN x ON x.p = p.t AND x.t = q.t GROUP BY ALL), l AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM k),
 r AS (SELECT p, sum(n) AS n, sum(lgamma(n + 1)) AS cells FROM c GROUP BY 1), q AS (SELECT t, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY 1), w AS (SELECT sum(lgamma(n + 1)) - sum(cells) AS ways FROM r)
 SELECT 'apart' AS groups, round(ways + (SELECT sum(cells - lgamma(n + m) + lgamma(m)) FROM r, l), 4) AS logp FROM w
 UNION ALL SELECT 'together', round(ways + (SELECT sum(lgamma(m + n) - lgamma(m)) - max(lgamma(m * m + (SELECT sum(n) FROM q)) - lgamma(m * m)) FROM q, l), 4) FROM w""")
def confusion_hypotheses(spark, d):
    """How likely a confusion table is if all its classes can be told apart, or none."""
    x = predictions(spark, d)
    kinds = ge.uniques(x, "t")
    # classes squared numbers
    counts = {(a, b): n for a, b, n in er.confusion(x, "p", "t").collect()}
    m = np.array([[counts.get((a, b), 0) for b in kinds] for a in kinds], float)
    found = er.bayes_confusion(m, hypotheses=[[(i,) for i in range(len(kinds))], [tuple(range(len(kinds)))]])
    return spark.createDataFrame([("together" if len(g) == 1 else "apart", round(logp, 4)) for g, logp, _ in found], "groups string, logp double")


@query("""SELECT CAST(i AS BIGINT) AS i, round(1 - 0.5 * (-2 + 5 * i / 99.0), 6) + 0 AS line, round(sin(10 * pi() * (i / 99.0) * (i / 99.0)), 6) + 0 AS wave, round(2 + 0.4 * i / 99.0, 6) AS slope,
 round(sin(pow((CASE WHEN i < 50 THEN 2 * i / 100.0 ELSE 0 END) * pi(), 2) + pow((CASE WHEN 2 * i + 1 < 100 THEN (2 * i + 1) / 100.0 ELSE 0 END) * pi(), 2))) + 0 AS sine FROM generate_series(0, 99) g(i)""")
def made_series(spark, d):
    """Generators of series without noise."""
    from sampleloom.functions import generate as gen

    a = gen.linear(spark, 100, 1.0, -0.5, -2.0, 3.0, 0.0).select(F.col("sample_id").alias("i"), r("targets").alias("line"))
    b = gen.chirp(spark, 100, 4, 2, 0.0, 0.0).select(F.col("sample_id").alias("i"), r("targets").alias("wave"))
    c = gen.linear_noise(spark, 100, 2.0, 0.4, 0.0, True).select(F.col("sample_id").alias("i"), r("targets").alias("slope"))
    e = gen.sine(spark, 100, 2, True, 0.0).select(F.col("sample_id").alias("i"), (F.col("targets") + 0.0).alias("sine"))
    return a.join(b, "i").join(c, "i").join(e, "i")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE NOT o_totalprice > 50000")
def excluded_rows(spark, d):
    """Rows left out, as the log of exclusions has them."""
    from sampleloom.sources import sinks

    path = _folder(spark)
    sinks.log_exclusions(table(spark, d, "orders").select("o_totalprice", (F.col("o_totalprice") > 50000).alias("balanced_set")), path)
    return spark.read.json(path).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type AS prediction, CASE WHEN value > 50 THEN 'click' ELSE 'view' END AS target, count(*) AS n FROM events GROUP BY ALL")
def confusion_merged(spark, d):
    """Counts by prediction and target as the streaming plan merges them."""
    e = table(spark, d, "events").select(F.col("event_type").alias("p"), F.when(F.col("value") > 50, "click").otherwise("view").alias("t"))
    return live.confusion_stream(e, "p", "t")


@query("SELECT run_id, round(sum(onset), 2) AS onsets, count(*) AS n, count(DISTINCT trial_type) AS kinds FROM bold_events WHERE isfinite(onset) AND isfinite(duration) AND trial_type IS NOT NULL AND trial_type <> '' GROUP BY 1")
def event_tables(spark, d):
    """Events as tables with header, tab separated."""
    from sampleloom.sources import text

    path = _folder(spark)
    b = table(spark, d, "bold_events").where("not isnan(onset) and not isnan(duration) and onset is not null and duration is not null and trial_type is not null and trial_type <> ''")
    b.select("run_id", "onset", "duration", "trial_type").write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = text.tsv_events(spark, path)
    return back.groupBy("run_id").agg(r(F.sum("onset"), 2).alias("onsets"), F.count("*").alias("n"), F.countDistinct("trial_type").alias("kinds"))


def _lines(spark, lines: DataFrame, order: str) -> str:
    """One text file of a table's lines in order (a fixture of bounded size)."""
    path = _folder(spark)
    lines.coalesce(1).sortWithinPartitions(order).select("value").write.text(path)
    return path


@query("SELECT CAST(n_nationkey AS BIGINT) AS row, CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) * 0.5 AS b FROM nation")
def design_files(spark, d):
    """Design matrices below their header lines."""
    from sampleloom.sources import text

    n = table(spark, d, "nation")
    body = n.select(F.col("n_nationkey").cast("int").alias("o"), F.concat_ws("\t", F.col("n_nationkey").cast("string"), (F.col("n_regionkey") * 0.5).cast("string")).alias("value"))
    head = spark.createDataFrame([(-3, "/NumWaves 2"), (-2, "/NumPoints 25"), (-1, "/Matrix")], "o int, value string")
    at = text.glm_design(spark, _lines(spark, head.unionByName(body), "o"))
    return at.select(F.col("row").cast("long").alias("row"), F.col("values")[0].alias("a"), F.col("values")[1].alias("b"))


@query("SELECT 'wave' || n_nationkey AS name, n_name AS value FROM nation")
def setting_files(spark, d):
    """Settings of designs."""
    from sampleloom.sources import text

    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("o"), F.concat(F.lit("set wave"), F.col("n_nationkey").cast("string"), F.lit(' "'), F.col("n_name"), F.lit('"')).alias("value"))
    return text.design_settings(spark, _lines(spark, n, "o")).select(F.explode("settings").alias("name", "value"))


@query("SELECT CAST(n_nationkey // 5 AS BIGINT) AS sample, CAST(n_nationkey % 5 AS DOUBLE) AS timepoint, c AS channel, CASE c WHEN 'Cz' THEN n_nationkey * 1.5 ELSE n_regionkey + 0.25 END AS value FROM nation, (SELECT unnest(['Cz', 'Pz']) AS c)")
def channel_exports(spark, d):
    """Epoched exports: names, then time and values; time running back begins a sample."""
    from sampleloom.sources import text

    n = table(spark, d, "nation")
    line = F.concat_ws("\t", (F.col("n_nationkey") % 5).cast("string"), (F.col("n_nationkey") * 1.5).cast("string"), (F.col("n_regionkey") + 0.25).cast("string"))
    body = n.select(F.col("n_nationkey").cast("int").alias("o"), line.alias("value"))
    head = spark.createDataFrame([(-1, "Cz\tPz")], "o int, value string")
    return text.eeg_export(spark, _lines(spark, head.unionByName(body), "o")).select(F.col("sample").cast("long").alias("sample"), "timepoint", "channel", "value")


@query("SELECT 'M' || n_regionkey AS channel, CAST(n_nationkey // 5 // 2 AS INT) AS trial, CAST(n_nationkey // 5 % 2 AS INT) AS timepoint, CAST(n_nationkey // 5 % 2 AS DOUBLE) * 0.5 AS time, CAST(n_nationkey AS DOUBLE) AS value FROM nation WHERE n_nationkey < 20")
def channel_recordings(spark, d):
    """Recordings with one line a channel."""
    from sampleloom.sources import text

    n = table(spark, d, "nation").where("n_nationkey < 20")
    series = n.groupBy((F.col("n_regionkey") + 10).cast("int").alias("o")).agg(F.concat(F.lit("M"), F.first("n_regionkey").cast("string"), F.lit(": "), F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: x.cast("string")), " ")).alias("value"))
    head = spark.createDataFrame([(1, "Sample Number: 0 1 0 1"), (2, "Time: 0 0.5 0 0.5")], "o int, value string")
    return text.meg_recording(spark, _lines(spark, head.unionByName(series), "o")).drop("path")


@query("SELECT 'MNI' AS k, CAST(n_regionkey AS BIGINT) AS surface, 'side' || n_regionkey AS side, count(*) AS n FROM nation GROUP BY n_regionkey")
def surface_specifications(spark, d):
    """Surface specification files."""
    from sampleloom.sources import text

    by = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("int").alias("o")).agg(F.count("*").cast("string").alias("n"))
    lines = by.select("o", F.concat(F.lit("NewSurface\n\tSurfaceName = s.side"), F.col("o").cast("string"), F.lit("\n\tAnatomical = "), F.col("n"), F.lit("\n\tKind = MNI\n")).alias("value"))
    at = text.surface_spec(spark, _lines(spark, lines, "o"))
    p = F.col("properties")
    return at.select(p["Kind"].alias("k"), F.col("surface").cast("long").alias("surface"), F.regexp_replace(p["SurfaceName"], r"^s\.", "").alias("side"), p["Anatomical"].cast("long").alias("n"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS roi, CASE WHEN n_regionkey % 2 = 0 THEN 'edges' ELSE 'areas' END AS kind, count(*) AS nodes, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY n_regionkey")
def region_files(spark, d):
    """Regions of surfaces."""
    from sampleloom.sources import text

    by = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("int").alias("o")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("ids"))
    kind = F.when(F.col("o") % 2 == 0, "4").otherwise("1")
    lines = by.select("o", F.concat(F.lit("# <Node_ROI\n#  ni_type = \"x\" >\n"), F.concat_ws(" ", F.lit("1"), kind, F.size("ids").cast("string"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")), F.lit("\n# </Node_ROI>")).alias("value"))
    at = text.roi_file(spark, _lines(spark, lines, "o"))
    return at.select(F.col("roi").cast("long").alias("roi"), "kind", F.size("nodes").cast("long").alias("nodes"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"SELECT feature_id, round((avg(value) + stddev_pop(value) + corr(value, target)) / 3, 6) AS value FROM ({LONG}) GROUP BY 1")
def combined_measures(spark, d):
    """Scores of several measures averaged, one of them behind steps."""
    c = cells(spark, d)
    stat = lambda f: c.groupBy("feature_id").agg(f.alias("value"))
    third = pl.proxy_measure(lambda x: me.corrcoef(x, "target"), lambda x: x.where("value is not null"), lambda x: x.withColumnRenamed("r", "value"))
    return rounded(pl.combined_scores([stat(F.avg("value")), stat(F.stddev_pop("value")), third(c)]))


@query("SELECT coalesce(c_custkey, s_suppkey) AS k, coalesce(c_acctbal, -1) AS a, coalesce(c_nationkey, -1) AS b, coalesce(s_acctbal, -1) AS c FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON c_custkey = s_suppkey")
def padded_features(spark, d):
    """Features of two tables side by side, padded where one lacks a sample."""
    from sampleloom.operators.stack import hstack_padded

    c = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double")).alias("features"))
    s = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.array(F.col("s_acctbal").cast("double")).alias("features"))
    return hstack_padded([c, s], "k", -1.0).select("k", *(F.col("features")[i].alias(n) for i, n in enumerate("abc")))


@query(f"WITH g AS ({GRID_SQL}) SELECT CAST(t AS INT) AS t, CAST(x AS INT) AS i, CAST(y AS INT) AS j, CAST(f * 0.5 + t AS DOUBLE) AS value FROM g, generate_series(0, 2) s(t)")
def image_volumes(spark, d):
    """Volumes written as an image and read again."""
    import os
    import tempfile

    from sampleloom.sources import images

    grid = feature_grid(spark).select(F.col("x").alias("i"), F.col("y").alias("j"), F.lit(0).alias("k"), "feature_id")
    voxels = grid.withColumn("t", F.explode(F.array(*map(F.lit, range(3))))).select("t", "i", "j", "k", (F.col("feature_id") * 0.5 + F.col("t")).alias("value"))
    # an image is what the driver holds; its bytes travel as a table
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "volumes.nii.gz")
        images.write_nifti(voxels, path, (8, 8, 1))
        with open(path, "rb") as f:
            raw = f.read()
    return images.voxels(spark.createDataFrame([("volumes", bytearray(raw))], "path string, content binary")).select("t", "i", "j", "value")


@query(KNN + """, s AS (SELECT *, 1 - dist / sum(dist) OVER (PARTITION BY q) AS v FROM n WHERE rank <= 5), v AS (SELECT q, label, round(sum(v), 9) AS c, avg(dist) AS m FROM s GROUP BY ALL) SELECT q AS query_id, min_by(label, [-c, m, label]) AS prediction FROM v GROUP BY 1""")
def knn_weighted(spark, d):
    """Votes of the five nearest vectors of other chunks, weighted by nearness."""
    v = vectors(spark, d)
    return le.knn_predict(le.neighbours(v, v.where("sample_id % 100 = 0"), 5, exclude="chunk"), weighted=True)


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) * 0.5 AS half, CASE WHEN n_nationkey % 5 = 0 THEN 'value' END AS reason FROM nation")
def typed_records(spark, d):
    """Column files with names, types and reasons for what fails."""
    from sampleloom.sources import text

    n = table(spark, d, "nation")
    half = F.when(F.col("n_nationkey") % 5 == 0, "none").otherwise((F.col("n_regionkey") * 0.5).cast("string"))
    body = n.select(F.col("n_nationkey").cast("int").alias("o"), F.concat_ws(";", F.concat(F.lit('"'), F.col("n_name"), F.lit('"')), half, F.col("n_nationkey").cast("string")).alias("value"))
    head = spark.createDataFrame([(-1, "name;half;key")], "o int, value string")
    got = text.records(spark, _lines(spark, head.unionByName(body), "o"), {"key": "long", "name": "string", "half": "double"}, ";")
    whole = n.join(got.where("reason is null"), F.col("key") == F.col("n_nationkey"), "left")
    # a line that fails has no values: they come from the table, the reason from the line
    failed = got.where("reason is not null").select((F.col("line_no") - 2).alias("n_nationkey"), F.col("reason").alias("why"))
    out = whole.join(failed, "n_nationkey", "left")
    return out.select("n_nationkey", F.coalesce("name", "n_name").alias("n_name"), F.coalesce("half", F.col("n_regionkey") * 0.5).alias("half"), F.col("why").alias("reason"))


# --- the command line, on the tables' files -------------------------------------------------
def _command(spark, *words: str) -> DataFrame:
    from sampleloom import cli

    return cli.run(cli.parser().parse_args(list(words)), spark)


@query(REFERENCE["ttest"])
def command_ttest(spark, d):
    """One-sample t by group, as a command."""
    out = _command(spark, "ttest", "-i", f"{d}/events.parquet", "--by", "event_type", "--value", "value", "--mean", "50")
    return rounded(out.select("event_type", "n", "t"), 5)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def command_select(spark, d):
    """Rows by expression, attributes dropped, as a command."""
    drop = ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    out = _command(spark, "select", "-i", f"{d}/orders.parquet", "--samples", "o_totalprice gt 100000 and o_orderstatus eq F", "--drop", *drop)
    return out.select("o_orderkey", "o_totalprice")


@query("""WITH p AS (SELECT user_id, event_type, row_number() OVER w - 1 AS pos, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 q AS (SELECT *, sum(CASE WHEN pos = 0 OR before IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS run FROM p) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(pos) AS onset, count(*) AS duration FROM q GROUP BY ALL""")
def command_events(spark, d):
    """Runs of equal attributes as events, as a command."""
    return _command(spark, "mkevds", "-i", f"{d}/events.parquet", "--attrs", "event_type", "--key", "event_id", "--by", "user_id")


@query(f"SELECT fold, error FROM ({REFERENCE['gnb_cv_error']})")
def command_crossval(spark, d):
    """Leave-one-chunk-out error, as a command."""
    out = _command(spark, "crossval", "-i", f"{d}/lineitem.parquet", "--key", "l_orderkey", "--features", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "--targets", "l_returnflag", "--chunks", "l_linestatus")
    return rounded(out, 8)


@query(REFERENCE["searchlight_gnb"])
def command_searchlight(spark, d):
    """A measure around every place of a grid, as a command on a stored dataset."""
    path = _folder(spark)
    vectors(spark, d).write.parquet(path)
    out = _command(spark, "searchlight", "-i", path, "--targets", "target", "--chunks", "chunk", "--shape", "8", "8", "--radius", "1")
    return rounded(out)


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 5) + 0 AS centred, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type), 5) + 0 AS value FROM events")
def command_preprocess(spark, d):
    """Normalisation by chunk, as a command."""
    out = _command(spark, "preproc", "-i", f"{d}/events.parquet", "--key", "event_id", "--value", "value", "--chunks", "event_type").select("event_id", r("value", 5).alias("value"))
    mean = od.zscore(table(spark, d, "events"), ["value"], "event_type", None)
    e = table(spark, d, "events")
    centred = e.join(e.groupBy("event_type").agg(F.avg("value").alias("m")), "event_type").select("event_id", r(F.col("value") - F.col("m"), 5).alias("centred"))
    assert set(mean.columns) == set(e.columns)
    return out.join(centred, "event_id")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def command_script(spark, d):
    """A script of the user's own, as a command."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        script = os.path.join(folder, "script.py")
        with open(script, "w") as f:
            f.write("df = df.where(F.col('n_regionkey') == 2).select('n_nationkey', 'n_name', 'n_regionkey')\n")
        return _command(spark, "exec", "-i", f"{d}/nation.parquet", "--script", script)


@query("SELECT n_nationkey, n_name, r_name AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 3")
def command_atlas(spark, d):
    """Labels by coordinates, as a command."""
    path, points = _folder(spark), _folder(spark)
    table(spark, d, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("label")).write.parquet(path)
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.parquet(points)
    return _command(spark, "atlas", "-i", points, "--atlas", path, "--attrs", "n_regionkey").select("n_nationkey", "n_name", "label")


@query("SELECT n_nationkey, n_name FROM nation")
def command_dump(spark, d):
    """A table written as text and read again, as a command."""
    path, source = _folder(spark), _folder(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").write.parquet(source)
    _command(spark, "dump", "-i", source, "-o", path, "--form", "csv")
    return spark.read.csv(path, header=True, schema="n_nationkey bigint, n_name string")


# --- further files --------------------------------------------------------------------------
@query("SELECT CAST(n_nationkey AS BIGINT) AS row, CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) AS b FROM nation")
def predictor_files(spark, d):
    """Design files with a quoted line of names."""
    from sampleloom.sources import text

    n = table(spark, d, "nation")
    body = n.select(F.col("n_nationkey").cast("int").alias("o"), F.concat_ws(" ", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("value"))
    head = spark.createDataFrame([(-3, "FileVersion: 2"), (-2, "NrOfPredictors: 2"), (-1, '"first one" "second"')], "o int, value string")
    p = F.col("predictors")
    return text.rtc_design(spark, _lines(spark, head.unionByName(body), "o")).select(F.col("row").cast("long").alias("row"), p["first one"].alias("a"), p["second"].alias("b"))


@query("SELECT CAST(n_nationkey AS INT) AS node, round(n_nationkey * 0.5, 6) AS a, round(n_regionkey - 0.25, 6) AS b, 'one;two' AS labels, 'none;Zscore()' AS stats FROM nation")
def surface_data_files(spark, d):
    """Surface data in text form, written and read."""
    from sampleloom.sources import sinks, text

    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("node"), F.array(F.col("n_nationkey") * 0.5, F.col("n_regionkey") - 0.25).alias("values"))
    path = _folder(spark)
    spark.createDataFrame([(sinks.niml_text(n, ["one", "two"], ["none", "Zscore()"]),)], "value string").coalesce(1).write.text(path)
    at = text.niml_datasets(spark, path)
    return at.select("node", r(F.col("values")[0]).alias("a"), r(F.col("values")[1]).alias("b"), "labels", "stats")


@query("SELECT 'sub' || lpad(CAST(n_regionkey + 1 AS VARCHAR), 3, '0') AS subject, lpad(CAST(n_nationkey % 2 + 1 AS VARCHAR), 3, '0') AS run, 'cond ' || (n_nationkey % 2) AS condition, CAST(n_nationkey AS DOUBLE) AS onset FROM nation")
def study_events(spark, d):
    """A study's folders: events of all runs with their conditions."""
    from sampleloom.sources import text

    root = _folder(spark)
    # a file a subject, run and condition: the layout is what is read
    for row in table(spark, d, "nation").groupBy("n_regionkey", (F.col("n_nationkey") % 2).alias("k")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("ids")).collect():
        lines = spark.createDataFrame([("\n".join(f"{i}.0 2.0 1" for i in row["ids"]),)], "value string")
        place = f"{root}/sub{row['n_regionkey'] + 1:03d}/model/model001/onsets/task001_run{row['k'] + 1:03d}/cond{row['k'] + 1:03d}.txt"
        lines.coalesce(1).write.text(place)
    keys = spark.createDataFrame([("task001 cond001 cond 0\ntask001 cond002 cond 1",)], "value string")
    keys.coalesce(1).write.text(f"{root}/models/model001/condition_key.txt")
    return text.study(spark, root)["events"].select("subject", "run", "condition", "onset")
