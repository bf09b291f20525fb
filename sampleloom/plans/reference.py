"""Queries of the engine's own operators over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sampleloom.dataset import Dataset
from sampleloom.functions import distance as dist
from sampleloom.operators import aggregate as ag
from sampleloom.operators import choose as ch
from sampleloom.operators import errors as er
from sampleloom.operators import generators as ge
from sampleloom.operators import inference as inf
from sampleloom.operators import learners as le
from sampleloom.operators import measures as me
from sampleloom.operators import neighborhood as ne
from sampleloom.operators import ordered as od
from sampleloom.operators import select as se
from sampleloom.operators import stack as st
from sampleloom.plans import pipelines as pl
from sampleloom.session import table
from sampleloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, n: int = 6):
    """A double rounded for comparison, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + 0.0


def micros(c: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(r(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as samples: sample_id, target, chunk, features."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("target"), (F.col("vec_id") % 5).alias("chunk"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return Dataset(vectors(spark, d)).long()


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """Events with their place in the user's sequence."""
    return se.ranked(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).drop("_part")


def feature_grid(spark: SparkSession) -> DataFrame:
    """64 features on an 8 x 8 grid."""
    return spark.range(64).selectExpr("cast(id as int) feature_id", "cast(id div 8 as int) x", "cast(id % 8 as int) y")


LONG = "SELECT vec_id AS sample_id, label AS target, vec_id % 5 AS chunk, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS feature_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"


GRID_SQL = "SELECT CAST(i AS INT) AS f, i // 8 AS x, i % 8 AS y FROM generate_series(0, 63) t(i)"


def all_measures(fx: str) -> str:
    return ", ".join(f"{fx.format(m)} AS {m}" for m in MEASURES)


# --- aggregation along samples ---------------------------------------------
@query(f"SELECT {all_measures('round(avg({}), 6)')} FROM lineitem")
def mean_sample(spark, d):
    return table(spark, d, "lineitem").agg(*(r(F.avg(m)).alias(m) for m in MEASURES))


@query(f"SELECT {all_measures('round(sum({}), 2)')} FROM lineitem")
def sum_sample(spark, d):
    return table(spark, d, "lineitem").agg(*(r(F.sum(m), 2).alias(m) for m in MEASURES))


@query("SELECT event_type, round(sum(abs(value)), 4) AS sumofabs, max(abs(value)) AS maxofabs FROM events GROUP BY event_type")
def sumofabs_maxofabs_sample(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r(F.sum(F.abs("value")), 4).alias("sumofabs"), F.max(F.abs("value")).alias("maxofabs"))


@query(f"SELECT l_returnflag, l_linestatus, {all_measures('round(avg({}), 6)')} FROM lineitem GROUP BY ALL")
def mean_group_sample(spark, d):
    return ag.fx_samples(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {m: r(F.avg(m)) for m in MEASURES})


@query("SELECT o_custkey % 100 AS bucket, round(avg(o_totalprice), 4) AS price, string_agg(DISTINCT o_orderpriority, '+' ORDER BY o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1")
def group_merge_attr(spark, d):
    o = table(spark, d, "orders").withColumn("bucket", F.col("o_custkey") % 100)
    return ag.fx_samples(o, ["bucket"], {"price": r(F.avg("o_totalprice"), 4)}, merge=["o_orderpriority"])


@query("SELECT event_type, min_by(user_id, event_id) AS user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def group_first_attr(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(ag.merge_first("user_id", "event_id").alias("user_id"), r(F.avg("value")).alias("mean"))


# --- aggregation along features --------------------------------------------
@query(f"""SELECT sample_id, round(avg(value), 6) AS mean, round(sum(value), 6) AS total, round(sum(abs(value)), 6) AS sumofabs, round(max(abs(value)), 6) AS maxofabs,
 round(sqrt(sum(value * value)), 6) AS l2, CAST(count(*) FILTER (value <> 0) AS INT) AS nonzero FROM ({LONG}) GROUP BY 1""")
def mean_feature(spark, d):
    v = vectors(spark, d)
    names = {"mean": "mean", "sum": "total", "sumofabs": "sumofabs", "maxofabs": "maxofabs", "l2": "l2", "nonzero": "nonzero"}
    return rounded(v.select("sample_id", *(ag.over_features("features", k).alias(n) for k, n in names.items())))


@query(f"SELECT sample_id, CAST(feature_id // 8 AS INT) AS feature_group, round(avg(value), 6) AS mean FROM ({LONG}) GROUP BY ALL")
def mean_group_feature(spark, d):
    g = feature_grid(spark).select("feature_id", F.col("x").alias("feature_group"))
    return cells(spark, d).join(F.broadcast(g), "feature_id").groupBy("sample_id", "feature_group").agg(r(F.avg("value")).alias("mean"))


@query(f"SELECT sample_id, feature_id, round(value - avg(value) OVER (PARTITION BY sample_id), 6) + 0 AS value FROM ({LONG})")
def mean_removal(spark, d):
    v = vectors(spark, d).select("sample_id", ag.mean_removed("features").alias("features"))
    return Dataset(v).long().select("sample_id", "feature_id", r("value").alias("value"))


@query(f"SELECT sample_id, feature_id, abs(value) AS value FROM ({LONG})")
def absolute_features(spark, d):
    return Dataset(vectors(spark, d).select("sample_id", F.transform("features", F.abs).alias("features"))).long()


@query(f"SELECT sample_id, feature_id, round(value / sqrt(sum(value * value) OVER (PARTITION BY sample_id)), 6) + 0 AS l2, round(value / sum(abs(value)) OVER (PARTITION BY sample_id), 6) + 0 AS l1 FROM ({LONG})")
def normed(spark, d):
    v = vectors(spark, d).select("sample_id", F.posexplode(F.zip_with(ag.normed("features"), ag.normed("features", kind="l1"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("feature_id", "x"))
    return v.select("sample_id", "feature_id", r("x.a").alias("l2"), r("x.b").alias("l1"))


@query(f"SELECT feature_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) FILTER (value <> 0) AS nonzero FROM ({LONG}) GROUP BY 1")
def first_axis_statistics(spark, d):
    return cells(spark, d).groupBy("feature_id").agg(r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("std"), F.count_if(F.col("value") != 0).alias("nonzero"))


@query("""SELECT round(avg(CASE WHEN isfinite(data) AND abs(data) < 9e7 THEN data END), 4) AS m, recording_id, channel_id,
 count(*) FILTER (data IS NOT NULL AND NOT isnan(data)) AS n FROM meg_data GROUP BY ALL""")
def nanmean(spark, d):
    x = table(spark, d, "meg_data")
    fine = F.when(~F.isnan("data") & (F.abs("data") < 9e7), F.col("data"))
    return x.groupBy("recording_id", "channel_id").agg(r(F.avg(fine), 4).alias("m"), F.count_if(F.col("data").isNotNull() & ~F.isnan("data")).alias("n"))


# --- normalisation and order -----------------------------------------------
@query("""SELECT event_id, CASE WHEN s <> 0 THEN round((value - m) / s, 5) ELSE round(value - m, 5) END + 0 AS value FROM events
 JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) USING (event_type)""")
def zscore_chunk(spark, d):
    return rounded(od.zscore(table(spark, d, "events").select("event_id", "event_type", "value"), ["value"], "event_type").select("event_id", "value"), 5)


@query("SELECT event_id, round((value - m) / s, 5) + 0 AS value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)")
def zscore_all(spark, d):
    return rounded(od.zscore(table(spark, d, "events").select("event_id", "value"), ["value"]), 5)


@query("""SELECT o_orderkey, round((o_totalprice - m) / s, 5) + 0 AS o_totalprice FROM orders JOIN
 (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m, stddev_pop(o_totalprice) FILTER (o_orderstatus = 'F') AS s FROM orders GROUP BY 1) USING (o_orderpriority)""")
def zscore_baseline(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return rounded(od.zscore(o, ["o_totalprice"], "o_orderpriority", F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice"), 5)


@query(f"""SELECT sample_id, feature_id, round(CASE WHEN s <> 0 THEN (value - m) / s ELSE value - m END, 5) + 0 AS value FROM ({LONG})
 JOIN (SELECT feature_id, chunk, avg(value) AS m, stddev_pop(value) AS s FROM ({LONG}) GROUP BY ALL) USING (feature_id, chunk)""")
def zscore_features(spark, d):
    return od.zscore_long(cells(spark, d), "chunk").select("sample_id", "feature_id", r("value", 5).alias("value"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
 f AS (SELECT user_id, avg(i) AS mi, avg(value) AS mv, covar_pop(value, i) AS c, var_pop(i) AS v FROM s GROUP BY 1)
 SELECT event_id, round(value - mv - CASE WHEN v > 0 THEN c / v ELSE 0 END * (i - mi), 5) + 0 AS value FROM s JOIN f USING (user_id)""")
def detrend_linear(spark, d):
    e = numbered(spark, d).withColumn("i", F.col("pos"))
    return od.detrend_linear(e, "value", "i", ["user_id"]).select("event_id", r("value", 5).alias("value"))


FINE = "SELECT DISTINCT ON (recording_id, channel_id, sample_number) recording_id, channel_id, sample_number, data, row_number() OVER (PARTITION BY recording_id, channel_id ORDER BY sample_number) - 1 AS i, count(*) OVER (PARTITION BY recording_id, channel_id) AS n FROM (SELECT recording_id, channel_id, sample_number, min(data) AS data FROM meg_data WHERE isfinite(data) AND abs(data) < 9e7 GROUP BY ALL)"


def fine_readings(spark, d) -> DataFrame:
    """Readings without repeats, missing and impossible values."""
    x = table(spark, d, "meg_data").where("data is not null and not isnan(data) and abs(data) < 9e7")
    return x.groupBy("recording_id", "channel_id", "sample_number").agg(F.min("data").alias("data"))


@query(f"""WITH x AS (SELECT *, 2.0 * i / (n - 1) - 1 AS t FROM ({FINE})), m AS (SELECT recording_id, channel_id, avg(data) AS my, avg(t * t) AS mq, covar_pop(data, t) / var_pop(t) AS b FROM x GROUP BY ALL),
 q AS (SELECT x.*, my, b, t * t - mq AS u FROM x JOIN m USING (recording_id, channel_id)), c AS (SELECT recording_id, channel_id, sum(u * data) / sum(u * u) AS c FROM q GROUP BY ALL)
 SELECT recording_id, channel_id, sample_number, round(data - my - b * t - c * u, 5) + 0 AS data FROM q JOIN c USING (recording_id, channel_id)""")
def detrend_polynomial(spark, d):
    """Quadratic trends removed per recording and channel."""
    x = fine_readings(spark, d)
    return od.detrend(x, ["data"], "sample_number", ["recording_id", "channel_id"], 2).select("recording_id", "channel_id", "sample_number", r("data", 5).alias("data"))


EVENT_RUNS = """WITH p AS (SELECT user_id, event_type, row_number() OVER w - 1 AS pos, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 q AS (SELECT *, sum(CASE WHEN pos = 0 OR before IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS run FROM p) """


@query(EVENT_RUNS + "SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(pos) AS onset, count(*) AS duration FROM q GROUP BY ALL")
def find_events(spark, d):
    return od.find_events(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], ["user_id"])


@query(EVENT_RUNS + "SELECT user_id, min(pos) AS onset, event_type FROM q GROUP BY user_id, run, event_type")
def break_points(spark, d):
    return od.break_points(table(spark, d, "events"), "event_type", ["ts", "event_id"], ["user_id"])


@query("""WITH p AS (SELECT *, CASE WHEN lag(1) OVER w = 1 AND lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 q AS (SELECT event_id, max(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 0 PRECEDING AND 2 FOLLOWING) AS near FROM p) SELECT event_id FROM q WHERE near = 0""")
def strip_boundaries(spark, d):
    return se.strip_boundaries(table(spark, d, "events"), "event_type", 2, 1, ["ts", "event_id"], ["user_id"]).select("event_id")


@query("""SELECT DISTINCT event_id, CAST(floor(onset / 2.5) AS BIGINT) AS onset, CAST(ceil((onset + duration) / 2.5) - floor(onset / 2.5) AS BIGINT) AS duration, round(onset - floor(onset / 2.5) * 2.5, 6) + 0 AS offset_s
 FROM bold_events WHERE isfinite(onset) AND isfinite(duration)""")
def discrete_events(spark, d):
    b = table(spark, d, "bold_events").where("not isnan(onset) and not isnan(duration) and onset is not null and duration is not null").select("event_id", "onset", "duration")
    return rounded(od.discrete_events(b, 2.5, "offset_s").distinct())


@query("""SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id DESC) - 1 AS rank,
 row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS reverse_rank FROM events""")
def rank_order(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    both = od.rank_order(od.rank_order(e, ["event_type"], "value", "event_id"), ["event_type"], "value", "event_id", True, "reverse_rank")
    return both.select("event_id", "rank", "reverse_rank")


AS_OF = """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), b AS (SELECT user_id, ts, max(event_id) AS hit FROM events WHERE event_type = 'purchase' GROUP BY ALL),
 p AS (SELECT a.event_id, b.hit, b.ts FROM a ASOF JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts), n AS (SELECT a.event_id, b.hit, b.ts FROM a ASOF JOIN b ON a.user_id = b.user_id AND a.ts <= b.ts) """


def _as_of(spark, d, how):
    e = table(spark, d, "events").withColumn("t", micros("ts"))
    hits = e.where("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max("event_id").alias("hit"))
    return od.as_of(e.where("event_type <> 'purchase'").select("event_id", "user_id", F.col("t").alias("at")), hits, ["user_id"], "at", "t", "hit", how, slot=30 * 86_400e6).select("event_id", "hit")


@query(AS_OF + "SELECT a.event_id, p.hit FROM a LEFT JOIN p USING (event_id)")
def asof_prev(spark, d):
    return _as_of(spark, d, "prev")


@query(AS_OF + "SELECT a.event_id, n.hit FROM a LEFT JOIN n USING (event_id)")
def asof_next(spark, d):
    return _as_of(spark, d, "next")


@query(AS_OF + """SELECT a.event_id, CASE WHEN p.hit IS NULL THEN n.hit WHEN n.hit IS NULL THEN p.hit WHEN epoch_us(a.ts) - epoch_us(p.ts) <= epoch_us(n.ts) - epoch_us(a.ts) THEN p.hit ELSE n.hit END AS hit
 FROM a LEFT JOIN p USING (event_id) LEFT JOIN n USING (event_id)""")
def asof_closest(spark, d):
    return _as_of(spark, d, "closest")


@query("""WITH s AS (SELECT DISTINCT sample_id, subjects, time_coords FROM samples), e AS (SELECT event_id, run_id, subjects, onset, duration, lower(regexp_replace(trial_type, '^\\s+|\\s+$', '', 'g')) AS c FROM bold_events
  WHERE isfinite(onset) AND isfinite(duration) AND duration > 0),
 x AS (SELECT DISTINCT event_id, run_id, onset, duration, c FROM e WHERE c NOT IN ('', 'n/a')),
 g AS (SELECT run_id, unnest(generate_series(0, CAST(ceil(greatest(max(onset + duration), 0) / 2.5) AS BIGINT))) AS k FROM x GROUP BY 1), t AS (SELECT run_id, CAST(k AS DOUBLE) * 2.5 AS t, run_id || ':' || k AS sid FROM g),
 b AS (SELECT x.*, (SELECT max(t.t) FROM t WHERE t.run_id = x.run_id AND t.t <= x.onset) AS f FROM x),
 h AS (SELECT t.sid, max_by(b.c, b.event_id) AS condition FROM t JOIN b ON t.run_id = b.run_id AND t.t >= b.f AND t.t < b.onset + b.duration GROUP BY 1)
 SELECT t.sid, coalesce(h.condition, 'rest') AS condition FROM t LEFT JOIN h USING (sid)""")
def interval_label(spark, d):
    """Condition of the events of each run at times 2.5 s apart, up to the run's end."""
    from sampleloom.operators.intervals import trimmed

    b = table(spark, d, "bold_events").where("not isnan(onset) and not isnan(duration) and duration > 0 and onset is not null").withColumn("condition", F.lower(trimmed(F.col("trial_type"))))
    b = b.where("condition not in ('', 'n/a')").select("event_id", "run_id", "onset", "duration", "condition").distinct()
    last = F.ceil(F.greatest(F.max(F.col("onset") + F.col("duration")), F.lit(0.0)) / 2.5)
    grid = b.groupBy("run_id").agg(last.alias("last")).select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("k"))
    grid = grid.select("run_id", (F.col("k") * 2.5).alias("t"), F.concat_ws(":", "run_id", F.col("k").cast("string")).alias("sid"))
    return od.label_samples(grid, b, ["run_id"], "t", "condition", "rest", key="sid").select("sid", "condition")


@query("""WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
 SELECT user_id, CAST(pos // 4 AS BIGINT) AS box, round(avg(value), 6) AS mean, count(*) AS n FROM p GROUP BY ALL HAVING count(*) = 4""")
def boxcar_mean(spark, d):
    e = numbered(spark, d)
    starts = e.where("pos % 4 = 0").select("user_id", F.expr("pos div 4").alias("box"), F.col("pos").alias("start"))
    return rounded(od.boxcar_mean(e, starts, 4, ["user_id"], "value")).where("n = 4").drop("start")


@query("""WITH p AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
 SELECT a.user_id, a.event_id AS box, string_agg(CAST(round(b.value, 2) AS VARCHAR), ',' ORDER BY b.pos) IS NOT NULL AS found, round(sum(b.value * (b.pos - a.pos + 1)), 4) AS weighted FROM p a JOIN p b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos AND a.pos + 2
 WHERE a.event_type = 'purchase' GROUP BY ALL HAVING count(*) = 3""")
def event_samples(spark, d):
    e = numbered(spark, d)
    ev = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("box"), F.col("pos").alias("start"))
    s = od.event_samples(e.select("user_id", "pos", "value"), ev, ["user_id"], "pos", "value", 3)
    return s.select("user_id", "box", F.lit(True).alias("found"), r(F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("weighted"))


# --- selection ---------------------------------------------------------------
@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'")
def select_match(spark, d):
    return se.match(table(spark, d, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["O"]}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 OR o_orderstatus = 'F') AND o_custkey <= 500")
def select_expression(spark, d):
    o = table(spark, d, "orders")
    return o.where(se.expression(o, "o_totalprice gt 100000 or o_orderstatus eq F and o_custkey le 500")).select("o_orderkey")


@query("SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos >= 10 AND (pos - 10) % 7 = 0")
def slice_samples(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return se.positions(o, ["o_orderkey"]).where("pos >= 10 and (pos - 10) % 7 = 0")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'click')")
def samples_by_attr(spark, d):
    return se.samples_by_attr(table(spark, d, "events"), "event_type", ["purchase", "click"], key="event_id")


@query(f"SELECT feature_id FROM ({LONG}) GROUP BY 1 HAVING min(value) <> max(value) AND bool_and(isfinite(value))")
def varying_finite_features(spark, d):
    c = cells(spark, d)
    return se.invariant_features(c).join(se.finite_features(c), "feature_id", "left_semi")


@query("SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def attribute_map(spark, d):
    return se.attribute_map(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT DISTINCT o_orderpriority FROM orders")
def unique_values(spark, d):
    return table(spark, d, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority")


@query("""WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY ALL),
 k AS (SELECT o_custkey FROM c GROUP BY 1 HAVING count(*) = 2 AND min(n) = max(n)) SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM k)""")
def sifter(spark, d):
    return se.sift(table(spark, d, "orders"), "o_custkey", [("o_orderstatus", {"uvalues": ["O", "F"], "balanced": True})]).select("o_orderkey")


@query(f"SELECT sample_id, CAST(CASE feature_id WHEN 5 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS INT) AS feature_id, value FROM ({LONG}) WHERE feature_id IN (3, 5, 60)")
def feature_slice(spark, d):
    return Dataset(se.keep_features(Dataset(vectors(spark, d)), [5, 3, 60]).samples.select("sample_id", "features")).long()


# --- stacking ------------------------------------------------------------------
@query("SELECT c_custkey AS key, c_acctbal AS bal, CAST(0 AS INT) AS ds_index FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier")
def vstack(spark, d):
    return st.vstack([table(spark, d, "customer").selectExpr("c_custkey key", "c_acctbal bal"), table(spark, d, "supplier").selectExpr("s_suppkey key", "s_acctbal bal")])


@query(f"""WITH w AS (SELECT sample_id, value, feature_id FROM ({LONG})) SELECT sample_id, feature_id, value FROM w
 UNION ALL SELECT vec_id, CAST(64 + generate_subscripts(e, 1) - 1 AS INT), unnest(e) FROM (SELECT vec_id, [CAST(label AS DOUBLE), CAST(vec_id AS DOUBLE)] AS e FROM embeddings)""")
def hstack(spark, d):
    v = vectors(spark, d)
    other = v.select("sample_id", F.array(F.col("target").cast("double"), F.col("sample_id").cast("double")).alias("features"))
    return Dataset(st.hstack([v.select("sample_id", "features"), other], ["sample_id"])).long()


@query("""WITH t AS (SELECT r_regionkey, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS pos FROM region JOIN nation ON r_regionkey = n_regionkey)
 SELECT pos, max(CASE WHEN r_regionkey = 0 THEN n_nationkey END) AS a, max(CASE WHEN r_regionkey = 1 THEN n_nationkey END) AS b FROM t WHERE r_regionkey IN (0, 1) GROUP BY 1
 HAVING count(*) = 2""")
def stack_by_sample_attribute(spark, d):
    n = table(spark, d, "nation").where("n_regionkey in (0, 1)")
    least = n.groupBy("n_regionkey").count().agg(F.min("count").alias("m"))
    n = n.withColumn("_i", F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))).join(F.broadcast(least), F.col("_i") <= F.col("m"))
    s = st.stack_by_sample_attribute(n.select("n_regionkey", "n_nationkey"), "n_regionkey", [0, 1], ["n_nationkey"], "n_nationkey")
    return s.select("pos", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))


@query(f"SELECT sample_id, CAST(feature_id // 8 AS INT) AS x, round(sum(value * (feature_id % 8 + 1)), 5) AS checksum FROM ({LONG}) GROUP BY ALL")
def stack_by_feature_attribute(spark, d):
    ds = Dataset(vectors(spark, d).select("sample_id", "features"), feature_grid(spark))
    s = st.stack_by_feature_attribute(ds, "x")
    return s.select("sample_id", "x", r(F.aggregate(F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 5).alias("checksum"))


# --- tables and summaries ----------------------------------------------------
@query("""SELECT l_linestatus, l_returnflag, count(l.l_orderkey) AS n FROM (SELECT DISTINCT l_linestatus FROM lineitem) CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem) LEFT JOIN lineitem l USING (l_linestatus, l_returnflag) GROUP BY ALL""")
def chunk_target_counts(spark, d):
    return ag.contingency(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag")


GRID = "WITH g AS (SELECT o_orderstatus, o_orderpriority, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) LEFT JOIN orders o USING (o_orderstatus, o_orderpriority) GROUP BY ALL) "


@query(GRID + """SELECT o_orderpriority AS value, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS min, max(n) AS max, count(*) FILTER (n > 0) AS nonzero, 'target' AS axis FROM g GROUP BY 1
 UNION ALL SELECT o_orderstatus, round(avg(n), 6), round(stddev_pop(n), 6), min(n), max(n), count(*) FILTER (n > 0), 'chunk' FROM g GROUP BY 1""")
def summary_targets(spark, d):
    return rounded(ag.summary_targets(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"))


@query("SELECT value, following, count(*) AS n FROM (SELECT event_type AS value, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events) WHERE following IS NOT NULL GROUP BY ALL")
def sequence_transitions(spark, d):
    return ag.transitions(table(spark, d, "events"), "event_type", ["ts", "event_id"], ["user_id"], 2)


@query("""WITH s AS (SELECT user_id % 10 AS u, value AS v, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id % 10) AS n FROM events)
 SELECT a.u, CAST(k AS INT) AS shift, round(covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)), 6) AS r FROM s a, generate_series(1, 3) AS g(k), s b WHERE a.u = b.u AND b.i = (a.i + k) % a.n AND k < a.n GROUP BY ALL""")
def autocorrelation(spark, d):
    e = table(spark, d, "events").withColumn("u", F.col("user_id") % 10)
    return rounded(ag.circular_autocorrelation(e, "value", ["ts", "event_id"], ["u"], 3))


@query("""WITH b AS (SELECT recording_id, channel_id, avg(data) AS m, stddev_pop(data) AS s FROM meg_data WHERE isfinite(data) AND abs(data) < 9e7 GROUP BY ALL),
 k AS (SELECT * FROM meg_data JOIN b USING (recording_id, channel_id) WHERE isfinite(data) AND abs(data) < 9e7 AND NOT abs(data - m) > 3 * s)
 SELECT recording_id, channel_id, round(avg(data), 7) AS mean, round(quantile_cont(data, 0.5), 7) AS median, round(stddev_pop(data), 7) AS std, round(min(data), 7) AS min, round(max(data), 7) AS max, round(quantile_cont(data, 0.25), 7) AS p25, round(quantile_cont(data, 0.75), 7) AS p75, count(*) AS n
 FROM k GROUP BY ALL""")
def boxplot_stats(spark, d):
    x = table(spark, d, "meg_data").where("abs(data) < 9e7 and not isnan(data)")
    return rounded(ag.boxplot_stats(x, ["recording_id", "channel_id"], "data"), 7)


@query("SELECT o_orderkey % 7 AS g, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY 1")
def describe(spark, d):
    return rounded(table(spark, d, "orders").groupBy((F.col("o_orderkey") % 7).alias("g")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std")), 4)


Z = 1.959963984540054


def ci_sql(low: str, high: str) -> str:
    return f"WITH c AS (SELECT l_linestatus, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS x FROM lineitem GROUP BY 1), p AS (SELECT *, x / n AS p FROM c) SELECT l_linestatus, round({low}, 8) AS low, round({high}, 8) AS high FROM p WHERE x > 0 AND x < n"


def _ci(spark, d, method):
    c = table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("x")).where("x > 0 and x < n")
    low, high = ag.binomial_ci(F.col("n"), F.col("x"), Z, method)
    return c.select("l_linestatus", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query(ci_sql(f"p - {Z} * sqrt(p * (1 - p) / n)", f"p + {Z} * sqrt(p * (1 - p) / n)"))
def ci_wald(spark, d):
    return _ci(spark, d, "wald")


W_MID, W_D = f"(x + {Z * Z} / 2) / (n + {Z * Z})", f"{Z} * sqrt(p * (1 - p) * n + {Z * Z} / 4) / (n + {Z * Z})"


@query(ci_sql(f"{W_MID} - {W_D}", f"{W_MID} + {W_D}"))
def ci_wilson(spark, d):
    return _ci(spark, d, "wilson")


A_D = f"{Z} * sqrt({W_MID} * (1 - {W_MID}) / (n + {Z * Z}))"


@query(ci_sql(f"{W_MID} - {A_D}", f"{W_MID} + {A_D}"))
def ci_agresti_coull(spark, d):
    return _ci(spark, d, "agresti-coull")


@query(ci_sql(f"pow(sin(asin(sqrt(p)) - {Z} / (2 * sqrt(n))), 2)", f"pow(sin(asin(sqrt(p)) + {Z} / (2 * sqrt(n))), 2)"))
def ci_arc_sine(spark, d):
    return _ci(spark, d, "arc-sine")


L_ = "ln(x / (n - x))"
L_D = f"{Z} * sqrt(n / (x * (n - x)))"


@query(ci_sql(f"exp({L_} - {L_D}) / (1 + exp({L_} - {L_D}))", f"exp({L_} + {L_D}) / (1 + exp({L_} + {L_D}))"))
def ci_logit(spark, d):
    return _ci(spark, d, "logit")


N_ = "ln((x + 0.5) / (n - x + 0.5))"
N_D = f"{Z} * sqrt((n + 1) * (n + 2) / (n * (x + 1) * (n - x + 1)))"


@query(ci_sql(f"exp({N_} - {N_D}) / (1 + exp({N_} - {N_D}))", f"exp({N_} + {N_D}) / (1 + exp({N_} + {N_D}))"))
def ci_anscombe(spark, d):
    return _ci(spark, d, "anscombe")


@query()
def ci_jeffreys(spark, d):
    """Beta quantiles: no SQL."""
    c = table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("x"))
    low, high = inf.beta_interval(F.col("n"), F.col("x"))
    return c.select("l_linestatus", low.alias("low"), high.alias("high"))


# --- generators ----------------------------------------------------------------
@query("SELECT o_orderkey, s - 1 AS partitions_set, CAST(CASE WHEN o_orderpriority = p THEN 2 ELSE 1 END AS INT) AS partitions FROM orders, (SELECT p, CAST(row_number() OVER (ORDER BY p) AS INT) AS s FROM (SELECT DISTINCT o_orderpriority AS p FROM orders))")
def nfold_partitions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return ge.partitions(o, "o_orderpriority", ge.n_fold(ge.uniques(o, "o_orderpriority"))).drop("o_orderpriority")


@query("""WITH u AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)), c AS (SELECT a.p AS p1, b.p AS p2, CAST(row_number() OVER (ORDER BY a.k, b.k) - 1 AS INT) AS s FROM u a JOIN u b ON a.k < b.k)
 SELECT o_orderkey, s AS partitions_set, CAST(CASE WHEN o_orderpriority IN (p1, p2) THEN 2 ELSE 1 END AS INT) AS partitions FROM orders, c""")
def nfold_pairs(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return ge.partitions(o, "o_orderpriority", ge.n_fold(ge.uniques(o, "o_orderpriority"), 2)).drop("o_orderpriority")


RANKED = "WITH u AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderpriority FROM orders)) "


@query(RANKED + "SELECT o_orderkey, CAST(s AS INT) AS partitions_set, CAST(CASE WHEN (k % 2 = 1) = (s = 0) THEN 2 ELSE 1 END AS INT) AS partitions FROM orders JOIN u USING (o_orderpriority), (VALUES (0), (1)) t(s)")
def oddeven_partitions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return ge.partitions(o, "o_orderpriority", ge.odd_even(ge.uniques(o, "o_orderpriority"))).drop("o_orderpriority")


@query(RANKED + "SELECT o_orderkey, CAST(s AS INT) AS partitions_set, CAST(CASE WHEN (k < n // 2) = (s = 0) THEN 2 ELSE 1 END AS INT) AS partitions FROM orders JOIN u USING (o_orderpriority), (VALUES (0), (1)) t(s)")
def half_partitions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return ge.partitions(o, "o_orderpriority", ge.halves(ge.uniques(o, "o_orderpriority"))).drop("o_orderpriority")


@query("""WITH RECURSIVE c AS (SELECT o_orderpriority AS v, count(*) AS n, row_number() OVER (ORDER BY o_orderpriority) AS i FROM orders GROUP BY 1), t AS (SELECT sum(n) / 3.0 AS share FROM c),
 g AS (SELECT i, v, 0 AS s, n AS so_far FROM c WHERE i = 1 UNION ALL SELECT c.i, c.v, CAST(CASE WHEN g.so_far >= (g.s + 1) * share AND g.s < 2 THEN g.s + 1 ELSE g.s END AS INT), g.so_far + c.n FROM g JOIN c ON c.i = g.i + 1, t)
 SELECT o_orderkey, CAST(k AS INT) AS partitions_set, CAST(CASE WHEN s = k THEN 2 ELSE 1 END AS INT) AS partitions FROM orders JOIN g ON v = o_orderpriority, generate_series(0, 2) AS x(k)""")
def ngroup_partitions(spark, d):
    """Greedy groups of about equal size."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    counts = [(x[0], x[1]) for x in o.groupBy("o_orderpriority").count().collect()]
    return ge.partitions(o, "o_orderpriority", ge.n_groups(counts, 3)).drop("o_orderpriority")


@query("""WITH n AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2),
 a AS (SELECT n_name AS x, row_number() OVER (ORDER BY r_name, n_name) AS i FROM n WHERE r_name = (SELECT min(r_name) FROM n)), b AS (SELECT n_name AS y, row_number() OVER (ORDER BY n_name) AS j FROM n WHERE r_name = (SELECT max(r_name) FROM n)),
 c AS (SELECT x, y, CAST(row_number() OVER (ORDER BY i, j) - 1 AS INT) AS s FROM a, b) SELECT n_name, s AS partitions_set, CAST(CASE WHEN n_name IN (x, y) THEN 2 ELSE 1 END AS INT) AS partitions FROM n, c""")
def factorial_partitions(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 2").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    return ge.factorial(n, "n_name", "r_name").drop("r_name")


@query("""WITH p AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS p FROM nation), c AS (SELECT a.r_regionkey AS x, b.r_regionkey AS y, CAST(row_number() OVER (ORDER BY a.r_regionkey, b.r_regionkey) - 1 AS INT) AS k FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey)
 SELECT n_nationkey, k AS combination, CAST(CASE WHEN p = 2 AND n_regionkey NOT IN (x, y) THEN 3 WHEN p <> 2 AND n_regionkey IN (x, y) THEN 3 ELSE p END AS INT) AS partitions FROM p, c""")
def exclude_combinations(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(2).alias("partitions"))
    return ge.exclude_target_combinations(n, 2, "n_regionkey").drop("n_regionkey")


@query("SELECT event_id, CAST(CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS INT) AS split, event_type <> 'purchase' AS lastsplit FROM events WHERE event_type IN ('purchase', 'click')")
def splitter(spark, d):
    return ge.splitter(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["purchase", "click"]).drop("event_type")


@query("SELECT n_nationkey, CAST(g AS INT) AS repetitions FROM nation, generate_series(0, 2) t(g)")
def repeater(spark, d):
    return ge.repeated(table(spark, d, "nation").select("n_nationkey"), 3)


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(g AS INT) AS rep, md5('0:' || g || ':' || o_orderkey) AS h FROM orders, generate_series(0, 1) t(g)),
 k AS (SELECT o_orderstatus, min(n) AS k FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1)
 SELECT o_orderkey, rep, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, rep ORDER BY h, o_orderkey) <= k AS balanced_set FROM r JOIN k USING (o_orderstatus)""")
def balance_equal(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return ge.balance(o, "o_orderpriority", "o_orderkey", limit=["o_orderstatus"], count=2).select("o_orderkey", "rep", "balanced_set")


@query("""WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), b AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY md5('0:0:' || event_id), event_id) AS i FROM events)
 SELECT a.event_id, b.value FROM a JOIN b USING (event_type, i)""")
def permute_within(spark, d):
    return ge.permute(table(spark, d, "events").select("event_id", "event_type", "value"), ["value"], "event_id", ["event_type"]).select("event_id", "value")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('0:0:' || o_orderkey), o_orderkey) AS i FROM orders) WHERE i <= 5")
def random_samples(spark, d):
    return ge.random_samples(table(spark, d, "orders"), "o_orderpriority", 5, "o_orderkey").select("o_orderkey")


# --- measures --------------------------------------------------------------------
@query(f"""WITH l AS ({LONG}), c AS (SELECT feature_id, target, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l GROUP BY ALL), t AS (SELECT feature_id, avg(value) AS g FROM l GROUP BY 1)
 SELECT feature_id, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS f FROM c JOIN t USING (feature_id) GROUP BY 1""")
def anova(spark, d):
    return rounded(me.anova(cells(spark, d), "target").select("feature_id", "f"), 5)


@query(f"""WITH l AS ({LONG}), k AS (SELECT DISTINCT target AS t FROM l), x AS (SELECT feature_id, t, target = t AS own, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l, k GROUP BY ALL), g AS (SELECT feature_id, avg(value) AS g FROM l GROUP BY 1)
 SELECT feature_id, t AS target, round(sum(n * (m - g) * (m - g)) / (sum(n * v) / (sum(n) - 2)), 4) AS f FROM x JOIN g USING (feature_id) GROUP BY ALL""")
def compound_anova(spark, d):
    return rounded(me.compound_anova(cells(spark, d), "target"), 4)


@query(f"SELECT feature_id, round(covar_pop(value, target) / (stddev_pop(value) * stddev_pop(target)), 6) AS r, count(*) AS n FROM ({LONG}) GROUP BY 1")
def corrcoef(spark, d):
    return rounded(me.corrcoef(cells(spark, d), "target"))


@query(f"""WITH m AS (SELECT feature_id, chunk, target, avg(value) AS m FROM ({LONG}) GROUP BY ALL),
 p AS (SELECT a.feature_id, a.m AS x, b.m AS y FROM m a JOIN m b ON a.feature_id = b.feature_id AND a.target = b.target AND a.chunk < b.chunk)
 SELECT feature_id, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS stability FROM p GROUP BY 1""")
def corrstability(spark, d):
    return rounded(me.corrstability(cells(spark, d), "target", "chunk"))


MEANS = f"WITH m AS (SELECT target, feature_id, avg(value) AS m FROM ({LONG}) GROUP BY ALL) "


@query(MEANS + "SELECT a.target AS id_a, b.target AS id_b, round(sum((a.m - b.m) * (a.m - b.m)), 6) AS value FROM m a JOIN m b USING (feature_id) WHERE a.target < b.target GROUP BY ALL")
def pdist_euclidean(spark, d):
    return rounded(me.pdist(me.group_means(vectors(spark, d), ["target"]), "target", dist.squared_euclidean))


@query(MEANS + "SELECT a.target AS id_a, b.target AS id_b, round(abs(1 - covar_pop(a.m, b.m) / (stddev_pop(a.m) * stddev_pop(b.m))), 6) AS value FROM m a JOIN m b USING (feature_id) WHERE a.target < b.target GROUP BY ALL")
def pdist_correlation(spark, d):
    return rounded(me.pdist(me.group_means(vectors(spark, d), ["target"]), "target", dist.one_minus_correlation))


@query(f"""WITH m AS (SELECT target, chunk < 3 AS train, feature_id, avg(value) AS m FROM ({LONG}) GROUP BY ALL)
 SELECT a.target AS id_a, b.target AS id_b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS value FROM m a JOIN m b USING (feature_id) WHERE a.train AND NOT b.train GROUP BY ALL""")
def cdist(spark, d):
    v = vectors(spark, d)
    return rounded(me.cdist(v.where("chunk < 3"), v.where("chunk >= 3"), "target", dist.euclidean))


CHUNK_DSM = f"""WITH m AS (SELECT chunk, target, feature_id, avg(value) AS m FROM ({LONG}) GROUP BY ALL),
 p AS (SELECT a.chunk, a.target AS x, b.target AS y, sum((a.m - b.m) * (a.m - b.m)) AS v FROM m a JOIN m b ON a.chunk = b.chunk AND a.feature_id = b.feature_id AND a.target < b.target GROUP BY ALL) """


@query(CHUNK_DSM + "SELECT a.chunk AS chunk_a, b.chunk AS chunk_b, round(covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)), 6) AS r FROM p a JOIN p b ON a.x = b.x AND a.y = b.y AND a.chunk < b.chunk GROUP BY ALL")
def dsm_consistency(spark, d):
    m = me.group_means(vectors(spark, d), ["chunk", "target"])
    return rounded(me.dsm_consistency(me.pdist(m, "target", dist.squared_euclidean, block=["chunk"]), "chunk"))


@query(MEANS + """, p AS (SELECT a.target AS x, b.target AS y, sum((a.m - b.m) * (a.m - b.m)) AS v, abs(a.target - b.target) AS t FROM m a JOIN m b USING (feature_id) WHERE a.target < b.target GROUP BY ALL)
 SELECT round(covar_pop(v, t) / (stddev_pop(v) * stddev_pop(t)), 6) AS rho FROM p""")
def target_similarity(spark, d):
    dsm = me.pdist(me.group_means(vectors(spark, d), ["target"]), "target", dist.squared_euclidean)
    on = dsm.select("id_a", "id_b", F.abs(F.col("id_a") - F.col("id_b")).alias("target"))
    return rounded(me.dsm_correlation(dsm, on))


@query(MEANS + """, s AS (SELECT a.target AS id_a, b.target AS id_b, sum(a.m * b.m) AS dp, sum((a.m - b.m) * (a.m - b.m)) AS sq, sum(abs(a.m - b.m)) AS l1, max(abs(a.m - b.m)) AS mx FROM m a JOIN m b USING (feature_id) WHERE a.target < b.target GROUP BY ALL)
 SELECT id_a, id_b, round(dp, 6) AS linear, round(pow(dp + 1, 2), 6) AS poly, round(exp(-sq / 2.0), 6) AS rbf, round(l1, 6) AS manhattan, round(mx, 6) AS chebyshev, round(exp(-sqrt(sq)), 6) AS exponential, round(exp(-0.5 * sq), 6) AS squared_exponential,
 round((1 + sqrt(1.5 * sq)) * exp(-sqrt(1.5 * sq)), 6) AS matern_3_2, round((1 + sqrt(2.5 * sq) + 2.5 * sq / 3) * exp(-sqrt(2.5 * sq)), 6) AS matern_5_2, round(pow(1 + sq / (2 * 0.5), -0.5), 6) AS rational_quadratic, round(tanh(dp), 6) AS sigmoid FROM s""")
def kernels(spark, d):
    m = me.group_means(vectors(spark, d), ["target"])
    j = m.select(F.col("target").alias("id_a"), F.col("features").alias("a")).join(m.select(F.col("target").alias("id_b"), F.col("features").alias("b")), F.expr("id_a < id_b"))
    each = {"linear": dist.linear, "poly": dist.polynomial, "rbf": lambda a, b: dist.rbf(a, b, 2.0), "manhattan": dist.manhattan, "chebyshev": dist.chebyshev, "exponential": dist.exponential, "squared_exponential": dist.squared_exponential, "matern_3_2": dist.matern_3_2, "matern_5_2": dist.matern_5_2, "rational_quadratic": dist.rational_quadratic, "sigmoid": dist.sigmoid}
    return rounded(j.select("id_a", "id_b", *(f("a", "b").alias(n) for n, f in each.items())))


# --- winners and selectors -----------------------------------------------------
@query(f"SELECT sample_id, min_by(feature_id, [-value, feature_id]) AS winner, min_by(feature_id, [value, feature_id]) AS loser FROM ({LONG}) GROUP BY 1")
def feature_winner(spark, d):
    return vectors(spark, d).select("sample_id", ch.feature_winner("features").cast("int").alias("winner"), ch.feature_loser("features").cast("int").alias("loser"))


@query(f"SELECT feature_id, min_by(sample_id, [-value, sample_id]) AS winner, min_by(sample_id, [value, sample_id]) AS loser FROM ({LONG}) GROUP BY 1")
def sample_winner(spark, d):
    c = cells(spark, d)
    return ch.sample_winner(c).join(ch.sample_winner(c, lowest=True).withColumnRenamed("winner", "loser"), "feature_id")


@query(MEANS + "SELECT feature_id, min_by(target, [-m, target]) AS winner, min_by(target, [m, target]) AS loser FROM m GROUP BY 1")
def group_sample_winner(spark, d):
    c = cells(spark, d)
    return ch.group_winner(c, "target").join(ch.group_winner(c, "target", lowest=True).withColumnRenamed("winner", "loser"), "feature_id")


F_SCORES = f"""WITH l AS ({LONG}), c AS (SELECT feature_id, target, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l GROUP BY ALL), t AS (SELECT feature_id, avg(value) AS g FROM l GROUP BY 1),
 s AS (SELECT feature_id, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM c JOIN t USING (feature_id) GROUP BY 1) """


@query(F_SCORES + "SELECT feature_id FROM s EXCEPT SELECT feature_id FROM (SELECT feature_id FROM s ORDER BY f, feature_id LIMIT 6)")
def tail_select(spark, d):
    return ch.tail(me.anova(cells(spark, d), "target"), "f", fraction=0.1).select("feature_id")


@query(F_SCORES + "SELECT feature_id FROM s WHERE f > 1.0 AND f < 10.0")
def range_select(spark, d):
    return me.anova(cells(spark, d), "target").where(ch.in_range("f", 1.0, 10.0)).select("feature_id")


@query(F_SCORES + "SELECT feature_id FROM (SELECT feature_id FROM s ORDER BY f DESC, feature_id LIMIT 20) WHERE feature_id < 32")
def combined_select(spark, d):
    from sampleloom.operators.featsel import combine

    top = ch.tail(me.anova(cells(spark, d), "target"), "f", n=20, which="upper", mode="select").select("feature_id")
    return combine([top, feature_grid(spark).where("feature_id < 32").select("feature_id")], "intersection")


@query(F_SCORES + ", k AS (SELECT feature_id FROM s EXCEPT SELECT feature_id FROM (SELECT feature_id FROM s ORDER BY f, feature_id LIMIT 3)) SELECT sample_id, round(avg(value), 6) AS mean FROM l JOIN k USING (feature_id) GROUP BY 1")
def sensitivity_selection(spark, d):
    from sampleloom.operators.featsel import by_sensitivity

    c = cells(spark, d)
    return by_sensitivity(c, me.anova(c, "target"), "f").groupBy("sample_id").agg(r(F.avg("value")).alias("mean"))


# --- learners --------------------------------------------------------------------
CV = """, s AS (SELECT a.n, a.chunk AS c, a.target AS label, a.feature_id, a.m, a.v FROM (SELECT chunk, target, feature_id, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, var_pop(value) AS v FROM l GROUP BY ALL) a),
 k AS (SELECT DISTINCT chunk AS fold FROM l), w AS (SELECT fold, label, feature_id, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum(n * (v + m * m)) / sum(n) AS q FROM s, k WHERE c <> fold GROUP BY ALL),
 z AS (SELECT fold, label, max(n) AS n FROM w GROUP BY ALL), y AS (SELECT fold, sum(n) AS t, count(*) AS k FROM z GROUP BY 1), pr AS (SELECT fold, label, ln((1 + n) / (t + k)) AS lp FROM z JOIN y USING (fold)) """
LOGP = "-0.5 * (ln(2 * pi()) + ln(q - mean * mean) + (value - mean) * (value - mean) / (q - mean * mean))"


@query(f"WITH l AS ({LONG}) {CV}, sc AS (SELECT fold, sample_id, l.target, label, sum({LOGP}) AS s FROM l JOIN w ON l.chunk = w.fold AND l.feature_id = w.feature_id GROUP BY ALL), b AS (SELECT fold, sample_id, target, label, s + lp AS s FROM sc JOIN pr USING (fold, label)) SELECT fold, sample_id, target, arg_max(label, s) AS prediction FROM b GROUP BY ALL")
def gnb_predict(spark, d):
    return le.gnb_folds(cells(spark, d), "target", "chunk")


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_S = ", ".join(f"avg({c}) AS m{i}, var_pop({c}) AS v{i}" for i, c in enumerate(LINE))
_M = ", ".join(f"sum(n * m{i}) / sum(n) AS m{i}, sum(n * (v{i} + m{i} * m{i})) / sum(n) - pow(sum(n * m{i}) / sum(n), 2) AS v{i}" for i in range(4))
_P = " + ".join(f"-0.5 * (ln(2 * pi()) + ln(v{i}) + pow({c} - m{i}, 2) / v{i})" for i, c in enumerate(LINE))


@query(f"""WITH c AS (SELECT l_linestatus, l_returnflag, CAST(count(*) AS DOUBLE) AS n, {_S} FROM lineitem GROUP BY ALL), f AS (SELECT DISTINCT l_linestatus AS fold FROM lineitem),
 w AS (SELECT fold, l_returnflag AS label, sum(n) AS n, {_M} FROM c, f WHERE l_linestatus <> fold GROUP BY ALL), y AS (SELECT fold, sum(n) AS t, count(*) AS k FROM w GROUP BY 1),
 x AS (SELECT l.rowid AS id, l_linestatus AS fold, l_returnflag AS target, label, ln((1 + n) / (t + k)) + {_P} AS s FROM (SELECT *, row_number() OVER () AS rowid FROM lineitem) l JOIN w ON l_linestatus = w.fold JOIN y ON y.fold = w.fold),
 b AS (SELECT fold, id, target, arg_max(label, s) AS p FROM x GROUP BY ALL) SELECT fold, round(avg(CASE WHEN p <> target THEN 1.0 ELSE 0.0 END), 8) AS error, count(*) AS n FROM b GROUP BY 1""")
def gnb_cv_error(spark, d):
    """Leave-one-chunk-out error of naive Bayes on the line items: the flagship."""
    x = table(spark, d, "lineitem")
    p = le.wide_gnb_folds(x, "l_orderkey", LINE, "l_returnflag", "l_linestatus")
    return p.groupBy("fold").agg(F.round(er.mean_mismatch("prediction", "target"), 8).alias("error"), F.count("*").alias("n"))


KNN = f"""WITH e AS (SELECT vec_id, label, vec_id % 5 AS chunk, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
 p AS (SELECT a.vec_id AS q, b.vec_id AS t, b.label, list_sum([pow(x[1] - x[2], 2) FOR x IN list_zip(a.v, b.v)]) AS dist FROM e a JOIN e b ON a.chunk <> b.chunk WHERE a.vec_id % 100 = 0),
 n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS rank FROM p) """


@query(KNN + "SELECT q AS query_id, t AS train_id, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM n WHERE rank <= 5")
def nearest_neighbours(spark, d):
    """Five nearest vectors of other chunks, for the stated query set against all rows."""
    v = vectors(spark, d)
    near = le.neighbours(v, v.where("sample_id % 100 = 0"), 5, exclude="chunk")
    return rounded(near.select("query_id", "train_id", "dist", "rank"))


@query(KNN + ", v AS (SELECT q, label, count(*) AS c, avg(dist) AS m FROM n WHERE rank <= 5 GROUP BY ALL) SELECT q AS query_id, min_by(label, [-c, m, label]) AS prediction FROM v GROUP BY 1")
def knn_predict(spark, d):
    v = vectors(spark, d)
    return le.knn_predict(le.neighbours(v, v.where("sample_id % 100 = 0"), 5, exclude="chunk"))


@query(MEANS + f", x AS (SELECT l.sample_id, l.target, m.target AS label, sum(pow(l.value - m.m, 2)) AS s FROM ({LONG}) l JOIN m USING (feature_id) GROUP BY ALL) SELECT sample_id, target, min_by(label, [s, label]) AS prediction FROM x GROUP BY ALL")
def nearest_mean(spark, d):
    v = vectors(spark, d)
    return le.nearest_mean(v, me.group_means(v, ["target"]), "target").select("sample_id", "target", "prediction")


@query("""WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT 'intercept' AS name, round(a, 3) AS beta FROM s UNION ALL SELECT 'l_quantity', round(b, 3) FROM s""")
def linear_regression(spark, d):
    return rounded(me.linear_regression(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").select("name", "beta"), 3)


@query()
def glm_features(spark, d):
    """Ordinary least squares of each measure, with t and p (no SQL for p)."""
    return me.linear_regression(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["l_linestatus"])


@query("""WITH g AS (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) + 0.25 AS sxx, sum(l_extendedprice) AS sy, sum(l_quantity * l_extendedprice) AS sxy FROM lineitem), b AS (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, n, sx, sy FROM g)
 SELECT 'l_quantity' AS name, round(b, 3) AS beta FROM b UNION ALL SELECT 'intercept', round((sy - b * sx) / n, 3) FROM b""")
def ridge(spark, d):
    return rounded(le.ridge(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", 0.5), 3)


def _cv(name: str):
    from sampleloom.functions.models import REGISTRY

    make = REGISTRY[name][1]

    def run(spark, d):
        errors = {"error": er.mean_mismatch, "n": lambda p, t: F.count("*")}
        return rounded(le.cross_validate(vectors(spark, d), make, "target", "chunk", errors))

    run.__name__ = f"{name.replace('(', '_').replace(')', '')}_cv"
    how = "sums over all rows" if make().sums else "at most 2,000 rows of each fold, drawn by hash"
    run.__doc__ = f"Leave-one-chunk-out error of {name}, fitted to {how}."
    return run


for _name in ("lda", "qda", "smlr", "svm", "svm(rbf)"):
    query()(_cv(_name))


@query(KNN + """, v AS (SELECT q, label, count(*) AS c, avg(dist) AS m FROM n WHERE rank <= 5 GROUP BY ALL), b AS (SELECT q, min_by(label, [-c, m, label]) AS p FROM v GROUP BY 1)
 SELECT chunk AS fold, round(avg(CASE WHEN p <> label THEN 1.0 ELSE 0.0 END), 6) AS error, count(*) AS n FROM b JOIN e ON q = vec_id GROUP BY 1""")
def knn_cv(spark, d):
    """Leave-one-chunk-out error of five nearest neighbours among all rows, for the stated query set."""
    v = vectors(spark, d)
    asked = v.where("sample_id % 100 = 0")
    p = le.knn_predict(le.neighbours(v, asked, 5, exclude="chunk")).withColumnRenamed("query_id", "sample_id")
    return rounded(asked.join(p, "sample_id").groupBy(F.col("chunk").alias("fold")).agg(er.mean_mismatch("prediction", "target").alias("error"), F.count("*").alias("n")))


@query()
def regression_cv(spark, d):
    """Held-out error of penalised regressions of the label: by sums over all rows; Gaussian process and support vectors on at most 2,000 rows a fold."""
    from sampleloom.functions.models import REGISTRY

    v = vectors(spark, d).withColumn("target", F.col("target").cast("double"))
    out = None
    for n in ("ridge", "blr", "enet", "lars", "gpr", "svr"):
        part = le.cross_validate(v, REGISTRY[n][1], "target", "chunk", {"rmse": er.rms_error, "corr_error": er.corr_error}).withColumn("model", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


# --- errors ------------------------------------------------------------------------
PRED = f"WITH e AS (SELECT user_id, event_id, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, value FROM events), x AS (SELECT * FROM e WHERE p IS NOT NULL) "


def predictions(spark, d) -> DataFrame:
    """Each event's type predicted by the user's previous one."""
    e = numbered(spark, d).select("user_id", "event_id", F.col("event_type").alias("t"), "value", "pos")
    before = e.select("user_id", (F.col("pos") + 1).alias("pos"), F.col("t").alias("p"))
    return e.join(before, ["user_id", "pos"]).select("user_id", "event_id", "t", "p", "value")


@query(PRED + "SELECT p AS prediction, t AS target, count(*) AS n FROM x GROUP BY ALL")
def confusion(spark, d):
    return er.confusion(predictions(spark, d), "p", "t")


@query(PRED + """, c AS (SELECT p, t, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL), l AS (SELECT DISTINCT t AS label FROM c UNION SELECT p FROM c),
 s AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE p = label AND t = label), 0) AS tp, coalesce((SELECT sum(n) FROM c WHERE p = label), 0) AS pp, coalesce((SELECT sum(n) FROM c WHERE t = label), 0) AS ps, (SELECT sum(n) FROM c WHERE p = t) AS ok, (SELECT sum(n) FROM c) AS n FROM l),
 v AS (SELECT label, tp, pp - tp AS fp, ps - tp AS fn, ok - tp AS tn, ps, ok / n AS acc FROM s)
 SELECT label, round(tp / ps, 6) AS tpr, round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv, round(fp / (tp + fp), 6) AS fdr, round(tn / (fp + tn), 6) AS spc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
 round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(acc, 6) AS acc FROM v""")
def confusion_stats(spark, d):
    s = er.confusion_stats(er.confusion(predictions(spark, d), "p", "t"))
    return rounded(s.select("label", "tpr", "ppv", "npv", "fdr", "spc", "f1", "mcc", "acc"))


@query(PRED + ", c AS (SELECT t, avg(CASE WHEN p = t THEN 1.0 ELSE 0.0 END) AS r FROM x GROUP BY 1) SELECT round(avg(r), 6) AS mean_tpr, round(1 - avg(r), 6) AS mean_fnr FROM c")
def mean_tpr(spark, d):
    return rounded(er.mean_tpr(predictions(spark, d), "p", "t"))


@query(PRED + "SELECT round(avg(CASE WHEN p <> t THEN 1.0 ELSE 0.0 END), 6) AS mean_mismatch, count(*) FILTER (p <> t) AS mismatches, count(*) FILTER (p = t) AS matches, round(avg(CASE WHEN p = t THEN 1.0 ELSE 0.0 END), 6) AS mean_match FROM x")
def mismatch_errors(spark, d):
    return rounded(predictions(spark, d).agg(er.mean_mismatch("p", "t").alias("mean_mismatch"), er.mismatch("p", "t").alias("mismatches"), er.match_accuracy("p", "t").alias("matches"), er.mean_match("p", "t").alias("mean_match")))


@query("""WITH s AS (SELECT event_type = 'purchase' AS y, row_number() OVER (PARTITION BY user_id % 10 ORDER BY value DESC, event_id DESC) AS r, user_id % 10 AS u FROM events),
 t AS (SELECT *, sum(CASE WHEN y THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY r) AS tp FROM s)
 SELECT u, round(sum(CASE WHEN y THEN 0 ELSE tp END) / (CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y)), 6) AS auc FROM t GROUP BY 1""")
def auc(spark, d):
    e = table(spark, d, "events").withColumn("u", F.col("user_id") % 10)
    return rounded(er.auc(e, "value", F.col("event_type") == "purchase", "event_id", ["u"]))


@query("""WITH q AS (SELECT l_linestatus AS s, l_quantity * 1000 AS p, l_extendedprice AS t FROM lineitem),
 a AS (SELECT s, round(1 - covar_pop(p, t) / (stddev_pop(p) * stddev_pop(t)), 6) AS cce, round(sqrt(avg((p - t) * (p - t))), 3) AS rmse, round(sqrt(avg(t * t)), 3) AS rmp_t, round(sqrt(avg(p * p)), 3) AS rmp_p, round(stddev_pop(t), 3) AS std_t, round(stddev_pop(p), 3) AS std_p, round(sqrt(avg((p - t) * (p - t))) / sqrt(avg(t * t)), 6) AS rmse_rmp FROM q GROUP BY GROUPING SETS ((s), ()))
 SELECT * FROM a""")
def regression_stats(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("s"), (F.col("l_quantity") * 1000).alias("p"), F.col("l_extendedprice").alias("t"))
    s = er.regression_stats(x, "p", "t", "s")
    return s.select("s", r("cce").alias("cce"), *(r(c, 3).alias(c) for c in ("rmse", "rmp_t", "rmp_p", "std_t", "std_p")), r("rmse_rmp").alias("rmse_rmp"))


@query("""WITH m AS (SELECT var_pop(l_quantity) AS a, var_pop(l_discount * 100) AS b, covar_pop(l_quantity, l_discount * 100) AS c FROM lineitem), v AS (SELECT (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS first, (a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c) AS second FROM m) SELECT round(first / (first + second), 6) AS share FROM v""")
def variance_1sv(spark, d):
    x = table(spark, d, "lineitem").withColumn("q", F.col("l_discount") * 100)
    return x.agg(r(er.variance_1sv("l_quantity", "q")).alias("share"))


@query(PRED + ", n AS (SELECT user_id, p, count(*) AS n FROM x GROUP BY ALL) SELECT user_id, min_by(p, {'n': -n, 'p': p}) AS prediction FROM n GROUP BY 1")
def maximal_vote(spark, d):
    return le.vote(predictions(spark, d), "user_id", "p")


# --- inference ----------------------------------------------------------------------
@query("""WITH o AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1), n AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL),
 c AS (SELECT o.event_type, o.v, avg(CASE WHEN n.v <= o.v THEN 1.0 ELSE 0.0 END) AS l, avg(CASE WHEN n.v >= o.v THEN 1.0 ELSE 0.0 END) AS r, CAST(count(*) AS DOUBLE) AS k FROM o JOIN n USING (event_type) GROUP BY ALL)
 SELECT event_type, round(least(1.0, 2 * least(greatest(least(l, (k + 1) / (k + 2)), 1 / (k + 2)), greatest(least(r, (k + 1) / (k + 2)), 1 / (k + 2)))), 6) AS p FROM c""")
def empirical_null(spark, d):
    e = table(spark, d, "events")
    observed = e.groupBy("event_type").agg(F.avg("value").alias("value"))
    null = e.groupBy("event_type", "user_id").agg(F.avg("value").alias("value"))
    return rounded(inf.null_probability(observed, null, ["event_type"]).select("event_type", "p"))


@query("""WITH b AS (SELECT CAST(avg(value) AS DOUBLE) AS m, stddev_pop(value) AS s FROM events), z AS (SELECT event_id, event_type, 1 / (1 + exp(abs(value - m) / s)) AS p FROM events, b), q AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS q FROM z)
 SELECT event_id, round(least(1.0, max(q) OVER (PARTITION BY event_type ORDER BY p, event_id ROWS UNBOUNDED PRECEDING)), 6) AS fdr FROM q""")
def fdr_curve(spark, d):
    z = od.zscore(table(spark, d, "events").select("event_id", "event_type", "value"), ["value"])
    p = z.withColumn("p", 1 / (1 + F.exp(F.abs("value"))))
    return rounded(inf.fdr_curve(p, "p", "event_id", ["event_type"]).select("event_id", "fdr"))


@query("SELECT event_type, count(value) AS n, round((avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))), 5) AS t FROM events GROUP BY 1")
def ttest(spark, d):
    return rounded(inf.ttest(table(spark, d, "events"), ["event_type"], "value", 50.0).select("event_type", "n", "t"), 5)


@query("""WITH c AS (SELECT l_linestatus, l_returnflag, count(l.l_orderkey) AS n FROM (SELECT DISTINCT l_linestatus FROM lineitem) CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem) LEFT JOIN lineitem l USING (l_linestatus, l_returnflag) GROUP BY ALL),
 e AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) * 1.0 / count(*) OVER (PARTITION BY l_returnflag) AS e FROM c) SELECT round(sum((n - e) * (n - e) / e), 4) AS chi2, count(*) - 1 AS df FROM e""")
def chisquare(spark, d):
    c = ag.contingency(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag")
    return rounded(inf.chisquare(c, "l_linestatus", "l_returnflag", expected="indep_rows").select("chi2", "df"), 4)


@query(f"WITH x AS (SELECT feature_id, value, row_number() OVER (PARTITION BY feature_id ORDER BY value DESC) AS r, count(*) OVER (PARTITION BY feature_id) AS n FROM ({LONG})) SELECT feature_id, round(value, 6) AS threshold FROM x WHERE r = CAST(floor(n * 0.05) AS BIGINT)")
def threshold_map(spark, d):
    return rounded(inf.threshold_map(cells(spark, d), 0.05))


@query(f"""WITH RECURSIVE m AS (SELECT feature_id, avg(value) AS v FROM ({LONG}) GROUP BY 1 HAVING avg(value) > 0), g AS ({GRID_SQL}), o AS (SELECT feature_id AS f, v, x, y FROM m JOIN g ON f = feature_id),
 e AS (SELECT a.f AS a, b.f AS b FROM o a JOIN o b ON abs(a.x - b.x) + abs(a.y - b.y) = 1), c AS (SELECT f AS node, f AS top FROM o UNION SELECT e.b, c.top FROM c JOIN e ON e.a = c.node), k AS (SELECT node, min(top) AS cluster FROM c GROUP BY 1)
 SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS size, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(min(v), 6) AS min, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std FROM k JOIN o ON f = node GROUP BY 1""")
def cluster_sizes(spark, d):
    """Clusters of features above their thresholds in the mean map, on the grid."""
    c = cells(spark, d)
    mean = c.groupBy("feature_id").agg(F.avg("value").alias("value"))
    on = mean.where(F.col("value") > 0).join(feature_grid(spark), "feature_id")
    near = ne.neighbours(on, ["x", "y"], 1.0).where("center_id <> feature_id")
    label = inf.connected(near.select(F.col("center_id").alias("a"), F.col("feature_id").alias("b")), on.select(F.col("feature_id").alias("node")))
    return rounded(inf.cluster_statistics(label.join(mean.withColumnRenamed("feature_id", "node"), "node")))


@query()
def bootstrap_null(spark, d):
    """Thresholds from bootstrapped group maps: one random map of every chunk and draw."""
    draws = inf.bootstrap_maps(cells(spark, d), "chunk", 50)
    return rounded(inf.threshold_map(draws, 0.05))


# --- neighbourhoods ---------------------------------------------------------------
NEAR = f"near AS (SELECT a.f AS center_id, b.f AS feature_id FROM ({GRID_SQL}) a, ({GRID_SQL}) b WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1)"


@query(f"WITH {NEAR} SELECT * FROM near")
def sphere_neighbours(spark, d):
    return ne.neighbours(feature_grid(spark), ["x", "y"], 1.0)


@query(f"SELECT a.f AS center_id, b.f AS feature_id FROM ({GRID_SQL}) a, ({GRID_SQL}) b WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 4 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) > 1")
def hollow_sphere(spark, d):
    return ne.neighbours(feature_grid(spark), ["x", "y"], 2.0, inner=1.0, centre=False)


@query(f"WITH {NEAR}, l AS ({LONG}) SELECT center_id, round(avg(value), 6) AS value, CAST(count(DISTINCT l.feature_id) AS INT) AS roi_size FROM near JOIN l USING (feature_id) GROUP BY 1")
def searchlight_mean(spark, d):
    return rounded(ne.mean_searchlight(cells(spark, d), ne.neighbours(feature_grid(spark), ["x", "y"], 1.0)))


@query(f"WITH l AS ({LONG}), {NEAR} {CV}, sc AS (SELECT l.chunk AS fold, sample_id, l.target, label, l.feature_id, {LOGP} AS s FROM l JOIN w ON l.chunk = w.fold AND l.feature_id = w.feature_id), ar AS (SELECT center_id, fold, sample_id, target, label, sum(s) AS s FROM sc JOIN near USING (feature_id) GROUP BY ALL), b AS (SELECT center_id, fold, sample_id, target, arg_max(label, s + lp) AS p FROM ar JOIN pr USING (fold, label) GROUP BY ALL) SELECT center_id, fold, round(avg(CASE WHEN p <> target THEN 1.0 ELSE 0.0 END), 6) AS error FROM b GROUP BY ALL")
def searchlight_gnb(spark, d):
    return rounded(ne.gnb_searchlight(cells(spark, d), ne.neighbours(feature_grid(spark), ["x", "y"], 1.0), "target", "chunk"))


@query(f"""WITH l AS ({LONG}), {NEAR}, c AS (SELECT chunk, target, feature_id, CAST(count(*) AS DOUBLE) AS n, sum(value) AS s FROM l GROUP BY ALL), w AS (SELECT k.chunk AS fold, c.target AS label, feature_id, sum(s) / sum(n) AS m FROM c, (SELECT DISTINCT chunk FROM l) k WHERE c.chunk <> k.chunk GROUP BY ALL),
 a AS (SELECT center_id, c.chunk AS fold, c.target, label, sum(pow(c.s / c.n - w.m, 2)) AS dd FROM c JOIN w ON c.chunk = w.fold AND c.feature_id = w.feature_id JOIN near ON near.feature_id = c.feature_id GROUP BY ALL), b AS (SELECT center_id, fold, target, min_by(label, [dd, label]) AS p FROM a GROUP BY ALL)
 SELECT center_id, fold, round(avg(CASE WHEN p <> target THEN 1.0 ELSE 0.0 END), 6) AS error FROM b GROUP BY ALL""")
def searchlight_m1nn(spark, d):
    return rounded(ne.m1nn_searchlight(cells(spark, d), ne.neighbours(feature_grid(spark), ["x", "y"], 1.0), "target", "chunk"))


@query()
def searchlight_generic(spark, d):
    """Any measure around each centre: here the error of a nearest-mean rule in place."""
    import numpy as np

    def measure(x, a):
        t = a["target"].to_numpy()
        means = np.array([x[t == c].mean(0) for c in np.unique(t)])
        return float(np.mean(np.unique(t)[np.argmin(((x[:, None] - means[None]) ** 2).sum(-1), axis=1)] != t))

    return rounded(ne.searchlight(cells(spark, d), ne.neighbours(feature_grid(spark), ["x", "y"], 1.0), measure, ["target"]))


# --- mappers --------------------------------------------------------------------
@query(f"SELECT CAST(feature_id AS BIGINT) AS sample_id, sample_id AS feature_id, value FROM ({LONG})")
def transpose(spark, d):
    from sampleloom.operators.mappers import transpose as swap

    return swap(cells(spark, d).select("sample_id", "feature_id", "value"))


@query()
def svd_energy(spark, d):
    """Squared singular values of the demeaned vectors."""
    from sampleloom.operators.mappers import svd

    _, s = svd(vectors(spark, d))
    return spark.createDataFrame([(i, round(float(v * v), 4)) for i, v in enumerate(s)], "component int, energy double")


@query()
def svd_projected(spark, d):
    """Vectors on their first principal axes."""
    from sampleloom.operators.mappers import Projection, svd

    p, _ = svd(vectors(spark, d))
    return Projection(p.matrix[:, :4], p.offset).forward(vectors(spark, d))


@query()
def hyperalignment(spark, d):
    """Chunks as subjects, class means as samples, aligned to one space inside each row of the grid."""
    from sampleloom.operators.mappers import hyperalign_groups

    m = cells(spark, d).join(F.broadcast(feature_grid(spark)), "feature_id").groupBy("x", "chunk", "target", "y").agg(F.avg("value").alias("value"))
    rows = m.groupBy("x", "chunk", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "value"))), lambda c: c["value"]).alias("features"))
    return rounded(hyperalign_groups(rows, "x", "chunk", key="target"), 4)


@query()
def irelief_weights(spark, d):
    """Feature relevance: the stated query set against all rows, in rounds."""
    return rounded(me.irelief_weights(vectors(spark, d), "target", F.col("sample_id") % 100 == 0, rounds=5))


@query()
def som_units(spark, d):
    """Best units of a map trained on all vectors."""
    from sampleloom.operators.mappers import SOM

    v = vectors(spark, d)
    return SOM((4, 4), 5, 0.1).fit_rows(v).forward(v)


@query(f"""WITH l AS ({LONG}), d AS (SELECT a.feature_id, a.sample_id AS i, abs(a.value - b.value) AS x, CAST(abs(a.target - b.target) AS DOUBLE) AS y FROM l a JOIN l b USING (feature_id)),
 m AS (SELECT feature_id, i, sum(x) AS a, sum(y) AS b, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY ALL),
 s AS (SELECT feature_id, max(n) AS n, sum(a) AS a, sum(b) AS b, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb, sum(xy) AS xy, sum(xx) AS xx, sum(yy) AS yy FROM m GROUP BY 1),
 c AS (SELECT feature_id, xy / (n * n) + a * b / pow(n, 4) - 2 * ab / pow(n, 3) AS xy, xx / (n * n) + a * a / pow(n, 4) - 2 * aa / pow(n, 3) AS xx, yy / (n * n) + b * b / pow(n, 4) - 2 * bb / pow(n, 3) AS yy FROM s)
 SELECT feature_id, round(sqrt(greatest(xy, 0) / sqrt(xx * yy)), 6) AS value FROM c""")
def distance_correlation(spark, d):
    """Distance correlation of each feature with the label, over all rows."""
    return rounded(me.label_distance_correlation(cells(spark, d), "target"))


@query(f"""WITH x AS ({FINE}), e AS (SELECT recording_id, channel_id, min_by(data, i) AS a, max_by(data, i) AS z FROM x GROUP BY ALL),
 y AS (SELECT recording_id, channel_id, i, data FROM x UNION ALL SELECT recording_id, channel_id, -i, 2 * a - data FROM x JOIN e USING (recording_id, channel_id) WHERE i IN (1, 2) UNION ALL SELECT recording_id, channel_id, 2 * (n - 1) - i, 2 * z - data FROM x JOIN e USING (recording_id, channel_id) WHERE i IN (n - 2, n - 3))
 SELECT recording_id, channel_id, CAST(x.i AS INT) AS pos, round(sum(y.data * CASE abs(y.i - x.i) WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 1 END) / 16 * sqrt(0.5), 5) + 0 AS scaled FROM x JOIN y USING (recording_id, channel_id) WHERE y.i BETWEEN x.i - 2 AND x.i + 2 GROUP BY ALL""")
def filtered_series(spark, d):
    """Zero-phase smoothing of each channel; times an irrational number, so that no value lies in the middle of two roundings."""
    y = od.zero_phase_fir(fine_readings(spark, d), ["recording_id", "channel_id"], "sample_number", "data", [0.25, 0.5, 0.25])
    return y.select("recording_id", "channel_id", "pos", r(F.col("value") * F.sqrt(F.lit(0.5)), 5).alias("scaled"))


@query()
def resampled_series(spark, d):
    """Each channel resampled to 100 points in the frequency domain."""
    x = table(spark, d, "meg_data").where("data is not null and not isnan(data) and abs(data) < 9e7").dropDuplicates(["recording_id", "channel_id", "sample_number"])
    return rounded(od.per_series(x, ["recording_id", "channel_id"], "sample_number", "data", lambda s: od.fft_resample(s, 100)), 6)


# --- streams and chains -----------------------------------------------------------
@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    """The streaming window plan over the table at once."""
    return rounded(live.windowed(table(spark, d, "events"), "ts", "6 hours", None, ["event_type"], "value").drop("end"))


@query("""WITH c AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1), z AS (SELECT event_type, user_id % 10 AS u, CASE WHEN s <> 0 THEN (value - m) / s ELSE value - m END AS v FROM events JOIN c USING (event_type))
 SELECT event_type, u, round(avg(v), 6) + 0 AS value FROM z GROUP BY ALL""")
def preproc_chain(spark, d):
    """Normalisation per chunk, then means per group, as a chain of nodes."""
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("u"), "value")
    return ge.chain(lambda x: od.zscore(x, ["value"], "event_type"), lambda x: x.groupBy("event_type", "u").agg(F.avg("value").alias("value")), rounded)(e)


@query("""WITH t AS (SELECT DISTINCT c.cond_id, lower(regexp_replace(s.targets, '^\\s+|\\s+$', '', 'g')) AS name, s.sample_id FROM samples s LEFT JOIN (SELECT min(cond_id) AS cond_id, cond_name FROM condition_key GROUP BY cond_name) c ON c.cond_name = lower(regexp_replace(s.targets, '^\\s+|\\s+$', '', 'g')))
 SELECT name, cond_id, count(*) AS n FROM t GROUP BY ALL""")
def condition_names(spark, d):
    """Targets of the samples through the condition key."""
    from sampleloom.operators.intervals import trimmed

    s = table(spark, d, "samples").select("sample_id", F.lower(trimmed(F.col("targets"))).alias("name")).distinct()
    key = table(spark, d, "condition_key").groupBy(F.col("cond_name").alias("name")).agg(F.min("cond_id").alias("cond_id"))
    return s.join(key, "name", "left").groupBy("name", "cond_id").agg(F.count("*").alias("n"))



# --- whole analyses -----------------------------------------------------------
@query()
def permutation_test(spark, d):
    """Cross-validated error of the line items' flags and its probability under permuted flags."""
    x = table(spark, d, "orders").select("o_orderkey", "o_totalprice", micros("o_orderdate").cast("double").alias("t"), "o_orderstatus", (F.col("o_orderkey") % 4).alias("chunk"))
    return pl.permutation_test(x, "o_orderkey", ["o_totalprice", "t"], "o_orderstatus", "chunk", 10)


@query()
def balanced_cv(spark, d):
    """Error on balanced draws, five repetitions."""
    x = table(spark, d, "orders").select("o_orderkey", "o_totalprice", micros("o_orderdate").cast("double").alias("t"), "o_orderstatus", (F.col("o_orderkey") % 4).alias("chunk"))
    return rounded(pl.balanced_cv(x, "o_orderkey", ["o_totalprice", "t"], "o_orderstatus", "chunk"), 6)


@query()
def cluster_threshold(spark, d):
    """Clusters of one label's mean map on the grid above thresholds bootstrapped from all, with corrected probabilities."""
    c = cells(spark, d)
    observed = c.where("target = 3").groupBy("feature_id").agg(F.avg("value").alias("value"))
    return rounded(pl.cluster_threshold(observed, c, "chunk", feature_grid(spark), ["x", "y"], 40, 0.2))


@query()
def event_amplitudes(spark, d):
    """Response amplitudes of each trial type in a signal made from the events themselves."""
    from sampleloom.operators.intervals import trimmed

    b = table(spark, d, "bold_events").where("not isnan(onset) and not isnan(duration) and duration > 0 and onset is not null").withColumn("condition", F.lower(trimmed(F.col("trial_type"))))
    b = b.where("condition not in ('', 'n/a')").select("event_id", "run_id", "onset", "duration", "condition").distinct()
    times = b.groupBy("run_id").agg(F.max("onset").alias("m")).select("run_id", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("m"), F.lit(0)).cast("int"), F.lit(2))).alias("k")).select("run_id", F.col("k").cast("double").alias("t"))
    x = od.hrf_design(times, b, ["run_id"], "t", "condition").groupBy("run_id", "t").agg((F.sum("x") * 2 + 5).alias("signal"))
    signal = times.join(x, ["run_id", "t"], "left").na.fill(5.0, ["signal"])
    return rounded(pl.event_model(signal, b, ["run_id"], "t", "signal", "condition"), 4)


@query()
def dsm_regression(spark, d):
    """Dissimilarity of class means explained by label distance and by an earlier half of the data."""
    v = vectors(spark, d)
    dsm = me.pdist(me.group_means(v, ["target"]), "target", dist.squared_euclidean)
    labels = dsm.select("id_a", "id_b", F.abs(F.col("id_a") - F.col("id_b")).cast("double").alias("value"))
    half = me.pdist(me.group_means(v.where("chunk < 2"), ["target"]), "target", dist.squared_euclidean)
    return rounded(pl.dsm_regression(dsm, {"label": labels, "half": half}), 5)


@query()
def searchlight_alignment(spark, d):
    """Chunks as subjects aligned in every neighbourhood, the local projections summed."""
    c = cells(spark, d).groupBy(F.col("chunk").alias("subject"), F.col("target").cast("long").alias("sample_id"), "feature_id").agg(F.avg("value").alias("value"))
    return rounded(pl.searchlight_alignment(c, ne.neighbours(feature_grid(spark), ["x", "y"], 1.0)), 4)


@query()
def ml_logistic_cv(spark, d):
    """Any pyspark.ml estimator by chunk: here logistic regression."""
    from pyspark.ml.classification import LogisticRegression

    p = pl.ml_cross_validate(vectors(spark, d), LogisticRegression(maxIter=5), "target", "chunk")
    return rounded(p.groupBy("fold").agg(er.mean_mismatch("prediction", "target").alias("error")))


@query(f"""WITH c AS (SELECT target, feature_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM ({LONG}) GROUP BY ALL), w AS (SELECT feature_id, sum(n * v) / sum(n) AS var FROM c GROUP BY 1)
 SELECT a.target AS label_a, b.target AS label_b, feature_id, round((b.m - a.m) / var, 5) + 0 AS weight FROM c a JOIN c b USING (feature_id) JOIN w USING (feature_id) WHERE a.target < b.target""")
def gnb_weights(spark, d):
    return rounded(le.gnb_weights(cells(spark, d), "target"), 5)


@query()
def svm_sensitivities(spark, d):
    """Weights of the pairwise linear machines of every fold, with their pairs named."""
    from sampleloom.functions.models import SVM

    v = vectors(spark, d)
    return rounded(le.binary_labels(le.sensitivities(le.fit_folds(v, SVM, "target", "chunk")), ge.uniques(v, "target")), 5)


@query("""WITH s AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS pos, count(*) OVER () AS n FROM events) SELECT event_id, pos, CAST(floor(pos * 10 / n) AS BIGINT) AS decile FROM s""")
def global_ranks(spark, d):
    """Place and decile of every row among all, ranked by ranges."""
    x = se.ranked(table(spark, d, "events").select("event_id", "value"), [], ["value", "event_id"], "pos", "n")
    return x.select("event_id", "pos", F.floor(F.col("pos") * 10 / F.col("n")).alias("decile"))


@query("""WITH c AS (SELECT lower(regexp_replace(trial_type, '^\\s+|\\s+$', '', 'g')) AS t, run_id, event_id FROM bold_events WHERE trial_type IS NOT NULL), d AS (SELECT DISTINCT t, run_id, event_id FROM c WHERE t NOT IN ('', 'n/a'))
 SELECT run_id, count(DISTINCT t) AS kinds, string_agg(DISTINCT t, '+' ORDER BY t) AS merged, count(*) AS n FROM d GROUP BY 1""")
def merged_trial_types(spark, d):
    """Per run the trial types joined by '+', as merged attributes are."""
    from sampleloom.operators.intervals import trimmed

    b = table(spark, d, "bold_events").select("event_id", "run_id", F.lower(trimmed(F.col("trial_type"))).alias("t")).where("t not in ('', 'n/a')").distinct()
    return b.groupBy("run_id").agg(F.countDistinct("t").alias("kinds"), ag.merge_unique("t").alias("merged"), F.count("*").alias("n"))
