"""Queries of the general data problems: failing rows, intervals, packed fields, implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.operators.intervals import periods_and_gaps, trimmed
from sampleloom.operators.packed import split_packed
from sampleloom.operators.readings import implausible
from sampleloom.operators.records import parse_lines
from sampleloom.session import table


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Valid data lines as typed records."""
    return parse_lines(table(spark, d, "column_lines"), table(spark, d, "column_files")).where("reason is null").drop("reason")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Data lines that fail, with the reason."""
    parsed = parse_lines(table(spark, d, "column_lines"), table(spark, d, "column_files"))
    return parsed.where("reason is not null").select("file_id", "line_no", "reason")


# read from left to right, quoted spans of one word lose their quotes and others become a letter; then separators separate
P1_SQL = r"""
WITH f AS (SELECT file_id, nullif(sep, '') AS sep, header, coalesce(skiplines, 0) AS skip FROM column_files),
l AS (SELECT DISTINCT file_id, line_no, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM column_lines WHERE line IS NOT NULL),
h AS (SELECT f.*, coalesce(header, own.t) AS names, CASE WHEN header IS NULL THEN skip + 1 ELSE skip END AS top, CASE WHEN header IS NULL THEN sep ELSE ',' END AS hsep
 FROM f LEFT JOIN l AS own ON own.file_id = f.file_id AND own.line_no = f.skip + 1 AND f.header IS NULL),
n AS (SELECT *, list_transform(CASE WHEN hsep IS NULL THEN regexp_split_to_array(names, '[ \t]+') ELSE string_split(names, hsep) END, lambda x: trim(trim(x, ' ' || chr(9)), '"')) AS cols FROM h),
b AS (SELECT l.file_id, line_no, t, sep, cols FROM l JOIN n USING (file_id) WHERE line_no > top AND t <> '' AND t NOT LIKE '#%'),
q AS (SELECT *, CASE WHEN sep IS NULL THEN regexp_full_match(t, '("([^"]|"")*"|[^" \t]+)([ \t]+("([^"]|"")*"|[^" \t]+))*')
  ELSE regexp_full_match(replace(t, sep, chr(1)), '[ \t]*("([^"]|"")*"|[^"\x01]*)[ \t]*(\x01[ \t]*("([^"]|"")*"|[^"\x01]*)[ \t]*)*') END AS closed,
  array_to_string(list_transform(regexp_extract_all(replace(t, coalesce(sep, chr(2)), chr(1)), '"([^"]|"")*"|[^"]'), lambda x: CASE WHEN x[1] <> '"' THEN x WHEN regexp_full_match(x, '"[ ]*[^" \t\x01]+[ ]*"') THEN trim(trim(x, '"')) ELSE 'Q' END), '') AS bare FROM b),
v AS (SELECT *, CASE WHEN sep IS NULL THEN regexp_split_to_array(bare, '[ \t]+') ELSE string_split(bare, chr(1)) END AS parts FROM q),
w AS (SELECT *, trim(parts[list_position(cols, 'onset')], ' ' || chr(9)) AS onset, trim(parts[list_position(cols, 'duration')], ' ' || chr(9)) AS duration FROM v),
x AS (SELECT *, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?' AS num FROM w),
r AS (SELECT file_id, line_no, CASE WHEN NOT closed THEN 'quoting' WHEN len(parts) <> len(cols) THEN 'columns'
  WHEN NOT (coalesce(regexp_full_match(onset, num), false) AND coalesce(regexp_full_match(duration, num), false)) THEN 'value'
  WHEN NOT (isfinite(TRY_CAST(onset AS DOUBLE)) AND isfinite(TRY_CAST(duration AS DOUBLE)) AND TRY_CAST(duration AS DOUBLE) >= 0) THEN 'value' END AS reason,
  TRY_CAST(onset AS DOUBLE) AS onset, TRY_CAST(duration AS DOUBLE) AS duration FROM x)
"""
P1_FOUND_SQL = P1_SQL + "SELECT file_id, CAST(line_no AS INT) AS line_no, reason FROM r WHERE reason IS NOT NULL"
P1_RECORDS_SQL = P1_SQL + "SELECT file_id, CAST(line_no AS INT) AS line_no, onset, duration FROM r WHERE reason IS NULL"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of the events of each run and trial type, and the gaps between them.

    Times beyond 9e15 seconds either way, which no BIGINT of milliseconds holds, are as missing ones.
    """
    kind = F.lower(trimmed(F.col("trial_type")))
    finite = ~F.isnan("onset") & ~F.isnan("duration") & (F.abs("onset") < 9e15) & (F.abs("duration") < 9e15)
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    events = (
        table(spark, d, "bold_events")
        .select("run_id", kind.alias("trial_type"), "onset", "duration")
        .where(finite & (F.col("duration") > 0) & ~F.col("trial_type").isin("", "n/a"))
        .select("run_id", "trial_type", ms("onset").alias("start_ms"), (ms("onset") + ms("duration")).alias("end_ms"))
    )
    return periods_and_gaps(events, ["run_id", "trial_type"], "start_ms", "end_ms")


P2_SQL = r"""
WITH e AS (
  SELECT run_id, lower(regexp_replace(trial_type, '^\s+|\s+$', '', 'g')) AS trial_type,
         CAST(round(onset * 1000) AS BIGINT) AS s, CAST(round(onset * 1000) AS BIGINT) + CAST(round(duration * 1000) AS BIGINT) AS e
  FROM bold_events WHERE isfinite(onset) AND isfinite(duration) AND duration > 0 AND run_id IS NOT NULL),
f AS (SELECT DISTINCT * FROM e WHERE trial_type NOT IN ('', 'n/a') AND s < e),
m AS (SELECT *, max(e) OVER (PARTITION BY run_id, trial_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, trial_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
p AS (SELECT run_id, trial_type, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY run_id, trial_type, g),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY run_id, trial_type ORDER BY start_ms) AS nxt FROM p)
SELECT run_id, trial_type, 'period' AS kind, start_ms, end_ms FROM p
UNION ALL SELECT run_id, trial_type, 'gap', end_ms, nxt FROM n WHERE nxt IS NOT NULL
"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values packed in labels and stats, one a row, with their places."""
    return split_packed(table(spark, d, "niml_dsets"), ["dset_id"], ["labels", "stats"]).where("dset_id is not null").distinct()


# one item after the other, with its delimiter: a quoted value, or any signs with parentheses and entities as one
P3_SQL = r"""
WITH t AS (SELECT DISTINCT dset_id, 'labels' AS field_name, labels AS x FROM niml_dsets UNION SELECT DISTINCT dset_id, 'stats', stats FROM niml_dsets),
b AS (SELECT dset_id, field_name, CASE WHEN regexp_full_match(regexp_replace(x, '^\s+|\s+$', '', 'g'), '(?s)\[.*\]') THEN regexp_replace(x, '(?s)^\s*\[(.*)\]\s*$', '\1') ELSE x END AS x FROM t WHERE x IS NOT NULL AND dset_id IS NOT NULL),
i AS (SELECT dset_id, field_name, regexp_extract_all(x, '(?:[ \r]*(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*'')[ \r]*|(?:\([^()]*\)|&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^;,|\t\n(&]|[(&])*)(?:[;,|\t\n]|$)') AS items FROM b),
u AS (SELECT dset_id, field_name, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM i),
v AS (SELECT dset_id, field_name, pos, regexp_replace(regexp_replace(item, '[;,|\t\n]$', ''), '^\s+|\s+$', '', 'g') AS v FROM u),
q AS (SELECT dset_id, field_name, pos, CASE WHEN regexp_full_match(v, '"(?:[^"]|"")*"') THEN replace(v[2:-2], '""', '"') WHEN regexp_full_match(v, '''(?:[^'']|'''')*''') THEN replace(v[2:-2], '''''', '''') ELSE v END AS v FROM v),
d AS (SELECT dset_id, field_name, pos, regexp_replace(replace(replace(replace(replace(v, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS value FROM q)
SELECT DISTINCT dset_id, field_name, CAST(pos AS INT) AS pos, value FROM d WHERE value <> ''
"""


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings with what is wrong with them."""
    return implausible(table(spark, d, "meg_data"), ["recording_id", "channel_id"], "sample_number", "data")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings."""
    return p5_flags(spark, d).select("recording_id", "channel_id", "sample_number")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p2_found, p3_found, p5_found, p5_flags)}
SQL = {"p1_found": P1_FOUND_SQL, "p1_records": P1_RECORDS_SQL, "p2_found": P2_SQL, "p3_found": P3_SQL}
