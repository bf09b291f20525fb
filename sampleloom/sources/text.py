"""Text formats as DataFrames: column files, events, sensors, designs, recordings, exports.

All readers scan with Spark, so paths may be globs and gzip is transparent;
``path`` tells the file of each row. Lines are numbered by blocks, so a file of
any size is shared among tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sampleloom.operators.records import column_records, parse_lines
from sampleloom.session import materialised


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, numbered from 1 in each file.

    Files are split as any text is. A line's number is the count of lines in its
    file's blocks before (a table of one row a block) and its place in the
    block, which the row's number in the scan tells; no line is shuffled for it.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.expr("input_file_block_start()").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    blocks = lines.groupBy("path", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = materialised(blocks.select("path", "_block", "_first", before.alias("_before")))
    return lines.join(blocks, ["path", "_block"]).select("path", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line_no"), "line")


def content(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(path, line) without blank and comment lines, outer white space gone. Scanned line by line, splittable."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.trim(F.regexp_replace("value", r"[\t\r]+$", "")).alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith(comment))


def fields(sep: str | None = None, line: str = "line") -> Column:
    return F.split(F.trim(line), r"[ \t]+") if sep is None else F.transform(F.split(line, re.escape(sep)), lambda x: F.trim(x))


def typed(df: DataFrame, schema: list[tuple[str, str]], sep: str | None = None) -> DataFrame:
    """Lines to typed columns by place; what isn't a number becomes NULL."""
    f = fields(sep)
    return df.select("path", *(F.try_element_at(f, F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(schema)))


def columns(spark: SparkSession, path: str, header: list[str] | bool = True, sep: str | None = None, types: dict[str, str] | str = "double", skip: int = 0) -> DataFrame:
    """Column files of one layout: names from the header line or given, each column typed."""
    at = raw_lines(spark, path).where(F.col("line_no") > skip)
    if header is True:
        # one short line of one file
        first = at.where(F.col("line_no") == skip + 1).orderBy("path").first()
        names = [x for x in (re.split(r"[ \t]+", first["line"].strip()) if sep is None else first["line"].strip().split(sep)) if x]
        at = at.where(F.col("line_no") > skip + 1)
    else:
        names = list(header)
    body = at.select("path", F.trim("line").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    return typed(body, [(n, types if isinstance(types, str) else types.get(n, "string")) for n in names], sep)


def records(spark: SparkSession, path: str, types: dict[str, str], sep: str | None = None, header: list[str] | None = None, skip: int = 0) -> DataFrame:
    """Typed records of column files, with the reason for each line that fails; see :func:`sampleloom.operators.records.column_records`."""
    return column_records(raw_lines(spark, path), types, sep, header, skip)


def inferred(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited table with header, types inferred: int, then float, then text."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def rejects(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines that fail, with the reason; see :func:`sampleloom.operators.records.parse_lines`."""
    return parse_lines(lines, files).where("reason is not null")


def sample_attributes(spark: SparkSession, path: str, literal: bool = True) -> DataFrame:
    """Two columns: targets (text or number) and chunks."""
    return typed(content(spark, path), [("targets", "string" if literal else "double"), ("chunks", "double")])


def xavr_sensors(spark: SparkSession, path: str) -> DataFrame:
    return typed(content(spark, path), [("names", "string"), ("some_number", "int"), ("pos_x", "double"), ("pos_y", "double"), ("pos_z", "double")])


def meg_sensors(spark: SparkSession, path: str) -> DataFrame:
    """Name, inner y, x, z, outer y, x, z."""
    return typed(content(spark, path), [("names", "string"), *((n, "double") for n in ("pos_y", "pos_x", "pos_z", "pos_y2", "pos_x2", "pos_z2"))])


def ev3_events(spark: SparkSession, path: str) -> DataFrame:
    """Onset, duration, intensity."""
    return typed(content(spark, path), [("onset", "double"), ("duration", "double"), ("intensity", "double")])


def motion_parameters(spark: SparkSession, path: str) -> DataFrame:
    return typed(content(spark, path), [(n, "double") for n in ("rot1", "rot2", "rot3", "x", "y", "z")])


def tsv_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with header, tab separated."""
    return spark.read.csv(path, sep="\t", header=True, schema=None, inferSchema=True)


def numeric_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, values): rows of numbers, such as 1D files."""
    return content(spark, path).select("path", F.transform(fields(), lambda x: x.try_cast("double")).alias("values"))


def glm_design(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values) of a design matrix; lines with a slash are its header."""
    at = raw_lines(spark, path).where((F.trim("line") != "") & ~F.col("line").startswith("/"))
    base = at.groupBy("path").agg(F.min("line_no").alias("_0"))
    return at.join(base, "path").select("path", (F.col("line_no") - F.col("_0")).alias("row"), F.transform(fields(), lambda x: x.try_cast("double")).alias("values"))


def design_settings(spark: SparkSession, path: str) -> DataFrame:
    """(path, settings) of ``set key value`` lines."""
    kv = content(spark, path).select("path", F.regexp_extract("line", r"^set\s+(\S+)\s+(.*)$", 1).alias("k"), F.regexp_extract("line", r"^set\s+(\S+)\s+(.*)$", 2).alias("v")).where("k <> ''")
    return kv.groupBy("path", "k").agg(F.max(F.regexp_replace("v", r'^"|"$', "")).alias("v")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("settings"))


def rtc_design(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, predictors): map of predictor name to value; the quoted line holds the names."""
    at = raw_lines(spark, path)
    names = at.where(F.col("line").startswith('"')).select("path", F.col("line_no").alias("_h"), F.regexp_extract_all("line", F.lit('"([^"]*)"'), 1).alias("names"))
    body = at.join(names, "path").where((F.col("line_no") > F.col("_h")) & (F.trim("line") != ""))
    values = F.transform(fields(), lambda x: x.try_cast("double"))
    return body.select("path", (F.col("line_no") - F.col("_h") - 1).alias("row"), F.map_from_arrays("names", values).alias("predictors"))


def meg_recording(spark: SparkSession, path: str) -> DataFrame:
    """(path, channel, trial, timepoint, time, value) of recordings with one line a channel."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value").where(F.col("value").contains(":"))
    head, tail = F.substring_index("value", ":", 1), F.expr("substring(value, instr(value, ':') + 1)")
    cells = lines.select("path", head.alias("channel"), F.posexplode(F.split(F.trim(tail), r"[\t ]+")).alias("i", "v"))
    number = cells.where("channel = 'Sample Number'").select("path", "i", F.col("v").try_cast("int").alias("timepoint"))
    number = number.join(number.groupBy("path").agg((F.max("timepoint") + 1).alias("_n")), "path")
    time = cells.where("channel = 'Time'").select("path", "i", F.col("v").try_cast("double").alias("time"))
    data = cells.where("channel not in ('Sample Number', 'Time')").select("path", "channel", "i", F.col("v").try_cast("double").alias("value"))
    return data.join(number, ["path", "i"]).join(time, ["path", "i"], "left").selectExpr("path", "channel", "cast(i div _n as int) trial", "timepoint", "time", "value")


def eeg_export(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample, timepoint, channel, value) of epoched exports: names first, then time and values; time running back begins a sample."""
    at = raw_lines(spark, path).where(F.trim("line") != "")
    names = at.where("line_no = 1").select("path", fields().alias("names"))
    body = at.where("line_no > 1").select("path", "line_no", F.transform(fields(), lambda x: x.cast("double")).alias("v"))
    w = W.partitionBy("path").orderBy("line_no")
    body = body.withColumn("_new", F.coalesce((F.col("v")[0] < F.lag(F.col("v")[0]).over(w)).cast("int"), F.lit(0)))
    body = body.withColumn("sample", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).join(names, "path")
    right = F.size("v") == F.size("names") + 1
    cells = F.when(right, F.arrays_zip(F.col("names").alias("channel"), F.slice("v", 2, F.size("names")).alias("value"))).otherwise(F.raise_error(F.lit("a line has another number of values than channels")))
    flat = body.select("path", "sample", F.col("v")[0].alias("timepoint"), F.explode(cells).alias("c"))
    return flat.select("path", "sample", "timepoint", F.col("c")["0"].alias("channel") if "0" in flat.schema["c"].dataType.names else F.col("c")[flat.schema["c"].dataType.names[0]].alias("channel"), F.col("c")[flat.schema["c"].dataType.names[1]].alias("value"))


def eep_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, trial, channel, timepoint, value) of binary recordings: text header, then float32 trials x channels x time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                end = raw.index(b";EOH;")
                head, body = raw[:end].decode("ascii"), raw[raw.index(b"\n", end) + 1 :]
                info = {}
                for line in head.splitlines():
                    if ":" in line:
                        k, _, v = line.lstrip(";").partition(":")
                        info[k] = v.strip()
                    elif line.strip():
                        c, n, trials, t0, dt = line.strip().lstrip(";").split()[:5]
                        c, n, trials, t0, dt = int(c), int(n), int(trials), float(t0), float(dt)
                names = info.get("channels", "").split() or [str(i) for i in range(c)]
                x = np.frombuffer(body, "<f4", trials * c * n).astype(float)
                i = np.arange(len(x))
                yield pd.DataFrame({"path": name, "trial": i // (c * n), "channel": np.array(names, object)[i // n % c], "timepoint": t0 + (i % n) * dt, "value": x})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, trial int, channel string, timepoint double, value double")


def light_svm(spark: SparkSession, path: str) -> DataFrame:
    """(label, features) of dense ``label 1:v 2:v ...`` lines; incomplete or unordered indices raise."""
    f = fields()
    pairs = F.slice(f, 2, F.size(f) - 1)
    ok = F.forall(F.transform(pairs, lambda x, i: F.split(x, ":")[0].try_cast("int") == i + 1), lambda x: F.coalesce(x, F.lit(False)))
    values = F.transform(pairs, lambda x: F.split(x, ":")[1].cast("double"))
    return content(spark, path).select(f[0].alias("label"), F.when(ok, values).otherwise(F.raise_error(F.lit("indices must be complete and in order"))).alias("features"))


def roi_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, roi, kind, nodes) of surface regions: lines of node, type, count, nodes; type 4 is an edge, 1 an area."""
    at = raw_lines(spark, path).where(F.trim("line") != "")
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    at = at.withColumn("roi", F.sum(F.col("line").startswith("# <Node_ROI").cast("int")).over(w) - 1).where(~F.col("line").startswith("#"))
    v = F.transform(fields(), lambda x: x.cast("int"))
    kind = F.when(v[1] == 4, "edges").when(v[1] == 1, "areas").otherwise(F.raise_error(F.lit("unknown kind of region")))
    return at.select("path", "roi", kind.alias("kind"), F.slice(v, 4, F.size(v) - 3).alias("nodes"))


def surface_spec(spark: SparkSession, path: str) -> DataFrame:
    """(path, surface, properties) of surface specification files."""
    at = raw_lines(spark, path)
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    at = at.withColumn("surface", F.sum(F.col("line").contains("NewSurface").cast("int")).over(w) - 1)
    kv = at.select("path", "surface", F.regexp_extract("line", r"([\w\.]+)\s*=\s*([\w\./]+)", 1).alias("k"), F.regexp_extract("line", r"([\w\.]+)\s*=\s*([\w\./]+)", 2).alias("v")).where("k <> '' and surface >= 0")
    return kv.groupBy("path", "surface").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("properties"))


def niml_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, element, attributes) of the elements of NIML text files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"(?m)^#\s?", "").alias("value"))
    each = files.select("path", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<([A-Za-z_]\w*\b[^>]*?)/?>"), 1)).alias("e"))
    keys = F.regexp_extract_all("e", F.lit(r"(?s)([\w.]+)\s*=\s*\"?([^\"\n]*?)\"?\s*(?=\n|\s[\w.]+\s*=|$)"), 1)
    values = F.regexp_extract_all("e", F.lit(r"(?s)([\w.]+)\s*=\s*\"?([^\"\n]*?)\"?\s*(?=\n|\s[\w.]+\s*=|$)"), 2)
    return each.select("path", F.regexp_extract("e", r"^(\w+)", 1).alias("element"), F.map_from_arrays(keys, values).alias("attributes"))


def ascii_surface(path: str):
    """Mesh of an ASCII surface file: counts, then vertices, then faces."""
    from sampleloom.operators.neighborhood import Surface

    with open(path) as f:
        lines = [x for x in f if x.strip() and not x.startswith("#")]
    n, m = map(int, lines[0].split()[:2])
    v = np.array([x.split()[:3] for x in lines[1 : n + 1]], float)
    return Surface(v, np.array([x.split()[:3] for x in lines[n + 1 : n + m + 1]], int))


def xml_atlas(spark: SparkSession, path: str, row: str = "label") -> DataFrame:
    """Labels of an XML atlas."""
    return spark.read.format("xml").option("rowTag", row).load(path)


def study(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """A study's directory layout: events of all runs with subject, task and run, condition and task keys.

    Subject, task and run come from the paths, so one scan reads all runs.
    """
    part = lambda p, c="path": F.regexp_extract(c, p, 1)
    onsets = typed(content(spark, f"{root}/sub*/model/*/onsets/*/cond*.txt"), [("onset", "double"), ("duration", "double"), ("intensity", "double")])
    onsets = onsets.select(part(r"/(sub\d+)/").alias("subject"), part(r"/model/([^/]+)/").alias("model"), part(r"/(task\d+)_run").alias("task"), part(r"_run(\d+)/").alias("run"), part(r"/cond(\d+)\.txt").alias("cond_id"), "onset", "duration", "intensity")
    three = [("task", "string"), ("cond_id", "string")]
    keys = content(spark, f"{root}/models/*/condition_key.txt")
    keys = keys.select(part(r"/models/([^/]+)/").alias("model"), *(fields()[i].alias(n) for i, (n, _) in enumerate(three)), F.regexp_replace("line", r"^\S+\s+\S+\s+", "").alias("condition"))
    named = onsets.join(keys.withColumn("cond_id", F.regexp_extract("cond_id", r"(\d+)", 1)), ["model", "task", "cond_id"], "left")
    return {"events": named, "conditions": keys}


def inline(spark: SparkSession, name: str, values: list) -> DataFrame:
    """An attribute given in place."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["sample_id", name])


def npy(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """A vector from a .npy file."""
    return inline(spark, name, np.load(path, allow_pickle=False).tolist())


NIML_GROUP = re.compile(r"<(\w+)((?:\s+[\w.]+\s*=\s*(?:\"[^\"]*\"|\S+?))*)\s*(/?)>", re.S)
NIML_ATTR = re.compile(r"([\w.]+)\s*=\s*(?:\"([^\"]*)\"|([^\s>]+))", re.S)


def niml_datasets(spark: SparkSession, path: str) -> DataFrame:
    """(path, node, row, values, labels, stats) of NIML datasets in text form: the data rows with their node indices, and the column labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["path"], pdf["value"], strict=True):
                text = re.sub(r"(?m)^#\s?", "", text)
                data, nodes, info = [], None, {}
                for m in NIML_GROUP.finditer(text):
                    attrs = {a: b or c for a, b, c in NIML_ATTR.findall(m.group(2))}
                    body = text[m.end() : text.find(f"</{m.group(1)}>", m.end())] if not m.group(3) else ""
                    if m.group(1) == "SPARSE_DATA":
                        data = [[float(v) for v in line.split()] for line in body.strip().splitlines() if line.strip()]
                    elif m.group(1) == "INDEX_LIST":
                        nodes = [int(v) for v in body.split()]
                    elif m.group(1) == "AFNI_atr":
                        info[attrs.get("atr_name")] = body.strip().strip('"')
                n = len(data)
                nodes = nodes if nodes is not None else list(range(n))
                yield pd.DataFrame({"path": [name] * n, "row": list(range(n)), "node": nodes[:n], "values": data, "labels": [info.get("COLMS_LABS")] * n, "stats": [info.get("COLMS_STATSYM")] * n})

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(run, "path string, row int, node int, values array<double>, labels string, stats string")
