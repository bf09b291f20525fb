"""Delimited lines to typed records, with every failing line set apart and why.

The split is done by structural indexing over a byte buffer: a quote mask, its
prefix parity, and from both the delimiters and field ends, all as NumPy array
operations over many lines at once. Which lines fail follows from counts and
type checks on that index, the numbers of all lines run through their grammar
together; only fields that fail there are looked at one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
QUOTE, COMMA = 34, 44


class Structure:
    """Structural index of lines that share one separator.

    ``lines`` are UTF-8 byte strings without outer white space. ``sep`` is the
    separator's bytes, None for any run of blanks or tabs. Field f of line i is
    ``buffer[start[k]:end[k]]`` with k = ``first[i] + f``, blanks around it and
    enclosing quotes excluded; ``broken[i]`` says that the quoting is broken.
    """

    def __init__(self, lines: list[bytes], sep: bytes | None):
        n = len(lines)
        lengths = np.fromiter(map(len, lines), np.int64, n)
        # one guard byte after each line: every line then ends with a delimiter
        self.buffer = b"\n".join(lines) + b"\n"
        buf = np.frombuffer(self.buffer, np.uint8)[: int(lengths.sum()) + n]
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        quote = buf == QUOTE
        before = np.cumsum(quote) - quote
        line_of = np.repeat(np.arange(n), lengths + 1)
        inside = ((before - before[begins][line_of]) & 1).astype(bool)
        record_end = np.zeros(len(buf), bool)
        record_end[ends] = True
        odd = (before[ends] - before[begins]) & 1
        if sep is None:
            blank = ((buf == 32) | (buf == 9)) & ~inside & ~record_end
            delimiter = blank.copy()
            delimiter[1:] &= ~blank[:-1]
            width = 1
        else:
            delimiter = buf == sep[0]
            width = len(sep)
            for k in range(1, width):
                delimiter[:-k] &= buf[k:] == sep[k]
                delimiter[-k:] = False
            delimiter &= ~inside & ~record_end
            if width > 1:
                delimiter = _without_overlaps(delimiter, width)
        cut = np.flatnonzero(delimiter | record_end)
        self.count = np.bincount(line_of[cut], minlength=n)
        self.first = np.cumsum(self.count) - self.count
        start = np.empty(len(cut), np.int64)
        start[1:] = cut[:-1] + np.where(record_end[cut[:-1]], 1, width)
        start[:1] = 0
        # trim blanks: next and previous sign that is none, within the field
        solid = ~BLANKS[buf]
        solid[ends] = False
        at = np.flatnonzero(solid)
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, cut)
        empty = lo >= hi
        at = np.append(at, 0)
        s = np.where(empty, cut, at[np.minimum(lo, len(at) - 1)])
        e = np.where(empty, cut, at[hi - 1] + 1)
        # a field with quotes: each other sign in it must lie inside them
        total = np.append(np.cumsum(quote) - quote, quote.sum())
        quoted = total[e] > total[s]
        stray = np.append(0, np.cumsum(~quote & ~inside))
        bad = quoted & (stray[e] > stray[s])
        self.broken = odd.astype(bool)
        np.logical_or.at(self.broken, line_of[cut], bad)
        self.start, self.end, self.quoted = np.where(quoted, s + 1, s), np.where(quoted, e - 1, e), quoted

    def field(self, line: int, f: int) -> bytes:
        k = self.first[line] + f
        x = self.buffer[self.start[k] : self.end[k]]
        return x.replace(b'""', b'"') if self.quoted[k] else x

    def fields(self, line: int) -> list[bytes]:
        return [self.field(line, f) for f in range(self.count[line])]


def _without_overlaps(delimiter: np.ndarray, width: int) -> np.ndarray:
    kept, last = np.zeros_like(delimiter), -width
    for i in np.flatnonzero(delimiter):
        if i - last >= width:
            kept[i] = True
            last = i
    return kept


def number(x: bytes) -> float | None:
    """The finite decimal number ``x`` spells in ASCII, None if it spells none."""
    x = x.strip()
    if not NUMBER.match(x):
        return None
    value = float(x)
    return value if np.isfinite(value) else None


#: Signs of a number by kind (digit, sign, point, exponent, none, other), and the grammar of numbers as a table of states.
KIND = np.full(256, 5, np.uint8)
KIND[48:58], KIND[[43, 45]], KIND[46], KIND[[69, 101]], KIND[0] = 0, 1, 2, 3, 4
START, SIGNED, WHOLE, POINT, BARE, BROKEN_PART, EXPONENT, EXPONENT_SIGN, EXPONENT_PART, DONE, NONE = range(11)
NEXT = np.full((11, 6), NONE, np.uint8)
for _state, _moves in {
    START: {0: WHOLE, 1: SIGNED, 2: BARE}, SIGNED: {0: WHOLE, 2: BARE}, WHOLE: {0: WHOLE, 2: POINT, 3: EXPONENT, 4: DONE}, POINT: {0: BROKEN_PART, 3: EXPONENT, 4: DONE}, BARE: {0: BROKEN_PART},
    BROKEN_PART: {0: BROKEN_PART, 3: EXPONENT, 4: DONE}, EXPONENT: {0: EXPONENT_PART, 1: EXPONENT_SIGN}, EXPONENT_SIGN: {0: EXPONENT_PART}, EXPONENT_PART: {0: EXPONENT_PART, 4: DONE}, DONE: {4: DONE},
}.items():
    for _kind, _to in _moves.items():
        NEXT[_state, _kind] = _to
#: Stands for a layout's missing separator or header.
ABSENT = "\x01"
#: Bytes of a number that are checked together; longer ones are looked at one by one.
DIGITS = 40


def numbers(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The finite decimal numbers spelt by ``buffer[start:end]``, NaN where there is none; all fields at once."""
    width = np.minimum(end - start, DIGITS)
    at = start[:, None] + np.arange(DIGITS + 1)
    cells = np.where(np.arange(DIGITS + 1) < width[:, None], buffer[np.minimum(at, len(buffer) - 1)], 0).astype(np.uint8)
    state = np.zeros(len(start), np.uint8)
    for k in range(DIGITS + 1):
        state = NEXT[state, KIND[cells[:, k]]]
    fine = (state == DONE) & (end - start <= DIGITS)
    out = np.full(len(start), np.nan)
    if fine.any():
        out[fine] = np.ascontiguousarray(cells[fine, :DIGITS]).view(f"S{DIGITS}").ravel().astype(float)
    # what remains is long, has blanks inside its quotes, or is no number
    for i in np.flatnonzero(~fine):
        v = number(buffer[start[i] : end[i]].tobytes())
        out[i] = np.nan if v is None else v
    return np.where(np.isfinite(out), out, np.nan)


def header_names(header: str, sep: str | None) -> list[str]:
    s = Structure([header.strip().encode()], None if sep is None else sep.encode())
    return [x.decode() for x in s.fields(0)]


def _parsed(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf[["file_id", "line_no"]].copy()
    lines = [x.strip().encode() for x in pdf["line"]]
    reason = np.full(len(pdf), None, object)
    values = np.full((2, len(pdf)), np.nan)
    content = np.fromiter((bool(x) and not x.startswith(b"#") for x in lines), bool, len(lines))
    # lines of one layout share everything but their bytes
    code, layouts = pd.factorize(pd.MultiIndex.from_frame(pdf[["sep", "header", "header_sep"]].fillna(ABSENT)))
    places = []
    for key in layouts:
        sep, header, header_sep = (None if x == ABSENT else x for x in key)
        names = header_names(header, header_sep) if header is not None else []
        places.append((sep, len(names), *(names.index(c) if c in names else -1 for c in ("onset", "duration"))))
    seps = [p[0] for p in places]
    table = np.array([p[1:] for p in places], np.int64).reshape(-1, 3)
    for sep in dict.fromkeys(seps):
        rows = np.flatnonzero(content & np.isin(code, [i for i, x in enumerate(seps) if x == sep]))
        if not len(rows):
            continue
        s = Structure([lines[i] for i in rows], sep.encode() if sep else None)
        buffer = np.frombuffer(s.buffer, np.uint8)
        broken, count, (width, *columns) = np.asarray(s.broken, bool), np.asarray(s.count), table[code[rows]].T
        right = ~broken & (count == width)
        found = np.full((2, len(rows)), np.nan)
        for f, column in enumerate(columns):
            use = right & (column >= 0)
            at = np.asarray(s.first)[use] + column[use]
            found[f, use] = numbers(buffer, np.asarray(s.start)[at], np.asarray(s.end)[at])
        bad = right & (np.isnan(found).any(0) | (found[1] < 0))
        reason[rows[broken]], reason[rows[~broken & ~right]], reason[rows[bad]] = "quoting", "columns", "value"
        values[:, rows[right & ~bad]] = found[:, right & ~bad]
    out["onset"], out["duration"], out["reason"] = values[0], values[1], reason
    return out[content]


def parse_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Records (file_id, line_no, onset, duration, reason) of the data lines.

    ``lines`` (file_id, line_no, line) hold the raw text, ``files`` (file_id,
    sep, header, skiplines) each file's layout. Skipped, header, blank and
    comment lines give no record. A valid record has a NULL reason; a rejected
    one has NULL numbers and the first that applies of ``quoting``, ``columns``
    and ``value``.

    Cases: a NULL line or key gives no record; a NULL skiplines is 0; repeated
    rows give one record; a file without header line, or whose header lacks
    onset or duration, gives only rejects; lines of unknown files are left out;
    further columns on either side are ignored; empty tables give an empty
    result. Lines are parsed in Arrow batches, so neither a file that holds
    most rows nor a very long line gathers anywhere: the joins are on file_id
    with the small side (one row a file) broadcast by Spark if its measured
    size allows, else sort-merge with AQE splitting hot files.
    """
    lines = lines.select("file_id", "line_no", "line").where("file_id is not null and line_no is not null and line is not null")
    layout = files.select(
        "file_id", F.when(F.length("sep") > 0, F.col("sep")).alias("sep"), "header", F.coalesce("skiplines", F.lit(0)).alias("skiplines")
    ).where("file_id is not null").dropDuplicates(["file_id"])
    own = (
        lines.join(layout.where("header is null"), "file_id")
        .where("line_no = skiplines + 1")
        .groupBy("file_id")
        .agg(F.min("line").alias("own_header"))
    )
    given: Column = F.col("header").isNotNull()
    layout = layout.join(own, "file_id", "left").select(
        "file_id",
        "sep",
        F.coalesce("header", "own_header").alias("header"),
        F.when(given, F.lit(",")).otherwise(F.col("sep")).alias("header_sep"),
        (F.col("skiplines") + F.when(given, 0).otherwise(1)).alias("first"),
    )
    body = lines.join(layout, "file_id").where("line_no > first").drop("first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _parsed(pdf)

    types = dict(lines.dtypes)
    parsed = body.mapInPandas(run, f"file_id {types['file_id']}, line_no {types['line_no']}, onset double, duration double, reason string")
    valid = F.col("reason").isNull()
    # of repeated rows one is kept, and kept whole
    row = F.struct(F.when(valid, F.col("onset")).alias("onset"), F.when(valid, F.col("duration")).alias("duration"), "reason")
    return parsed.groupBy("file_id", "line_no").agg(F.min(row).alias("r")).select("file_id", "line_no", "r.*")


def column_records(lines: DataFrame, types: dict[str, str], sep: str | None = None, header: list[str] | None = None, skip: int = 0, comment: str = "#") -> DataFrame:
    """Typed records of column files of any columns: (path, line_no, the columns of ``types``, reason).

    ``lines`` (path, line_no, line) are numbered from 1 in each file. ``types``
    names the wanted columns as ``double``, ``long`` or ``string``; their order
    and further columns may differ from file to file. Without ``header`` the
    first line after ``skip`` ones holds the names.

    Cases: blank and comment lines give no row; a line that fails has the first
    that applies of ``quoting``, ``columns`` and ``value`` (a number that isn't
    one, a ``long`` that isn't whole, or a column that the header lacks) as its
    reason and NULL values; repeated rows give one; NULL lines none.
    """
    lines = lines.select("path", "line_no", "line").where("path is not null and line is not null").dropDuplicates(["path", "line_no"])
    if header is None:
        names = lines.where(F.col("line_no") == skip + 1).select("path", F.col("line").alias("header"))
        body = lines.where(F.col("line_no") > skip + 1).join(names, "path")
    else:
        body = lines.where(F.col("line_no") > skip).withColumn("header", F.lit(None).cast("string"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [x.strip() for x in pdf["line"]]
            pdf = pdf.assign(line=text)[[bool(x) and not x.startswith(comment) for x in text]].reset_index(drop=True)
            for first, part in pdf.groupby("header", dropna=False):
                columns = header or header_names(first, sep)
                s = Structure([x.encode() for x in part["line"]], sep.encode() if sep else None)
                buffer = np.frombuffer(s.buffer, np.uint8)
                right = ~np.asarray(s.broken, bool) & (np.asarray(s.count) == len(columns))
                bad, values = np.zeros(len(part), bool), {}
                for name, kind in types.items():
                    if name not in columns:
                        bad[:] = True
                        values[name] = np.full(len(part), None if kind == "string" else np.nan, object if kind == "string" else float)
                        continue
                    at = np.asarray(s.first)[right] + columns.index(name)
                    if kind == "string":
                        values[name] = np.full(len(part), None, object)
                        values[name][right] = [s.field(i, columns.index(name)).decode() for i in np.flatnonzero(right)]
                        continue
                    values[name] = np.full(len(part), np.nan)
                    values[name][right] = numbers(buffer, np.asarray(s.start)[at], np.asarray(s.end)[at])
                    bad |= right & (np.isnan(values[name]) | ((kind == "long") & (values[name] != np.round(values[name]))))
                bad &= right
                reason = np.full(len(part), None, object)
                reason[np.asarray(s.broken, bool)], reason[~np.asarray(s.broken, bool) & ~right], reason[bad] = "quoting", "columns", "value"
                out = part[["path", "line_no"]].copy()
                for name, kind in types.items():
                    v = pd.Series(values[name], index=part.index).where(right & ~bad)
                    out[name] = v if kind == "double" else v.astype(object).where(v.notna(), None) if kind == "string" else v.astype("Int64")
                yield out.assign(reason=reason)

    schema = ", ".join([f"path {dict(lines.dtypes)['path']}", f"line_no {dict(lines.dtypes)['line_no']}", *(f"{n} {t}" for n, t in types.items()), "reason string"])
    return body.mapInPandas(parse, schema)
