"""Continuous periods and gaps of intervals, by a globally sorted two-pass scan.

The intervals are range-sorted by (entity, start, end) over all partitions. A
first pass gives each partition's summary; the summaries, one row a partition,
are combined in order to the state in which each partition begins; a second
pass rescans with that carried state. An entity of any size is thus spread over
as many partitions as its rows need, and nothing is gathered per entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.session import checkpointed, partitions_for

WHITE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trimmed(c: Column) -> Column:
    """``c`` without outer white space of any kind."""
    return F.regexp_replace(c, WHITE, "")


def _runs(pdf: pd.DataFrame, keys: list[str]) -> list[tuple[tuple, np.ndarray, np.ndarray]]:
    """Stretches of one entity in sorted rows: its key, starts and ends."""
    if not len(pdf):
        return []
    change = np.zeros(len(pdf), bool)
    change[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    at = [*np.flatnonzero(change), len(pdf)]
    s, e, key = pdf["s"].to_numpy(), pdf["e"].to_numpy(), [pdf[k].to_numpy() for k in keys]
    return [(tuple(v[a] for v in key), s[a:b], e[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _islands(s: np.ndarray, e: np.ndarray, start, end) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the periods of one entity's sorted intervals, after an open period (start, end)."""
    if start is not None:
        s, e = np.append(start, s), np.append(end, e)
    top = np.maximum.accumulate(e)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > top[:-1]
    at = np.flatnonzero(new)
    return s[at], top[np.append(at[1:], len(s)) - 1]


def _open_state(batches: Iterator[pd.DataFrame], keys: list[str], state: tuple | None):
    """Scan of one partition; yields closed periods as (key, starts, ends, next starts) and finally the open state."""
    for pdf in batches:
        for key, s, e in _runs(pdf, keys):
            same = state is not None and state[0] == key
            if state is not None and not same:
                yield state[0], np.array([state[1]]), np.array([state[2]]), np.array([], np.int64)
            a, b = _islands(s, e, *(state[1:] if same else (None, None)))
            if len(a) > 1:
                yield key, a[:-1], b[:-1], a[1:]
            state = (key, a[-1], b[-1])
    yield state


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Maximal covered periods and the gaps between them, per entity.

    ``df`` has one interval [start, end] a row, in whole numbers; ``keys`` name
    the entity's columns. Result: keys, kind (``period`` or ``gap``), start and
    end. Touching intervals form one period.

    Cases: intervals with a NULL key, start or end, or whose end is not after
    their start, cover nothing; repeated, nested and tied intervals change
    nothing; further columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    spark = df.sparkSession
    names = [f"k{i}" for i in range(len(keys))]
    types = [df.schema[k].dataType.simpleString() for k in keys]
    plain = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    plain = plain.where("s < e").dropna(subset=names)
    order = [*names, "s", "e"]
    sorted_ = checkpointed(plain.repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order))
    key_schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the partition: its first entity, and its last one with the period open at the end."""
        first, state = None, None
        for pdf in batches:
            for key, s, e in _runs(pdf, names):
                first = first or key
                a, b = _islands(s, e, *(state[1:] if state is not None and state[0] == key else (None, None)))
                state = (key, a[-1], b[-1])
        if state is not None:
            yield pd.DataFrame([{"pid": TaskContext.get().partitionId(), "single": first == state[0], "s": state[1], "e": state[2]} | dict(zip(names, state[0], strict=True))])

    # one row a partition: bounded by the number of partitions, not by the data
    rows = sorted_.mapInPandas(summary, f"pid int, single boolean, s long, e long, {key_schema}").collect()
    carry: dict[int, tuple | None] = {}
    state = None
    for r in sorted(rows, key=lambda r: r["pid"]):
        carry[r["pid"]] = state
        key, s, e = tuple(r[n] for n in names), r["s"], r["e"]
        if state is not None and r["single"] and state[0] == key and s <= state[2]:
            s, e = state[1], max(e, state[2])  # the carried period reaches the partition's last one
        state = (key, s, e)
    last = max(carry, default=None)

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        if pid not in carry:
            return
        rows: list[tuple] = []
        scan = _open_state(batches, names, carry[pid])
        for x in scan:
            if x is not None and len(x) == 4:
                key, a, b, nxt = x
                rows += [(*key, "period", i, j) for i, j in zip(a, b, strict=True)]
                rows += [(*key, "gap", i, j) for i, j in zip(b, nxt, strict=False)]
            elif x is not None and pid == last:
                rows.append((*x[0], "period", x[1], x[2]))
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=[*names, "kind", "s", "e"])
                rows = []
        yield pd.DataFrame(rows, columns=[*names, "kind", "s", "e"])

    found = sorted_.mapInPandas(rescan, f"{key_schema}, kind string, s long, e long")
    return found.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "kind", F.col("s").alias(start), F.col("e").alias(end))
