"""Several values packed in one field, split by a learned segmentation.

Each distinct field becomes a lattice: nodes are its delimiters, edges the
possible values between them. Quoted spans, parentheses and character entities
are atomic where they are well formed; where a quote or parenthesis is left
open, it may be an ordinary sign or protect the delimiters behind it up to any
later place, and all these readings stay in the lattice.
Expectation-maximisation over the whole column learns how frequent each value
is and how often each sign protects (forward-backward over the lattices, summed
by Spark), and a Viterbi pass picks the likeliest segmentation of each field.

A delimiter outside quotes, parentheses and entities always delimits and one
inside never does; that is what the column format says, so edges against it
have weight 0 and aren't built. A field without open signs has one path left,
whose posterior is 1 in every round: its counts are taken once.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator
from html.entities import html5
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.session import materialised, release

DELIMITERS = ";,|\t\n"
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
TOKENS = re.compile(r"""[;,|\t\n"'()&]""")
#: Probability that an open quote or parenthesis protects what follows: first guess, and the openers that it counts as.
LOOSE, FIRM = 0.1, 10.0
#: What a value that was never seen costs, and each of its characters, in natural logarithms.
UNSEEN, CHARACTER = 20.0, 2.0
#: Characters up to which a value is its own key.
BRIEF = 64


def entity_end(text: str, at: int) -> int:
    """End of the character entity that begins at ``at``, -1 if none does."""
    m = ENTITY.match(text, at)
    if m and (text[at + 1] == "#" or m.group()[1:] in html5):
        return m.end()
    return -1


def bare(text: str) -> tuple[int, int]:
    """The span of the list in ``text``: without outer white space and the brackets around the whole."""
    lo, hi = 0, len(text)
    while lo < hi and text[lo].isspace() and text[lo] not in DELIMITERS:
        lo += 1
    while hi > lo and text[hi - 1].isspace() and text[hi - 1] not in DELIMITERS:
        hi -= 1
    a, b = lo, hi
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return (a + 1, b - 1) if b - a >= 2 and text[a] == "[" and text[b - 1] == "]" else (lo, hi)


def _quote_end(text: str, at: int, hi: int) -> int:
    """Where the quoted value opened at ``at`` ends, after its closing quote; -1 if it is not well formed."""
    q, i = text[at], at + 1
    while True:
        i = text.find(q, i, hi)
        if i < 0:
            return -1
        if text[i + 1 : i + 2] == q and i + 1 < hi:
            i += 2
            continue
        j = i + 1
        while j < hi and text[j].isspace() and text[j] not in DELIMITERS:
            j += 1
        if j >= hi or text[j] in DELIMITERS:
            return i + 1
        i += 1


def _paren_end(text: str, at: int, hi: int) -> int:
    depth = 0
    for m in re.compile("[()]").finditer(text, at, hi):
        depth += 1 if m.group() == "(" else -1
        if not depth:
            return m.end()
    return -1


def boundaries(text: str) -> tuple[int, int, list[int], list[int], list[tuple[int, str]]]:
    """Span of the list, its sure delimiters, those that an open sign may protect, and the open signs.

    An open sign is given as (number of delimiters before it, sign).
    """
    lo, hi = bare(text)
    sure, loose, opened = [], [], []

    def closed(end: int, i: int) -> int:
        if end < 0:
            opened.append((len(sure) + len(loose), text[i]))
        return end if end > 0 else i + 1

    i, fresh = lo, True
    while i < hi:
        c = text[i]
        if c in DELIMITERS:
            (loose if opened else sure).append(i)
            fresh, i = True, i + 1
        elif c.isspace():
            i += 1
        elif c in "\"'" and fresh:
            fresh, i = False, closed(_quote_end(text, i, hi), i)
        elif c == "(":
            fresh, i = False, closed(_paren_end(text, i, hi), i)
        elif c == "&":
            end = entity_end(text, i)
            fresh, i = False, (end if end > 0 else i + 1)
        else:
            m = TOKENS.search(text, i + 1, hi)
            fresh, i = False, (m.start() if m else hi)
    return lo, hi, sure, loose, opened


def value_of(raw: str) -> str:
    """A piece's value: outer white space and enclosing quotes gone, entities decoded."""
    x = raw.strip()
    if len(x) >= 2 and x[0] in "\"'" and x[-1] == x[0] and _quote_end(x, 0, len(x)) == len(x):
        x = x[1:-1].replace(x[0] * 2, x[0])
    out, last = [], 0
    for m in ENTITY.finditer(x):
        if entity_end(x, m.start()) > 0:
            out += [x[last : m.start()], html.unescape(m.group())]
            last = m.end()
    return ("".join(out) + x[last:]).strip()


def value_key(value: str) -> str:
    """The value, or a digest of one that is long."""
    return value if len(value) <= BRIEF else "\0" + hashlib.sha256(value.encode()).hexdigest()


class Edge(NamedTuple):
    """The value between nodes ``start`` and ``end``, by its key; ``sign`` is the open sign that the edge decides on, ``over`` whether that protects."""

    start: int
    end: int
    key: str
    length: int
    sign: str | None
    over: bool


class Lattice:
    """The possible segmentations of one field: an edge is the value between two delimiters.

    Neighbouring delimiters are joined by an edge. An open sign may protect up
    to any delimiter before the next open sign, or up to the end, so there are
    about twice as many edges as delimiters, whatever the field's length. Edges
    hold keys of values, not values, so that long ones take no room.
    """

    def __init__(self, text: str):
        self.text = text
        lo, hi, sure, loose, opened = boundaries(text)
        self.nodes = [lo - 1, *sure, *loose, hi]
        self.branches = bool(loose)
        last = len(self.nodes) - 1
        signs: dict[int, str] = {}
        for at, sign in opened if loose else ():
            signs.setdefault(at, sign)
        starts = [*sorted(signs), last]
        ahead = dict(zip(starts, starts[1:], strict=False))
        self.edges: list[Edge] = []
        for i in range(last):
            ends = [i + 1]
            if i in signs and i + 1 < last:
                ends += [*range(i + 2, ahead[i] + 1), *([last] if ahead[i] < last else [])]
            for j in ends:
                self.edges.append(Edge(i, j, value_key(self.value(i, j)), self.nodes[j] - self.nodes[i] - 1, signs.get(i) if i + 1 < last else None, j > i + 1))

    def value(self, i: int, j: int) -> str:
        return value_of(self.text[self.nodes[i] + 1 : self.nodes[j]])

    def viterbi(self, weight: dict[str, float], protects: dict[str, float] | None = None) -> list[str]:
        best, back = {0: 0.0}, {}
        for e in self.edges:
            w = best.get(e.start, -math.inf) + _log(weight, protects, e)
            if w > best.get(e.end, -math.inf):
                best[e.end], back[e.end] = w, e
        path, at = [], len(self.nodes) - 1
        while at:
            e = back[at]
            path.append(self.value(e.start, e.end))
            at = e.start
        return path[::-1]

    def expected(self, weight: dict[str, float], protects: dict[str, float] | None = None) -> list[tuple[Edge, float]]:
        """Expected number of uses of each edge over all segmentations."""
        end = len(self.nodes) - 1
        ahead, behind = [-math.inf] * (end + 1), [-math.inf] * (end + 1)
        ahead[0] = behind[end] = 0.0
        logs = [_log(weight, protects, e) for e in self.edges]
        for e, w in zip(self.edges, logs, strict=True):
            ahead[e.end] = _logadd(ahead[e.end], ahead[e.start] + w)
        for e, w in zip(reversed(self.edges), reversed(logs), strict=True):
            behind[e.start] = _logadd(behind[e.start], behind[e.end] + w)
        return [(e, math.exp(ahead[e.start] + w + behind[e.end] - ahead[end])) for e, w in zip(self.edges, logs, strict=True)]


def _log(weight: dict[str, float], protects: dict[str, float] | None, e: Edge) -> float:
    # an unseen value is spelt out: it costs more than a rare one, and more the longer it is
    w, seen = -UNSEEN - CHARACTER * e.length, weight.get(e.key, 0.0)
    w = _logadd(math.log(seen), w) if seen else w
    if e.sign is None:
        return w
    p = (protects or {}).get(e.sign, LOOSE)
    return w + math.log(p if e.over else 1 - p)


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _counts(batches: Iterator[pd.DataFrame], protects: dict[str, float]) -> Iterator[pd.DataFrame]:
    """E-step: expected counts of a batch, summed before they are shuffled; of values, and of signs that protect."""
    for pdf in batches:
        total: dict[tuple, list[float]] = {}
        for text, n, weights in zip(pdf["text"], pdf["n"], pdf["weights"], strict=True):
            for e, x in Lattice(text).expected(dict(weights) if weights is not None else {}, protects):
                if e.key:
                    total.setdefault((e.key, None), [0.0, 0.0])[0] += float(n) * x
                if e.sign:
                    sums = total.setdefault((None, e.sign), [0.0, 0.0])
                    sums[0] += float(n) * x * e.over
                    sums[1] += float(n) * x
        yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["value", "sign", "w", "of"])


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(t, v) for t in pdf["text"] for v in {e.key for e in Lattice(t).edges} if v]
        yield pd.DataFrame(rows, columns=["text", "value"])


def split_packed(df: DataFrame, key: list[str], fields: list[str], rounds: int = 3) -> DataFrame:
    """One row (key, field_name, pos, value) for each non-empty value packed in ``fields``.

    Semicolon, comma, bar, tab and newline delimit, except in quotes,
    parentheses and character entities; square brackets around a whole list are
    not part of it. Places count from 0, empty ones included. Fields whose
    quotes and parentheses all close have one segmentation only; their values
    are counted once and stay as counted. Fields left open are ambiguous: they
    go through ``rounds`` of expectation-maximisation against the frequencies
    of the whole column and are then segmented by Viterbi. A field may hold any
    number of values, and an open sign may protect any number of delimiters.

    Cases: NULL, blank and bracket-only fields give no row; repeated rows give
    the same rows once; a row with a NULL key is kept under that key; a value
    longer than any seen is possible, but unlikely; empty tables give an empty
    result; further columns are ignored.
    """
    packed = df.select(*key, F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string"))))).alias("field_name", "text"))
    packed = packed.where("text is not null").distinct()
    parts = ", ".join(f"{k} {t}" for k, t in packed.dtypes if k in key)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Unambiguous fields to their values; an ambiguous one to a row at place -1 that holds its text."""
        for pdf in batches:
            rows = []
            for *k, name, text in pdf[[*key, "field_name", "text"]].itertuples(index=False):
                if not text.strip():
                    continue
                lattice = Lattice(text)
                if lattice.branches:
                    rows.append((*k, name, -1, text))
                    continue
                # one path only: no weights can change it
                rows += [(*k, name, p, v) for p, v in enumerate(lattice.viterbi({})) if v]
            yield pd.DataFrame(rows, columns=[*key, "field_name", "pos", "value"])

    schema = f"{parts}, field_name string, pos int, value string"
    first = materialised(packed.mapInPandas(split, schema))
    sure = first.where("pos >= 0")
    unclear = first.where("pos < 0").select(*key, "field_name", F.col("value").alias("text"))
    texts = unclear.groupBy("text").agg(F.count("*").alias("n"))
    if texts.isEmpty():
        return sure
    brief = F.when(F.length("value") <= BRIEF, F.col("value")).otherwise(F.concat(F.lit("\0"), F.sha2("value", 256)))
    fixed = materialised(sure.groupBy(brief.alias("value")).agg(F.count("*").cast("double").alias("w")))
    lattice_values = materialised(texts.select("text").mapInPandas(_candidates, "text string, value string"))

    def weighted(counts: DataFrame) -> DataFrame:
        """The ambiguous fields, each with the weights of the values in its own lattice only."""
        total = counts.agg(F.sum("w")).first()[0] or 1.0
        mine = lattice_values.join(counts, "value").withColumn("w", F.col("w") / F.lit(total))
        mine = mine.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("value", "w"))).alias("weights"))
        return texts.join(mine, "text", "left")

    counts, protects = fixed, dict.fromkeys("'\"(", LOOSE)
    for _ in range(rounds):
        soft = weighted(counts).mapInPandas(lambda it, p=dict(protects): _counts(it, p), "value string, sign string, w double, of double")
        soft = materialised(soft.groupBy("value", "sign").agg(F.sum("w").alias("w"), F.sum("of").alias("of")))
        # three signs, three rows at most
        for r in soft.where("sign is not null").collect():
            protects[r["sign"]] = (r["w"] + LOOSE * FIRM) / (r["of"] + FIRM)
        before, counts = counts, materialised(fixed.unionByName(soft.where("value is not null").select("value", "w")).groupBy("value").agg(F.sum("w").alias("w")))
        for old in (soft, before):
            if old is not fixed:
                release(old)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, weights in zip(pdf["text"], pdf["weights"], strict=True):
                path = Lattice(text).viterbi(dict(weights) if weights is not None else {}, protects)
                rows += [(text, p, v) for p, v in enumerate(path) if v]
            yield pd.DataFrame(rows, columns=["text", "pos", "value"])

    decoded = weighted(counts).select("text", "weights").mapInPandas(decode, "text string, pos int, value string")
    return sure.unionByName(unclear.join(decoded, "text").select(*key, "field_name", "pos", "value"))
