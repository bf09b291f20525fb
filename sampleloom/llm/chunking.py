"""Oversized texts to pieces under a token limit, cut at natural boundaries, by byte ranges.

Texts are seen as byte ranges with a halo before and after. A worker finds where
its range begins and ends, tokenizes it, and marks the natural boundaries. What
travels is a boundary table: for each token before the range that a piece may
begin at, where the piece that is open at the range's end begins then, and how
many pieces lie between. Stitching the tables of a text in order, by prefix
sums of their numbers of pieces, tells every range where its first piece begins
and its number; each worker then emits its pieces by their offsets. The text
itself doesn't travel: a file is read by seeking, a text in a table is cut where
it is read, and only one of several ranges is dealt out to other tasks, once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.llm.tokens import INSIDE, SYNC, TOKENIZER, WORD, Cutter, count_tokens, strengths, token_sizes
from sampleloom.session import materialised

PIECE = "piece int, start_byte long, end_byte long, n_tokens int, text string"
TABLE = "r int, fresh boolean, entries binary, exits binary, pieces binary"
#: Bytes seen before a place to tell whether a text can be cut there.
BEFORE = 8
#: Bytes of the longest token of the tokenizer.
LONGEST = 128


class Ranges:
    """How texts are cut into ranges: ``size`` bytes each, with a halo before that holds every token a piece may begin at."""

    def __init__(self, limit: int, overlap: int, path: str, size: int, reach: int, longest: int):
        self.cutter, self.path, self.reach = Cutter(limit, overlap), path, reach
        # an open piece is at most so long
        self.halo = self.cutter.limit * longest + reach
        self.size = max(size, 2 * self.halo)

    def begin(self, read: Callable[[int, int], bytes], r: int, total: int) -> int:
        """Where range ``r`` begins: the first place that a text can be tokenized from, else the next character; neighbours find the same."""
        at = r * self.size
        if at <= 0 or at >= total:
            return max(0, min(at, total))
        lead = min(BEFORE, at)
        raw = read(at - lead, min(at + self.reach + BEFORE, total))
        m = SYNC.search(raw, lead, lead + self.reach)
        if m:
            return at - lead + m.start()
        while lead < len(raw) and raw[lead] & 0xC0 == 0x80:
            at, lead = at + 1, lead + 1
        return at

    def restart(self, read: Callable[[int, int], bytes], at: int) -> int | None:
        """A place far enough before ``at`` from which tokens are the same whatever precedes; None if there is none."""
        low = max(0, at - self.halo)
        if not low:
            return 0
        m = SYNC.search(read(low, low + self.reach), 1)
        return low + m.start() if m else None


class Span:
    """One range's tokens and those of the halo before it: offsets in the text, and how good a cut before each is."""

    def __init__(self, read: Callable[[int, int], bytes], r: int, total: int, ranges: Ranges):
        self.read, self.cutter, self.path = read, ranges.cutter, ranges.path
        self.begin, end = ranges.begin(read, r, total), ranges.begin(read, r + 1, total)
        known = ranges.restart(read, self.begin) if r else 0
        #: Whether pieces start afresh here because no place before is sure to be a token's begin.
        self.fresh = known is None
        #: Whether all pieces end here; nothing does in a range that holds no more than the rest of a character.
        self.final = self.begin < total and (end >= total or ranges.restart(read, end) is None)
        low = known
        if self.fresh:
            low = self.begin - ranges.halo
            while low < self.begin and read(low, low + 1)[0] & 0xC0 == 0x80:
                low += 1
        before = token_sizes(read(low, self.begin).decode(), self.path)
        own = token_sizes(read(self.begin, end).decode(), self.path)
        sizes = np.concatenate([before, own]).astype(np.int64)
        self.first = len(before)
        self.offset = low + np.append(0, np.cumsum(sizes))
        near = max(0, low - BEFORE)
        self.good = strengths(read(near, min(end + ranges.reach, total)), self.offset[:-1] - near)

    def count(self, a: int, b: int) -> int:
        return count_tokens(self.read(a, b).decode(), self.path)

    def entries(self) -> np.ndarray:
        """The tokens that the piece open at the range's begin may begin with."""
        if self.fresh:
            return np.array([self.cutter.following(np.append(self.good, 0), 0, self.first)]) if self.first > self.cutter.overlap + 1 else np.array([self.first])
        at = np.arange(max(0, self.first - self.cutter.limit), self.first + 1)
        # no piece begins inside a character
        return at[np.append(self.good, WORD)[at] != INSIDE]

    def table(self) -> tuple[bool, bytes, bytes, bytes]:
        """For each entry: its offset, the offset of the piece open at the end, and the number of pieces that end here."""
        known: dict[int, tuple[int, int]] = {}
        entries = self.entries()
        for s in entries.tolist():
            path = []
            while s not in known:
                piece = self.cutter.step(self.good, self.offset, s, self.final, self.count) if s < len(self.good) else None
                if piece is None:
                    known[s] = (s, 0)
                    break
                path.append(s)
                s = piece[1]
            to, n = known[s]
            for x in reversed(path):
                n += 1
                known[x] = (to, n)
        to = np.array([known[s] for s in entries.tolist()], np.int64).reshape(-1, 2)
        return self.fresh, self.offset[entries].astype("<i8").tobytes(), self.offset[to[:, 0]].astype("<i8").tobytes(), to[:, 1].astype("<i8").tobytes()

    def pieces(self, start: int) -> Iterator[tuple[int, int, int]]:
        return self.cutter.walk(self.good, self.offset, int(np.searchsorted(self.offset, start)), self.final, self.count)


def reader(raw: bytes, base: int = 0) -> Callable[[int, int], bytes]:
    return lambda a, b: raw[a - base : b - base]


def opened(path: str) -> Callable[[int, int], bytes]:
    """Reads byte ranges of a file, by seeking, from any file system that Arrow knows."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        system, name = fs.LocalFileSystem(), unquote(urlparse(path).path)
    else:
        system, name = fs.FileSystem.from_uri(path)
    f = system.open_input_file(name)
    return lambda a, b: f.read_at(b - a, a)


def _whole(batches: Iterator[pd.DataFrame], ranges: Ranges) -> Iterator[pd.DataFrame]:
    """Pieces of texts of one range, where they are read."""
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            raw = text.encode()
            span = Span(reader(raw), 0, len(raw), ranges)
            if len(span.good) > ranges.cutter.most:
                rows += [(doc, k, a, b, n, raw[a:b].decode()) for k, (a, b, n) in enumerate(span.pieces(0))]
        yield pd.DataFrame(rows, columns=["doc_id", "piece", "start_byte", "end_byte", "n_tokens", "text"])


def _spans(pdf: pd.DataFrame, ranges: Ranges) -> Iterator[tuple[tuple, Span]]:
    """The ranges of a batch: of files by seeking, of texts from the bytes at hand."""
    path, read = None, None
    for row in pdf.itertuples(index=False):
        if hasattr(row, "raw"):
            read = reader(row.raw, max(0, row.r * ranges.size - ranges.halo - BEFORE))
        elif row.doc_id != path:
            path, read = row.doc_id, opened(row.doc_id)
        yield row, Span(read, row.r, row.total, ranges)


def _tables(batches: Iterator[pd.DataFrame], ranges: Ranges) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(row.doc_id, row.r, *span.table()) for row, span in _spans(pdf, ranges)], columns=["doc_id", "r", "fresh", "entries", "exits", "pieces"])


def _stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the first piece of each range begins, and its number; the tables of a text come in order."""
    doc, at, number = None, 0, 0
    for pdf in batches:
        rows = []
        for d, r, fresh, entries, exits, pieces in pdf[["doc_id", "r", "fresh", "entries", "exits", "pieces"]].itertuples(index=False):
            if d != doc:
                doc, at, number = d, 0, 0
            entries = np.frombuffer(entries, "<i8")
            i = 0 if fresh else int(np.searchsorted(entries, at))
            if entries[i] != at and not fresh:
                raise RuntimeError(f"range {r} of {d}: no token begins at byte {at}")
            rows.append((d, r, int(entries[i]), number, number + int(np.frombuffer(pieces, "<i8")[i])))
            at, number = int(np.frombuffer(exits, "<i8")[i]), rows[-1][4]
        yield pd.DataFrame(rows, columns=["doc_id", "r", "start", "number", "ended"])


def _pieces(batches: Iterator[pd.DataFrame], ranges: Ranges) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(row.doc_id, row.number + k, a, b, n, span.read(a, b).decode()) for row, span in _spans(pdf, ranges) for k, (a, b, n) in enumerate(span.pieces(row.start))]
        yield pd.DataFrame(rows, columns=["doc_id", "piece", "start_byte", "end_byte", "n_tokens", "text"])


def by_ranges(parts: DataFrame, ranges: Ranges, key: str) -> DataFrame:
    """Pieces of the texts whose ranges are the rows of ``parts`` (doc_id, r, total and, but for files, raw)."""
    tables = parts.mapInPandas(lambda it: _tables(it, ranges), f"doc_id {key}, {TABLE}")
    # some KB a range travel; a text's tables pass by one task one after the other
    ordered = tables.dropDuplicates(["doc_id", "r"]).repartition("doc_id").sortWithinPartitions("doc_id", "r")
    starts = materialised(ordered.mapInPandas(_stitch, f"doc_id {key}, r int, start long, number int, ended int"))
    # a text within the limit is one piece, which is none
    several = starts.groupBy("doc_id").agg(F.max("ended").alias("all")).where(F.col("all") > 1)
    starts = starts.join(several, "doc_id", "left_semi").drop("ended")
    return parts.join(starts, ["doc_id", "r"]).mapInPandas(lambda it: _pieces(it, ranges), f"doc_id {key}, {PIECE}")


def split_oversized(docs: DataFrame, limit: int = 512, overlap: int = 64, path: str = TOKENIZER, range_bytes: int = 1 << 20, halo: int = 1024, longest: int = LONGEST) -> DataFrame:
    """Pieces (doc_id, piece, start_byte, end_byte, n_tokens, text) of the texts above ``limit`` tokens.

    ``docs`` has a unique doc_id (BIGINT) and text. The pieces cover the whole
    text; each has at most ``limit`` tokens when tokenized alone and begins
    about ``overlap`` tokens (up to eight more, for a whole word) before the
    previous one's end. Cuts fall at the best place in the second half of the
    piece: paragraph, line, sentence, word, and only in a word that has no such
    place inside it. Offsets count bytes of the UTF-8 text. A range has
    ``range_bytes`` (twice the longest piece at least), and the place where it
    begins is looked for within ``halo`` bytes; ``longest`` is the length in
    bytes of the tokenizer's longest token. Texts of one range need no exchange. :func:`split_files` is the same for files.

    Cases: NULL and empty texts, and those within the limit, give no piece; a
    NULL doc_id gives none; a text without any white space is cut between
    characters; a repeated row gives its pieces once more; further columns are
    ignored; an empty table gives an empty result. Where a text has no blank
    after an ASCII sign within ``halo`` bytes, one longest piece before a range's
    begin, all pieces end at that begin and new ones start, with the overlap.
    """
    ranges = Ranges(limit, overlap, path, range_bytes, halo, longest)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    n, size = F.octet_length("text"), ranges.size
    # a token has one byte at least: no text of at most `limit` bytes is over it
    short = docs.where((n > limit) & (n <= size)).mapInPandas(lambda it: _whole(it, ranges), f"doc_id long, {PIECE}")
    # one range after the other is taken from a long text, never all at once
    long = docs.where(n > size).select("doc_id", "text", n.cast("long").alias("total"), F.explode(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)).alias("r"))
    low = F.greatest(F.col("r") * size - (ranges.halo + BEFORE), F.lit(0))
    raw = F.substring(F.col("text").cast("binary"), low + 1, (F.col("r") + 1) * size + 3 * halo - low)
    parts = materialised(long.select("doc_id", "r", "total", raw.alias("raw")).repartition("doc_id", "r"))
    return short.unionByName(by_ranges(parts, ranges, "long"))


def split_files(spark: SparkSession, paths: str | list[str], limit: int = 512, overlap: int = 64, path: str = TOKENIZER, range_bytes: int = 1 << 24, halo: int = 1024, longest: int = LONGEST) -> DataFrame:
    """Pieces (doc_id = the file's path, piece, start_byte, end_byte, n_tokens, text) of UTF-8 files above ``limit`` tokens.

    As :func:`split_oversized`, for files of any size: workers seek to their
    ranges, so a file may be larger than any executor's memory. Cases: an empty
    file gives no piece; bytes that are no UTF-8 raise an error.
    """
    ranges = Ranges(limit, overlap, path, range_bytes, halo, longest)
    # only names and lengths are read
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("doc_id"), F.col("length").alias("total")).where(F.col("total") > limit)
    parts = files.withColumn("r", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / ranges.size).cast("int") - 1)))
    return by_ranges(materialised(parts.select("doc_id", "r", "total").repartition("doc_id", "r")), ranges, "string")
