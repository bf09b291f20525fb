"""Items into fixed-capacity containers by bounded-space online packing.

Each partition keeps a fixed number of open windows. An item goes into the
window it fits best; if none has room, the fullest window is emitted and a new
one opened. What is still open at a partition's end is merged afterwards: the
leftover windows of up to ``fan_in`` partitions, a bounded number, are packed
into each other by best fit, largest first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.tokens import TOKENIZER, Cutter, count_tokens, cut_text
from sampleloom.session import materialised

ITEMS = "pid int, local long, place int, open boolean, doc_id long, piece int, start_byte long, end_byte long, n_tokens int"
NAMES = [c.split()[0] for c in ITEMS.split(", ")]
#: Containers of one partition are numbered from its number times this.
STRIDE = 1 << 32


def pieces(doc, text: str, capacity: int, path: str) -> Iterator[tuple]:
    """The item itself, or its pieces if it alone exceeds the capacity."""
    size = len(text.encode()) if not text.isascii() else len(text)
    n = count_tokens(text, path)
    if n <= capacity:
        yield doc, 0, 0, size, n
        return
    raw = text.encode()
    for k, (a, b, size) in enumerate(cut_text(text, Cutter(capacity, 0, slack=0.03), path)):
        yield doc, k, a, b, size


class Windows:
    """A fixed number of open windows, by room left."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.rooms: list[tuple[int, int]] = []  # (room, number of the window), sorted
        self.items: dict[int, list] = {}
        self.next = 0

    def put(self, item: tuple, size: int) -> tuple[int, list] | None:
        """Places ``item``; returns a window that had to be emitted, if any."""
        out = None
        i = bisect_left(self.rooms, (size, -1))
        if i < len(self.rooms):
            room, w = self.rooms.pop(i)
        else:
            if len(self.rooms) >= self.most:
                _, full = self.rooms.pop(0)  # least room: the fullest
                out = full, self.items.pop(full)
            room, w = self.capacity, self.next
            self.next += 1
            self.items[w] = []
        self.items[w].append(item)
        if room - size > 0:
            insort(self.rooms, (room - size, w))
        elif out is None:
            out = w, self.items.pop(w)
        else:  # full at once: kept with no room until it is emitted
            insort(self.rooms, (0, w))
        return out


def pack(docs: DataFrame, capacity: int = 2048, windows: int = 64, path: str = TOKENIZER, fan_in: int = 256) -> DataFrame:
    """Container and place of each item: (container, place, doc_id, piece, start_byte, end_byte, n_tokens).

    ``docs`` has doc_id (BIGINT) and text; sizes count tokens. Only an item that
    alone exceeds ``capacity`` is divided, into pieces cut at natural boundaries
    near the capacity (offsets count bytes of the UTF-8 text). Places count from
    0 in each container.

    Cases: NULL texts, and rows without doc_id, are no items; an empty text is an
    item of no tokens and takes a place; repeated rows are items of their own;
    further columns are ignored; an empty table gives an empty result. Memory is
    bounded by the open windows of a partition, whatever its size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, state = TaskContext.get().partitionId(), Windows(capacity, windows)

        def rows(w: int, items: list, is_open: bool) -> list[tuple]:
            return [(pid, w, i, is_open, *x) for i, x in enumerate(items)]

        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                for item in pieces(doc, text, capacity, path):
                    if full := state.put(item, item[-1]):
                        out += rows(*full, False)
            yield pd.DataFrame(out, columns=NAMES)
        yield pd.DataFrame([r for w, items in state.items.items() for r in rows(w, items, True)], columns=NAMES)

    # numbers only, a small part of the texts; written once, as it is read twice
    packed = materialised(docs.mapInPandas(run, ITEMS))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Leftover windows of ``fan_in`` partitions into each other, best fit, largest first."""
        rooms: list[tuple[int, int]] = []
        into: list[tuple] = []
        taken: dict[int, int] = {}
        pdf = pdf.sort_values(["used", "pid", "local"], ascending=[False, True, True])
        for pid, local, used, items in pdf[["pid", "local", "used", "items"]].itertuples(index=False):
            i = bisect_left(rooms, (used, -1))
            if i < len(rooms):
                room, c = rooms.pop(i)
            else:
                room, c = capacity, int(pid) * STRIDE + int(local)
                taken[c] = 0
            into.append((pid, local, c, taken[c]))
            taken[c] += int(items)
            insort(rooms, (room - int(used), c))
        return pd.DataFrame(into, columns=["pid", "local", "container", "offset"])

    left = packed.where("open").groupBy("pid", "local").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    merged = left.groupBy(F.floor(F.col("pid") / fan_in).alias("g")).applyInPandas(merge, "pid int, local long, container long, offset int")
    columns = ["doc_id", "piece", "start_byte", "end_byte", "n_tokens"]
    closed = packed.where("not open").select((F.col("pid") * F.lit(STRIDE) + F.col("local")).alias("container"), "place", *columns)
    opened = packed.where("open").join(merged, ["pid", "local"]).select("container", (F.col("place") + F.col("offset")).alias("place"), *columns)
    return closed.unionByName(opened)
