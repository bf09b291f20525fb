"""Evaluation texts that leak into training text, by SimHash windows and exact verification.

Windows of several sizes go over the items and the documents: the size of the
whole item, that of two fifths and of one fifth of it (the longer of a passage's
two stretches holds at least that), and a short one. A window's SimHash sums the
bits of its words, weighted by their rarity among the items; words in no item
weigh nothing. The items' fingerprints are indexed by blocks of bits: two that
differ in at most ``radius`` bits differ in at most radius // BLOCKS bits of one
block, so probing each block with so few bits flipped finds all of them. Pairs
of document and item that share a window are then verified exactly: shingles of
three words, chained in the order of both texts, and the item's words that they
cover, counted and weighted by rarity.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.words import word_hashes

#: Share of an item's words that a passage must hold, less an allowance for altered words at its ends.
SHARE, ALLOWANCE = 0.4, 0.05
#: The same share with words weighted by rarity may be smaller by this: a passage may be the plainer part of an item.
PLAINER = 0.1
#: Items whose index is broadcast at once; more items go in several passes over the documents.
BLOCK_ITEMS = 20_000
#: The short windows' words, and the steps by which the sizes of longer ones grow.
SHORT, STEP = 5, 1.5
#: Blocks of bits that the index is kept by.
BLOCKS = 4


def window_sizes(n: int) -> list[int]:
    """Sizes of an item's windows: short, and the sizes at or next below a fifth, two fifths and the whole of its ``n`` words."""
    ladder = [SHORT]
    while ladder[-1] * STEP <= n:
        ladder.append(round(ladder[-1] * STEP))
    at = lambda x: max(w for w in ladder if w == SHORT or w <= x)
    return [n] if n < SHORT else sorted({SHORT, at(n / 5), at(2 * n / 5), at(n)})


def simhash(words: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of each window of ``width`` words (64 bits as uint64), by sliding sums."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    signs = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
    total = np.cumsum(signs.astype(np.int32) * weights[:, None].astype(np.int32), axis=0, dtype=np.int32)
    window = total[width - 1 :].copy()
    window[1:] -= total[:-width]
    return np.packbits(window > 0, axis=1).view(np.uint64).ravel()


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of at most ``most`` of ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


class Blocks:
    """Multi-index over fingerprints: finds all within ``radius`` bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        bits = 64 // BLOCKS
        self.bits, self.masks = bits, flips(bits, radius // BLOCKS)
        self.tables = []
        for b in range(BLOCKS):
            key = ((prints >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.tables.append((np.searchsorted(key[order], np.arange((1 << bits) + 1)).astype(np.int32), order))

    def near(self, probes: np.ndarray, step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the probe, number of the print) within the radius."""
        found = [np.zeros((2, 0), np.int64)]
        for a in range(0, len(probes), step):
            some = probes[a : a + step]
            for b, (first, order) in enumerate(self.tables):
                k = (some >> np.uint64(b * self.bits)) & np.uint64((1 << self.bits) - 1)
                k = (k[:, None] ^ self.masks[None, :]).astype(np.int64).ravel()
                lo = first[k]
                count = first[k + 1] - lo
                hit = np.flatnonzero(count)
                lo, count = lo[hit], count[hit]
                who = np.repeat(hit // len(self.masks), count)
                what = order[np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
                ok = popcount(some[who] ^ self.prints[what]) <= self.radius
                found.append(np.stack([who[ok] + a, what[ok]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]


class Items:
    """The items' side, fit for broadcasting: words, weights and the index of fingerprints of each window size."""

    def __init__(self, ids: list[int], texts: list[str], radius: int, common: float = 0.1):
        self.ids = np.array(ids, np.int64)
        self.words, self.bounds = word_hashes(texts)
        sizes = np.diff(self.bounds)
        of = np.repeat(np.arange(len(ids)), sizes)
        self.vocabulary, code = np.unique(self.words, return_inverse=True)
        spread = np.bincount(np.unique(np.stack([code, of]), axis=1)[0], minlength=len(self.vocabulary))
        # rarity in whole numbers: a word of one item weighs most, one of all items least
        self.weights = np.maximum(1, np.round(2 * np.log2((1 + len(ids)) / spread))).astype(np.int32) if len(self.vocabulary) else np.zeros(0, np.int32)
        self.word_weight = self.weights[code] if len(code) else np.zeros(0, np.int32)
        self.known = np.zeros(1 << max(20, len(self.vocabulary).bit_length() + 5), bool)
        self.known[self.words & np.uint64(len(self.known) - 1)] = True
        wanted: dict[int, list[int]] = {}
        for item, n in enumerate(sizes.tolist()):
            for width in window_sizes(n) if n >= 3 else ():
                wanted.setdefault(width, []).append(item)
        #: Of each window size: the index and the items that its fingerprints are of.
        self.index: dict[int, tuple[Blocks, np.ndarray]] = {}
        for width, members in sorted(wanted.items()):
            self.index[width] = self.windows(width, np.isin(np.arange(len(ids)), members), of, radius, common)
        every = shingles(self.words)
        inside = of[: len(every)] == of[2 : 2 + len(every)] if len(every) else np.zeros(0, bool)
        place = np.flatnonzero(inside)
        order = place[np.argsort(every[place], kind="stable")]
        #: The items' shingles, sorted, with the item and the place in it.
        self.shingle, self.shingle_item = every[order], of[order]
        self.shingle_at = order - self.bounds[:-1][of[order]] if len(order) else order

    def windows(self, width: int, members: np.ndarray, of: np.ndarray, radius: int, common: float) -> tuple[Blocks, np.ndarray]:
        prints = simhash(self.words, self.word_weight, width)
        first = np.arange(len(prints))
        inner = (of[first] == of[first + width - 1]) & members[of[first]]
        prints, owner = prints[inner], of[first[inner]]
        # windows that many items share, such as a common instruction, are no sign of one of them
        value, code = np.unique(prints, return_inverse=True)
        shared = np.bincount(np.unique(np.stack([code, owner]), axis=1)[0], minlength=len(value))
        special = shared[code] <= max(5, common * len(self.ids))
        has = np.bincount(owner[special], minlength=len(self.ids)) > 0
        keep = special | ~has[owner]
        pairs = np.unique(np.stack([prints[keep], owner[keep].astype(np.uint64)]), axis=1)
        return Blocks(pairs[0], radius), pairs[1].astype(np.int64)

    def weigh(self, words: np.ndarray) -> np.ndarray:
        """Weight of each word, 0 of those in no item."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, self.weights[at], 0)


def shingles(w: np.ndarray) -> np.ndarray:
    """Hashes of all runs of three words."""
    if len(w) < 3:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(0x9E3779B97F4A7C15) + w[2:] * np.uint64(0xC2B2AE3D27D4EB4F)


#: Words that one shingle of a chain can newly cover at most.
MOST = 6


def covered(matches: list[tuple[int, int]], weights: np.ndarray) -> tuple[float, float]:
    """Share of an item's words that matching shingles cover in order: by number, and by weight.

    ``matches`` are places (in the document, in the item), sorted by the first,
    then falling by the second. The chain with growing places in both texts that
    is longest counts; a word or two altered between neighbours of a chain, at
    equal distance in both texts, count as covered.
    """
    tails: list[int] = []
    back: list[int] = []
    ends: list[int] = []
    for at, (_, j) in enumerate(matches):
        k = bisect_left(tails, j)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(j)
            ends.append(at)
        else:
            tails[k], ends[k] = j, at
    if not ends:
        return 0.0, 0.0
    path, at = [], ends[-1]
    while at >= 0:
        path.append(matches[at])
        at = back[at]
    path.reverse()
    last, hit = path[0], np.zeros(len(weights), bool)
    hit[last[1] : last[1] + 3] = True
    for i, j in path[1:]:
        gap, other = j - last[1], i - last[0]
        # a gap of three or four shingles is that of one altered word, or of one and a split or lost one
        if gap <= MOST and abs(gap - other) <= 1:
            hit[last[1] : j] = True
        hit[j : j + 3] = True
        last = (i, j)
    return float(hit.mean()), float(weights[hit].sum() / weights.sum())


def search(ids: np.ndarray, texts: list[str], items: Items) -> list[tuple[int, int, float]]:
    """(document, item, share of the item's words) of the documents that hold a passage."""
    if not items.index:
        return []
    words, bounds = word_hashes(texts)
    known = items.known[(words & np.uint64(len(items.known) - 1)).astype(np.int64)]
    count = np.cumsum(np.append(0, known))
    pairs = [np.zeros((2, 0), np.int64)]
    for width, (blocks, owner) in items.index.items():
        # a window in which more than a quarter of the words are in no item is like none of an item's
        near = np.flatnonzero(count[width:] - count[:-width] >= width - width // 4) if len(words) >= width else np.zeros(0, int)
        doc = np.searchsorted(bounds, near, side="right") - 1
        near = near[near + width <= bounds[doc + 1]]
        if not len(near):
            continue
        # stretches of neighbouring windows, each fingerprinted by sliding sums
        split = np.flatnonzero(np.diff(near) > 1) + 1
        begin, end = near[np.append(0, split)], near[np.append(split - 1, len(near) - 1)] + width
        part = np.repeat(np.arange(len(begin)), end - begin)
        take = np.arange(len(part)) + np.repeat(begin - np.append(0, np.cumsum(end - begin)[:-1]), end - begin)
        step = 1 << 16
        for a in range(0, len(take), step):
            at = take[a : a + step + width - 1]
            prints = simhash(words[at], items.weigh(words[at]), width)
            first = np.arange(len(prints))
            inner = part[a + first] == part[a + first + width - 1]
            first = first[inner]
            who, what = blocks.near(prints[inner])
            pairs.append(np.unique(np.stack([np.searchsorted(bounds, at[first[who]], side="right") - 1, owner[what]]), axis=1))
    return verified(ids, words, bounds, known, np.unique(np.concatenate(pairs, axis=1), axis=1), items)


def verified(ids: np.ndarray, words: np.ndarray, bounds: np.ndarray, known: np.ndarray, pairs: np.ndarray, items: Items) -> list[tuple[int, int, float]]:
    """The candidate pairs (document, item) that hold a passage, by all shingles they have in common."""
    if not pairs.shape[1] or len(words) < 3:
        return []
    wanted = np.zeros(len(bounds) - 1, bool)
    wanted[pairs[0]] = True
    at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
    doc = np.searchsorted(bounds, at, side="right") - 1
    use = wanted[doc] & (at + 3 <= bounds[doc + 1])
    at, doc = at[use], doc[use]
    every = shingles(words)[at]
    lo, hi = np.searchsorted(items.shingle, every), np.searchsorted(items.shingle, every, side="right")
    count = hi - lo
    hit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    at, doc, item, place = np.repeat(at, count), np.repeat(doc, count), items.shingle_item[hit], items.shingle_at[hit]
    k = len(items.ids)
    pair, candidates = doc * k + item, pairs[0] * k + pairs[1]
    order = np.lexsort((-place, at, pair))
    pair, at, place = pair[order], at[order], place[order]
    lo, hi = np.searchsorted(pair, candidates), np.searchsorted(pair, candidates, side="right")
    size = np.diff(items.bounds)[pairs[1]]
    # so few shingles can't cover enough, however they lie
    enough = (hi - lo) * MOST >= (SHARE - ALLOWANCE) * size
    out = []
    for c in np.flatnonzero(enough):
        a, b, item = lo[c], hi[c], pairs[1, c]
        share, weighted = covered(list(zip(at[a:b].tolist(), place[a:b].tolist(), strict=True)), items.word_weight[items.bounds[item] : items.bounds[item + 1]])
        if share >= SHARE - ALLOWANCE and weighted >= SHARE - ALLOWANCE - PLAINER:
            out.append((int(ids[pairs[0, c]]), int(items.ids[item]), share))
    return out


def leaks(docs: DataFrame, items: DataFrame, radius: int = 7) -> DataFrame:
    """(doc_id, item_id, share): documents that hold a passage of an item, and how much of its words.

    ``docs`` has doc_id (BIGINT) and text, ``items`` item_id (BIGINT) and
    item_text. A passage holds two fifths of the item's words in their order, in
    any number of stretches, whatever case, accents, punctuation, spacing, line
    ends, markup, quoting marks and single altered words. The scan of the
    documents needs no shuffle. Items are indexed in blocks of ``BLOCK_ITEMS``,
    so what is broadcast is bounded; more items take more passes. Windows within
    ``radius`` of 64 bits make a pair a candidate; with one word in five altered
    a whole window differs by about nine bits, its better parts by fewer.

    Cases: NULL and empty texts hold nothing; items of one or two words are short
    phrases and never found; windows that more than a tenth of all items share
    don't propose an item that has others; a passage that several items share counts for each; repeated
    rows of either table give one row; further columns are ignored; empty tables
    give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("item_text").alias("text")).where("item_id is not null and text is not null").dropDuplicates(["item_id"])
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    schema = "doc_id long, item_id long, share double"
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        index = docs.sparkSession.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], radius))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), 2000):
                    some = pdf.iloc[a : a + 2000]
                    yield pd.DataFrame(search(some["doc_id"].to_numpy(), list(some["text"]), index.value), columns=["doc_id", "item_id", "share"])

        found = docs.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
