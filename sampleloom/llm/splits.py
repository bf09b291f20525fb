"""Splits that keep tied records together: distributed union-find, then greedy assignment.

Links between chunks are contracted to forests inside each partition; the
forests are merged hierarchically, some partitions into one per level, each
level contracting again. A level's input is bounded: forests that outgrow
``most_edges`` are contracted by rounds of star operations over all executors
instead, until they fit. Groups are then assigned largest first, each to the
split furthest below its target. Groups of one size whose main kind of target is
the same are one class, so the greedy rule runs over classes with counts: there
are at most about sqrt(2 N) sizes among N records, times the kinds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sampleloom.session import materialised, partitions_for, release

#: Signs of white space, which is trimmed.
WHITE = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Levels of the hierarchy take this many partitions into one.
FAN_IN = 8
#: Members of a component that one part of the pairs' join holds.
PART = 1000
#: Kinds of target told apart in the mixes; with more, those beyond the most frequent ones share these by their hash.
KINDS = 256
#: Bits of a hash by which the groups of one class are ranked in slots.
SLOTS = 20


def chunk_key(c: Column) -> Column:
    """A chunk's name without outer white space, in lower case, with ``-`` for each separator sign; NULL if nothing is left."""
    x = F.translate(F.lower(F.btrim(c, F.lit(WHITE))), "_. ", "---")
    return F.when((x != "") & (x != "n/a"), x)


def origin_key(c: Column) -> Column:
    """An origin's name, NULL if it is missing."""
    x = F.btrim(c, F.lit(WHITE))
    return F.when((x != "") & (F.lower(x) != "n/a"), x)


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's links; gives a link from each node to the smallest of its tree."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
    for i in range(0, len(pairs), 100_000):
        yield pd.DataFrame(pairs[i : i + 100_000], columns=["a", "b"])


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round: every node linked closer to the smallest it can see."""
    for larger in (True, False):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        seen = both.join(least, "a")
        keep = seen.where("b > a") if larger else seen.where("b <= a").unionByName(seen.select("a", F.col("a").alias("b"), "m"))
        edges = keep.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return edges


def components(edges: DataFrame, most_edges: int = 4_000_000) -> DataFrame:
    """(node, root) of every linked node: the root is its component's smallest node.

    ``edges`` has string columns a and b. Links with a NULL end are none; a node
    linked to itself only is left out; repeated links count once.
    """
    n = partitions_for(edges.sparkSession)
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    forest = materialised(edges.mapInPandas(_forest, "a string, b string").distinct())
    while (size := forest.count()) > most_edges:
        shrunk = materialised(_stars(forest).mapInPandas(_forest, "a string, b string").distinct())
        if not shrunk.exceptAll(forest).limit(1).count() and shrunk.count() == size:
            return shrunk.select(F.col("a").alias("node"), F.col("b").alias("root"))
        release(forest)
        forest = shrunk
    # every level has at most most_edges links in all, so one task can hold the last
    n = min(n, 64)
    forest = forest.repartition(n, "a")
    while True:
        forest = forest.mapInPandas(_forest, "a string, b string")
        if n == 1:
            return forest.select(F.col("a").alias("node"), F.col("b").alias("root"))
        n = -(-n // FAN_IN)
        forest = forest.coalesce(n) if n > 1 else forest.repartition(1)


def tie_edges(samples: DataFrame, chunk: str, origin: str) -> DataFrame:
    """Links between chunks that hold samples of one origin: each to the smallest of the origin's chunks."""
    # read twice below: written, so that names are worked out once
    pairs = materialised(samples.select(chunk_key(F.col(chunk)).alias("a"), origin_key(F.col(origin)).alias("o")).dropna().distinct())
    shared = pairs.groupBy("o").agg(F.min("a").alias("b"), F.max("a").alias("z")).where("b < z").select("o", "b")
    return pairs.join(shared, "o").where("a <> b").select("a", "b").distinct()


def tied_pairs(samples: DataFrame, chunk: str = "chunks", origin: str = "origids") -> DataFrame:
    """(chunk_a, chunk_b): all pairs of different chunks that must share a set, the smaller first.

    Cases: NULL, empty and ``n/a`` chunks or origins tie nothing; spellings that
    differ in case, outer white space or separator sign are one chunk; repeated
    rows change nothing; an empty table gives an empty result.
    """
    tree = materialised(components(tie_edges(samples, chunk, origin)))
    members = tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
    # the pairs are the result; those of a large component are spread over parts of its members
    parts = members.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = members.join(parts, "root")
    left = members.select("root", F.col("node").alias("chunk_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = members.select("root", F.col("node").alias("chunk_b"), F.pmod(F.hash("node"), "parts").alias("part"))
    return left.join(right, ["root", "part"]).where("chunk_a < chunk_b").select("chunk_a", "chunk_b")


def tied_groups(samples: DataFrame, chunk: str = "chunks", origin: str = "origids") -> DataFrame:
    """(chunk, group_id) of every chunk: the group's smallest chunk, its own name if nothing ties it."""
    tree = components(tie_edges(samples, chunk, origin))
    names = samples.select(chunk_key(F.col(chunk)).alias("chunk")).dropna().distinct()
    return names.join(tree.withColumnRenamed("node", "chunk"), "chunk", "left").select("chunk", F.coalesce("root", "chunk").alias("group_id"))


def deal(lack: np.ndarray, step: float, count: int) -> np.ndarray:
    """How many of ``count`` equal groups each split gets if each goes to the split that lacks most, ``step`` less afterwards."""
    got = np.zeros(len(lack), np.int64)
    if count > len(lack):
        # as long as all are above a common level, the order doesn't matter
        low, high = lack.min() - step * (count + 1), lack.max()
        for _ in range(200):
            level = (low + high) / 2
            if np.floor(np.maximum(lack - level, 0) / step).sum() <= count:
                high = level
            else:
                low = level
        got = np.floor(np.maximum(lack - high, 0) / step).astype(np.int64)
    left = lack - got * step
    for _ in range(count - int(got.sum())):
        i = int(np.argmax(left))
        got[i] += 1
        left[i] -= step
    return got


def assign(classes: list[tuple[int, int, dict[int, int]]], shares: np.ndarray, kinds: int = KINDS) -> np.ndarray:
    """Greedy assignment: how many groups of each class go to each split.

    A class is (size, number of groups, their records by kind); classes come
    largest size first. A group goes to the split furthest below its target,
    counted in records and in records of the kinds that the group holds, so that
    the splits' mixes come out alike.
    """
    total = np.zeros(kinds + 1)  # the last: records of any kind
    for size, count, mix in classes:
        total[kinds] += size * count
        for k, x in mix.items():
            total[k] += x
    lack = shares[:, None] * total[None, :]
    out = np.zeros((len(classes), len(shares)), np.int64)
    left = [count for _, count, _ in classes]
    for size, same in groupby(range(len(classes)), lambda i: classes[i][0]):
        same = list(same)
        # groups of one size tie: half of each class's rest in turn, so that none is dealt out before the others
        while same:
            for i in same:
                _, count, mix = classes[i]
                at = np.append(np.fromiter(mix, int, len(mix)), kinds)
                each = np.append(np.fromiter(mix.values(), float, len(mix)) / count, size)
                part = deal(lack[:, at] @ (each / size), float(each @ each) / size, -(-left[i] // 2))
                lack[:, at] -= part[:, None] * each[None, :]
                out[i] += part
                left[i] -= -(-left[i] // 2)
            same = [i for i in same if left[i]]
    return out


def split_records(samples: DataFrame, shares: dict[str, float], key: str = "sample_id", chunk: str = "chunks", origin: str = "origids", target: str = "targets") -> DataFrame:
    """(key, chunk, group_id, split) of each record: tied chunks share a split.

    Groups are assigned largest first, with a view to the mix of targets, each
    to the split furthest below its target. The driver sees one row for each
    size, main kind and kind of target; which groups of a class go where is
    settled by ranks among their hashes.

    Cases: records whose chunk is missing are groups of their own unless their
    origin ties them to others; a NULL target is a kind of its own; repeated
    rows go with their key; an empty table gives an empty result; further
    columns are ignored.
    """
    spark = samples.sparkSession
    base = samples.select(F.col(key).alias("id"), chunk_key(F.col(chunk)).alias("chunk"), origin_key(F.col(origin)).alias("o"), F.lower(F.btrim(F.col(target), F.lit(WHITE))).alias("kind")).distinct()
    tree = materialised(components(tie_edges(samples, chunk, origin)))
    # a record without chunk goes with a chunk that holds its origin, else stands alone
    home = base.where("chunk is not null and o is not null").groupBy("o").agg(F.min("chunk").alias("home"))
    loose = base.where("chunk is null").join(home, "o", "left")
    # no chunk's name holds a "_", so these are names of their own
    alone = F.concat(F.lit("_"), F.coalesce(F.concat(F.lit("o"), "o"), F.concat(F.lit("i"), F.col("id").cast("string"))))
    loose = loose.select("id", "chunk", "kind", F.coalesce("home", alone).alias("node"))
    nodes = base.where("chunk is not null").select("id", "chunk", "kind", F.col("chunk").alias("node")).unionByName(loose)
    grouped = materialised(nodes.join(tree, "node", "left").select("id", "chunk", "kind", F.coalesce("root", "node").alias("group_id")))

    names, quota = list(shares), np.array(list(shares.values()), float)
    quota = quota / quota.sum()
    common = grouped.groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(KINDS - 1).collect()
    pairs = [F.lit(x) for i, r in enumerate(common) if r["kind"] is not None for x in (r["kind"], i)]
    missing = next((i for i, r in enumerate(common) if r["kind"] is None), KINDS - 1)
    shared = F.pmod(F.xxhash64("kind"), F.lit(KINDS)).cast("int")
    coded = F.coalesce(F.create_map(*pairs)[F.col("kind")], shared) if pairs else shared
    cells = grouped.groupBy("group_id", F.when(F.col("kind").isNull(), F.lit(missing)).otherwise(coded).alias("k")).count()
    rate = F.create_map(*(F.lit(x) for i, r in enumerate(common) for x in (i, float(r["count"])))) if common else F.create_map(F.lit(0), F.lit(1.0))
    # the kind that a group holds more of than others do
    over = F.col("count") / F.coalesce(rate[F.col("k")], F.lit(1.0))
    groups = materialised(cells.groupBy("group_id").agg(F.sum("count").alias("n"), F.max_by("k", F.struct(over, "k")).alias("main"), F.collect_list(F.struct("k", "count")).alias("mix")))
    parts = groups.select("n", "main", F.explode("mix").alias("x")).groupBy("n", "main", F.col("x.k").alias("k")).agg(F.sum("x.count").alias("c"))
    counts = groups.groupBy("n", "main").agg(F.count("*").alias("c"), F.lit(-1).alias("k"))
    table = parts.unionByName(counts).toPandas()
    found: dict[tuple[int, int], list] = {}
    for n, main, k, c in zip(table["n"].tolist(), table["main"].tolist(), table["k"].tolist(), table["c"].tolist(), strict=True):
        row = found.setdefault((n, main), [n, 0, {}])
        if k < 0:
            row[1] = c
        else:
            row[2][k] = c
    order = sorted(found, key=lambda x: (-x[0], x[1]))
    ends = np.cumsum(assign([tuple(found[x]) for x in order], quota), axis=1).tolist()
    cuts = spark.createDataFrame([(n, m, e) for (n, m), e in zip(order, ends, strict=True)], "n long, main int, ends array<long>")
    # rank among the groups of one class, by ranges of a hash: no class is gathered in one task
    at = groups.select("group_id", "n", "main", F.xxhash64("group_id").alias("h")).withColumn("slot", F.shiftright("h", 64 - SLOTS).cast("int"))
    per = at.groupBy("n", "main", "slot").count()
    prior = per.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("n", "main").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = at.join(prior, ["n", "main", "slot"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("n", "main", "slot").orderBy("h", "group_id")))
    which = F.expr("size(filter(ends, e -> e < rank))")
    placed = rank.join(cuts, ["n", "main"]).select("group_id", F.element_at(F.array(*map(F.lit, names)), which + 1).alias("split"))
    return grouped.join(placed, "group_id").select(F.col("id").alias(key), "chunk", "group_id", "split")
