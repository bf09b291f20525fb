"""Fan-out of a dataset as key tables: partitions, splits, balanced draws, permutations.

A generator yields no datasets one by one; it adds key columns (``set_id`` and
a role), and what follows groups by them in one plan. Specifications are built
on the driver from distinct attribute values, never from rows. Random draws
order by a hash of key, repetition and seed, so they are the same on every run.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sampleloom.operators.ordered import coarse_groups
from sampleloom.operators.select import ranked

TRAIN, TEST = 1, 2


def uniques(df: DataFrame, attr: str) -> list:
    """Sorted distinct values of an attribute: the size of its axis."""
    return sorted(r[0] for r in df.select(attr).where(F.col(attr).isNotNull()).distinct().collect())


# --- specifications: each a list over sets, of lists of values; None is "the rest"
def n_fold(values: list, k: int | float = 1) -> list[list]:
    """Leave-k-out in lexical order; a float is a share of the values."""
    k = int(k * len(values)) if isinstance(k, float) else k
    return [[None, list(c)] for c in itertools.combinations(values, k)]


def odd_even(values: list, use_values: bool = False) -> list[list]:
    even, odd = [], []
    for i, v in enumerate(values):
        (odd if (v if use_values else i) % 2 else even).append(v)
    return [[None, odd], [None, even]]


def halves(values: list) -> list[list]:
    a, b = values[: len(values) // 2], values[len(values) // 2 :]
    return [[None, a], [None, b]]


def n_groups(counts: list[tuple], n: int) -> list[list]:
    if len(counts) < n:
        raise ValueError("fewer values than groups")
    groups = coarse_groups(counts, n)
    return [[None, [v for v, g in groups.items() if g == i]] for i in range(n)]


def choose_specs(specs: list, count: int | None, strategy: str = "equidistant", seed: int = 0) -> list:
    """``count`` of the specifications: the first, random or equidistant ones."""
    if count is None or count >= len(specs):
        return specs
    if strategy == "first":
        return specs[:count]
    if strategy == "random":
        return [specs[i] for i in sorted(random.Random(seed).sample(range(len(specs)), count))]
    step = len(specs) / count
    return [specs[int(i * step + 0.5)] for i in range(count)]


def role(attr: str, spec: list) -> Column:
    """Partition number of a sample under one specification.

    A None is the rest: what not all other filters hold; later filters
    overwrite earlier ones; 0 is unselected.
    """
    filters = [F.col(attr).isin(s) if s is not None else None for s in spec]
    known = [f for f in filters if f is not None]
    together = known[0] if known else F.lit(False)
    for f in known[1:]:
        together = together & f
    out = F.lit(0)
    for k, f in enumerate(filters, 1):
        out = F.when(f if f is not None else ~together, k).otherwise(out)
    return out


def partitions(df: DataFrame, attr: str, specs: list[list]) -> DataFrame:
    """Each sample once per set, with ``partitions_set`` and ``partitions``."""
    sets = F.array(*(F.struct(F.lit(i).alias("partitions_set"), role(attr, s).alias("partitions")) for i, s in enumerate(specs)))
    return df.select("*", F.explode(sets).alias("_p")).select(*df.columns, "_p.*")


def factorial(df: DataFrame, attr: str, super_attr: str, spec=n_fold) -> DataFrame:
    """Product of the partitionings of ``attr`` inside every value of ``super_attr``."""
    pairs: dict = {}
    for r in df.select(super_attr, attr).distinct().collect():
        pairs.setdefault(r[0], []).append(r[1])
    inner = [spec(sorted(v)) for _, v in sorted(pairs.items())]
    specs = [[None, [v for part in combo for v in part[1]]] for combo in itertools.product(*inner)]
    return partitions(df, attr, specs)


def exclude_target_combinations(df: DataFrame, k: int, target: str, keep: int = TEST, assign: int = 3) -> DataFrame:
    """Per set and k-combination of targets: the test part keeps only these, the others' training part drops them (role ``assign``)."""
    combos = [list(c) for c in itertools.combinations(uniques(df, target), k)]
    pick = F.array(*(F.struct(F.lit(i).alias("combination"), F.col(target).isin(c).alias("_in")) for i, c in enumerate(combos)))
    wide = df.select("*", F.explode(pick).alias("_c")).select(*df.columns, "_c.*")
    p = F.col("partitions")
    new = F.when((p == keep) & ~F.col("_in"), F.lit(assign)).when((p != keep) & F.col("_in"), F.lit(assign)).otherwise(p)
    return wide.withColumn("partitions", new).drop("_in")


def splitter(df: DataFrame, attr: str, values: list | None = None, count: int | None = None, reverse: bool = False, ignore: Iterable = ()) -> DataFrame:
    """Each sample with ``split`` (place of its value) and ``lastsplit``; values listed twice give it twice."""
    values = [v for v in (values or uniques(df, attr)) if v not in set(ignore)]
    values = (values[::-1] if reverse else values)[:count]
    at = F.filter(F.transform(F.array(*map(F.lit, values)), lambda v, i: F.when(v == F.col(attr), i)), lambda i: i.isNotNull())
    return df.select("*", F.explode(at).alias("split")).withColumn("lastsplit", F.col("split") == len(values) - 1)


def repeated(df: DataFrame, count: int, name: str = "repetitions") -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name))


def draw(key: str | Column, rep: Column | int, seed: int) -> Column:
    """A reproducible random order: MD5 of seed, repetition and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(rep).cast("string") if isinstance(rep, int) else rep.cast("string"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def balance(df: DataFrame, attr: str, key: str, amount: str | float | int = "equal", limit: list[str] | None = None, count: int = 1, seed: int = 0, apply: bool = False, name: str = "balanced_set", among: Column | None = None, include_offlimit: bool = False) -> DataFrame:
    """Random selection per value of ``attr`` within limit groups: the smallest count, a share, or a number.

    ``among`` restricts what is balanced; other rows are marked as
    ``include_offlimit`` says.

    The draw is the ``n`` smallest hashes of a class. Classes are cut by a
    threshold found from hash ranges first, so a class of any size is only
    sorted near the cut.
    """
    limit = limit or []
    if among is not None:
        inside = F.coalesce(among, F.lit(False))
        drawn = balance(df.where(inside), attr, key, amount, limit, count, seed, False, name)
        other = repeated(df.where(~inside), count, "rep").withColumn(name, F.lit(include_offlimit))
        marked = drawn.unionByName(other)
        return marked.where(name).drop(name) if apply else marked
    out = repeated(df, count, "rep").withColumn("_h", draw(key, F.col("rep"), seed))
    sizes = df.groupBy(*limit, attr).agg(F.count("*").alias("_n"))
    if amount == "equal":
        least = sizes.groupBy(*limit).agg(F.min("_n").alias("_k"))
        quota = sizes.join(least, limit) if limit else sizes.withColumn("_k", least.scalar())
    else:
        quota = sizes.withColumn("_k", F.round(F.lit(amount) * F.col("_n")).cast("long") if isinstance(amount, float) else F.lit(amount))
    group = [*limit, attr, "rep"]
    # by the first three signs of the hash: 4,096 ranges; only the one that holds the cut is ranked
    out = out.withColumn("_r", F.substring("_h", 1, 3))
    ranges = out.groupBy(*group, "_r").agg(F.count("*").alias("_c"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(*group).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    at = out.join(ranges, [*group, "_r"]).join(quota.drop("_n"), [*limit, attr])
    place = F.col("_before") + F.row_number().over(W.partitionBy(*group, "_r").orderBy("_h", key))
    marked = at.withColumn(name, place <= F.col("_k")).drop("_h", "_r", "_before", "_k")
    return marked.where(name).drop(name) if apply else marked


def permute(df: DataFrame, attrs: list[str], key: str, limit: list[str] | None = None, count: int = 1, seed: int = 0) -> DataFrame:
    """Attributes shuffled jointly within limit groups, ``count`` times (``rep``): rows of one order get those of another."""
    limit = limit or []
    base = repeated(df, count, "rep")
    group = [*limit, "rep"]
    # the places that rows have by themselves are the same in every repetition
    a = repeated(ranked(df, limit, [key], "_i").drop(*attrs, "_part"), count, "rep")
    b = ranked(base.withColumn("_h", draw(key, F.col("rep"), seed)), group, ["_h", key], "_i").select(*group, *attrs, "_i")
    return a.join(b, [*group, "_i"]).drop("_i")


def permute_values(df: DataFrame, attr: str, count: int = 1, seed: int = 0) -> DataFrame:
    """The values' meaning shuffled: each value replaced by another, by one mapping per repetition."""
    values = uniques(df, attr)
    rows = []
    for rep in range(count):
        shuffled = values[:]
        random.Random(seed * 1_000_003 + rep).shuffle(shuffled)
        rows += [(rep, v, s) for v, s in zip(values, shuffled, strict=True)]
    kind = dict(df.dtypes)[attr]
    mapping = df.sparkSession.createDataFrame(rows, f"rep int, _v {kind}, _s {kind}")
    return df.join(F.broadcast(mapping), F.col(attr) == F.col("_v")).drop(attr, "_v").withColumnRenamed("_s", attr)


def permute_chunks(df: DataFrame, attr: str, chunk: str, order: str, count: int = 1, seed: int = 0) -> DataFrame:
    """Whole chunks of an attribute swapped: the n-th sample of a chunk gets the n-th of another's."""
    mapping = permute_values(df.select(chunk).distinct().withColumn("_from", F.col(chunk)), chunk, count, seed).withColumnRenamed(chunk, "_to")
    w = W.partitionBy(chunk).orderBy(order)
    at = df.withColumn("_i", F.row_number().over(w))
    source = at.select(F.col(chunk).alias("_to"), "_i", F.col(attr).alias("_new"))
    return at.join(F.broadcast(mapping), F.col(chunk) == F.col("_from")).join(source, ["_to", "_i"], "left").drop(attr, "_to", "_from", "_i").withColumnRenamed("_new", attr)


def random_samples(df: DataFrame, attr: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` samples of each target."""
    return balance(df, attr, key, n, seed=seed, apply=True).drop("rep")


# --- small combinatorics on the driver -------------------------------------
def unique_combinations(values: list, n: int, ordered: bool = False) -> list[tuple]:
    out = list(itertools.combinations(values, n))
    return sorted(out) if ordered else out


def random_combinations(values: list, n: int, k: int, seed: int = 0) -> Iterator[tuple]:
    """``k`` distinct combinations at random."""
    rng, seen = random.Random(seed), set()
    from math import comb

    while len(seen) < min(k, comb(len(values), n)):
        c = tuple(sorted(rng.sample(range(len(values)), n)))
        if c not in seen:
            seen.add(c)
            yield tuple(values[i] for i in c)


def random_product(n: int, *seqs: list, seed: int = 0) -> Iterator[tuple]:
    """``n`` distinct elements of a product at random."""
    rng, seen, total = random.Random(seed), set(), 1
    for s in seqs:
        total *= len(s)
    while len(seen) < min(n, total):
        c = tuple(rng.randrange(len(s)) for s in seqs)
        if c not in seen:
            seen.add(c)
            yield tuple(s[i] for s, i in zip(seqs, c, strict=True))


# --- composition -----------------------------------------------------------
def chain(*nodes):
    """Nodes applied one after the other; each is DataFrame -> DataFrame (or Dataset -> Dataset)."""

    def run(x):
        for node in nodes:
            x = node(x)
        return x

    return run


def combined(*nodes, name: str = "node"):
    """Nodes on the same input, their outputs below each other with the node's number."""

    def run(df: DataFrame) -> DataFrame:
        out = None
        for i, node in enumerate(nodes):
            part = node(df).withColumn(name, F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out

    return run
