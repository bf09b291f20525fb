import random

from sampleloom.operators.intervals import periods_and_gaps


def brute(rows):
    by = {}
    for k, s, e in rows:
        if None not in (k, s, e) and s < e:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, v in by.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)}
    return out


def check(spark, rows, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        # further columns, one with a name that the operator uses itself
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "ent string, a long, b long, s int, kind string")
        got = [tuple(r) for r in periods_and_gaps(df, ["ent"], "a", "b").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_random_over_many_partitions(spark):
    rng = random.Random(1)
    for parts in (1, 7, 40):
        rows = [(rng.choice("aaab") + str(rng.randrange(3)), s := rng.randrange(3000), s + rng.randrange(-2, 60)) for _ in range(700)]
        check(spark, rows + rows[:50], parts)


def test_one_entity_holds_most_and_one_period_spans_all(spark):
    rows = [("hot", i * 10, i * 10 + 5) for i in range(500)]
    check(spark, rows, 16)
    check(spark, [*rows, ("hot", 0, 10_000)], 16)
    check(spark, [("a", i, i + 1) for i in range(300)], 16)  # touching: one period


def test_edges(spark):
    check(spark, [], 4)
    check(spark, [(None, 1, 2), ("a", None, 2), ("a", 3, None), ("a", 5, 5), ("a", 6, 1)], 4)
    check(spark, [("a", 1, 2)] * 9 + [("b", 1, 2)], 4)
