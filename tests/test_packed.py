from sampleloom.operators.packed import CHARACTER, UNSEEN, Lattice, boundaries, split_packed, value_of


def values(text):
    lo, hi, sure, *_ = boundaries(text)
    cut = [lo - 1, *sure, hi]
    return [value_of(text[a + 1 : b]) for a, b in zip(cut, cut[1:], strict=False)]


def test_rule():
    assert values("a;b,c|d\te\nf") == list("abcdef")
    assert values("Ftest(2,116);none") == ["Ftest(2,116)", "none"]
    assert values("x &amp; y;&lt;46 Hz;z") == ["x & y", "<46 Hz", "z"]
    assert values("""['a', "b;c", 'd''s e']""") == ["a", "b;c", "d's e"]
    assert values("""the "rest" block, kettle's side""") == ['the "rest" block', "kettle's side"]
    assert values('"the ""rest"" block";b') == ['the "rest" block', "b"]
    assert values(";a;;b;") == ["", "a", "", "b", ""]
    assert values("a & b;&nosuch;c") == ["a & b", "&nosuch", "c"]


def test_ambiguous_fields_follow_the_column(spark):
    rows = [(i, "alpha;beta", None) for i in range(30)] + [(100, "'alpha;beta", None), (101, "(gamma, delta", "x")]
    df = spark.createDataFrame(rows, "id long, labels string, stats string")
    got = {(r.id, r.field_name, r.pos): r.value for r in split_packed(df, ["id"], ["labels", "stats"]).collect()}
    # beta is frequent, so the open quote is an ordinary sign
    assert got[100, "labels", 0] == "'alpha" and got[100, "labels", 1] == "beta"
    assert got[101, "stats", 0] == "x" and got[5, "labels", 1] == "beta"


def test_expected_counts_sum_to_one_path():
    e = {edge.key: x for edge, x in Lattice("'a;b").expected({"b": 0.5})}
    assert abs(e["b"] + e["'a;b"] - 1) < 1e-9


def test_edges(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "  ", "[]"), (3, "a", "a"), (3, "a", "a"), (None, "b", None), (4, "v;" * 3000, None)], "id long, labels string, pos string")
    got = [tuple(r) for r in split_packed(df, ["id"], ["labels", "pos"]).collect()]
    assert len(got) == len(set(got)) == 2 + 1 + 3000
    assert (3, "pos", 0, "a") in got and (None, "labels", 0, "b") in got and (4, "labels", 2999, "v") in got
    empty = spark.createDataFrame([], "id long, labels string")
    assert split_packed(empty, ["id"], ["labels"]).count() == 0


def test_open_sign_before_many_delimiters(spark):
    long = "'" + "a;" * 100 + "end"
    assert len(Lattice(long).edges) < 2 * 101 + 1
    # the open quote protects nothing where the values are frequent, everything where they are never seen
    rows = [(i, "a;end,b|c", None) for i in range(50)] + [(100, long, None), (101, "'" + ";".join(f"q{i}" for i in range(200)), None)]
    rows += [(200 + i, "'x1;x2", None) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, labels string, stats string")
    got = {}
    for r in split_packed(df, ["id"], ["labels", "stats"]).collect():
        got.setdefault(r.id, {})[r.pos] = r.value
    assert [got[100][k] for k in range(101)] == ["'a", *["a"] * 99, "end"]
    assert got[101] == {0: "'" + ";".join(f"q{i}" for i in range(200))}
    assert [got[7][k] for k in range(4)] == ["a", "end", "b", "c"]


def test_open_sign_protects_up_to_frequent_values(spark):
    rows = [(i, "rest,face;house", None) for i in range(60)] + [(100, "(x: one, two; rest,face", None)]
    df = spark.createDataFrame(rows, "id long, labels string, stats string")
    got = {r.pos: r.value for r in split_packed(df, ["id"], ["labels"]).where("id = 100").collect()}
    assert got == {0: "(x: one, two", 1: "rest", 2: "face"}


def test_viterbi_and_expectation_equal_brute_force():
    import itertools
    import math

    text, weight, protects = "'a;b,(c;d|e", {"b": 0.2, "d": 0.1, "e": 0.3, "(c;d": 0.05}, {"'": 0.3, "(": 0.2}
    lat = Lattice(text)
    last = len(lat.nodes) - 1
    by = {(e.start, e.end): e for e in lat.edges}
    paths = []
    for k in range(last):
        for inner in itertools.combinations(range(1, last), k):
            steps = list(itertools.pairwise([0, *inner, last]))
            if all(x in by for x in steps):
                es = [by[x] for x in steps]
                p = math.prod((weight.get(e.key, 0) + math.exp(-UNSEEN - CHARACTER * e.length)) * ((protects[e.sign] if e.over else 1 - protects[e.sign]) if e.sign else 1) for e in es)
                paths.append((p, [e.key for e in es]))
    assert len(paths) > 4 and lat.viterbi(weight, protects) == max(paths)[1]
    total = sum(p for p, _ in paths)
    for e, x in lat.expected(weight, protects):
        assert abs(x - sum(p for p, v in paths if e.key in v) / total) < 1e-9
