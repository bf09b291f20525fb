import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.llm import chunking, leaks, packing, splits, tokens, words

WORDS = "the quick brown fox jumps over a lazy dog while seven amber quills buried modest kites near every frosty harbour".split()


def text_of(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS))
        if i % 11 == 10:
            out[-1] += rng.choice([". ", ".\n", ".\n\n", "! "])
        else:
            out[-1] += " "
    return "".join(out)


# --- tokens ----------------------------------------------------------------
def test_counts_of_parts_add_up():
    rng = random.Random(0)
    t = text_of(rng, 40_000) + "  \n\t x" * 50 + "é" * 300 + "你好。" * 100
    whole = len(tokens.encoder().encode_ordinary(t))
    assert tokens.count_tokens(t) == whole
    assert sum(len(tokens.encoder().encode_ordinary(p.decode())) for p in tokens.parts(t.encode(), 500)) == whole
    assert int(tokens.token_sizes(t).sum()) == len(t.encode())


def test_strengths():
    raw = "One two.\n\nThree. Four\nfive".encode()
    at = np.array([3, 8, 10, 16, 21, 1])
    assert tokens.strengths(raw, at).tolist() == [tokens.WORD, tokens.PARAGRAPH, tokens.PARAGRAPH, tokens.SENTENCE, tokens.LINE, tokens.WORD_PART]


# --- splitting oversized items ---------------------------------------------
def check_pieces(rows, texts, limit, overlap):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for doc, ps in by.items():
        raw, ps = texts[doc].encode(), sorted(ps, key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert ps[0].start_byte == 0 and ps[-1].end_byte == len(raw)
        for p in ps:
            assert raw[p.start_byte : p.end_byte].decode() == p.text
            assert tokens.count_tokens(p.text) == p.n_tokens <= limit
        for a, b in zip(ps, ps[1:], strict=False):
            shared = raw[b.start_byte : a.end_byte].decode()
            assert a.start_byte < b.start_byte <= a.end_byte
            assert overlap - 2 <= tokens.count_tokens(shared) <= overlap + 12
    return by


def test_ranges_and_whole_texts_are_cut_alike(spark):
    rng = random.Random(1)
    texts = {i: text_of(rng, n) for i, n in enumerate([5, 120, 900, 5000, 20_000])}
    texts[9] = "xyz" * 4000
    texts[10] = "你好。今天很好" * 900
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()] + [(50, None, 1, "x"), (51, "", 1, "x"), (None, texts[3], 1, "x")], "doc_id long, text string, piece int, raw string").repartition(3)
    whole = chunking.split_oversized(df, 128, 16, range_bytes=10_000_000).collect()
    by = check_pieces(whole, texts, 128, 16)
    assert set(by) == {i for i, t in texts.items() if tokens.count_tokens(t) > 128}
    ranged = chunking.split_oversized(df, 128, 16, range_bytes=3000, halo=200).collect()
    check_pieces(ranged, texts, 128, 16)
    plain = lambda rows: {(r.doc_id, r.piece, r.start_byte, r.end_byte) for r in rows if r.doc_id in (2, 3, 4)}
    assert plain(whole) == plain(ranged)
    assert chunking.split_oversized(df.limit(0), 128, 16).count() == 0


def test_texts_of_many_ranges_without_blanks(spark):
    rng = random.Random(11)
    texts = {1: "xyz" * 50_000, 2: "你好。今天很好" * 9_000, 3: text_of(rng, 30_000), 4: "你好" * 20_000 + " and then " + text_of(rng, 9000), 5: "a" + " " * 40_000 + text_of(rng, 15_000), 6: "x" * 31_121 + "é", 7: " " * 70_000, 8: "".join(rng.choice(["x 你好世界。", " 🜚🜛 ok", " ﷽ᚠᛇ", "\n\nplain words. "]) for _ in range(25_000))}
    df = spark.createDataFrame(list(texts.items()) + [(3, texts[3])], "doc_id long, text string").repartition(2)
    rows = chunking.split_oversized(df, 128, 16, range_bytes=1, halo=200).collect()
    three = [r for r in rows if r.doc_id == 3]
    assert len(three) == 2 * len(set(three))  # a repeated row gives its pieces once more
    by = {}
    for r in set(rows):
        by.setdefault(r.doc_id, []).append(r)
    whole = [r for r in chunking.split_oversized(df, 128, 16, range_bytes=1 << 30).collect() if r.doc_id in (3, 8)]
    assert set(whole) == {r for r in rows if r.doc_id in (3, 8)}
    for doc, ps in by.items():
        raw, ps = texts[doc].encode(), sorted(ps, key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and ps[0].start_byte == 0 and ps[-1].end_byte == len(raw)
        assert all(raw[p.start_byte : p.end_byte].decode() == p.text and tokens.count_tokens(p.text) == p.n_tokens <= 128 for p in ps)
        assert all(a.start_byte < b.start_byte <= a.end_byte < b.end_byte for a, b in zip(ps, ps[1:], strict=False))
    assert set(by) == set(texts)


def test_texts_of_one_range_are_cut_where_they_are_read(spark):
    """The branch of texts of one range has no exchange; the other is empty here and has its own."""
    import re

    df = spark.createDataFrame([(1, "a word " * 2000)], "doc_id long, text string")
    text = chunking.split_oversized(df, 128, 16)._jdf.queryExecution().optimizedPlan().toString()
    first = text.split("\n")
    assert first[0].startswith("Union") and not re.search(r"Join|Repartition|Aggregate|Sort", "\n".join(first[1:5]))


def test_files_are_cut_by_seeking(spark, tmp_path):
    rng = random.Random(12)
    texts = {"long one.txt": text_of(rng, 200_000), "short.txt": text_of(rng, 20), "empty.txt": "", "mid.txt": text_of(rng, 400)}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    got = {}
    for r in chunking.split_files(spark, str(tmp_path), 64, 8, range_bytes=20_000, halo=200).collect():
        got.setdefault(r.doc_id.rpartition("/")[2], set()).add((r.piece, r.start_byte, r.end_byte, r.n_tokens, r.text))
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    want = {}
    for r in chunking.split_oversized(df, 64, 8, range_bytes=1 << 30).collect():
        want.setdefault(list(texts)[r.doc_id], set()).add((r.piece, r.start_byte, r.end_byte, r.n_tokens, r.text))
    names = {k.replace("%20", " "): v for k, v in got.items()}
    assert set(want) == {"long one.txt", "mid.txt"} and names == want
    read = []
    ranges = chunking.Ranges(64, 8, tokens.TOKENIZER, 20_000, 200, 128)
    raw = texts["long one.txt"].encode()
    chunking.Span(lambda a, b: read.append((a, b)) or raw[a:b], 20, len(raw), ranges).table()
    assert max(b - a for a, b in read) < 2 * ranges.size  # never the whole file


def test_pieces_are_counted_and_cut_again():
    """A count that grows when a piece is taken out makes it shorter."""
    cutter = tokens.Cutter(50, 5)
    good = np.full(400, tokens.WORD, np.uint8)
    count = lambda a, b: (b - a) // 2 + (9 if 100 <= a < 300 else 0)
    spans = list(cutter.feed(np.full(400, 2), good, count=count)) + list(cutter.finish(count))
    assert spans[0][0] == 0 and spans[-1][1] == 800 and all(n <= 50 for *_, n in spans)
    assert all(a[0] < b[0] < a[1] < b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_cuts_prefer_natural_boundaries():
    rng = random.Random(2)
    t = text_of(rng, 3000)
    spans = tokens.cut_text(t, tokens.Cutter(200, 20))
    raw = t.encode()
    good = [tokens.strengths(raw, np.array([b]))[0] for _, b, _ in spans[:-1]]
    assert np.mean([g >= tokens.SENTENCE for g in good]) > 0.9
    with pytest.raises(ValueError):
        tokens.Cutter(10, 10)


# --- packing -----------------------------------------------------------------
def test_packing(spark):
    rng = random.Random(3)
    texts = {i: text_of(rng, rng.choice([3, 20, 60, 150])) for i in range(400)}
    texts[1000] = text_of(rng, 2500)
    texts[1001] = ""
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()] + [(2000, None, 5), (None, "a b", 5)], "doc_id long, text string, place int").repartition(6)
    rows = packing.pack(df, 256, windows=16).collect()
    used = {}
    for r in rows:
        used.setdefault(r.container, []).append(r)
    assert all(sum(r.n_tokens for r in v) <= 256 for v in used.values())
    assert all(sorted(r.place for r in v) == list(range(len(v))) for v in used.values())
    assert {r.doc_id for r in rows} == set(texts)
    assert {r.doc_id for r in rows if r.piece} == {1000}
    long = sorted((r for r in rows if r.doc_id == 1000), key=lambda r: r.piece)
    assert long[0].start_byte == 0 and all(a.end_byte == b.start_byte for a, b in zip(long, long[1:], strict=False)) and long[-1].end_byte == len(texts[1000].encode())
    offline: list[int] = []  # first fit, largest first, over all items at once
    for n in sorted((r.n_tokens for r in rows), reverse=True):
        at = next((i for i, room in enumerate(offline) if room >= n), None)
        if at is None:
            offline.append(256 - n)
        else:
            offline[at] -= n
    assert len(used) <= len(offline) * 1.03 + 2
    assert packing.pack(df.limit(0), 256).count() == 0


def test_windows_never_overflow():
    rng = random.Random(4)
    w = packing.Windows(100, 5)
    out = []
    for i in range(3000):
        if full := w.put((i, s := rng.randrange(0, 101)), s):
            out.append(full[1])
        assert len(w.items) <= 6
    every = [*out, *w.items.values()]
    assert sorted(i for v in every for i, _ in v) == list(range(3000))
    assert all(sum(s for _, s in v) <= 100 for v in every)


# --- splits --------------------------------------------------------------------
def brute_components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by = {}
    for c, o in rows:
        if c and o:
            by.setdefault(o, set()).add(c)
    for cs in by.values():
        first, *rest = sorted(cs)
        for c in rest:
            a, b = find(first), find(c)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


@pytest.mark.parametrize("most", [4_000_000, 10])
def test_components(spark, monkeypatch, most):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(300):03d}", f"o{rng.randrange(700)}") for _ in range(800)]
    rows += [(f"p{i:03d}", f"q{i}") for i in range(60)] + [(f"p{i + 1:03d}", f"q{i}") for i in range(59)]
    df = spark.createDataFrame(rows, "chunks string, origids string").repartition(7)
    tree = splits.components(splits.tie_edges(df, "chunks", "origids"), most).collect()
    root = {r.node: r.root for r in tree}
    pairs = brute_components(rows)
    assert {(a, b) for a, b in pairs if root.get(a, a) != root.get(b, b)} == set()
    assert len(root) == len({x for p in pairs for x in p}) - len({root[x] for x in root})
    for part in (1000, 7):
        monkeypatch.setattr(splits, "PART", part)
        got = [tuple(r) for r in splits.tied_pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs


def test_spellings_and_missing(spark):
    rows = [(1, " S1.R1", "o1", "a"), (2, "s1_r1\t", "o2", "a"), (3, "s2 r1", " o1 ", "b"), (4, "s3-r1", None, "b"), (5, "s4-r1", "n/a", "b"), (6, "s5-r1", "n/a", None), (7, None, "o2", "a"), (8, None, None, "a"), (8, None, None, "a"), (9, "", "o9", "c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "sample_id long, chunks string, origids string, targets string, group_id int")
    assert [tuple(r) for r in splits.tied_pairs(df).collect()] == [("s1-r1", "s2-r1")]
    got = {r.sample_id: (r.group_id, r.split) for r in splits.split_records(df, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert set(got) == set(range(1, 10))
    assert got[1] == got[2] == got[3] == got[7]
    assert got[8][0] != got[9][0]
    assert splits.tied_pairs(df.limit(0)).count() == 0
    assert splits.split_records(df.limit(0), {"a": 1.0}).count() == 0


def test_proportions(spark):
    rng = random.Random(6)
    rows = [(i, f"c{rng.randrange(200)}" if i > 500 else f"c{i // 300}", f"o{i}", rng.choice(["rest", "rest", "face", "house"])) for i in range(5000)]
    df = spark.createDataFrame(rows, "sample_id long, chunks string, origids string, targets string")
    got = splits.split_records(df, {"train": 0.8, "validation": 0.1, "test": 0.1})
    share = {r.split: r["count"] / 5000 for r in got.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    assert got.groupBy("chunk").agg(F.countDistinct("split").alias("k")).agg(F.max("k")).first()[0] == 1
    assert got.count() == 5000


def test_proportions_of_many_groups(spark):
    """100,000 groups of 1 to 9 records: the splits are within one group's size of their targets, and so are the kinds."""
    n = F.col("id")
    of = F.explode(F.sequence(F.lit(1), F.pmod(F.xxhash64("id"), F.lit(9)) + 1))
    df = spark.range(100_000).select(F.concat(F.lit("c"), n.cast("string")).alias("chunks"), of.alias("i")).withColumn("sample_id", F.xxhash64("chunks", "i"))
    df = df.withColumn("origids", F.col("sample_id").cast("string")).withColumn("targets", F.concat(F.lit("t"), F.pmod(F.hash("sample_id"), F.lit(4)).cast("string")))
    got = splits.split_records(df, {"train": 0.8, "validation": 0.1, "test": 0.1}).join(df.select("sample_id", "targets"), "sample_id")
    by = {(r.split, r.targets): r["count"] for r in got.groupBy("split", "targets").count().collect()}
    total = sum(by.values())
    assert total == df.count() and got.groupBy("chunk").agg(F.countDistinct("split").alias("k")).agg(F.max("k")).first()[0] == 1
    for s, q in {"train": 0.8, "validation": 0.1, "test": 0.1}.items():
        assert abs(sum(x for (a, _), x in by.items() if a == s) - q * total) <= 9
        for t in ("t0", "t1", "t2", "t3"):
            kind = sum(x for (_, b), x in by.items() if b == t)
            assert abs(by[s, t] - q * kind) < 0.02 * kind


def test_dealing_equals_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lack, step, count = rng.normal(size=4) * 100, float(rng.uniform(0.5, 30)), int(rng.integers(0, 60))
        got, left = splits.deal(lack, step, count), lack.copy()
        for _ in range(count):
            left[int(np.argmax(left))] -= step
        assert got.sum() == count and np.allclose(lack - got * step, left)


def test_other_names_of_origins_tie(spark):
    df = spark.createDataFrame([("a", "none"), ("b", "none"), ("c", "N/A"), ("d", "n/a")], "chunks string, origids string")
    assert [tuple(r) for r in splits.tied_pairs(df).collect()] == [("a", "b")]
    assert {tuple(r) for r in splits.tied_groups(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}


# --- leaks -----------------------------------------------------------------------
def test_hashes_equal_plain_words():
    t = ["It's Ärger-\n> lich, <b>bold</b> &amp; x_y 1,5 ﬁne STRASSE", "", "plain words here"]
    h, b = words.word_hashes(t)
    want = ["it", "s", "argerlich", "bold", "x", "y", "1", "5", "fine", "strasse"]
    one, _ = words.word_hashes([" ".join(want)])
    assert h[b[0] : b[1]].tolist() == one.tolist() and b[1] == b[2] and b[3] - b[2] == 3
    big = "word salad " * 300_000
    hb, bb = words.word_hashes([big, "x"])
    assert bb.tolist() == [0, 600_000, 600_001] and len(set(hb.tolist())) == 3


def test_markup_of_any_length_is_no_word():
    h, b = words.word_hashes(['one <a href="' + "x" * 5000 + '">two</a> [url=' + "y" * 4000 + "]three[/url]", "one two three"])
    assert b.tolist() == [0, 3, 6] and h[:3].tolist() == h[3:].tolist()
    open_sign = "<a " * 50_000
    h, b = words.word_hashes([open_sign])
    assert b[1] == 50_000


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    probes = prints[rng.integers(0, 300, 400)].copy()
    for i in range(400):
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            probes[i] ^= np.uint64(1) << np.uint64(bit)
    a, b = leaks.Blocks(prints, 3).near(probes)
    brute = {(i, j) for i in range(400) for j in range(300) if int(probes[i] ^ prints[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == brute


def test_simhash_slides():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, 50, dtype=np.uint64)
    weight = rng.integers(1, 9, 50)
    s = leaks.simhash(w, weight, 7)
    assert [leaks.simhash(w[i : i + 7], weight[i : i + 7], 7)[0] for i in range(44)] == s.tolist()
    assert len(leaks.simhash(w[:3], weight[:3], 7)) == 0


def test_leaks(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    item = {i: [rng.choice(vocab) for _ in range(60)] for i in range(1, 21)}
    common = "read the passage and choose the best answer".split()
    item = {i: (common if i % 2 else []) + w for i, w in item.items()}
    item[30] = item[1][:40] + [rng.choice(vocab) for _ in range(20)]  # a shared passage
    filler = lambda n: [rng.choice(["lorem", "ipsum", "dolor", "sit", *vocab[:20]]) for _ in range(n)]

    def alter(w, k):
        w = w[:]
        for p in rng.sample(range(3, len(w) - 3), k):
            w[p] = "zz" + w[p]
        return w

    docs, want = {}, set()
    docs[1] = " ".join(filler(50) + item[2] + filler(50))
    want |= {(1, 2)}
    docs[2] = "> " + "\n> ".join(" ".join(item[3][10:42][i : i + 6]).upper() for i in range(0, 32, 6))
    want |= {(2, 3)}
    docs[3] = ", ".join(filler(30) + alter(item[4][5:40], 3) + filler(400))
    want |= {(3, 4)}
    docs[4] = " ".join(filler(20) + item[6][:15] + filler(25) + item[6][30:45] + filler(9))  # two stretches
    want |= {(4, 6)}
    docs[5] = " ".join(filler(20) + common + filler(20))  # the instruction alone
    docs[6] = " ".join(filler(20) + item[8][5:13] + filler(20))  # a short phrase
    docs[7] = " ".join(filler(9) + rng.sample(item[10], len(item[10])))  # another order
    docs[8] = " ".join(item[1][:40])
    want |= {(8, 1), (8, 30)}
    docs[9] = " ".join(filler(60_000) + item[12] + filler(1000))
    want |= {(9, 12)}
    rows = [(i, t, 1, "x") for i, t in docs.items()] + [(1, docs[1], 1, "x"), (20, None, 1, "x"), (21, "", 1, "x"), (None, docs[1], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int, share string")
    it = spark.createDataFrame([(i, " ".join(w), "t") for i, w in item.items()] + [(2, " ".join(item[2]), "t"), (40, None, "t"), (41, "", "t"), (42, "one two", "t")], "item_id long, item_text string, text string")
    got = [(r.doc_id, r.item_id) for r in leaks.leaks(df, it).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leaks.leaks(df.limit(0), it).count() == 0 and leaks.leaks(df, it.limit(0)).count() == 0


def altered_corpus(rng, every):
    """Posts with 0.45 of an item each, one word in ``every`` altered; and posts of the same words in other order."""
    vocab = [f"w{i}" for i in range(800)]
    item = {i: [rng.choice(vocab) for _ in range(rng.randrange(40, 130))] for i in range(60)}
    docs = {}
    for i, w in item.items():
        n = round(len(w) * 0.45)
        a = rng.randrange(len(w) - n + 1)
        cut = ["zq" + x if k % every == every - 1 else x for k, x in enumerate(w[a : a + n])]
        docs[i] = [rng.choice(vocab) for _ in range(rng.randrange(60))] + cut + [rng.choice(["lorem", "ipsum", *vocab[:9]]) for _ in range(40)]
        docs[1000 + i] = rng.sample(w, len(w))
    return {i: " ".join(w) for i, w in item.items()}, {i: " ".join(w) for i, w in docs.items()}


@pytest.mark.parametrize("every", [6, 5, 4])
def test_altered_words_and_brute_force(every):
    item, docs = altered_corpus(random.Random(every), every)
    ids, texts = np.array(list(docs)), list(docs.values())
    index = leaks.Items(list(item), list(item.values()), 7)
    got = {(d, i) for d, i, _ in leaks.search(ids, texts, index)}
    # every pair of post and item verified, without any search for candidates
    w, b = words.word_hashes(texts)
    known = index.known[(w & np.uint64(len(index.known) - 1)).astype(np.int64)]
    pairs = np.stack([x.ravel() for x in np.meshgrid(np.arange(len(ids)), np.arange(len(item)), indexing="ij")])
    brute = {(d, i) for d, i, _ in leaks.verified(ids, w, b, known, pairs, index)}
    assert got <= brute and len(brute - got) <= 0.02 * len(brute)
    assert sum((i, i) in got for i in item) >= 0.9 * len(item) and not any(d >= 1000 for d, _ in got)
    if every < 6:  # equal fingerprints alone don't find them
        exact = {(d, i) for d, i, _ in leaks.search(ids, texts, leaks.Items(list(item), list(item.values()), 0))}
        assert exact < got and len(exact) < 0.9 * len(got)


def test_window_sizes_and_short_items():
    assert leaks.window_sizes(3) == [3] and leaks.window_sizes(6) == [5] and leaks.window_sizes(100) == [5, 18, 40, 90]
    index = leaks.Items([1, 2, 3], ["alpha beta gamma", "one two", "delta epsilon zeta eta"], 7)
    texts = ["so alpha, BETA gamma!", "one two three", "x delta epsilon zeta eta", "alpha beta", ""]
    assert {(d, i) for d, i, _ in leaks.search(np.arange(5), texts, index)} == {(0, 1), (2, 3)}
    assert leaks.search(np.arange(1), ["alpha beta gamma"], leaks.Items([], [], 7)) == []


def test_instruction_alone_is_no_case():
    rng = random.Random(3)
    common = "read the passage with care and choose the one best answer".split()
    item = {i: common + [f"v{rng.randrange(3000)}" for _ in range(12)] for i in range(40)}
    index = leaks.Items(list(item), [" ".join(w) for w in item.values()], 7)
    assert leaks.search(np.arange(2), [" ".join(common), "x y " + " ".join(common + item[3][11:13])], index) == []
    assert [r[:2] for r in leaks.search(np.arange(1), [" ".join(item[5])], index)] == [(0, 5)]


def test_items_in_several_blocks(spark, monkeypatch):
    rng = random.Random(8)
    item = {i: " ".join(f"v{rng.randrange(5000)}" for _ in range(50)) for i in range(30)}
    df = spark.createDataFrame(list(item.items()), "doc_id long, text string")
    it = spark.createDataFrame(list(item.items()), "item_id long, item_text string")
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 7)
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(df, it).collect()} == {(i, i) for i in range(30)}


# --- queries -----------------------------------------------------------------------
def test_queries(spark):
    import duckdb

    from sampleloom.llm import queries as q

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view samples as select * from '{d}/samples.parquet'")
    for name, sql in q.SQL.items():
        want = con.sql(sql)
        assert {tuple(r) for r in q.QUERIES[name](spark, d).select(*want.columns).collect()} == set(want.fetchall()), name
    for name, f in q.QUERIES.items():
        assert f(spark, d).count() >= 0, name
