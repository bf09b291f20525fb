import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sampleloom.operators.records import Structure, number, parse_lines


def brute(line: str, sep: str | None):
    """Fields by a sign-by-sign scan; None if the quoting is broken."""
    line, parts, cur, inside = line.strip(), [], "", False
    for ch in line:
        inside ^= ch == '"'
        if not inside and (ch == sep if sep else ch in " \t"):
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    if inside:
        return None
    parts = [p.strip(" \t") for p in [*parts, cur] if sep or p]
    if any('"' in p and not re.fullmatch(r'"(?:[^"]|"")*"', p) for p in parts):
        return None
    return [p[1:-1].replace('""', '"') if '"' in p else p for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a1," ;\t.é', min_size=1, max_size=12).filter(lambda s: s.strip() and not s.strip(" \t\";,") == "" or s.strip()), min_size=1, max_size=8), st.sampled_from([",", ";", None]))
def test_structure_equals_scan(lines, sep):
    lines = [x.strip() for x in lines if x.strip()]
    s = Structure([x.encode() for x in lines], sep.encode() if sep else None)
    for i, x in enumerate(lines):
        want = brute(x, sep)
        assert bool(s.broken[i]) == (want is None), (x, sep)
        if want is not None:
            assert [f.decode() for f in s.fields(i)] == want, (x, sep)


def test_wide_separator():
    s = Structure([b'a||"b||c"||d'], b"||")
    assert s.fields(0) == [b"a", b"b||c", b"d"]


def test_numbers():
    assert number(b"+1.5e2") == 150 and number(b".5") == 0.5 and number(b"5.") == 5
    for x in ("", "1e999", "nan", "inf", "1_0", "0x1", "−1", "１２", "1,5", "-"):
        assert number(x.encode()) is None


def run(spark, lines, files):
    f = spark.createDataFrame(files, "file_id long, sep string, header string, skiplines int, line string")
    return {(r.file_id, r.line_no): (r.onset, r.duration, r.reason) for r in parse_lines(spark.createDataFrame(lines, "file_id long, line_no int, line string, sep string"), f).collect()}


def test_reasons_and_edges(spark):
    lines = [(1, 1, "junk", None), (1, 2, "onset,duration,x", None), (1, 3, " 1.0 , 2 ,a ", None), (1, 3, " 1.0 , 2 ,a ", None), (1, 4, '1,"2",b"c', None), (1, 5, "1,2", None), (1, 6, "1,-2,c", None), (1, 7, "# 1,2,3", None), (1, 8, "", None), (1, 9, None, None), (1, 10, "1e999,2,x", None), (2, 1, "5 1 x", None), (2, 2, '6\t  "1"  "a b"', None), (9, 1, "1,2", None), (None, 1, "1,2", None), (1, 11, "1," * 50000, None)]
    files = [(1, ",", None, 1, "x"), (2, None, "onset,duration,name", None, "x"), (None, ",", None, 0, "x")]
    got = run(spark, lines, files)
    assert got[1, 3] == (1.0, 2.0, None)
    assert [got[1, n][2] for n in (4, 5, 6, 10, 11)] == ["quoting", "columns", "value", "value", "columns"]
    assert got[2, 1] == (5.0, 1.0, None) and got[2, 2] == (6.0, 1.0, None)
    assert set(got) == {(1, n) for n in (3, 4, 5, 6, 10, 11)} | {(2, 1), (2, 2)}


def test_empty(spark):
    assert run(spark, [], []) == {}


def test_records_of_any_columns(spark, tmp_path):
    from sampleloom.sources import text

    (tmp_path / "a.csv").write_text('name,size,n\n"x, y",1.5e1,3\n# note\n\nz,2,4\nbad,oops,5\nw,1\nq"r,1,1\nv,7,2.5\n')
    (tmp_path / "b.csv").write_text("n,extra,size,name\n8,?,-.5,m\n")
    (tmp_path / "c.csv").write_text("size,name\n1,k\n")
    got = {(r.path.rpartition("/")[2], r.line_no): (r.name, r["size"], r.n, r.reason) for r in text.records(spark, str(tmp_path), {"name": "string", "size": "double", "n": "long"}, ",").collect()}
    assert got == {
        ("a.csv", 2): ("x, y", 15.0, 3, None), ("a.csv", 5): ("z", 2.0, 4, None), ("a.csv", 6): (None, None, None, "value"), ("a.csv", 7): (None, None, None, "columns"),
        ("a.csv", 8): (None, None, None, "quoting"), ("a.csv", 9): (None, None, None, "value"), ("b.csv", 2): ("m", -0.5, 8, None), ("c.csv", 2): (None, None, None, "value"),
    }
    named = text.records(spark, str(tmp_path / "c.csv"), {"u": "double"}, ",", ["u", "t"], 1).collect()
    assert [(r.line_no, r.u) for r in named] == [(2, 1.0)]


def test_numbers_at_once_equal_one_by_one():
    import numpy as np

    from sampleloom.operators.records import numbers

    spelt = ["1", "-2.5", "+.5", "5.", ".", "", "-", "1e5", "1e", "1e+", "2E-3", "1e999", "nan", "inf", "0x1", " 7 ", "1 2", "1" * 60, "0." + "0" * 50 + "1", "--1", "1.2.3", "١", "-0", "1e5 "]
    raw = [x.encode() for x in spelt]
    buffer, end = np.frombuffer(b"|".join(raw) + b"|", np.uint8), np.cumsum([len(x) + 1 for x in raw]) - 1
    got = numbers(buffer, end - [len(x) for x in raw], end)
    for x, v in zip(raw, got, strict=True):
        want = number(x)
        assert (want is None and np.isnan(v)) or want == v, (x, want, v)
