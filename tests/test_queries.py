"""Every query with SQL against DuckDB on the smallest tables; the others run and give their columns."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sampleloom.plans import problems, reference, survey

SMALL = "/root/testdata/sf0.001"
OWN = {**problems.QUERIES, **reference.QUERIES, **survey.QUERIES}
SQL = {**problems.SQL, **reference.SQL, **survey.SQL}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings column_files column_lines bold_events condition_key niml_dsets samples meg_data eval_items".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def canon(df):
    df = df[sorted(df.columns)]
    text = lambda v: "None" if v is None or pd.isna(v) else f"{float(v):.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, row)) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want = OWN[name](spark, SMALL).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canon(got), canon(want)
    close = all(all(x == y or abs(float(x) - float(y)) < 2e-4 * max(1, abs(float(y))) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)) if a != b else True
    assert close, (set(a) ^ set(b))


def test_queries_without_sql_are_tested_otherwise():
    """Each has its comparison in test_brute.py, which names it or the models that it is made of."""
    from pathlib import Path

    text = Path(__file__).with_name("test_brute.py").read_text()
    models = {"lda_cv", "qda_cv", "smlr_cv", "svm_cv", "svm_rbf_cv"}
    missing = {n for n in set(OWN) - set(SQL) if f'"{n}"' not in text and n not in models}
    assert not missing, missing


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() == 2
