"""Queries of the training-data problems: splits, packing, leaks and pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.llm.chunking import split_oversized
from sampleloom.llm.leaks import leaks
from sampleloom.llm.packing import pack
from sampleloom.llm.splits import split_records, tied_groups, tied_pairs
from sampleloom.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks that must share a set."""
    return tied_pairs(table(spark, d, "samples"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each chunk, named by its smallest chunk."""
    return tied_groups(table(spark, d, "samples"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Training, validation or test set of each sample."""
    return split_records(table(spark, d, "samples"), {"train": 0.8, "validation": 0.1, "test": 0.1})


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of each post or piece, at 2,048 tokens a container."""
    return pack(table(spark, d, "documents"), capacity=2048)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts that hold a passage of an evaluation item."""
    return p7_shares(spark, d).select("doc_id", "item_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same, with the share of the item's words that a post holds."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).withColumn("share", F.round("share", 4))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the posts above 512 tokens, overlapping by 64."""
    return split_oversized(table(spark, d, "documents"), limit=512, overlap=64)


P4_SQL = r"""
WITH RECURSIVE s AS (
  SELECT DISTINCT translate(lower(regexp_replace(chunks, '^\s+|\s+$', '', 'g')), '_. ', '---') AS c, regexp_replace(origids, '^\s+|\s+$', '', 'g') AS o FROM samples),
t AS (SELECT c, o FROM s WHERE c <> '' AND c <> 'n/a' AND o <> '' AND lower(o) <> 'n/a'),
e AS (SELECT DISTINCT a.c AS a, b.c AS b FROM t a JOIN t b ON a.o = b.o WHERE a.c <> b.c),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
"""
P4_FOUND_SQL = P4_SQL + "SELECT a AS chunk_a, b AS chunk_b FROM r WHERE a < b"
P4_GROUPS_SQL = P4_SQL + "SELECT c AS chunk, least(c, min(b)) AS group_id FROM (SELECT DISTINCT c FROM s WHERE c <> '' AND c <> 'n/a') LEFT JOIN r ON a = c GROUP BY c"

QUERIES = {f.__name__: f for f in (p4_found, p4_groups, p4_splits, p6_pack, p7_found, p7_shares, p8_pieces)}
SQL = {"p4_found": P4_FOUND_SQL, "p4_groups": P4_GROUPS_SQL}
