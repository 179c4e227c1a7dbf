"""Operator 12 against grouping by dictionary, also with a hash that collides."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sessionlake.llm.exact_dedup import label_copies, without_copies

LONG = "ab \t" * 40_000
ROWS = [
    (5, "a b"), (3, "a\t\n b"), (9, "a b "), (7, None), (8, ""), (2, " "), (4, "\x0b\x0c"), (6, "A b"), (1, "a b"),
    (11, LONG), (10, LONG.replace("\t", "\n")), (12, LONG + "c"), (13, "é"), (14, "é"), (None, "a b"), (None, "only null ids"),
    (None, "only null ids"), (20, "again"), (20, "again"), (20, "other"), (21, "other"), (5, "a  b"),
]


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(key)
    out = []
    for body, keys in groups.items():
        ids = sorted((k is None, k or 0) for k in keys)
        keep = None if ids[0][0] else ids[0][1]
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(None if none else k, keep, len(ids), i == 0, sha) for i, (none, k) in enumerate(ids)]
    return sorted(out, key=str)


def labelled(df, **given):
    return sorted(map(tuple, label_copies(df, **given).collect()), key=str)


@pytest.mark.parametrize("hashed", [None, lambda text: F.substring(F.unhex(F.md5(text)), 1, 1) == F.unhex(F.lit("00")), lambda text: F.lit(b"x")])
def test_same_as_brute_force(spark, hashed):
    rows = ROWS + [(100 + i, f"text {i % 7}{' ' * (i % 3)}") for i in range(60)] + [(300 + i, "copy") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert labelled(df, **({"hashed": hashed} if hashed else {})) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert labelled(spark.createDataFrame([], "doc_id bigint, text string")) == []
    names = ["doc_id", "text", "hash", "sha", "body", "row", "id", "first", "again", "group_size", "_sha_id", "kept"]
    df = spark.createDataFrame([(1, "a", *"0123456789"), (2, "a", *"0123456789"), (2, "a", *"9876543210")], names)
    assert labelled(df) == brute([(1, "a"), (2, "a"), (2, "a")])
    assert [r.doc_id for r in without_copies(df).collect()] == [1]


def test_rows_that_stay_keep_their_columns(spark):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(ROWS)], "doc_id bigint, text string, n int")
    left = without_copies(df)
    assert left.columns == df.columns
    stay = [(k, sha) for k, _, _, kept, sha in brute(ROWS) if kept]
    body = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert sorted(((r.doc_id, body(r.text)) for r in left.collect()), key=str) == sorted(stay, key=str)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    assert not any(x in label_copies(df)._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
