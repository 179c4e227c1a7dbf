"""Operator 12: exact duplicates by 128-bit content hash, with the bytes compared inside groups.

Texts are equal when they are identical after each run of white space became one space. Built from
DataFrame functions only:

- every row is hashed where its text is read; ids and hashes (no text) are written once, grouped by
  hash with partial counts, and rows alone with their hash are done;
- the texts of the others are grouped by (hash, text). Copies collapse in the task that reads them, so a
  group with a third of all rows sends one row per task. A hash with one text is a group of equal
  bytes, which its rows find by hash; where several texts share a hash, rows find theirs by text too.

Defined results: a null text counts as empty, so null, empty and equal white space texts meet by rule. Of
equal texts the row with the smallest id stays, null ids last; of rows that repeat id and text
exactly one stays. Ids may repeat with other texts: rows are what is grouped. Very long texts are
treated alike, extra columns are ignored (`without_copies` keeps them), an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.linking import small_side, stored

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits of a text's content."""
    return F.unhex(F.md5(text))


def label_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    plain = docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("body"))
    texts = plain.withColumn("hash", hashed(F.col("body")))
    rows = stored(texts.select("id", "hash", F.unhex(F.sha2("body", 256)).alias("sha")), "content-hashes")
    several = stored(rows.groupBy("hash").count().filter("count > 1").select("hash"), "repeated-hashes")
    few = small_side(several, several.count())
    copies = stored(texts.withColumn("sha", F.sha2("body", 256)).join(few, "hash", "left_semi").withColumn("row", F.monotonically_increasing_id()), "copies")

    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    groups = stored(copies.groupBy("hash", "body").agg(first, F.count("*").alias("group_size")), "equal-texts")
    by_hash = groups.groupBy("hash").agg(F.count("*").alias("texts"), F.first("first").alias("first"), F.first("group_size").alias("group_size"))
    alone = stored(by_hash.filter("texts = 1").drop("texts"), "texts-of-one-hash")
    shared = stored(groups.join(by_hash.filter("texts > 1").select("hash"), "hash", "left_semi"), "colliding-texts")

    def labelled(found: DataFrame) -> DataFrame:
        return found.select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "sha")

    n = shared.count()
    clash, shared = small_side(shared.select("hash").distinct(), n), small_side(shared, n)
    single = rows.join(few, "hash", "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("sha"))
    out = single.unionByName(labelled(copies.join(small_side(alone, alone.count()), "hash"))).unionByName(labelled(copies.join(clash, "hash", "left_semi").join(shared, ["hash", "body"])))
    return out.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns."""
    sha, mark = fresh("sha", docs.columns), fresh("again", docs.columns)
    stay = label_copies(docs, key, text).filter("kept").select(F.col(key).alias(f"{sha}_id"), F.col("text_sha256").alias(sha))
    stay = stored(stay, "texts-that-stay")
    rows = docs.withColumn(sha, F.sha2(normalised(F.col(text)), 256))
    same = rows[sha].eqNullSafe(stay[sha]) & rows[key].eqNullSafe(stay[f"{sha}_id"])
    rows = rows.join(stay, same, "left_semi")
    # Rows that repeat id and text are told by a count of light rows; only they are grouped whole.
    repeated = rows.groupBy(key, sha).count().filter("count > 1").select(F.col(key).alias(f"{sha}_id"), F.col(sha).alias(f"{sha}_text"), F.lit(True).alias(mark))
    repeated = stored(repeated, "repeated-rows")
    joined = rows.join(small_side(repeated, repeated.count()), rows[key].eqNullSafe(repeated[f"{sha}_id"]) & (rows[sha] == repeated[f"{sha}_text"]), "left")
    once = joined.filter(F.col(mark).isNull()).select(docs.columns)
    return once.unionByName(joined.filter(mark).dropDuplicates([key, sha]).select(docs.columns))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column has, whatever its case."""
    low = {c.lower() for c in taken}
    while any(c.startswith(name) for c in low):
        name = f"_{name}"
    return name
