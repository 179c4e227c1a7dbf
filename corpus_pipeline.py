"""The corpus pipeline: stages that each take documents and, but for the last, return documents.

Each stage's rows are written as Parquet in the shared folder and read again as the next
stage's documents, so a lost executor costs at most a part of the running stage. What a stage decides
takes effect: the next stage sees only what is left.

1. toxicity: documents that the nearest labelled examples call toxic go.
2. line dedup: later near copies of lines go from the texts; a document goes if it loses all of its lines.
3. near dedup: of each component of near-duplicate documents the one with the smallest id stays.
4. decontamination: documents that hold a passage of a benchmark item go.
5. SentencePiece: token ids of what is left, as digests with their decoded text.

Null and empty texts pass all stages. Rows with a null id are never duplicates or contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.config import storage_root
from sessionlake.llm import decontaminate, line_dedup, near_dedup, piece_codec, toxic_neighbours
from sessionlake.llm.linking import small_side, stored
from sessionlake.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ``ids`` (doc_id)."""
    ids = stored(ids, "gone")
    return docs.join(small_side(ids, ids.count()), "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that score 0.7 or more go."""
    return toxic_neighbours.without_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of near-equal lines the first stays, in the whole corpus."""
    rows = line_dedup.dedup_lines(docs)
    rows = rows.filter((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", changed).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near duplicates stays."""
    return without(docs, near_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with a passage of a benchmark item go."""
    return without(docs, decontaminate.passages(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return piece_codec.encode_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", encode),
]

#: SQL can't express the stages (models, similarity joins and a tokenizer); tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = storage_root(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
