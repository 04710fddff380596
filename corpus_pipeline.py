"""A corpus pipeline: toxicity, exact and near duplicates, benchmark passages, then token counts and digests.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept, which is written as Parquet and read again. All but the last return the
columns of documents.

In every stage null texts count as empty, texts of any length are read whole,
an empty table gives an empty table with the same columns, and further columns
are kept, whatever their names. Besides:

* toxicity decides on each row by its own text; an empty text has no hits.
* exact_dedup keeps of equal texts the row with the largest id (a null id is the
  smallest); rows that repeat both id and text are kept together.
* near_dedup keeps of each group the document with the smallest id, with all its
  rows; rows without an id, and documents without words, are kept.
* decontamination decides on each row by its own text; a row without words stays.
* tokens returns a row for each row it gets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bpe, decontam, exactdedup, neardup, toxicity
from ledgerlark.llm.queries import BYTE_BPE
from ledgerlark.llm.scratch import new_path
from ledgerlark.plans.tables import read_table


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of docs whose id is among `decided` (a column doc_id)."""
    decided = decided.select(F.col("doc_id").alias("__of"))
    return docs.join(decided, docs["doc_id"].eqNullSafe(decided["__of"]), "left_semi")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what operator 9 takes for toxic, each row by its own text."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the document with the largest id."""
    kept = exactdedup.exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__of"), F.col("text_sha256").alias("__sha"))
    same = docs["doc_id"].eqNullSafe(kept["__of"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == kept["__sha"])
    return docs.join(kept, same, "left_semi")


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) keeps the document with the smallest id."""
    return _kept(docs, neardup.near_duplicates(docs).filter("kept"))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated with benchmark items."""
    return decontam.without_documents(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and decodes it again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs, BYTE_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("decontamination", unseen),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, shingles and tokens are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None
