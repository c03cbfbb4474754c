"""The corpus pipeline: documents in, packed training windows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again before the next. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, languages, line_dedup, near_dup, packing
from rasterloom.llm.samples import folded
from rasterloom.llm.shared import free_names, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model doesn't reject; it learns outside fold 2 of 4.

    Texts that are null, empty or without a letter go. Each row is decided by its own text, so
    repeated rows and rows without doc_id stay or go alike. With nothing to learn from (no lang
    anywhere) only texts without letters go; an empty table stays empty.
    """
    model = languages.fit(docs.where(folded("doc_id", 4) != 2))
    return languages.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; those that lose all of their words go.

    Null, empty and blank texts lose no line and stay. Rows equal in doc_id and text keep the same
    lines. A row without doc_id comes before all others. An empty table stays empty.
    """
    (counted,) = free_names(docs, "n_removed")
    left = line_dedup.drop_lines(docs, counted=counted)
    return left.where((F.col(counted) == 0) | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Rows of one doc_id are one document and stay or go together. Null, empty and blank texts
    are near nothing and stay unless another row of their doc_id goes; rows without doc_id stay.
    An empty table stays empty.
    """
    groups = near_dup.near_duplicates(docs, size=5, percent=80)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, each row decided by its own text.

    Null, empty and blank texts hold none and stay; repeated rows stay or go alike, and rows
    without doc_id are decided like any other. An empty table stays empty, an empty benchmark
    removes nothing.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_without_id=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows; ids as a binary column.

    Every row is a document, repeated ones and those without doc_id, too; a null or empty text is
    its end id alone. An empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("packing", pack),
]

#: The stages hold a trained model, a tokenizer and iterative joins: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
