"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all documents that the
stage before it kept. Stages before the last return the columns of documents.
Texts are whole in each of them, of any length; an empty table stays empty,
columns beyond those of documents are dropped, and repeated rows are treated
alike, so they stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, langid, lines, packing, simhash
from tidewell.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go: null texts, texts without a letter, gibberish, other scripts.

    Every language of the column lang is learned, from rows that are not held
    out. Rows with a null id or lang are judged like any other.
    """
    model = langid.learn_languages(docs.filter(~langid.held_out()))
    return langid.drop_unidentified(docs, model).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go; n_chars follows the text.

    The passage of the smallest id stays. Documents of which no word is left
    go; null texts, and rows of a null id, stay as they are (n_chars of a null
    text is null).
    """
    kept = lines.drop_repeated_lines(docs, whole=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays.

    Linked are fingerprints within 4 bits, and texts of which 80 % of the
    distinct five-word shingles are common. Texts without a word form one group. Rows of a null id go if their group
    has an id, and else stay.
    """
    return simhash.keep_one_of_each(docs, similarity=0.8).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which 5 % of the words or more stand in benchmark items go; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row for each piece of a document.

    Null and empty texts are one end token; null ids are kept.
    """
    packed = packing.pack_documents(docs, with_ids=False, specials=True)
    return packed.select(F.col("doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, rolling hashes and token ids are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
