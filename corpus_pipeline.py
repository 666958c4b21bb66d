"""Corpus preparation: language, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.llm import decontaminate, language, lines, packing, simhash
from yieldloom.llm.common import drop_path, held, materialize, restored, scratch, table
from yieldloom.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or between two, go. A null text or one without a letter has none; repeated rows and rows
    without a doc_id are judged one by one."""
    return language.accepted(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier one go; n_chars follows the text. Every row stays, with an empty text if all of
    its lines go; repeated rows keep the same lines, and of equal lines in one doc_id's texts the first by the text's hash stays.
    Other columns pass as they are, whatever their names."""
    out = restored(lines.deduplicate(held(docs)), docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id (of several texts with it, that of the smallest hash; of equal
    rows one). Null and blank texts are one group; a row without a doc_id stays only if its whole group has none."""
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text; a null or empty text holds none."""
    return decontaminate.without_rows(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of token pieces in sequences of 2048. Each row is packed, repeated ones and those without a doc_id too; a null or empty
    text is its end id alone."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, limit=2048)


STAGES = [("language", identify_language), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("pack", pack)]

#: SQL has neither the classifiers nor the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage has written, its intermediate tables included, is deleted once the next stage has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", outlive=True)
        if before:
            drop_path(spark, before)
        before = os.path.dirname(docs.inputFiles()[0]) if name != STAGES[-1][0] and docs.inputFiles() else None
    return docs
