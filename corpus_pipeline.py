"""A corpus pipeline: five stages from raw documents to a mixed training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import compressor, cube, decontaminate, linededup, simhash
from lodeworks.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compressor.drop_bad(spark, docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_repeated_lines(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # every match within the bound, not the share that op6 aims at
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"), recall=1)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cube.draw(spark, docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("mixing", mixing)]

#: The classifier, the LSH searches and the cube method have no SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        after = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return docs
