"""The queries of the training-text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import ctph, decontaminate, extract, ngrams, packing, perspectives, repeats, simhash, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_query(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.lm_query(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_query(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_query(table(spark, sf_dir, "pages"))


def op6_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.neighbour_query(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotation_query(table(spark, sf_dir, "conversations"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extraction_query(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"pipeline": pipeline, "op3_extract": op3_extract, "op1_perspective_rotation": op1_perspective_rotation, "op4_toxicity": op4_toxicity, "op6_piecewise_hash": op6_piecewise_hash, "op7_warc": op7_warc, "op10_packing": op10_packing, "op5_kneser_ney": op5_kneser_ney, "op2_decontaminate": op2_decontaminate, "op8_substring_dedup": op8_substring_dedup, "op9_simhash": op9_simhash}
SQL = {"op1_perspective_rotation": perspectives.SQL, "op2_decontaminate": decontaminate.SQL, "op8_substring_dedup": repeats.SQL}
