"""A pipeline from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.

1. Toxicity: documents that the classifier rejects go.
2. SimHash near-dedup: of each group of near copies (sets of five-word shingles
   that are 0.8 similar or more) the document of the smallest id stays.
3. Substring dedup: words go that a run of 13 words covers which also starts in
   a document of smaller id; a document that keeps none of its words goes.
4. Benchmark decontamination: documents with a word in a window of a benchmark
   item go.
5. Packing: what is left, as pieces in sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, packing, repeats, simhash, toxicity
from orrery.llm.shared import fresh_dir


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have the score of the bias; a score of just 0.5 is toxic; rows without an id are judged, too; equal texts go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without words are copies of each other; rows without an id stay; of rows that repeat an id each has its own group, and one row of each group stays."""
    return simhash.drop_similar(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text; null texts stay null; rows without an id, and rows that repeat an id among themselves, take no words from each other."""
    kept = repeats.remove_repeats(docs, drop_emptied=True)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, and items without words, match nothing; items without an id count; each row is judged by itself."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), nameless=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text is one end token; rows that repeat an id are packed each; documents of equal length are packed in the order of their ids."""
    return packing.packing_query(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash near-dedup", remove_near_copies),
    ("substring dedup", remove_repeats),
    ("benchmark decontamination", remove_contaminated),
    ("packing", pack),
]

#: A trained classifier and a tokeniser are no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
