"""A training corpus from raw documents: five stages, one written table after each.

toxicity, line dedup, near-dedup, mixing, encoding.  A stage takes the table its
predecessor left and the folder of the given tables; all but the last return
the columns of ``documents``.

Every stage keeps further columns of any name and takes an empty table.  A null
text counts as an empty one and stays null: it is never toxic, has no lines,
is a copy of nothing, and has no ids.  Repeated rows are scored and cleaned
alike, and near-dedup keeps one row of an id; rows with a null id all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dustpan.llm import minhash, mixing, pieces, queries, template_lines, toxicity
from dustpan.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, scores below its threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate that recurs across others; a document left without text stays, empty."""
    return template_lines.drop_templates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources get shares nearer to each other (square root of their size)."""
    return mixing.replicate(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and what these decode to."""
    return pieces.encode_texts(docs, pieces.read_model(queries.vocabulary_path()))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near-dedup", drop_near_copies),
          ("mixing", mix), ("encoding", encode)]

# A trained classifier and sketches are not expressed in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
