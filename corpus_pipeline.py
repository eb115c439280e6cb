"""From raw documents to packed training sequences: five stages, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm.decontaminate import decontaminate
from mixspark.llm.exact_dedup import kept_rows
from mixspark.llm.jaccard_join import one_of_each
from mixspark.llm.packing import best_fit_pack
from mixspark.llm.quality import good_documents
from mixspark.sources.scratch import stored

#: The stages call models and graph searches, which SQL does not express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar texts hold together."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; a token is a UTF-8 byte, with one end a document."""
    return best_fit_pack(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 1)


STAGES = [("quality", quality), ("exact_dedup", exact), ("jaccard_join", near),
          ("decontaminate", benchmark), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
