"""The corpus pipeline: four stages over `documents`, each written as Parquet and read again.

language_id      texts without a letter, and texts of whose n-grams less than a fifth belong to any
                 learned language, go; languages are learned from the documents of three folds of four
near_duplicates  of every class of documents linked by Jaccard similarity of five-word shingles of at
                 least 0.8, the one with the smallest id stays; repeated rows of an id are one document
decontaminate    documents that hold a benchmark item go
mix              what the mix takes of every remaining document; sources weigh 5, 2, 1, repeating

Rows with a null id take part in every stage: they are their own class, and they are judged by their
text elsewhere. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilescope.llm.common import fold_of, shared_folder, stored
from tilescope.llm.decontaminate import drop_contaminated
from tilescope.llm.jaccard_join import ngram_jaccard_join
from tilescope.llm.language_id import UNKNOWN, identify_languages, learn_languages
from tilescope.llm.mixing import mix_sources
from tilescope.plans.registry import Query
from tilescope.session import ship_package

LEAST_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn_languages(docs.filter(fold_of(F.col("doc_id"), 4) != 2))
    found = identify_languages(docs, model)
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(keep).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = stored(ngram_jaccard_join(docs, width=5, threshold=0.8))
    gone = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    # Rows that repeat an id: the smallest stays. Rows without an id all stay.
    ids = docs.select(F.col("doc_id").cast("long").alias("_gone")).filter("_gone is not null")
    again = stored(ids.groupBy("_gone").agg(F.count("*").alias("n")).filter("n > 1").select("_gone"))
    out = stored(gone.unionByName(again).distinct())
    same = F.col("doc_id").cast("long") == F.col("_gone")
    once = docs.join(out, same, "left_anti")
    order = Window.partitionBy("doc_id").orderBy(*(c for c in docs.columns if c != "doc_id"))
    first = docs.join(again.join(gone, "_gone", "left_anti"), same, "left_semi")
    first = first.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return once.unionByName(first).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship_package(spark), docs, sf_dir)


STAGES = [(f.__name__, _shipped(f)) for f in (language_id, near_duplicates, decontaminate, mix)]
#: The join's components and the language filter are beyond SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERY = Query(run, ORACLE_SQL)
