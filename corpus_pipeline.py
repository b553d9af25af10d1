"""A corpus pipeline of five stages over documents: language, quality, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs; the folder of a stage goes once the next one is written. All stages but the
last return the columns of documents, extra ones included, whatever their names. Texts may be null, empty or
of any length in every stage; what each makes of them, and of repeated rows, is said there. An empty table
passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, ngram_join, packing, quality
from tessera.llm.common import fresh_dir, table
from tessera.storage import drop_dir

#: A document goes if its quality score is below this.
LEAST_QUALITY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay; those without a letter (``und``), so null and empty texts too, go. Where no language can be learned, all stay. Repeated rows stay or go alike."""
    model = langid.train(docs)
    if not model.languages:
        return docs
    return docs.where(langid.language(spark, model)(F.col("text")) != langid.UNKNOWN)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. A null text is judged as an empty one; repeated rows and equal texts stay or go alike; where no label can be learned from, all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scored(spark, model)(F.col("text")) >= LEAST_QUALITY)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near-duplicate texts: that with the least id. Null and empty texts are equal; rows without an id stay only for classes without one; of repeated rows one stays, chosen by a hash of all columns."""
    return ngram_join.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Null sources are one source; texts without a word are taken by chance alone; repeated rows are taken one by one."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and offset that each goes to. A null or empty text is its end id alone; copies that the mix took twice are packed twice."""
    return packing.packed(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Trained classifiers and random rounding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        at = fresh_dir(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            drop_dir(spark, before)
        before = at
    return docs
