"""The corpus pipeline: what is kept of ``documents``, mixed and encoded.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs; all but the last return the columns of
``documents``. Every stage works on all rows and whole texts of its predecessor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.llm import quality
from mediaquarry.llm.bpe import bpe_round_trip
from mediaquarry.llm.common import materialise
from mediaquarry.llm.exact_dedup import exact_dedup
from mediaquarry.llm.jaccard_join import jaccard_components
from mediaquarry.llm.mixing import mix_documents
from mediaquarry.llm.queries import vocabulary_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, scores 0.3 or more.

    A null text is the empty text, which is scored like others; null and repeated ids are judged row by row; without
    labels every document scores 0.5 and stays; an empty table gives an empty one.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts that with the largest id; rows that repeat it are one. A text whose ids are all null stays once.

    A null text is the empty text; an empty table gives an empty one.
    """
    verdicts = exact_dedup(docs).where("kept or keep_id is null").select("doc_id", "text_sha256").distinct()
    return _kept(docs, verdicts)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, by five-word shingles at a similarity of 0.8, that with the smallest id. Rows with a null id stay.

    Documents without words are linked with nothing and stay; rows that repeat an id stay or go together; an empty
    table gives an empty one.
    """
    found = jaccard_components(docs, shingle=5, percent=80)
    kept = found.where("component_id = doc_id or component_id is null").select(F.col("doc_id").alias("_want")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"))
    return rows.join(kept, F.col("_id").eqNullSafe(F.col("_want")), "left_semi").select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each pass over a document, with the words that the pass takes.

    Documents without words, null texts among them, have nothing to take and go; a null source is a source; rows that
    repeat an id, null ones too, have their own words taken; an empty table gives an empty one.
    """
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids and of the text that they decode to: one row for each row.

    A null text is the empty text, which has no tokens; null and repeated ids are kept; an empty table gives an empty one.
    """
    return bpe_round_trip(docs, vocabulary_path())


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, text_sha256) in ``verdicts``."""
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_sha"))
    wanted = verdicts.select(F.col("doc_id").alias("_want"), F.col("text_sha256").alias("_want_sha"))
    met = keyed.join(wanted, F.col("_id").eqNullSafe(F.col("_want")) & (F.col("_sha") == F.col("_want_sha")), "left_semi")
    return met.dropDuplicates(["_id", "_sha"]).select("_row.*")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("BPE encoding", encode),
]

#: No SQL can express the classifier, the mix or the encoder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
