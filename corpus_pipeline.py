"""A corpus pipeline of five stages over `documents`.

STAGES: language identification (texts without a letter go), n-gram Jaccard join (one document of each group of near copies
stays: five-word shingles, similarity of 0.8 or more), substring dedup, mixing to target weights, and SentencePiece
encoding with a check that decoding gives the text back. All but the last return the columns of documents; other columns
of a table, whatever their names, come through all stages. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import common, jaccard, langid, mixture, pieces, repeats

NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter; lang becomes the predicted language. Null and empty texts go; rows equal in text
    get the same language; the label of a document with none is learned from the others, and without any label all go."""
    model = langid.fit(langid.sample(docs.filter(common.row_bucket("doc_id", 5) != 0)))
    found = langid.identify(docs, model)
    predicted = found.columns[-2]
    return found.filter(F.col(predicted) != "und").withColumn("lang", F.col(predicted)).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id (null ids last; of equal ids the smallest text hash; of
    rows equal in both the least hash of the row). Texts without words are no copies of each other, except equal rows."""
    return jaccard.keep_first(docs, width=NEAR_SHINGLE, percent=NEAR_PERCENT)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has too; those left without words go. Texts that
    lose nothing stay byte for byte; n_chars is counted anew."""
    found = repeats.remove(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return found.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents chosen for the target weights, once an epoch; the last of a leaf may be cut after a token."""
    return mixture.select(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents, piece_ids, piece_score and whether decoding gave the text back (columns of these names
    in documents stay, the new ones' names then end in underscores). A null text has null ids and decodes to null."""
    return pieces.encode(docs, pieces.load(), check="round_trip")


STAGES = [
    ("language_id", identify_languages),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mixture", mix),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet in the shared folder and read again by the next. The folder
    of a stage goes when the next has been written; that of the last stays, since the result reads it."""
    docs, folder, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            common.delete(spark, last)
        last = path
    return docs
