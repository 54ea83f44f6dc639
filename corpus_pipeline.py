"""From documents to packed training sequences: quality, exact and near copies, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import exact_dedup, mixing, packing, quality, shingle_dedup, simhash
from wordloom.llm.common import scope, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, fitted on the labelled ones among them, rejects.

    Null and empty texts score as a text without features; rows that repeat an id and a text stay or go together; an
    empty table gives none. Columns are as they were.
    """
    return quality.drop_poor(docs, quality.fit_on_documents(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, keeps the one of the largest doc_id.

    Null texts are copies of empty ones; a null id loses against any other; of rows that repeat an id and a text one
    stays; an empty table gives none. Columns are as they were.
    """
    return exact_dedup.drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest doc_id.

    First by SimHash, then, as 3 differing bits stand for a similarity of about 0.97, by five-word shingles of a
    similarity of 0.8 or more. Texts without words are copies of each other; a null id loses against any other; of rows
    that repeat an id one stays; an empty table gives none. Columns are as they were.
    """
    first = written(simhash.leading_ids(simhash.near_dedup(docs)))
    return shingle_dedup.drop_near_copies(docs, among=first)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often, in whole times, as the mix by source weights does, in the order of its schedule.

    Texts without words (null ones too) are never taken; a null source is one source; rows that repeat an id are taken
    alike; an empty table gives none. Columns are as they were.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; a row per piece.

    A null or empty text is its end token alone; repeated rows are packed once each; an empty table gives none.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted classifier, fingerprints and a tokenizer are beyond SQL: tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage wrote on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scope():
            found = stage(spark, docs, sf_dir)
            docs = written(found, lasting=True)
    return docs
