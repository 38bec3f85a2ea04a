"""A corpus pipeline of five stages, each one of the corpus operators.

A stage takes (spark, docs, sf_dir) and returns documents in the columns of ``documents`` (the last: packed pieces).
Every stage works on all rows that its predecessor kept; results are written and read again between stages.
Repeated rows stay or go together; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayset.llm import language_id, mixing, near_dedup, packing, suffix_dedup
from wayset.llm._shared import documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told: those without any letter, so also null and empty texts.

    All others stay, whatever was learned and whatever their id, lang or source is; repeated rows stay or go together,
    ties between languages change nothing, an empty table gives none.
    """
    found = language_id.predict(docs, language_id.train(docs), COLUMNS)
    return found.where("has_letter").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Rows with a null id or without words are never linked and stay; rows that share the smallest id all stay. An empty
    table gives none.
    """
    gone = near_dedup.link_documents(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes that an earlier document has in a 50-byte string; no row is dropped.

    Null texts become empty ones; rows with a null id stay whole; rows that share an id don't remove from each other.
    An empty table gives none.
    """
    found = suffix_dedup.remove_repeats(docs, carry=["lang", "source"], with_text=True)
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; a document may go or come several times.

    A null source is one of its own, an empty text has size 0 and may come, equal rows come equally often, a null id
    draws like any other. An empty table gives none.
    """
    return mixing.mixed_documents(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; each copy of a document is packed.

    An empty text is its end id alone; null ids pass through; which of equal pieces gets which place is decided by
    their order and may be exchanged between them. An empty table gives none.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Prototypes, sketches, suffix sorting and token ids have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
