"""Whole texts of files in a folder, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_texts(texts: DataFrame, folder: str) -> None:
    """One file per row of ``texts`` (name, text), in a folder ``name=...`` of its own. Names are unique and not null."""
    texts.select("name", "text").repartition("name").write.mode("overwrite").partitionBy("name").text(folder)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of every file that ``write_texts`` wrote. A file is one row however many lines it has; files are
    read by as many tasks as their sizes ask for."""
    found = spark.read.schema("value string, name string").text(folder, wholetext=True)
    return found.select("name", F.regexp_replace("value", r"\n\z", "").alias("text"))


def read_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, text of every file below ``folder`` whose name fits the pattern."""
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
