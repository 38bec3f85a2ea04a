"""Places of rows in a total order, stored, so that a prefix is a range of numbers and not a sort."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import stored

#: Bits of a row's number in its task in ``monotonically_increasing_id``.
_WITHIN = 33
#: Bytes of a row group, about: a prefix reads one.
GROUP_BYTES = 1 << 20


def ranked(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` with ``pos``, each row's place (from 0) in the order of ``keys``, which should be total.

    Rows are dealt by ranges of the keys and sorted in each task; a task's first place is the number of rows in the
    tasks before it. That is one number for each task, gathered by the driver; no task sees more than its range.
    Rows with equal keys get different places in any order, which is fixed once they are written. An empty table stays
    empty.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    dealt = stored(dealt, "ranges")
    task = F.call_function("shiftright", F.col("__at"), F.lit(_WITHIN))
    counts = sorted(dealt.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())  # a row for each task
    starts = dict(zip((r["task"] for r in counts), accumulate((r["n"] for r in counts), initial=0), strict=False))
    first = F.broadcast(spark.createDataFrame(list(starts.items()), "__task long, __first long"))  # likewise
    placed = dealt.withColumn("__task", task).join(first, "__task")
    return placed.withColumn("pos", F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << _WITHIN) - 1))).drop("__at", "__task", "__first")


def write_ranked(df: DataFrame, path: str, *keys: str | Column) -> None:
    """``ranked`` rows as a table whose files and row groups hold stretches of places."""
    ranked(df, *keys).sortWithinPartitions("pos").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(path)


def prefix(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The first ``rows`` rows of a table that ``write_ranked`` wrote: a pushed comparison, no sort of the table."""
    return spark.read.parquet(path).where(F.col("pos") < rows).orderBy("pos")


def before(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with ``prev_<column>`` of the row one place before them: a join of places, not a window over all rows."""
    last = df.select((F.col("pos") + 1).alias("pos"), *(F.col(c).alias(f"prev_{c}") for c in columns))
    return df.join(last, "pos", "left")


def followed(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Rows with ``prev_<column>`` of the row before them in the order of ``keys``, which should be total; null for the first.

    Rows move once: they are dealt by ranges and sorted, each task carries the last row along, and only the last rows of
    the tasks (one each) reach the driver, which hands each to the first row of the next task.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("__task", F.spark_partition_id())
    kinds = dict(df.dtypes)
    earlier = [f"prev_{c}" for c in columns]

    def carried(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            given = pa.Table.from_batches([batch])
            one = given.slice(0, 1).select(list(columns))
            before = last if last is not None else pa.table([pa.nulls(1, one.schema.field(c).type) for c in columns], schema=one.schema)
            shifted = pa.concat_tables([before, given.slice(0, batch.num_rows - 1).select(list(columns))])
            head = pa.array([last is None] + [False] * (batch.num_rows - 1))
            last = given.slice(batch.num_rows - 1, 1).select(list(columns))
            for name, c in zip(earlier, columns, strict=True):
                given = given.append_column(name, shifted.column(c))
            yield from given.append_column("__head", head).append_column("__tail", pa.array([False] * batch.num_rows)).combine_chunks().to_batches()
        if last is not None:  # the task's last row once more, for the next task
            extra = given.slice(given.num_rows - 1, 1)
            yield from extra.append_column("__head", pa.array([False])).append_column("__tail", pa.array([True])).combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in df.columns) + ", __task int, " + ", ".join(f"`{e}` {kinds[c]}" for e, c in zip(earlier, columns, strict=True)) + ", __head boolean, __tail boolean"
    held = stored(dealt.mapInArrow(carried, schema), "followed")
    tails = sorted(held.where("__tail").select("__task", *columns).collect(), key=lambda r: r["__task"])  # a row for each task
    rows = held.where("not __tail").select(*df.columns, *earlier, "__task", "__head")
    handed = spark.createDataFrame([(after["__task"], *tuple(tail)[1:]) for tail, after in zip(tails, tails[1:], strict=False)], "__task int, " + ", ".join(f"`__{c}` {kinds[c]}" for c in columns))
    both = rows.join(F.broadcast(handed), "__task", "left")  # likewise
    return both.select(*df.columns, *(F.when(F.col("__head"), F.col(f"__{c}")).otherwise(F.col(e)).alias(e) for c, e in zip(columns, earlier, strict=True)))
