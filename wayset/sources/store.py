"""Tables that are written once and read many times, in the folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local run gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_wayset_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark._wayset_dir = "file://" + tempfile.mkdtemp(prefix="wayset-")
    return found


def at_exit_removed(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the driver's process ends."""
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM is gone already; nothing is left to tell
        pass


def _state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under ``path``: another text once any of them changes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(found))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    return at_exit_removed(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back: computed once, and lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def once(spark: SparkSession, name: str, inputs: list[str], write: Callable[[str], None]) -> str:
    """The path that ``write`` wrote to at the first call of this application.

    The folder's name holds the state of the input files, so changed inputs are computed anew.
    """
    state = hashlib.sha256("\n".join([name, *(_state(spark, i) for i in inputs)]).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{state}"
    if not exists(spark, f"{path}/_DONE"):  # readers pass over names that begin so
        write(at_exit_removed(spark, path))
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_DONE")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at).close()
    return path


def written_once(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written at the first call of this application and read back at all later ones."""
    return spark.read.parquet(once(spark, name, inputs, lambda path: make().write.mode("overwrite").parquet(path)))
