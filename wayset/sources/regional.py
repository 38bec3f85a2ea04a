"""Regional builds in folders, and the national roll-up kept true while single regions are built anew.

A segment that several regions hold belongs to the first of them. When a region changes, only segments that it held or
holds can have another owner or other values, so the roll-up takes off what those segments gave and adds what they
give now. It lies in buckets of sets; buckets without a changed set are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import seam_dedup
from .store import stored

LENGTH = "decimal(18,2)"
#: Folders of the roll-up. A set's folder never changes, so neither may this number for a table that exists.
BUCKETS = 64
#: Regions that one call may replace.
MOST_REGIONS = 1000
#: Files that a region's folder has at most, so that a large region is the work of several tasks.
SPREAD = 16


def _bucket():
    return F.pmod(F.xxhash64("refs"), F.lit(BUCKETS)).cast("int").alias("bucket")


def write_regional(segs: DataFrame, path: str) -> None:
    """One folder per region's build; the builds are united by reading them as one table."""
    segs.repartition("region", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).write.mode("overwrite").partitionBy("region").parquet(path)


def rolled_up(owned: DataFrame) -> DataFrame:
    """refs, km, arcs of the segments of a united build, with each set's ``bucket``."""
    return owned.groupBy("refs").agg(F.sum("km").cast(LENGTH).alias("km"), F.count("*").alias("arcs")).select("refs", "km", "arcs", _bucket())


def write_roll_up(spark: SparkSession, builds: str, path: str) -> None:
    """The roll-up of all regional builds, from nothing."""
    rolled_up(seam_dedup(spark.read.parquet(builds))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_roll_up(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("refs", F.size("refs").alias("n"), "km", "arcs")


def _delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """refs, km, arcs to add to the roll-up; sets that stay as they are, are left out."""
    sums = rolled_up(after).select("refs", "km", "arcs").unionByName(rolled_up(before).select("refs", (-F.col("km")).cast(LENGTH).alias("km"), (-F.col("arcs")).alias("arcs")))
    return sums.groupBy("refs").agg(F.sum("km").cast(LENGTH).alias("km"), F.sum("arcs").alias("arcs")).where("km <> 0 or arcs <> 0").select("refs", "km", "arcs", _bucket())


def replace_regions(spark: SparkSession, builds: str, roll_up: str, changed: DataFrame) -> None:
    """Put the regions in ``changed`` (segments with ``region``) in place of their old builds, and the roll-up right.

    Only their folders, and the buckets of sets whose sums change, are written; a region of which ``changed`` has no
    row keeps its build. All that is new is computed and written beside the tables first, the tables last; a run that
    ends between the two is put right by ``write_roll_up``.
    """
    old = spark.read.parquet(builds)
    new = stored(changed.select(*old.columns), "changed")
    names = [r["region"] for r in new.select("region").distinct().limit(MOST_REGIONS + 1).collect()]
    if None in names or len(names) > MOST_REGIONS:
        raise ValueError(f"up to {MOST_REGIONS} regions can be replaced at once, and each needs a name")
    replaced = old.where(F.col("region").isin(names))  # folders that the scan is left with
    touched = replaced.select("id").unionByName(new.select("id")).distinct()
    kept = old.where(~F.col("region").isin(names)).join(touched, "id", "left_semi").select(*old.columns)
    before = seam_dedup(kept.unionByName(replaced))
    after = seam_dedup(kept.unionByName(new))
    delta = stored(_delta(before, after), "delta")
    held = spark.read.parquet(roll_up).join(delta.select("bucket").distinct(), "bucket", "left_semi").select("refs", "km", "arcs", "bucket")
    summed = held.unionByName(delta).groupBy("refs", "bucket").agg(F.sum("km").cast(LENGTH).alias("km"), F.sum("arcs").alias("arcs"))
    fresh = stored(summed, "sums")
    emptied = fresh.groupBy("bucket").agg(F.max("arcs").alias("most")).where("most = 0").select("bucket").collect()  # BUCKETS rows at most
    overwrite = lambda df, by, path: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    overwrite(new.repartition("region", F.pmod(F.xxhash64("id"), F.lit(SPREAD))), "region", builds)
    overwrite(fresh.where("arcs > 0").repartition("bucket"), "bucket", roll_up)
    for row in emptied:  # no row is left to overwrite these with
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{roll_up}/bucket={row['bucket']}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
