"""Relations of the set-valued model, derived from the order tables.

A *segment* is one order: the complete set of designations (regions or nations of its suppliers) over it, its length,
kind, evidence, last edit and extent. Sets are sorted arrays without repeats, so they can be grouped by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import sums_by_set
from ..operators.spatial import World, write_tiles
from .store import once, written_once

#: Fixture values and the kinds and evidence they stand for; the last priority stands for an unknown kind.
KIND_OF = {"1-URGENT": "expressway", "2-HIGH": "construction", "3-MEDIUM": "road", "4-NOT SPECIFIED": "ferry"}
SOURCE_OF = {"F": "relation", "O": "name", "P": "tag"}
LENGTH = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Suppliers that are sent to all tasks, some 50 MB of hash table; more are joined by a shuffle of the line items.
SENT_ROWS = 1_000_000


def designated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with both designations of their supplier: ``region`` and ``nation``.

    Spark takes the size of suppliers with nations for the product of both, so their number decides whether they are
    sent to the line items: these need not move then, and an order's lines still lie together when they are summed.
    """
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    few = suppliers.count() <= SENT_ROWS
    places = suppliers.join(F.broadcast(nations) if few else nations, F.col("s_nationkey") == F.col("n_nationkey"))
    places = places.select("s_suppkey", F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    return table(spark, sf_dir, "lineitem").join(F.broadcast(places) if few else places, F.col("l_suppkey") == F.col("s_suppkey"))


#: Tables that segments are derived from.
INPUTS = ("lineitem", "supplier", "nation", "orders")


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    return written_once(spark, name, [f"{sf_dir}/{t}.parquet" for t in INPUTS], make)


def segments(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    """``derived`` segments, written once for both designations; ``by`` is 'region' or 'nation'."""
    both = _once(spark, sf_dir, "segments", lambda: derived(spark, sf_dir))
    refs = F.col(f"{by}s")
    return both.select("id", refs.alias("refs"), F.size(refs).alias("n"), "km", "updated", "kind", "src", "former", "name", "w", "s", "e", "t")


def sums(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    """The roll-up by set that every sum is answered from, written once."""
    return _once(spark, sf_dir, f"sums-{by}", lambda: sums_by_set(segments(spark, sf_dir, by)))


#: The box that tiles of segments halve: powers of two on either axis, so that shares of it are exact.
WORLD = World(0.0, 0.0, 64.0, 0.125)


def tiles(spark: SparkSession, sf_dir: str, by: str = "nation") -> str:
    """The path of the segments' tiles, written once in Z-order."""
    return once(spark, f"tiles-{by}", [f"{sf_dir}/{t}.parquet" for t in INPUTS], lambda path: write_tiles(segments(spark, sf_dir, by), path, WORLD))


def names(spark: SparkSession, sf_dir: str, by: str = "nation") -> DataFrame:
    """set_key, refs, name of every named segment's set, once each, written once in buckets of sets.

    A join or roll-up by ``set_key`` reads a bucket per task, and nothing stored is shuffled.
    """
    path = once(spark, f"names-{by}", [f"{sf_dir}/{t}.parquet" for t in INPUTS], lambda path: write_names(segments(spark, sf_dir, by), path))
    return read_names(spark, path)


def members(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    """``bridge`` rows, written once: a membership filter is an equality on ``ref`` that reaches the scan."""
    return _once(spark, sf_dir, f"bridge-{by}", lambda: bridge(segments(spark, sf_dir, by)))


#: Designations that one number holds as bits.
_BITS = 63


def _set_of(ref: str, largest: int) -> tuple[list[Column], Column]:
    """Aggregates of a set of numbers from 0 to ``largest`` as bits, and the sorted array that they stand for.

    Bits are merged in hash maps, where a set of numbers would be an object and sorted by its key first.
    """
    words = range(largest // _BITS + 1)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(ref) - k * _BITS).cast("int"))
    merged = [F.bit_or(F.when(F.col(ref).between(k * _BITS, k * _BITS + _BITS - 1), bit(k))).alias(f"__{ref}{k}") for k in words]

    def held(k: int) -> Column:
        least, most = k * _BITS, min(k * _BITS + _BITS - 1, largest)
        there = lambda x: F.call_function("shiftright", F.coalesce(F.col(f"__{ref}{k}"), F.lit(0).cast("long")), x - least).bitwiseAND(F.lit(1)) == 1
        return F.filter(F.sequence(F.lit(least), F.lit(most)), there)

    return merged, F.concat(*map(held, words)).alias(f"{ref}s")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, regions, nations, km, updated, kind, src, former, name, w, s, e, t. One shuffle gathers an order's lines."""
    top = table(spark, sf_dir, "nation").agg(F.max("n_regionkey"), F.max("n_nationkey")).first()
    (region_bits, regions), (nation_bits, nations) = _set_of("region", top[0] or 0), _set_of("nation", top[1] or 0)
    lines = designated(spark, sf_dir).groupBy(F.col("l_orderkey").alias("id")).agg(
        *region_bits, *nation_bits, F.sum(F.col("l_extendedprice").cast(LENGTH)).cast(LENGTH).alias("km"), F.max("l_shipdate").cast("date").alias("updated"),
        F.min("l_quantity").alias("w"), F.min("l_discount").alias("s"), F.max("l_quantity").alias("e"), F.max("l_discount").alias("t"),
    )
    pick = lambda c, names: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in names.items()))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick("o_orderpriority", KIND_OF).alias("kind"), pick("o_orderstatus", SOURCE_OF).alias("src"))
    named = F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("way "), F.col("id")))
    return lines.join(orders, "id").select("id", regions, nations, "km", "updated", "kind", "src", (F.col("id") % 97 == 0).alias("former"), named.alias("name"), "w", "s", "e", "t")


def segments_sql(by: str = "region") -> str:
    """The same relation for DuckDB, as the head of a statement that reads ``seg``."""
    ref = "n_regionkey" if by == "region" else "n_nationkey"
    case = lambda c, names: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
    return f"""WITH lines AS (SELECT l_orderkey AS id, list_sort(list_distinct(list({ref}::INTEGER))) AS refs, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(18,2) AS km,
  max(l_shipdate)::DATE AS updated, min(l_quantity) AS w, min(l_discount) AS s, max(l_quantity) AS e, max(l_discount) AS t
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
seg AS (SELECT id, refs, len(refs)::INTEGER AS n, km, updated, {case("o_orderpriority", KIND_OF)} AS kind, {case("o_orderstatus", SOURCE_OF)} AS src,
  id % 97 = 0 AS former, CASE WHEN id % 5 = 0 THEN '' ELSE 'way ' || id END AS name, w, s, e, t FROM lines JOIN orders ON o_orderkey = id)
"""


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref (event type), place: first and last hour of each user's events of a type, as chain ends."""
    ends = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select(F.col("event_type").alias("ref"), F.explode(F.array("a", "b")).alias("ts")).select("ref", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("place"))


ENDPOINTS_SQL = """WITH ends AS (SELECT user_id, event_type AS ref, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2),
points AS (SELECT ref, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS place FROM (SELECT ref, unnest([a, b]) AS ts FROM ends))
"""


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One build document: combinations, single and shared ends, and its dates; other fields are an error."""
    box = "struct<w:double,s:double,e:double,n:double>"
    schema = f"osm_timestamp timestamp, oldest_edit date, newest_edit date, endpoints array<string>, bbox {box}, combinations array<struct<refs:array<int>,n:int,km:double,arcs:bigint,names:array<string>,bbox:{box}>>, termini array<struct<ref:int,lon:double,lat:double>>, shared_termini array<struct<refs:array<int>,lon:double,lat:double>>"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """The region index; an empty one is an error."""
    found = spark.read.schema("region string, bbox struct<w:double,s:double,e:double,n:double>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    if found.isEmpty():
        raise ValueError(f"no region in {path}")
    return found


def relation(meta: DataFrame, name: str) -> DataFrame:
    """One of the document's nested relations as rows, in the document's order (``pos``)."""
    return meta.select(F.posexplode(name)).select("pos", "col.*")


def bridge(segs: DataFrame) -> DataFrame:
    """One row per member of each segment, sorted by ref in each file, with what filters show of a segment.

    Nothing is shuffled: every file holds all refs in order, so an equality reads one stretch of each.
    """
    return segs.select(F.explode("refs").alias("ref"), "id", "refs", "n", "kind").sortWithinPartitions("ref", "id")


def set_key() -> Column:
    return F.xxhash64("refs").alias("set_key")


def _table_name(path: str) -> str:
    return "names_" + "".join(c if c.isalnum() else "_" for c in path.rstrip("/").rpartition("/")[2])


def write_names(segs: DataFrame, path: str) -> None:
    """Distinct (set, name) pairs as a table at ``path`` in as many buckets of sets as shuffles have partitions.

    Null and empty names are none.
    """
    buckets = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = segs.where("name <> ''").select(set_key(), "refs", "name").distinct()
    dealt = pairs.repartition(buckets, "set_key")
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "set_key").sortBy("set_key").option("path", path).saveAsTable(_table_name(path))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(_table_name(path))


def write_bridge(segs: DataFrame, path: str) -> None:
    """The bridge as a table: a membership filter becomes a pushed equality and reads few row groups."""
    bridge(segs).write.mode("overwrite").parquet(path)


def write_regions(boxes: DataFrame, path: str) -> None:
    """region, w, s, e, t as the region index that ``read_regions`` reads: one JSON list of some dozens of regions."""
    each = F.struct("region", F.struct("w", "s", "e", F.col("t").alias("n")).alias("bbox"))
    boxes.agg(F.to_json(F.array_sort(F.collect_list(each)))).write.mode("overwrite").text(path)


def features(ends: DataFrame) -> DataFrame:
    """Ends (refs, lon, lat, shared) as one GeoJSON feature a row, with ``shared`` to put shared ones first."""
    refs = F.transform("refs", lambda r: r.cast("string"))
    properties = F.struct(F.concat(F.lit(","), F.array_join(refs, ","), F.lit(",")).alias("refs"), F.array_join(refs, "・").alias("label"), "shared", F.size("refs").alias("count"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return ends.select("shared", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))
