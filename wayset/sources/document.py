"""The display document as a folder: a head, and each nested relation as JSON lines in display order.

A build writes its relations under a version of its own and the head last, so a reader sees the old document or the
new one and never a half-written one. No task holds a relation; a reader of one relation reads no other.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinal import ranked
from .store import stored

_BOX = "struct<w:double,s:double,e:double,n:double>"
HEAD = f"osm_timestamp timestamp, oldest_edit date, newest_edit date, endpoints array<string>, bbox {_BOX}"
#: Relations and their columns; ``pos`` is the place in the document.
RELATIONS = {
    "combinations": f"pos long, refs array<int>, n int, km double, arcs bigint, bbox {_BOX}",
    "names": "pos long, name string",
    "termini": "pos long, ref int, lon double, lat double",
    "shared_termini": "pos long, refs array<int>, lon double, lat double",
}


@dataclass(frozen=True)
class Document:
    """``head`` has one row: dates, extent, endpoints, and how many rows each relation has."""

    head: DataFrame
    path: str
    version: str

    def relation(self, name: str) -> DataFrame:
        return self.head.sparkSession.read.schema(RELATIONS[name]).option("mode", "FAILFAST").json(f"{self.path}/{self.version}/{name}")


def box(w: str | Column, s: str | Column, e: str | Column, t: str | Column) -> Column:
    return F.struct(*((F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for c, n in ((w, "w"), (s, "s"), (e, "e"), (t, "n")))).alias("bbox")


def placed_combinations(combos: DataFrame, segs: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Combinations (refs, n, km, arcs, bbox) with their places in ``order``, and (pos, name) of each one's names.

    Names are rows: a set has as many as it has named segments. Null and empty names are none.
    """
    placed = stored(ranked(combos, *order), "combinations")
    named = segs.where("name <> ''").select("refs", "name").distinct()
    return placed, named.join(placed.select("refs", "pos"), "refs").select("pos", "name")


def write_document(path: str, head: DataFrame, relations: dict[str, DataFrame]) -> None:
    """``head`` is one row in the columns of HEAD; relations are in the columns of RELATIONS, in any order of rows."""
    version = f"v-{uuid.uuid4().hex}"
    counts = []
    for name, rows in relations.items():
        columns = [c.split()[0] for c in RELATIONS[name].replace(_BOX, "box").replace("array<int>", "ints").split(", ")]
        rows.select(*columns).write.json(f"{path}/{version}/{name}")
        found = head.sparkSession.read.schema("pos long").json(f"{path}/{version}/{name}")
        counts.append(F.lit(found.count()).cast("long").alias(name))
    head.select("osm_timestamp", "oldest_edit", "newest_edit", "endpoints", "bbox", F.lit(version).alias("version"), F.struct(*counts).alias("rows")).coalesce(1).write.mode("overwrite").json(f"{path}/head")


def read_document(spark: SparkSession, path: str) -> Document:
    """The document's last whole version. A field that is not as it should be, or no head, is an error."""
    rows = ", ".join(f"{name}:bigint" for name in RELATIONS)
    head = spark.read.schema(f"{HEAD}, version string, rows struct<{rows}>").option("mode", "FAILFAST").json(f"{path}/head")
    found = head.select("version").first()
    if found is None or found["version"] is None:
        raise ValueError(f"no document in {path}")
    return Document(head, path, found["version"])
