"""What the query modules share: the two dictionaries, the decorator that fills them, and common SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.segments import segments_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = sql
        return function

    return add


joined = lambda c: F.array_join(c, ",").alias("refs")
km = lambda: F.col("km").cast("double").alias("km")
LIST, NATIONS = "array_to_string(refs, ',') AS refs", segments_sql("nation")
REGIONS = segments_sql("region")
COMBOS = "combos AS (SELECT refs, max(n) AS n, sum(km)::DECIMAL(18,2) AS km, count(*) AS arcs, list_sort(list_distinct(list(nullif(name, '')))) AS names, min(w) AS w, min(s) AS s, max(e) AS e, max(t) AS t FROM seg GROUP BY refs)"
REGION_COMBOS, NATION_COMBOS = f"{REGIONS}, {COMBOS}\n", f"{NATIONS}, {COMBOS}\n"


def rows(spark, schema: str, *values):
    return spark.createDataFrame(list(values), schema)
