"""Periodic runs of words, found by comparing each document's word ids with themselves at every lag.

A run with smallest period q is a stretch of words that equal the word q places on, q words longer than the stretch of
equal comparisons. All lags up to n / EXPONENT are compared, shortest first, so that of several lags that give the
same stretch the first is its smallest period. A lag is first compared at every (m // 2)-th word, where m is the
shortest stretch of equal words that makes a run: such a stretch holds two neighbours of these. Where they are equal
the document is compared word by word at this lag, and the stretches are run-length encoded.

The unit of work is a document and a range of lags. Lags of a short document are one range, which needs no shuffle and
is compared together with those of the other documents of a chunk. A long document's lags are ranges of about WORK
comparisons, which are dealt to all machines with the word ids; what they find is reduced to the smallest lag of each
stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD, crc32_sql, documents, fresh, in_chunks, let, partitions

LEAST = 24
EXPONENT = 3
#: Bytes of a text whose lags are dealt out in ranges.
LONG = 1 << 16
#: Comparisons of a range of lags at most, if every one of its lags is compared word by word.
WORK = 1 << 31
#: Words that are compared together.
CHUNK = 1 << 18

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Ids of the words of texts, end to end; no two texts have an id in common. Their counts, and the words."""
    ids, counts, words = [], [], []
    for text in texts:
        own, known = text.split(), {}  # splits at the six ASCII spaces that end a word
        base = len(ids)
        ids += [base + known.setdefault(w, len(known)) for w in own]
        counts.append(len(own))
        words.append(own)
    return np.array(ids, np.int32), np.array(counts, np.int64), words


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``least`` or more true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]])))
    starts, ends = edge[0::2], edge[1::2]
    fit = ends - starts >= least
    return starts[fit], ends[fit]


def scan(ids: np.ndarray, counts: np.ndarray, low: int = 1, high: int | None = None) -> dict[tuple[int, int, int], int]:
    """(document, start, end) of the runs at lags from ``low`` to below ``high``, with the smallest such lag.

    ``ids`` are word ids of documents with ``counts`` words, longest first, without a common id.
    """
    found: dict[tuple[int, int, int], int] = {}
    ends = np.cumsum(counts)
    starts = ends - counts
    longest = int(counts[0]) if len(counts) else 0
    for lag in range(low, min(high or longest, longest // EXPONENT + 1)):
        held = int(np.searchsorted(-counts, -max(LEAST, EXPONENT * lag), side="right"))
        if not held:
            break
        least = max(LEAST - lag, (EXPONENT - 1) * lag)
        step, total = least // 2, int(ends[held - 1])
        probed = ids[: total - lag : step] == ids[lag:total:step]
        hit = np.flatnonzero(probed[:-1] & probed[1:]) * step
        for k in np.unique(np.searchsorted(ends, hit, side="right")).tolist():
            own = ids[starts[k] : ends[k]]
            for a, b in zip(*(x.tolist() for x in stretches(own[:-lag] == own[lag:], least)), strict=True):
                found.setdefault((k, a, b + lag), lag)
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run (start, length, period) repeats."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words) if keep.all() else b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lags of short documents, those of a chunk together."""
    fresh()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in in_chunks([len(t) // 4 + 16 for t in texts], CHUNK):
            ids, counts, words = word_ids(texts[part])
            order = np.argsort(-counts, kind="stable")
            bounds = np.cumsum(counts)
            sorted_ids = np.concatenate([ids[bounds[k] - counts[k] : bounds[k]] for k in order.tolist()])
            runs: list[list] = [[] for _ in words]
            for (k, a, b), lag in scan(sorted_ids, counts[order]).items():
                runs[order[k]].append((a, b - a, lag))
            for r in runs:
                r.sort(key=lambda x: (x[0], x[2]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id")[part.start : part.stop], pa.array(counts), pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs], _RUNS),
                pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()),
            ], ["doc_id", "n_words", "runs", "collapsed"])


def _ranges(work: int):
    """The word ids of long documents, once for each of their ranges of lags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                ids, counts, _ = word_ids([text.as_py()])
                n = int(counts[0])
                step = max(1, work // max(n, 1))
                for low in range(1, n // EXPONENT + 1, step):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([low], pa.int64()), pa.array([low + step], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["key", "low", "high", "ids"])

    return run


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh()
    for batch in batches:
        for key, low, high, packed in zip(*(batch.column(c) for c in ("key", "low", "high", "ids")), strict=True):
            ids = np.frombuffer(packed.as_buffer(), np.int32)
            found = scan(ids, np.array([len(ids)]), low.as_py(), high.as_py())
            rows = [(a, b - a, lag) for (_, a, b), lag in found.items()]
            columns = [pa.array([key.as_py()] * len(rows), pa.binary())] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "start", "length", "period"])


def _with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh()
    for batch in batches:
        for k, text in enumerate(batch.column("text")):
            words, runs = text.as_py().split(), batch.column("runs")[k].as_py() or []
            kept = collapsed(words, [(r["start"], r["length"], r["period"]) for r in runs])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[k : k + 1], pa.array([len(words)], pa.int64()), pa.array([runs], _RUNS), pa.array([kept], pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, long_bytes: int = LONG, work: int = WORK) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without its repetitions.

    A run is a stretch of words with smallest period q and at least max(LEAST, EXPONENT * q) words that no neighbour
    extends; ``collapsed`` has the words that no run holds after its first q, joined by one space. A null text is
    empty: no words, no runs. Null ids pass through, equal rows give equal rows, an empty table gives none. Only
    doc_id and text are read, so other columns' names don't matter.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    short = rows.where(F.octet_length("text") <= long_bytes).mapInArrow(_whole, FOUND)
    long = rows.where(F.octet_length("text") > long_bytes).withColumn("key", F.unhex(F.sha2("text", 256)))
    dealt = long.select("key", "text").mapInArrow(_ranges(work), "key binary, low long, high long, ids binary").repartition(partitions(docs.sparkSession), "key", "low")
    least = dealt.mapInArrow(_scan_ranges, "key binary, start long, length long, period long").groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    by_start = F.array_sort(F.collect_list(F.struct("start", "period", "length")))  # of one text: fewer than its words
    runs = least.groupBy("key").agg(F.transform(by_start, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    met = long.join(runs, "key", "left").select("doc_id", "text", "runs")
    return short.unionByName(met.mapInArrow(_with_runs, FOUND)).withColumn("collapsed", F.col("collapsed").cast("string"))


def rewritten(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, told by crc32 of the id, repeats a part of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")

        def joined(x: Column) -> Column:
            part = F.slice(words, (x["a"] + 1).cast("int"), x["p"].cast("int"))
            again = F.transform(F.sequence(F.lit(0).cast("long"), n - x["a"] - 1), lambda i: F.get(part, (i % x["p"]).cast("int")))
            return F.array_join(F.concat(F.slice(words, F.lit(1), x["a"].cast("int")), again), " ")

        place = F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))
        return F.when(n > 0, let(place, joined)).otherwise("")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0)
    return docs.select("doc_id", F.when(F.coalesce(h % 10 == 0, F.lit(False)), let(words, repeated)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The columns by which a table of runs is compared: their number, the strongest run, and two hashes."""
    better = lambda a, r: (r["length"] * a["period"] > a["length"] * r["period"]) | ((r["length"] * a["period"] == a["length"] * r["period"]) & ((r["start"] < a["start"]) | ((r["start"] == a["start"]) & (r["period"] < a["period"]))))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(better(a, r), r).otherwise(a)).alias("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    picked = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    return picked.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op12_periodic_runs(spark, sf_dir):
    return digest(periodic_runs(rewritten(documents(spark, sf_dir))))


def oracle(table: str = "documents") -> str:
    """Pairs of equal words of a document at every lag, and their islands. Ids must be unique and not null."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, {crc32_sql('doc_id')} AS h FROM {table}),
x AS (SELECT doc_id, words, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS again FROM d),
y AS (SELECT *, CASE WHEN again THEN g % n END AS a, CASE WHEN again THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM x),
w AS (SELECT doc_id, n, i, CASE WHEN again AND i >= a THEN words[1 + a + (i - a) % p] ELSE words[1 + i] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM y)),
pairs AS (SELECT l.doc_id, l.i, r.i - l.i AS lag FROM w l JOIN w r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i WHERE 3 * (r.i - l.i) <= l.n),
islands AS (SELECT doc_id, lag, min(i) AS start, count(*) + lag AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM pairs) GROUP BY doc_id, lag, island),
runs AS (SELECT doc_id, start, length, min(lag) AS period FROM islands WHERE length >= greatest(24, 3 * lag) GROUP BY 1, 2, 3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 12) / period DESC, start, period) AS k FROM runs) WHERE k = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS t FROM w LEFT JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i WHERE d.i IS NULL GROUP BY 1)
SELECT y.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM y LEFT JOIN best ON best.doc_id = y.doc_id LEFT JOIN lines ON lines.doc_id = y.doc_id LEFT JOIN kept ON kept.doc_id = y.doc_id"""
