"""Packing token sequences into fixed windows by non-negative least squares.

Documents are cut into full windows and one rest. Rests are classed by length (in units of a few tokens, rounded up),
and the histogram of classes is all that the driver sees: it enumerates combinations of up to three classes that fill
a window exactly, solves non-negative least squares for how often to repeat each, rounds, and packs what is left
greedily. Pieces then take their places by their rank in their class, in parallel.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, documents, fresh, partitions
from ._tokens import crc, default_tokenizer, encoder, text_chunks

WINDOW = 2048
END_ID = 1
#: Tokens in one unit of length; 256 classes fill a window.
UNIT = 8
DEPTH = 3


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of up to ``depth`` (at most 3) classes, largest first, that add up to ``units``."""
    found: list[tuple[int, ...]] = [(units,)]
    if depth >= 2:
        found += [(a, units - a) for a in range(units - 1, (units - 1) // 2, -1) if a >= units - a]
    if depth >= 3:
        found += [(a, b, units - a - b) for a in range(units - 2, 0, -1) for b in range(min(a, units - a - 1), 0, -1) if b >= units - a - b]
    return found


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int | None = None, tolerance: float = 1e-9) -> np.ndarray:
    """Least squares over x >= 0 by the active-set method: grow the passive set by the steepest column, step back to
    feasibility whenever a coefficient would turn negative."""
    n = columns.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    gram_of = lambda p: columns[:, p].T @ columns[:, p] + 1e-10 * np.eye(int(p.sum()))
    for _ in range(rounds or 3 * len(target)):
        slope = columns.T @ (target - columns @ x)
        slope[passive] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        passive[best] = True
        while True:
            trial = np.zeros(n)
            trial[passive] = np.linalg.solve(gram_of(passive), columns[:, passive].T @ target)
            low = passive & (trial <= 0)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x += step * (trial - x)
            passive &= x > tolerance * max(1.0, x.max())
            x[~passive] = 0
    return x


def plan_patterns(histogram: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(classes of a window, how many such windows) for a histogram {class: pieces}; every piece gets a place.

    Bounded by the number of classes, whatever the counts.
    """
    left = np.zeros(units + 1, dtype=np.int64)
    for k, n in histogram.items():
        left[k] = n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], most: int | None = None) -> None:
        need = Counter(pattern)
        n = min(int(left[c]) // m for c, m in need.items())
        n = n if most is None else min(n, most)
        if n > 0:
            for c, m in need.items():
                left[c] -= n * m
            patterns.append((pattern, n))

    take((units,))
    present = {c for c in range(1, units) if left[c]}
    usable = [p for p in combinations(units, depth) if len(p) > 1 and present.issuperset(p)]
    if usable:
        matrix = np.zeros((units, len(usable)))
        for j, p in enumerate(usable):
            for c in p:
                matrix[c, j] += 1
        scale = left.sum()
        for j in np.argsort(-(x := nnls(matrix, left[:units] / scale)), kind="stable"):
            if x[j] <= 0:
                break
            take(usable[j], int(round(x[j] * scale)))
    while left.any():
        room, pattern, after = units, [], left.copy()
        while len(fit := np.flatnonzero(after[1 : room + 1])):
            c = int(fit[-1]) + 1
            n = min(int(after[c]), room // c)
            pattern += [c] * n
            after[c] -= n
            room -= n * c
            if not room:
                break
        take(tuple(pattern))
    return patterns


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each class: the ranks at which its runs begin, with each run's first sequence, first slot and slots."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, n in patterns:
        slot = 0
        for c, m in sorted(Counter(pattern).items(), reverse=True):
            found.setdefault(c, []).append((used[c], sequence, slot, m))
            used[c] += n * m
            slot += m
        sequence += n
    return {c: dict(zip(("rank", "sequence", "slot", "many"), np.array(rows, dtype=np.int64).T, strict=True)) for c, rows in found.items()}


def _cutter(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        enc = encoder(path)
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text")
            for part in text_chunks(texts):
                flat, counts = enc.encode(texts[part])
                flat = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                pieces = -(-counts // window)
                row = np.repeat(np.arange(len(counts)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, counts[row] - start)
                at = np.repeat(np.cumsum(counts) - counts, pieces) + start
                crcs = np.fromiter((crc(flat[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(at))
                yield pa.RecordBatch.from_arrays([names[part].take(pa.array(row)), *map(pa.array, (start, length, crcs, counts[row]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _placer(table: dict[int, dict[str, np.ndarray]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh()
        for batch in batches:
            sequence, slot = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            classes, ranks = batch["__class"].to_numpy(), batch["__rank"].to_numpy()
            for c in np.unique(classes):
                mine, runs = np.flatnonzero(classes == c), table[int(c)]
                k = np.searchsorted(runs["rank"], ranks[mine], side="right") - 1
                off = ranks[mine] - runs["rank"][k]
                sequence[mine] = runs["sequence"][k] + off // runs["many"][k]
                slot[mine] = runs["slot"][k] + off % runs["many"][k]
            yield batch.drop(columns=["__class", "__rank"]).assign(sequence_id=sequence, slot=slot)

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, unit: int = UNIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    Every whole text is encoded and ended with ``end_id``; a null text is empty and so one token. Null ids pass
    through, equal rows are packed once each, an empty table gives none; only doc_id and text are read. A sequence
    holds at most ``window`` tokens and is padded to ``window`` unless its length is a power of two. Pieces of one
    class are ranked in hashed shards, so a class that holds most pieces is spread over all tasks; places come from
    a table bounded by the number of classes.
    """
    units, shards = window // unit, 4 * partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = cut(rows.mapInArrow(_cutter(tokenizer or default_tokenizer(), end_id, window), PIECES))
    classed = pieces.withColumn("__class", F.ceil(F.col("length") / unit).cast("int")).withColumn("__shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("int"))
    sizes = classed.groupBy("__class", "__shard").agg(F.count("*").alias("n"))
    histogram = {r["__class"]: r["n"] for r in sizes.groupBy("__class").agg(F.sum("n").alias("n")).collect()}  # window // unit rows at most
    before = Window.partitionBy("__class").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__class", "__shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__class", "__shard").orderBy("doc_id", "start", "ids_crc32"))
    ranked = classed.withColumn("__own", own - 1).join(offsets, ["__class", "__shard"])
    ranked = ranked.select(*pieces.columns, "__class", (F.col("__before") + F.col("__own")).cast("long").alias("__rank"))
    placed = ranked.mapInPandas(_placer(places(plan_patterns(histogram, units))), PIECES + ", sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot")
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    padded = F.when(F.bit_count(total) == 1, total).otherwise(F.lit(window)).cast("long")
    return placed.select(*pieces.columns, "sequence_id", offset.cast("long").alias("offset"), padded.alias("padded_length"))


def op6_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
