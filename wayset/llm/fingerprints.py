"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle is hashed once; the top bits choose one of BINS bins and every bin keeps its least hash. An empty bin
copies the bin that its own fixed random order of bins finds filled first, which is the same for every document, so
equal bins of two documents stay comparable. Only BITS low bits of each bin are stored; the share of equal codes is
corrected for the chance that unequal bins agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import documents, mix64, partitions, seeds, shingles

BINS, BITS = 512, 4
_TOP = np.uint64(64 - int(BINS).bit_length() + 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_orders: np.ndarray | None = None


def _order() -> np.ndarray:
    """For each bin, the order in which it looks for a filled one."""
    global _orders
    if _orders is None:
        _orders = np.argsort(seeds(BINS * BINS, 301).reshape(BINS, BINS), axis=1, kind="stable").astype(np.int16)
    return _orders


def codes(texts: list[bytes]) -> np.ndarray:
    """BINS codes of BITS bits for each text; a text without words has the code row 255."""
    hashes, n = shingles(texts)
    owner = np.repeat(np.arange(len(texts)), n)
    least = np.full(len(texts) * BINS, _NONE)
    np.minimum.at(least, owner * BINS + (hashes >> _TOP).astype(np.int64), hashes)
    least = least.reshape(len(texts), BINS)
    filled = least != _NONE
    some = n > 0
    doc, bin_ = np.nonzero(~filled & some[:, None])
    doc0, bin0, source = doc, bin_, np.full(len(doc), -1, dtype=np.int64)
    at, order = np.arange(len(doc)), _order()
    for k in range(BINS):
        if not len(at):
            break
        candidate = order[bin0[at], k]
        hit = filled[doc0[at], candidate]
        source[at[hit]] = candidate[hit]
        at = at[~hit]
    least[doc, bin_] = least[doc, source]
    # Keyed by the bin, so that a value which fills many bins does not agree or differ in all of them at once.
    out = (mix64((least ^ seeds(BINS, 302)).ravel()).reshape(least.shape) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    out[~some] = 255
    return out


def to_text(row: np.ndarray) -> str:
    """Packed codes in hex; an empty string for a text without words."""
    if row[0] == 255:
        return ""
    return np.packbits(np.unpackbits(row[:, None], axis=1, bitorder="little")[:, :BITS].ravel(), bitorder="little").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    if not fingerprint:
        return np.full(BINS, 255, dtype=np.uint8)
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8), bitorder="little").reshape(BINS, BITS)
    return np.packbits(bits, axis=1, bitorder="little")[:, 0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of codes; two texts without words are alike, one of them is like none."""
    chance = 1 / (1 << BITS)
    share = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    empty_a, empty_b = a[:, 0] == 255, b[:, 0] == 255
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), share)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch["bucket"], batch["guest"], batch["doc_id"].astype("Int64"), batch["text"], strict=True)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by bucket in descending id, each bucket's successor last; every row but that one meets its next."""

    def flush(held: list[tuple]) -> pd.DataFrame | None:
        here = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
        if not here:
            return None
        texts = [r[3] for r in held]
        changed = [edited(texts[i], texts[i + 1]).encode("utf-8", "surrogatepass") for i in here]
        own, other = codes([t.encode("utf-8", "surrogatepass") for t in texts]), codes(changed)
        at = np.array(here)
        return pd.DataFrame({
            "doc_id": pd.array([held[i][2] for i in here], dtype="Int64"), "n_chars": [len(texts[i]) for i in here], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
            "fingerprint": [to_text(own[i]) for i in here], "edited_fingerprint": [to_text(r) for r in other], "near_edited": likeness(own[at], other), "near_next": likeness(own[at], own[at + 1]),
        })

    held: list[tuple] = []
    size = 0
    for row in _rows(batches):
        held.append(row)
        size += len(row[3])
        if size > 700_000 and len(held) > 1:
            if (found := flush(held)) is not None:
                yield found
            held, size = held[-1:], len(row[3])
    if (found := flush(held)) is not None:
        yield found


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text; see the columns in ``_OUT``.

    The edited text ends with the beginning of the next document in descending doc_id (after the last: the first).
    Null texts are empty; their fingerprint is the empty string. Null ids come last in that order; rows that share an
    id are ordered by text, and each row gives one. A table of one row is its own next; an empty table gives none.
    Only doc_id and text are read.

    Ids are cut into equal ranges (their bounds and largest ids reach the driver: two numbers per range). A range's
    largest document is dealt to the range before it as well, so no range needs another one and each text moves once.
    """
    spark = docs.sparkSession
    parts = 4 * partitions(spark)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = rows.select(F.percentile_approx("at", [k / parts for k in range(1, parts)], 10_000).alias("b")).first()["b"]
    cuts = np.unique(np.array(bounds or [], dtype=np.int64))

    @F.pandas_udf(T.IntegerType())
    def bucket_of(at: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, at.to_numpy(), side="right"), dtype="int32")

    heads = sorted((r["bucket"], r["head"]) for r in rows.select(bucket_of("at").alias("bucket"), "at").groupBy("bucket").agg(F.max("at").alias("head")).collect())
    lead = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}  # the first head follows the last range
    names = np.array(sorted(lead), dtype=np.int64)
    to = np.array([lead[n] for n in names.tolist()], dtype=np.int32)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def dealt(at: pd.Series) -> pd.Series:
        own = len(cuts) - np.searchsorted(cuts, at.to_numpy(), side="right")
        k = np.minimum(np.searchsorted(names, at.to_numpy()), len(names) - 1)
        guest = np.where(names[k] == at.to_numpy(), to[k], -1)
        return pd.Series([[int(o)] if g < 0 else [int(o), int(g)] for o, g in zip(own, guest, strict=True)])

    moved = rows.select("doc_id", "at", "text", F.posexplode(dealt("at")).alias("guest", "bucket"))
    ordered = moved.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "guest", F.desc("at"), "text")
    return ordered.select("bucket", (F.col("guest") > 0).alias("guest"), "doc_id", "text").mapInPandas(_compare, _OUT)


def op5_fingerprints(spark, sf_dir):
    return fingerprint_edits(documents(spark, sf_dir))
