"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is the product (binding) of its letters' vectors, each
rotated by its place; a text is the sum (bundle) of its n-grams; a language is the sum of its training texts. A text
gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import documents, fresh, in_chunks, mix64, seeds

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
_BORDER = 0x20
#: Distinct n-grams whose vectors are held at once.
_BLOCK = 8192


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


_letters: np.ndarray | None = None


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """+1/-1 vectors that depend on the code point alone."""
    words = mix64(seeds(dimensions // 64, 101)[None, :] ^ mix64(codes.astype(np.uint64) + np.uint64(1))[:, None])
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Rows of GRAM code points to bound vectors: the product of the letters' vectors, each rotated by its place."""
    codes, at = np.unique(grams, return_inverse=True)
    letters, at = letter_vectors(codes, dimensions), at.reshape(grams.shape)
    out = np.roll(letters, GRAM - 1, axis=1)[at[:, 0]]
    for k in range(1, GRAM):
        out *= np.roll(letters, GRAM - 1 - k, axis=1)[at[:, k]]
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of code points of every n-gram and the text each belongs to; runs of other signs count as one border."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    letter = _letter_table()[codes]
    keep = letter.copy()  # and the first sign of every run of other signs
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    codes, owner = np.where(letter, codes, _BORDER)[keep], owner[keep]
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros((0, GRAM), np.int64), np.zeros(0, np.int64)
    whole = owner[:n] == owner[GRAM - 1 :]
    rows = np.stack([codes[k : k + n] for k in range(GRAM)], axis=1)[whole].astype(np.int64)
    return rows, owner[:n][whole]


def text_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundle of each text's n-grams; zero where a text has no letter."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    rows, owner = _grams(texts)
    if not len(rows):
        return out
    seen = np.zeros(0x110000, dtype=bool)
    seen[rows] = True
    names = np.flatnonzero(seen)
    base = len(names)
    local = np.zeros(0x110000, dtype=np.int64)
    local[names] = np.arange(base)
    keys = (local[rows[:, 0]] * base + local[rows[:, 1]]) * base + local[rows[:, 2]]
    if base**3 <= 1 << 22:
        rank = np.zeros(base**3, dtype=np.int64)
        rank[keys] = 1
        found = np.flatnonzero(rank)
        rank[found] = np.arange(len(found))
        at = rank[keys]
    else:
        found, at = np.unique(keys, return_inverse=True)
    grams = names[np.stack([found // (base * base), found // base % base, found % base], axis=1)]
    for first in range(0, len(grams), _BLOCK):
        size = min(_BLOCK, len(grams) - first)
        mine = (at >= first) & (at < first + size) if len(grams) > _BLOCK else slice(None)
        counts = np.bincount(owner[mine] * size + at[mine] - first, minlength=len(texts) * size).reshape(len(texts), size)
        out += counts.astype(np.float32) @ gram_vectors(grams[first : first + size], dimensions)
    return out


def _chunks(texts: list[str]):
    for part in in_chunks([len(t) for t in texts], 1_000_000):
        for i in range(part.start, part.stop, 256):
            yield slice(i, min(i + 256, part.stop))


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fresh()
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch["text"].tolist(), batch["lang"].to_numpy()
        for part in _chunks(texts):
            vectors = text_vectors(texts[part])
            size = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = vectors / np.where(size == 0, 1, size)
            for lang in set(langs[part]):
                sums[lang] = sums.get(lang, 0) + vectors[langs[part] == lang].sum(axis=0, dtype=np.float64)
    for lang, total in sums.items():
        yield pd.DataFrame({"lang": lang, "dimension": np.arange(len(total)), "total": total})


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names in order and their unit prototypes, from rows with text and lang whose id is not held out.

    All such rows are used, so that no language is too rare to be learned; each text counts with unit length. Sums
    are made per task, and nothing but languages times dimensions numbers reaches the driver.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    parts = usable.select("text", "lang").mapInPandas(_bundle, "lang string, dimension int, total double")
    found = parts.groupBy("lang", "dimension").agg(F.sum("total").alias("total")).toPandas()
    if not len(found):
        return [], np.zeros((0, DIMENSIONS))
    table = found.pivot(index="lang", columns="dimension", values="total")
    table = table.loc[sorted(table.index)]
    prototypes = np.round(table.to_numpy(), 6)
    return list(table.index), prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)


def _predictor(names: list[str], prototypes: np.ndarray, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh()
        labels = np.array([*names, UNKNOWN], dtype=object)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            best, score, lettered = np.full(len(texts), len(names)), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            for part in _chunks(texts):
                vectors = text_vectors(texts[part]).astype(np.float64)
                size = np.linalg.norm(vectors, axis=1)
                lettered[part] = size > 0
                known = (size > 0) & bool(names)
                if known.any():
                    cosine = vectors[known] @ prototypes.T / size[known, None]
                    at = np.flatnonzero(known) + part.start
                    best[at] = cosine.argmax(axis=1)
                    score[at] = np.clip(cosine.max(axis=1), 0, 1)
            yield batch[keep].assign(lang_pred=labels[best], score=score, has_letter=lettered)

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, lang_pred, score, has_letter for every row of ``docs``, from its whole text alone.

    A null text or one without a letter (also: nothing learned) gives 'und' with score 0; the score is the cosine
    with the winning prototype, at least 0. has_letter tells the two apart: it is of the text, not of the model. Ties
    go to the first language by code point. Null ids pass through, equal texts get equal results, an empty table gives
    none; columns outside ``keep`` are not read. A kept column whose name is one of the results' gives way to it.
    """
    kept = [c for c in keep if c not in ("lang_pred", "score", "has_letter")]
    own = [f"__{k}" for k in range(len(kept))]  # names that nothing else has
    rows = docs.select("text", *(F.col(c).alias(o) for c, o in zip(kept, own, strict=True)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    found = rows.mapInPandas(_predictor(*model, own), f"{schema}, lang_pred string, score double, has_letter boolean")
    return found.select(*(F.col(o).alias(c) for c, o in zip(kept, own, strict=True)), "lang_pred", "score", "has_letter")


def op1_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
