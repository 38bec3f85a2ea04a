"""Quality classifier: votes of nearest neighbours in a latent semantic space.

Texts become weighted term vectors (hashed words and byte trigrams, and terms for how repetitive and how odd their
signs are). A singular value decomposition of a bounded labelled sample gives the latent space. The sample's latent
vectors and labels are broadcast; every document is compared with all of them in blocks, exactly, and its nearest
neighbours vote with their cosine as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, documents, in_chunks, word_hashes

WORD_TERMS, GRAM_TERMS = 2048, 2048
#: Labels 0 and 1 that are used at most, of each: those whose ids have the least hashes.
LABELLED = 1000
LATENT = 64
NEIGHBOURS = 25
THRESHOLD = 0.7
_LEVELS = 10
_TRAITS = 7
TERMS = WORD_TERMS + GRAM_TERMS + _TRAITS * (_LEVELS + 1)
_SIGNS = np.zeros((4, 256), dtype=bool)
_SIGNS[0, 65:91] = True
_SIGNS[1, 48:58] = True
_SIGNS[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = True
_SIGNS[3, 128:] = True


def term_vectors(texts: list[bytes]) -> np.ndarray:
    """Rows of TERMS weights: damped counts of hashed terms at unit length, then one term per trait and level."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n) + 1
    blob = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    hashes, counts = word_hashes(blob, sizes)
    whose = np.repeat(np.arange(n), counts)
    words = np.bincount(whose * WORD_TERMS + (hashes % np.uint64(WORD_TERMS)).astype(np.int64), minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)
    wide = blob.astype(np.int64)
    grams = (wide[:-2] * 40503 + wide[1:-1] * 9973 + wide[2:] * 1009) * 2654435761 >> 20 & (GRAM_TERMS - 1)
    inside = owner[:-2] == owner[2:]
    grams = np.bincount((owner[:-2] * GRAM_TERMS + grams)[inside], minlength=n * GRAM_TERMS).reshape(n, GRAM_TERMS)
    parts = []
    for block in (words, grams):
        damped = np.log1p(block).astype(np.float32)
        parts.append(damped / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9))
    total = np.maximum(counts, 1)
    pairs = np.unique(np.stack([whose.astype(np.uint64), hashes], axis=1), axis=0)[:, 0].astype(np.int64) if len(hashes) else np.zeros(0, np.int64)
    letters = np.maximum(np.bincount(owner, weights=~SPACES[blob], minlength=n), 1)
    shares = [np.bincount(pairs, minlength=n) / total, np.minimum(letters / total / 20, 1)]
    shares += [np.bincount(owner, weights=_SIGNS[k][blob], minlength=n) / letters for k in range(4)]
    shares.append(np.minimum(np.log2(1 + counts) / 12, 1))
    for share in shares:
        at = np.clip(share * _LEVELS, 0, _LEVELS)
        low = np.minimum(at.astype(np.int64), _LEVELS - 1)
        level = np.zeros((n, _LEVELS + 1), dtype=np.float32)
        level[np.arange(n), low] = 1 - (at - low)
        level[np.arange(n), low + 1] = at - low
        parts.append(level * 0.6)
    return np.concatenate(parts, axis=1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def latent_space(terms: np.ndarray, latent: int = LATENT) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of a truncated singular value decomposition, by subspace iteration from a fixed start."""
    mean = terms.mean(axis=0)
    centred = terms - mean
    basis = np.random.default_rng(17).standard_normal((centred.shape[1], min(latent, len(terms)) + 16)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(centred.T @ (centred @ basis))
    _, _, right = np.linalg.svd(centred @ basis, full_matrices=False)
    return mean, (basis @ right.T)[:, :latent].astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels learning never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
        for part in in_chunks([len(t) for t in texts], 400_000):
            rows = term_vectors(texts[part]).astype(np.float16)
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part], "label": batch["label"].iloc[part], "terms": [r.tobytes() for r in rows]})


class Model:
    """Labelled latent vectors, their labels, and the way from terms to the latent space."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, latent: int = LATENT):
        self.labels = labels.astype(np.float64)
        self.mean, self.basis = latent_space(terms, latent) if len(terms) else (np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32))
        self.points = self.project(terms)

    def project(self, terms: np.ndarray) -> np.ndarray:
        return _unit((terms - self.mean) @ self.basis)

    def score(self, terms: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by cosine; 0.5 where nothing is like it."""
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        cosine = np.round((self.project(terms) @ self.points.T).astype(np.float64), 5)
        k = min(neighbours, len(self.labels))
        near = np.argsort(-cosine, axis=1, kind="stable")[:, :k] if len(self.labels) <= 64 else np.argpartition(-cosine - np.arange(len(self.labels))[::-1] * 1e-12, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 2
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), 0.5)


def train(docs: DataFrame, labels: DataFrame, per_label: int = LABELLED) -> Model:
    """Fit on the ``per_label`` rows of least hash of each label, from labels whose document is not held out.

    Labels other than 0 and 1, null ids and labels of missing documents are left out; a null text is empty.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    order = F.xxhash64(F.lit("labelled"), F.col("doc_id"))
    least = [usable.where(F.col("label") == label).orderBy(order, "doc_id").limit(per_label) for label in (0, 1)]
    sample = least[0].unionByName(least[1])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # per_label rows a label
    found = rows.mapInPandas(_terms, "doc_id long, label int, terms binary").toPandas().sort_values(["doc_id", "label", "terms"], kind="stable")
    terms = np.stack([np.frombuffer(t, np.float16) for t in found["terms"]]).astype(np.float32) if len(found) else np.zeros((0, TERMS), np.float32)
    return Model(terms, found["label"].to_numpy())


def _scorer(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            for part in in_chunks([len(t) for t in texts], 400_000):
                score = np.concatenate([model.score(term_vectors(texts[i : min(i + 256, part.stop)])) for i in range(part.start, part.stop, 256)])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part], "score": score})

    return run


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted (1 from THRESHOLD on) for every row, from its whole text alone.

    A null text is scored as an empty one; without any labelled row every score is 0.5. Null ids pass through, equal
    texts score alike, an empty table gives none; other columns are ignored. The broadcast model holds at most
    2 * LABELLED latent vectors, whatever the size of the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInPandas(_scorer(shared), "doc_id long, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op10_quality_knn(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
