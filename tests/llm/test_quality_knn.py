import numpy as np
from pyspark.sql import functions as F

from wayset.llm import quality_knn as op


def test_projection_keeps_the_largest_directions():
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((60, 4)) @ rng.standard_normal((4, 200))).astype(np.float32)
    mean, basis = op.latent_space(rows, 4)
    centred = rows - mean
    assert np.abs(centred @ basis @ basis.T - centred).max() < 1e-2


def test_votes_match_brute_force():
    rng = np.random.default_rng(4)
    terms, labels = rng.random((200, op.TERMS)).astype(np.float32), rng.integers(0, 2, 200)
    model = op.Model(terms, labels, 16)
    probe = rng.random((30, op.TERMS)).astype(np.float32)
    cosine = np.round((model.project(probe) @ model.points.T).astype(np.float64), 5)
    for row, score in zip(cosine, model.score(probe), strict=True):
        near = np.argsort(-row, kind="stable")[: op.NEIGHBOURS]
        weight = np.maximum(row[near], 0) ** 2
        assert abs(score - (weight * labels[near]).sum() / weight.sum()) < 1e-9


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = op.classify(docs, op.train(docs, labels)).join(labels.where(op.held_out(F.col("doc_id"))), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 0), (9, 1, 0), (99, 1, 0), (None, 1, 0), (10, None, None), (14, 7, 0)], "doc_id long, quality int, toxic int")
    rows = op.classify(odd, op.train(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= op.THRESHOLD) for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert abs(by_id[1] - by_id[3]) < 1e-9
    assert op.classify(none, op.train(none, labels)).count() == 0
    assert {r["score"] for r in op.classify(odd, op.train(odd, labels.where("false"))).collect()} == {0.5}


def test_sample_is_the_rows_of_least_hash(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("quality"))
    model = op.train(docs, labels, per_label=50)
    assert np.bincount(model.labels.astype(int)).tolist() == [50, 50]
    fewer = op.train(docs, labels.where("doc_id < 300"), per_label=50)
    assert 0 < (fewer.labels == 1).sum() < 50 and (fewer.labels == 0).sum() == 50


def test_scores_match_plain_steps(spark, docs):
    """Fit and votes again with numpy's own decomposition, one document at a time."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = {r["doc_id"]: r["score"] for r in op.classify(docs, op.train(docs, labels)).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    learned = [r["doc_id"] for r in labels.where(~op.held_out(F.col("doc_id"))).collect()]
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = np.concatenate([op.term_vectors([texts[d]]) for d in learned]).astype(np.float16).astype(np.float64)
    mean = rows.mean(axis=0)
    _, _, right = np.linalg.svd(rows - mean, full_matrices=False)
    unit = lambda x: x / max(np.linalg.norm(x), 1e-9)
    project = lambda x: unit((x - mean) @ right[: op.LATENT].T)
    points = np.array([project(r) for r in rows])
    for d, text in texts.items():
        cosine = points @ project(op.term_vectors([text])[0].astype(np.float64))
        near = np.argsort(-cosine, kind="stable")[: op.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** 2
        assert abs(found[d] - (weight * [quality[learned[k]] for k in near]).sum() / weight.sum()) < 0.1
