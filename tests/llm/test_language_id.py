import zlib

import numpy as np
from pyspark.sql import functions as F

from wayset.llm import language_id as op


def brute(text, dimensions=op.DIMENSIONS):
    shown = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    total, shown = np.zeros(dimensions), f" {shown} " if shown else ""
    for i in range(len(shown) - op.GRAM + 1):
        bound = np.ones(dimensions)
        for k, c in enumerate(shown[i : i + op.GRAM]):
            bound *= np.roll(op.letter_vectors(np.array([ord(c)]), dimensions)[0], op.GRAM - 1 - k)
        total += bound
    return total


def test_vectors_match_brute_force():
    texts = ["Hello, wörld!! x", "", "a", "  12 ", "日本語 テキスト", "ab  cd\nef", "x1y"]
    found = op.text_vectors(texts)
    assert all(np.abs(found[i] - brute(t)).max() < 1e-3 for i, t in enumerate(texts))


def test_many_letters_take_the_sorted_way():
    text = "".join(chr(0x4E00 + i) for i in range(400))
    assert np.abs(op.text_vectors([text])[0] - brute(text)).max() < 1e-3


def test_held_out_accuracy(docs):
    rows = op.predict(docs, op.train(docs), ("doc_id", "lang")).where(op.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_odd_documents(odd, none, spark):
    model = op.train(odd)
    assert model[0] == sorted(model[0])
    rows = op.predict(odd, model).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert {by_id[i]["lang_pred"] for i in (4, 5, 6, 8)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows) and by_id[1]["score"] == by_id[3]["score"]
    assert op.predict(none, model).count() == 0
    names, vectors = op.train(none)
    assert names == [] and {r["lang_pred"] for r in op.predict(odd, (names, vectors)).collect()} == {"und"}


def test_labels_are_not_inputs(odd):
    model = op.train(odd)
    shuffled = odd.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz"))
    key = lambda rows: sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in rows)
    assert key(op.predict(odd, model).collect()) == key(op.predict(shuffled, model).collect())


def test_rare_language_is_learned_whole(spark):
    own = [(20_000_000 + i, f"żółć gęśl jaźń {chr(97 + i) * 9} {chr(98 + i) * 5}", "pl") for i in range(20)]
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame(own, "doc_id long, text string, lang string")
    names, vectors = op.train(many.unionByName(rare))
    alone = op.train(rare)
    assert names == ["en", "pl"] and alone[0] == ["pl"]
    assert np.abs(vectors[1] - alone[1][0]).max() < 1e-5


def test_prototypes_and_choice_match_brute_force(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("a word of the day", "en"), ("der hund und die katze", "de"), ("ein wort am tag", "de"), ("le chat et le chien", "fr"), ("un mot du jour", "fr"), ("the dog", None), ("", "en"), ("12 !", "de"), ("die katze", "xx")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", op.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    sums = {}
    for i, text, lang in rows:
        if lang is not None and not held[i]:
            vector = brute(text)
            sums[lang] = sums.get(lang, 0) + vector / max(np.linalg.norm(vector), 1e-12)
    names = sorted(sums)
    for r in op.predict(docs, op.train(docs)).collect():
        vector = brute(rows[r["doc_id"]][1])
        if not vector.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosine = [vector @ sums[n] / max(np.linalg.norm(vector) * np.linalg.norm(sums[n]), 1e-12) for n in names]
        assert r["lang_pred"] == names[int(np.argmax(cosine))] and abs(r["score"] - max(max(cosine), 0)) < 1e-4


def test_kept_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "eins zwei drei", 5.0, 7), (2, None, 6.0, 8)], "doc_id long, text string, score double, size long")
    found = op.predict(rows, (["de"], op.text_vectors(["eins zwei drei"]) * 1.0), ("doc_id", "score", "size", "text"))
    assert found.columns == ["doc_id", "size", "text", "lang_pred", "score", "has_letter"]
    assert sorted((r["doc_id"], r["size"], r["lang_pred"], r["score"] > 0) for r in found.collect()) == [(1, 7, "de", True), (2, 8, "und", False)]
