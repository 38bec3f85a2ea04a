import hashlib
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wayset.llm import language_id, mixing
from wayset.llm._shared import stored
from wayset.llm._tokens import default_tokenizer

from . import test_near_dedup, test_suffix_dedup


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark, docs, sf_dir):
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, sf_dir), name)
        assert after.columns == docs.columns
        kept[name] = (before, after)
        before = after
    given, found = (rows_of(x) for x in kept["language_id"])
    assert found == {d: r for d, r in given.items() if any(c.isalpha() for c in r["text"])}
    given, found = (rows_of(x) for x in kept["near_dedup"])
    assert found == {d: given[d] for d in (int(r[0]) for r in test_near_dedup.brute([(d, r["text"]) for d, r in given.items()]) if r[3])}
    given, found = (rows_of(x) for x in kept["suffix_dedup"])
    expected = {int(r[0]): r for r in test_suffix_dedup.brute([(d, r["text"].encode()) for d, r in given.items()])}
    assert given.keys() == found.keys()
    for d, r in found.items():
        assert r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == (given[d]["lang"], given[d]["source"])
        if "�" not in r["text"] and len(r["text"].encode()) == expected[d][1] - expected[d][2]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == expected[d][4]
    given, found = kept["mixing"]
    ledger = {r["doc_id"]: r["copies"] for r in mixing.mix_ledger(given).collect()}
    assert Counter(r["doc_id"] for r in found.collect()) == Counter({d: n for d, n in ledger.items() if n})
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in before.collect()}
    assert sum(r["length"] for r in packed) == sum(len(ids[d]) * n for d, n in ledger.items() if n)
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in packed)


def test_run_and_odd_documents(spark, odd, none, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for given in (odd.select(*corpus_pipeline.COLUMNS), none.select(*corpus_pipeline.COLUMNS)):
        docs = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0) == (given is not none and given.count() > 0)


def test_rejected_language(spark, odd):
    model = language_id.train(odd)
    assert {r["doc_id"] for r in language_id.predict(odd, model).where("lang_pred = 'und'").collect()} == {4, 5, 6, 8}


def test_documents_stay_where_no_language_is_given(spark, odd):
    docs = odd.select(*corpus_pipeline.COLUMNS).withColumn("lang", F.lit(None).cast("string"))
    found = corpus_pipeline.identify_language(spark, docs, "").collect()
    expected = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert len(expected) > 5 and sorted(map(repr, found)) == sorted(map(repr, expected))
