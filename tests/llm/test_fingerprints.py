import hashlib
import re

import numpy as np

from wayset.llm import fingerprints as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(docs, tolerance):
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    found = sorted(op.fingerprint_edits(docs).collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["n_chars"]))
    assert len(found) == len(rows)
    off = []
    for i, (row, got) in enumerate(zip(rows, found, strict=True)):
        text, following = row["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        changed = op.edited(text, following)
        assert (got["doc_id"], got["n_chars"]) == (row["doc_id"], len(text))
        assert got["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        off += [got["near_edited"] - jaccard(text, changed), got["near_next"] - jaccard(text, following)]
    assert np.abs(off).max() < tolerance
    return found


def test_estimates_are_near(docs):
    check(docs, 0.12)


def test_odd_documents(odd, none):
    found = {r["doc_id"]: r for r in check(odd, 0.15)}
    assert found[1]["fingerprint"] == found[3]["fingerprint"] != found[2]["fingerprint"]
    assert found[4]["fingerprint"] == found[6]["fingerprint"] == ""
    assert op.fingerprint_edits(none).count() == 0


def test_one_row_is_its_own_next(spark):
    row = op.fingerprint_edits(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert row["near_next"] == 1 and row["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()


def test_text_form_round_trips():
    codes = op.codes([b"a b c d e f g", b"", b"x"])
    assert all((op.from_text(op.to_text(r)) == r).all() for r in codes)


def test_estimate_is_unbiased():
    a = " ".join(f"a{i}" for i in range(400))
    found = [op.likeness(op.codes([a.encode()]), op.codes([(a + " " + " ".join(f"b{k}x{i}" for i in range(400))).encode()]))[0] for k in range(30)]
    assert abs(np.mean(found) - 396 / 796) < 0.02
