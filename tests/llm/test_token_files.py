import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wayset.llm import _tokens
from wayset.llm import token_files as op


@pytest.mark.parametrize("bits", [1, 3, 11, 16, 17, 31])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_bits_round_trip(bits, n):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, n)
    packed = op.pack_bits(ids, bits)
    assert len(packed) == -(-n * bits // 8) and op.unpack_bits(packed, bits, n).tolist() == ids.tolist()


def test_too_large_an_id():
    with pytest.raises(ValueError, match="does not fit"):
        op.pack_bits(np.array([8]), 3)


def test_segment_random_access():
    ids = np.arange(20_000) % 50_257
    segment = op.Segment(op.encode_segment([5, None, -2], np.array([1, 9_999, 10_000]), ids, 16))
    assert segment.doc_ids == [5, None, -2] and segment.ids(4090, 8200).tolist() == ids[4090:8200].tolist()
    found = [(d, s, x.tolist()) for d, s, x in segment.documents()]
    assert found == [(5, 0, ids[:1].tolist()), (None, 1, ids[1:10_000].tolist()), (-2, 10_000, ids[10_000:].tolist())]


def test_memo_changes_no_id(monkeypatch):
    import random

    random.seed(5)
    monkeypatch.setattr(_tokens, "MEMO_PIECES", 50)
    plain = Tokenizer.from_file(_tokens.default_tokenizer())
    enc = _tokens.Encoder(_tokens.default_tokenizer())
    signs = [" ", "  ", "\n", " \n", "\n ", "a", "Bc", "é", "日本", "123", "!", "'s", "\t", " ", "don't", "<|endoftext|>", "\u3000", "\x1c", "\r\n", "     ", ""]
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 25))) for _ in range(2000)]
    for i in range(0, len(texts), 100):
        flat, counts = enc.encode(pa.array(texts[i : i + 100]))
        for text, part in zip(texts[i : i + 100], np.split(flat, np.cumsum(counts)[:-1]), strict=True):
            assert part.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_as_the_library_has_them():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain  text", "a<|endoftext|>b " + "x" * 100, ""]
    flat, counts = _tokens.Encoder(_tokens.default_tokenizer()).encode(pa.array(texts))
    plain = Tokenizer.from_file(_tokens.default_tokenizer())
    assert flat.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids] and counts[0] == 4


def expected(rows):
    tokenizer = Tokenizer.from_file(_tokens.default_tokenizer())
    start, out = 0, []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_files_hold_every_id(request, spark, tmp_path, which):
    docs = request.getfixturevalue(which)
    op.write_token_files(docs, str(tmp_path / "t"))
    found = [tuple(r) for r in op.read_token_index(spark, str(tmp_path / "t")).orderBy("start").collect()]
    assert found == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(spark, none, tmp_path):
    op.write_token_files(none, str(tmp_path / "t"))
    assert op.read_token_index(spark, str(tmp_path / "t")).count() == 0
