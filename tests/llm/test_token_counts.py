import re

from wayset.llm import token_counts as op

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(word, unigram):
    text, best = "▁".encode() + word, [(0.0, 0)]
    for i in range(1, len(text) + 1):
        top = (best[i - 1][0] + op.BYTE_COST, best[i - 1][1] + 1)
        for size in range(1, min(i, unigram.longest) + 1):
            score = unigram.pieces.get(text[i - size : i])
            if score is not None and best[i - size][0] + score >= top[0]:
                top = (best[i - size][0] + score, best[i - size][1] + 1)
        best.append(top)
    return best[-1][1]


def test_trie_matches_brute_force(docs):
    unigram = op.model(op.default_vocabulary())
    texts = [r["text"].encode() for r in docs.limit(12).collect()] + ["x".encode() * 300, "é".encode() * 150, b"", b"a ab abc abd b ba"]
    words, tokens = op.text_tokens(texts, unigram)
    for text, n, found in zip(texts, words, tokens, strict=True):
        parts = WORD.findall(text)
        assert n == len(parts)
        assert found == sum(brute(w, unigram) for w in parts)


def test_odd_documents(odd, none):
    rows = op.count_tokens(odd).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count()
    assert (by_id[4]["n_words"], by_id[4]["n_tokens"]) == (0, 0) == (by_id[6]["n_words"], by_id[6]["n_tokens"])
    assert by_id[1]["n_tokens"] == by_id[3]["n_tokens"] > 0 and None in by_id
    assert op.count_tokens(none).count() == 0


def test_long_words_are_segmented_whole(monkeypatch):
    unigram = op.model(op.default_vocabulary())
    words = ["x" * 300, "日本語" * 100, "https://example.org/" + "path/to/thing?key=value&" * 20, "é" * 150, "\U0001f389" * 40, "a" * op.LONGEST, "ab" * op.LONGEST, "internationalization" * 500]
    texts = [w.encode() for w in words] + [" ".join(["ab", *words, "b"]).encode()]
    expected = [brute(w.encode(), unigram) for w in words]
    assert expected[0] == 101
    for block in (op._BLOCK, 7, 50):
        monkeypatch.setattr(op, "_BLOCK", block)
        counts, tokens = op.text_tokens(texts, unigram)
        assert counts.tolist() == [1] * len(words) + [len(words) + 2]
        assert tokens.tolist() == [*expected, sum(expected) + brute(b"ab", unigram) + brute(b"b", unigram)]
