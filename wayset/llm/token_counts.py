"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The pre-tokens of many documents share prefixes. Distinct ones are sorted into a trie; for each trie node the best
unigram segmentation of its prefix follows from the best ones of its ancestors, so a prefix is scored once however
many pre-tokens begin with it. Each pre-token's end node stores its token count, and documents add those up.
Long pre-tokens hardly share prefixes; they are segmented one by one, from the pieces found in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, documents, in_chunks, seeds, word_hashes

#: Bytes of a word at most that goes through the trie; ``long_counts`` takes the others, of any length.
LONGEST = 96
#: Bytes of long words whose pieces are looked up at once.
_BLOCK = 1 << 17
#: Log probability of a byte that no piece covers.
BYTE_COST = -16.0
_ROOT = "▁".encode()
_KEY = seeds(256, 401)
_BASE = int(seeds(1, 402)[0]) | 1
_models: dict[str, Unigram] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Unigram:
    """Pieces as byte strings with log probabilities, looked up by hash.

    The vocabulary file ranks its pieces; probabilities follow Zipf's law on that rank, 1 / (rank + 1) before
    scaling. A byte outside every piece is a token of its own at BYTE_COST.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        scale = np.log(np.sum(1 / np.arange(1, len(names) + 1)))
        self.pieces = {n.encode(): -float(np.log(k + 1) + scale) for k, n in enumerate(names)}
        self._beginnings: list[np.ndarray] | None = None
        self.table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(p) for p in self.pieces}):
            own = sorted((byte_hash(p), s) for p, s in self.pieces.items() if len(p) == size)
            self.table[size] = np.array([h for h, _ in own], dtype=np.uint64), np.array([s for _, s in own])
        self.longest = max(self.table)

    def beginnings(self) -> list[np.ndarray]:
        """Sorted hashes of what pieces begin with, by length (the first for one byte)."""
        if self._beginnings is None:
            found: list[set[int]] = [set() for _ in range(self.longest)]
            for piece in self.pieces:
                h = 0
                for k, b in enumerate(piece):
                    h = (h * _BASE + int(_KEY[b])) & 0xFFFFFFFFFFFFFFFF
                    found[k].add(h)
            self._beginnings = [np.array(sorted(hashes), dtype=np.uint64) for hashes in found]
        return self._beginnings


def byte_hash(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * _BASE + int(_KEY[b])) & 0xFFFFFFFFFFFFFFFF
    return h


def model(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram(path)
    return _models[path]


def trie_counts(words: list[bytes], unigram: Unigram) -> np.ndarray:
    """Tokens of the best segmentation of each word of a sorted list of distinct words of at most LONGEST bytes.

    Ties go to the segmentation whose last piece is longest. Nodes are made level by level; a level's arrays hold
    each node's rolling hash, score and count, and its ancestors' as far back as the longest piece.
    """
    out = np.zeros(len(words), dtype=np.int64)
    words = [_ROOT + w for w in words]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max())
    letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    shared = np.zeros(len(words), dtype=np.int64)  # bytes that a word has in common with the word before it
    shared[1:] = np.cumprod((letters[1:] == letters[:-1]) & (np.arange(width) < np.minimum(lengths[1:], lengths[:-1])[:, None]), axis=1).sum(axis=1)
    back = unigram.longest + 1
    powers = np.ones(back + 1, dtype=np.uint64)
    for k in range(1, back + 1):
        powers[k] = np.uint64(int(powers[k - 1]) * _BASE & 0xFFFFFFFFFFFFFFFF)
    alive, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
    hashes, scores, counts = (np.zeros((1, 1), t) for t in (np.uint64, np.float64, np.int64))  # column j: j levels up
    for depth in range(width):
        keep = lengths[alive] > depth
        first = alive[keep]
        begins = np.ones(len(first), dtype=bool)
        gap = shared[first]  # words between are shorter, so what is shared with the last word alive is at most theirs
        if len(alive) != len(first):
            at = np.flatnonzero(keep)
            low = np.minimum.reduceat(shared[alive], np.append(0, at[:-1] + 1)) if len(at) else gap
            gap = np.where(np.arange(len(first)) > 0, low, gap)
        begins[1:] = (gap <= depth)[1:]
        parent = node[keep][begins]
        byte = letters[first[begins], depth]
        hashes, scores, counts = hashes[parent], scores[parent], counts[parent]
        own = hashes[:, 0] * np.uint64(_BASE) + _KEY[byte]
        best, many = scores[:, 0] + BYTE_COST, counts[:, 0] + 1
        for size, (names, weights) in unigram.table.items():
            if size > depth + 1:
                break
            part = own - hashes[:, size - 1] * powers[size]
            at = np.minimum(np.searchsorted(names, part), len(names) - 1)
            found = np.flatnonzero(names[at] == part)
            value = scores[found, size - 1] + weights[at[found]]
            better = value >= best[found]
            best[found[better]], many[found[better]] = value[better], counts[found[better], size - 1] + 1
        hashes, scores, counts = (np.column_stack([new, old[:, : back - 1]]) for new, old in ((own, hashes), (best, scores), (many, counts)))
        node = np.cumsum(begins) - 1
        alive = first
        ended = lengths[alive] == depth + 1
        out[alive[ended]] = many[node[ended]]
    return out


def _pieces_within(blob: np.ndarray, room: np.ndarray, unigram: Unigram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last byte, size and weight of every piece in ``blob``, ordered by last byte and size.

    ``room`` is how many bytes of its word begin at each byte; a start is followed only while pieces begin like it.
    """
    start, h = np.arange(len(blob)), np.zeros(len(blob), dtype=np.uint64)
    found = []
    for size, begin in enumerate(unigram.beginnings(), 1):
        go = room[start] >= size
        start, h = start[go], h[go]
        h = h * np.uint64(_BASE) + _KEY[blob[start + size - 1]]
        go = begin[np.minimum(np.searchsorted(begin, h), len(begin) - 1)] == h
        start, h = start[go], h[go]
        if not len(start):
            break
        if size in unigram.table:
            names, weights = unigram.table[size]
            at = np.minimum(np.searchsorted(names, h), len(names) - 1)
            whole = names[at] == h
            found.append((start[whole] + size - 1, np.full(int(whole.sum()), size), weights[at[whole]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ends, sizes, weights = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(ends, kind="stable")
    return ends[order], sizes[order], weights[order]


def long_counts(words: list[bytes], unigram: Unigram) -> np.ndarray:
    """The same as ``trie_counts`` for words of any length in any order, each with one word mark.

    Pieces are looked up in blocks of bytes; scores and counts go on from block to block, as far back as the longest
    piece, so a block's border is none for the segmentation.
    """
    out = np.zeros(len(words), dtype=np.int64)
    marked = [_ROOT + w for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    blob = np.frombuffer(b"".join(marked), np.uint8)
    stops = np.cumsum(lengths)
    word, back = 0, unigram.longest
    scores, counts = [0.0], [0]  # of the prefixes of the word, the latest last
    for first in range(0, len(blob), _BLOCK):
        stop = min(first + _BLOCK, len(blob))
        low = max(0, first - back + 1)
        room = stops[np.searchsorted(stops, np.arange(low, stop), side="right")]
        ends, sizes, weights = _pieces_within(blob[low:stop], np.minimum(room, stop) - np.arange(low, stop), unigram)
        own = ends >= first - low
        upto = np.searchsorted(ends[own], np.arange(first - low, stop - low), side="right").tolist()
        sizes, weights = sizes[own].tolist(), weights[own].tolist()
        at = 0
        for place, last in enumerate(upto, first + 1):
            best, many = scores[-1] + BYTE_COST, counts[-1] + 1
            for k in range(at, last):
                value = scores[-sizes[k]] + weights[k]
                if value >= best:
                    best, many = value, counts[-sizes[k]] + 1
            at = last
            scores.append(best)
            counts.append(many)
            if place == stops[word]:
                out[word] = many
                word += 1
                scores, counts = [0.0], [0]
        scores, counts = scores[-back:], counts[-back:]
    return out


def text_tokens(texts: list[bytes], unigram: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text; the texts' distinct pre-tokens go through one trie, long ones apart."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = b" ".join(texts) + b" "
    blob = np.frombuffer(joined, dtype=np.uint8)
    hashes, counts = word_hashes(blob, sizes)
    if not len(hashes):
        return counts, np.zeros(len(texts), np.int64)
    space = SPACES[blob]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    _, place, which = np.unique(hashes, return_index=True, return_inverse=True)
    distinct = [joined[starts[p] : stops[p]] for p in place]
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    each = np.zeros(len(distinct), dtype=np.int64)
    short = sorted(np.flatnonzero(size <= LONGEST).tolist(), key=distinct.__getitem__)
    if short:
        each[short] = trie_counts([distinct[i] for i in short], unigram)
    long = np.flatnonzero(size > LONGEST).tolist()
    if long:
        each[long] = long_counts([distinct[i] for i in long], unigram)
    owner = np.repeat(np.arange(len(texts)), counts)
    return counts, np.bincount(owner, weights=each[which], minlength=len(texts)).astype(np.int64)


def _counter(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unigram = model(path)
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            for part in in_chunks([len(t) for t in texts], 4_000_000):
                words, tokens = text_tokens(texts[part], unigram)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part], "n_words": words, "n_tokens": tokens})

    return run


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of ``docs``, over whole texts.

    A pre-token is a word of any length with the vocabulary's word mark before it. Null and empty texts have none. Null ids pass
    through, equal texts count alike, an empty table gives none; only doc_id and text are read. Nothing is shuffled:
    tries are made per task over a few MB of text at a time.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(_counter(vocabulary or default_vocabulary()), "doc_id long, n_words long, n_tokens long")


def op2_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir))
