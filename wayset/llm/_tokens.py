"""Encoding whole texts with a public byte-level tokenizer inside Spark tasks."""

from __future__ import annotations

import os
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shared import REMEMBERED, in_chunks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces and ids that a worker remembers at most; beyond that it starts anew.
MEMO_PIECES, MEMO_IDS = 800_000, 8_000_000
#: Characters of a piece that is remembered; longer ones are encoded each time.
MEMO_LENGTH = 64
#: New pieces that are encoded at once.
LEARNED = 64
_made: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class Encoder:
    """Encodes texts to the ids that the tokenizer gives them, remembering the ids of space-delimited pieces.

    A space after a sign that is no white space always begins a new pre-token of a byte-level tokenizer, so a text
    may be cut there. Where white space comes before a space, the pieces around it are encoded together. A text with
    an added token's string in it is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        self.first: dict[str, int] = {}  # places of strings that begin a text or are encoded together
        self.later: dict[str, int] = {}  # places of pieces that follow a space
        self.flat, self.used, self.many = np.zeros(1 << 16, np.int32), 0, 0
        self.start, self.length, self.loose = (np.zeros(1 << 14, t) for t in (np.int64, np.int64, bool))

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Keep the ids of new strings, end to end; their places are in a row from the number returned."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.many + len(lengths) > len(self.start):
            self.start, self.length, self.loose = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.loose))
        first = self.many
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first : first + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(lengths)] = lengths
        self.used += len(ids)
        self.many += len(lengths)
        return first

    def _alone(self, text: str, loose: bool) -> int:
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        at = self._store(ids, np.array([len(ids)]))
        self.loose[at] = loose
        return at

    def _opening(self, strings: list[str]) -> np.ndarray:
        """Where the ids are of strings that stand for themselves."""
        out = np.empty(len(strings), dtype=np.int64)
        for k, s in enumerate(strings):
            at = self.first.get(s)
            if at is None:
                at = self._alone(s, not s or s[-1].isspace())
                if len(s) <= MEMO_LENGTH:
                    self.first[s] = at
            out[k] = at
        return out

    def _after_space(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of a space and each of the distinct pieces are; new ones are encoded many at a time."""
        out = np.fromiter(map(self.later.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(out < 0).tolist()
        plain = [k for k in new if (p := pieces[k]) and not p[-1].isspace()]
        for i in range(0, len(plain), LEARNED):
            some = plain[i : i + LEARNED]
            ids = np.array(self.tokenizer.encode(" " + " ".join([pieces[k] for k in some]), add_special_tokens=False).ids, dtype=np.int32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(some) or at[0]:
                raise ValueError("the tokenizer is not a byte-level one whose spaces begin tokens")
            first = self._store(ids, np.diff(np.append(at, len(ids))))
            out[some] = np.arange(first, first + len(some))
        for k in np.flatnonzero(out < 0).tolist():
            out[k] = self._alone(" " + pieces[k], True)
        self.later.update((p, at) for k, at in zip(new, out[new].tolist(), strict=True) if len(p := pieces[k]) <= MEMO_LENGTH)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls) end to end, and how many each text has."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.many > MEMO_PIECES or self.used > MEMO_IDS:
            self.forget()
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts, " ")
        last = np.cumsum(pc.list_value_length(cut).to_numpy().astype(np.int64))
        first = np.concatenate([[0], last[:-1]])
        coded = cut.flatten().dictionary_encode()
        pieces, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        at = self._after_space(pieces)[code]
        opening = [pieces[c] for c in code[first].tolist()]
        for k in np.flatnonzero(whole).tolist():
            opening[k] = texts[k].as_py()
        at[first] = self._opening(opening)
        loose = self.loose[at]  # ends with white space, so must not be cut from what follows
        loose[last - 1] = False
        units = last - first
        if loose.any():
            begins = np.concatenate([[True], ~loose[:-1]])
            heads, stops = np.flatnonzero(begins & loose), np.flatnonzero(~loose)
            ends = stops[np.searchsorted(stops, heads)] + 1
            mark = np.where(np.isin(heads, first), "", " ").tolist()
            joined = [m + " ".join([pieces[c] for c in code[a:b].tolist()]) for a, b, m in zip(heads.tolist(), ends.tolist(), mark, strict=True)]
            at[heads] = self._opening(joined)
            at, units = at[begins], np.add.reduceat(begins.astype(np.int64), first)
        lengths, stops = self.length[at], np.cumsum(units)
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.start[at] - (ends - lengths), lengths) + np.arange(ends[-1])]
        return flat, np.diff(np.concatenate([[0], ends[stops - 1]]))


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def _forget_pieces() -> None:
    for one in _made.values():
        one.forget()


REMEMBERED.append(_forget_pieces)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def text_chunks(texts: pa.Array, most: int = 2_500_000):
    return in_chunks(pc.binary_length(texts).to_pylist(), most)
