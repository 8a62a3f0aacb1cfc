"""Exact token ids by the tokenizers library with a cache of the ids of text pieces.

The pre-tokenizers of the public files put a token boundary before every run of ASCII white space and wherever an ASCII
letter meets ASCII punctuation other than an apostrophe, so that the ids of a text are those of its pieces in a row.
Texts that hold the content of an added token, such as ``<|endoftext|>``, in any case of letters (a normalizer may lower
it), are encoded whole: the library takes it for that token. Pieces repeat, texts do not: a batch is cut and hashed with numpy, and the library sees each new piece once.
"""

from __future__ import annotations

import os
import re
import string
from itertools import chain

import numpy as np

from .common import WordHasher

#: White space beyond ASCII, before which a cut could change a token; texts that hold any of it are encoded whole.
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SLOTS = 1 << 20
_POOL = 1 << 23
_ENCODERS: dict[str, Encoder] = {}


def vocabulary_path(name: str) -> str:
    """The place of a public tokenizer's file; name may be a path of its own."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(chars)] = 1
    return table


class Encoder:
    """Token ids of whole texts, with a direct-mapped cache of bounded size (about 40 MB)."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.drops_space = self.tokenizer.normalizer is not None
        self.space = _bytes_table(b" \t\n\x0b\x0c\r").astype(bool)
        letters, marks = _bytes_table(string.ascii_letters.encode()), _bytes_table(string.punctuation.replace("'", "").encode())
        self.side = letters + 2 * marks
        self.powers = WordHasher()
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.start = np.zeros(_SLOTS, np.int32)
        self.length = np.zeros(_SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 20, self.kind), 0

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces stand in the pool, and how many they are."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter(chain.from_iterable(found), self.kind, int(lengths.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), self.kind)])
        at = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return at, lengths

    def _cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, the pieces' starts and ends, and the first piece of each text."""
        parts = [t.encode("utf-8", "replace") for t in texts]
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        raw = b"".join(parts)
        data = np.frombuffer(raw, np.uint8)
        space, side = self.space[data], self.side[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (space[1:] & ~space[:-1]) | (side[1:] + side[:-1] == 3) & (side[1:] != 0) & (side[:-1] != 0)
        if self.drops_space:
            cut[1:-1] |= space[:-1] & ~space[1:]
        cut[at] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        if self.drops_space:
            keep = ~space[starts]
            starts, ends = starts[keep], ends[keep]
        return raw, starts, ends, np.searchsorted(starts, at)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, starts, ends, first = self._cut(texts)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        hashes = self.powers.spans(raw, starts, ends)
        if self.used > _POOL:
            self._reset()
        slots = (hashes >> np.uint64(40)).astype(np.int64) & (_SLOTS - 1)
        at, lengths = self.start[slots].astype(np.int64), self.length[slots].astype(np.int64)
        missed = np.flatnonzero(self.keys[slots] != hashes)
        if len(missed):
            fresh, where, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
            own = missed[where]
            new_at, new_len = self._learn([raw[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            at[missed], lengths[missed] = new_at[which], new_len[which]
            self.keys[slots[own]], self.start[slots[own]], self.length[slots[own]] = fresh, new_at, new_len
        before = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        ids = self.pool[np.repeat(at - before[:-1], lengths) + np.arange(before[-1])]
        return ids, before[first]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row; those of text i are ids[offsets[i]:offsets[i + 1]]."""
        odd = [i for i, t in enumerate(texts) if self.added.search(t) or not self.drops_space and not t.isascii() and any(c in t for c in _WIDE)]
        if not odd:
            return self._encode(texts)
        alone = {i: self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in odd}
        ids, offsets = self._encode(["" if i in alone else t for i, t in enumerate(texts)])
        parts = [np.array(alone[i], self.kind) if i in alone else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def encoder(name: str) -> Encoder:
    """The worker's encoder of that vocabulary file, kept between tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(vocabulary_path(name))
    return _ENCODERS[name]
