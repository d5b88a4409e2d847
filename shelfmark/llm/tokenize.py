"""Whole texts to token ids through the tokenizers library, each distinct word once.

A text may be cut before a single space or newline that stands between two characters that
surely are no white space: the pre-tokenizers of the files here never join what such a cut
parts, nor look across it. Equal pieces have equal ids, so the library sees each distinct
piece once for as long as it stays in the cache, and the ids of a text are gathered from there. The
result is that of encoding the whole text; a test holds it against the library.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

#: Bytes that the distinct pieces held may take, about; when full the cache starts anew.
CACHE, ENTRY = 150 << 20, 200

#: Bytes of text that are looked at together; more of them share their distinct pieces.
RUN = 8 << 20
#: Pieces that are encoded in one call.
GROUP, TOGETHER = 200, 16
#: Bytes of which a joined piece may consist: no white space and no lead byte of any.
_PLAIN = bytes(i for i in range(256) if i not in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3))

#: Bytes of lower-case text of ASCII and of U+00DF to U+00FF, which normalizers here leave as it is.
_SAME = bytes([i for i in range(128) if i not in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32) and not 65 <= i <= 90] + [0xC3, *range(0x9F, 0xC0)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# byte classes: 0 ASCII that is no white space, 1 ASCII white space or separators, 2 leads that may
# begin white space, 3 leads of two-byte letters, 4 other leads, 5 continuation
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1
_CLASS[0x80:0xC0] = 5
_CLASS[0xC0:0xE0] = 3
_CLASS[0xE0:] = 4
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = 2


def cuts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Starts of the pieces of a run of texts, and its end. Empty texts have no piece."""
    n = len(data)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at >= 2) & (at + 1 < n)]
    kind = _CLASS[data]
    before, after = kind[at - 1], kind[at + 1]
    good = ((before == 0) | ((before == 5) & (kind[at - 2] == 3))) & ((after == 0) | (after == 3) | (after == 4))
    begins = np.zeros(n + 1, bool)
    begins[at[good]] = True
    begins[offsets] = True
    begins[n] = n > 0
    return np.flatnonzero(begins)


class Encoder:
    """Ids of texts under one tokenizer file, without added special tokens."""

    def __init__(self, path: str, cache: int = 0):
        self.most = cache or CACHE
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # normalizers here turn white space into one space, which the pre-tokenizer then drops
        self.normalizer = self.tokenizer.normalizer
        self.bare = self.tokenizer
        if self.normalizer is not None:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # byte-level: a character stands for a byte
            self.width[i] = len(token) - 4 if self.normalizer and token.endswith("</w>") and len(token) > 4 else len(token)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)

    def _learn(self, new: list[bytes]) -> None:
        new, ids, sizes = self._encode(new)
        total, first = len(ids), len(self.known)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(new) > len(self.start):
            self.start, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size))
        self.pool[self.used : self.used + total] = ids
        self.start[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(new)] = sizes
        self.known.update(zip(new, range(first, first + len(new))))
        self.used += total

    def _encode(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The pieces, put in another order, their ids in a row and how many each has.

        Pieces that begin with their cut and hold no other white space are encoded joined, many in
        one call, and told apart by the bytes that each id stands for; others go one by one.
        """
        done: list[bytes] = []
        ids, sizes = [], []
        plain, alone = [], []
        for x in pieces:
            (plain if x[:1] in (b" ", b"\n") and not x[1:].translate(None, _PLAIN) else alone).append(x)
        if self.normalizer is None:
            same, other = plain, []
        else:
            same, other = [], []
            for x in plain:
                (other if x[1:].translate(None, _SAME) else same).append(x)
        groups = [kind[i : i + GROUP] for kind in (same, other) for i in range(0, len(kind), GROUP)]
        texts = [b"".join(group).decode() for group in groups]
        easy = -(-len(same) // GROUP)
        for at, (group, text, e) in enumerate(zip(groups, texts, self._encodings(texts, easy))):
            found = np.array(e.ids, np.int32)
            if at < easy:
                widths = np.fromiter(map(len, group), np.int64, len(group)) - (self.normalizer is not None)
            else:
                raw = np.frombuffer(self.normalizer.normalize_str(text).encode(), np.uint8)
                widths = np.diff(np.append(np.flatnonzero(raw == 32), len(raw))) - 1
            ends, upto = np.cumsum(widths), np.cumsum(self.width[found])
            last = np.searchsorted(upto, ends)
            if len(widths) != len(group) or not len(found) or last[-1] != len(found) - 1 or (upto[last] != ends).any():
                alone += group  # cannot be told apart
                continue
            done += group
            ids.append(found)
            sizes.append(np.diff(last, prepend=-1))
        for e in self.tokenizer.encode_batch_fast([x.decode() for x in alone], add_special_tokens=False):
            ids.append(np.array(e.ids, np.int32))
            sizes.append(np.array([len(e.ids)], np.int64))
        return done + alone, np.concatenate(ids), np.concatenate(sizes)

    def _encodings(self, texts: list[str], easy: int):
        """Encodings of the texts, a few at a time: each holds far more than its ids."""
        for part, tokenizer in ((texts[:easy], self.bare), (texts[easy:], self.tokenizer)):
            for i in range(0, len(part), TOGETHER):
                yield from tokenizer.encode_batch_fast(part[i : i + TOGETHER], add_special_tokens=False)

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a run in a row, and where each text's begin (and the end)."""
        at = cuts(offsets, data)
        if len(at) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.normalizer is not None and b"<|" not in data.tobytes():
            # the normalizer lower-cases and makes a newline a space; special strings come before it
            data = _LOWER[data]
            data[at[:-1][data[at[:-1]] == 10]] = 32
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        known = self.known
        new = [x for x in distinct if x not in known]
        more = sum(map(len, new)) + ENTRY * len(new)
        if new and self.held + more > self.most:
            self._clear()
            known, new = self.known, distinct
            more = sum(map(len, new)) + ENTRY * len(new)
        if new:
            self.held += more
            self._learn(new)
        # a run's ids and the pool's places fit 32 bits, as a run's bytes do
        entry = np.fromiter(map(known.__getitem__, distinct), np.int32, len(distinct))[pieces.indices.to_numpy()]
        del pieces, distinct
        size = self.size[entry]
        upto = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=upto[1:])
        where = np.repeat(self.start[entry] - upto[:-1], size)
        where += np.arange(upto[-1], dtype=np.int32)
        return self.pool[where], upto[np.searchsorted(at, offsets)].astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache: int = 0) -> Encoder:
    """This process's encoder of a file; its cache lives on from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, cache)
    return _ENCODERS[path]


def forget(path: str) -> None:
    """Drop a file's encoder and its cache."""
    _ENCODERS.pop(path, None)


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
