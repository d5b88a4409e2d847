"""Exact token counts by compiled finite-state transducers, without encoding.

Two transducers stand for a byte-level BPE tokenizer file.

* The splitter reads character classes and annotates each transition with the pieces that begin at
  the character or the one before it. Texts of a batch form one stream, each closed by an
  end symbol. The stream is cut into chunks; a chunk is a map from each state to the state it leads
  to; the maps compose by a parallel prefix scan, and then all chunks run side by side from
  their true states.
* The counter reads the bytes of a piece; each transition is annotated with the change of the piece's
  token count. Its states are what can matter later: the suffixes of the input that may still
  grow into a token, and for each the last token before it and the tokens since. That an
  encoding is right if each two neighbours are makes these states finite in number. States and transitions are
  compiled when first met and kept in a hash table for all later texts; distinct pieces of a batch
  run through the table side by side. A very long piece is cut into chunks that run side by side too, from
  states foreseen by the bytes before them; their maps compose where the states meet, and the others run again.

The classes of characters are probed from the library, so that they are those of its Unicode version.

Defined results: null and empty texts have 0 bytes and 0 tokens; the file's special strings inside a text
count as the special token, as the library's default has it; repeated rows each have a row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import text_slices, tidied

#: Bytes of text that a task looks at together; more of them share their distinct pieces.
RUN = 4 << 20
#: Bytes beyond which a single piece is cut into chunks, of a chunk, and that are read ahead of one.
LONG, PART, LEAD = 4_096, 512, 128

# --- the splitter ----------------------------------------------------------------

#: The contractions of the pre-tokenizer's pattern are 's 't 'm 'd, 're 've and 'll.
CLASSES = ("short", "rv", "l", "e", "letter", "number", "space", "white", "quote", "other", "end")
SHORT, RV, ELL, E, LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(11)
STATES = ("closed", "letters", "numbers", "others", "space", "white", "more-space", "more-white", "quote", "quote-rv", "quote-l")
CLOSED, LETTERS, NUMBERS, OTHERS, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, QUOTED, QUOTED_RV, QUOTED_L = range(11)
HERE, BEFORE = 1, 2  # a piece begins at this character, at the one before
CHUNK = 64


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and where pieces begin."""
    letter = kind <= LETTER
    white = kind in (SPACE, WHITE)
    if kind == END:
        return CLOSED, HERE | (BEFORE if state in (QUOTED_RV, QUOTED_L) else 0)
    if state in (QUOTED_RV, QUOTED_L):
        if kind == (E if state == QUOTED_RV else ELL):
            return CLOSED, 0
        after, begins = _step(LETTERS, kind)  # the quote stood alone and the letter began a piece
        return after, begins | BEFORE
    if white:
        if state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
            return (MORE_SPACE if kind == SPACE else MORE_WHITE), 0
        return (ONE_SPACE if kind == SPACE else ONE_WHITE), HERE
    plain = LETTERS if letter else NUMBERS if kind == NUMBER else OTHERS
    if state in (ONE_SPACE, MORE_SPACE):  # the last space joins what follows
        return plain, BEFORE if state == MORE_SPACE else 0
    if state == MORE_WHITE:
        return (QUOTED if kind == QUOTE else plain), HERE | BEFORE
    if state == QUOTED:
        if kind == SHORT:
            return CLOSED, 0
        if kind == RV:
            return QUOTED_RV, 0
        if kind == ELL:
            return QUOTED_L, 0
        return plain, 0 if plain == OTHERS else HERE
    if state == plain:
        return plain, 0
    return (QUOTED if kind == QUOTE else plain), HERE


_TABLE = [[_step(s, k) for s in range(len(STATES))] for k in range(len(CLASSES))]
NEXT = np.array([[x[0] for x in row] for row in _TABLE], np.uint8)  # [class, state]
BEGIN = np.array([[x[1] for x in row] for row in _TABLE], np.uint8)


def state_maps(kinds: np.ndarray) -> np.ndarray:
    """For each chunk (row of kinds) the state it leads to from every state."""
    flat, width = NEXT.ravel(), len(STATES)
    maps = np.tile(np.arange(width, dtype=np.uint8), (len(kinds), 1))
    for j in range(kinds.shape[1]):
        maps = flat[(kinds[:, j].astype(np.uint16) * width)[:, None] + maps]
    return maps


def prefix_states(maps: np.ndarray, first: int = CLOSED) -> np.ndarray:
    """The state in which each chunk begins: maps composed by a scan in log2(chunks) rounds."""
    maps, shift = maps.copy(), 1
    while shift < len(maps):
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), axis=1)
        shift *= 2
    return np.concatenate([[first], maps[:-1, first]]).astype(np.uint8)


def begins(kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin in a stream of classes; end symbols count as pieces."""
    n = len(kinds)
    rows = np.full((-(-n // CHUNK), CHUNK), END, np.uint8)
    rows.ravel()[:n] = kinds
    state = prefix_states(state_maps(rows))
    out = np.zeros(rows.shape, np.uint8)
    next_, begin, width = NEXT.ravel(), BEGIN.ravel(), len(STATES)
    for j in range(CHUNK):
        at = rows[:, j].astype(np.uint16) * width + state
        out[:, j] = begin[at]
        state = next_[at]
    out = out.ravel()[:n]
    found = (out & HERE) != 0
    found[:-1] |= (out[1:] & BEFORE) != 0
    return np.flatnonzero(found)


@lru_cache(maxsize=4)
def character_classes(path: str) -> bytes:
    """The class of each code point, probed from the library's pre-tokenizer."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer
    kinds = np.full(0x110000, OTHER, np.uint8)
    blocks = [b for b in range(0, 0x110000, 0x4000) if (b < 0x40000 or 0xE0000 <= b < 0xF0000) and not 0xD800 <= b < 0xE000]
    for low in blocks:
        points = [p for p in range(low, low + 0x4000) if not 0xD800 <= p < 0xE000]
        single = np.array(points)
        apart = []
        for mark in "a1!":  # a character that does not begin a piece between two marks is of their kind
            text = "".join(f"{mark}{chr(p)}{mark}\n" for p in points)
            first = np.zeros(len(text) + 1, bool)
            first[[at[0] for _, at in split.pre_tokenize_str(text)]] = True
            apart.append(first[1 : 4 * len(points) : 4])
        kinds[single] = np.select([~apart[0], ~apart[1], ~apart[2]], [LETTER, NUMBER, OTHER], WHITE)
    for kind, letters in ((SHORT, "stmd"), (RV, "rv"), (ELL, "l"), (E, "e"), (SPACE, " "), (QUOTE, "'")):
        kinds[[ord(c) for c in letters]] = kind
    return kinds.tobytes()


# --- the counter -----------------------------------------------------------------


@lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The lazily compiled transducer of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE file")
        letters = _byte_letters()
        self.specials = [x["content"].encode() for x in spec["added_tokens"]]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        #: Trie of the tokens: children by (node, byte), the node's token, whether it has children.
        self.child: dict[tuple[int, int], int] = {}
        self.token: list[str | None] = [None]
        self.inner: list[bool] = [False]
        special = {x["content"] for x in spec["added_tokens"]}
        for text in model["vocab"]:
            if text in special:
                continue
            node = 0
            for c in text:
                key = (node, letters[c])
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(None)
                    self.inner[node] = True
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = text
        self.fits: dict[tuple[str, str], bool] = {}
        start = ((0, "", 0),)
        self.number = {start: 0}
        self.states = [start]
        self._grow(1 << 16)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Byte-pair merges: again and again the leftmost pair of lowest rank."""
        rank = self.rank
        while len(symbols) > 1:
            ranks = [rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _fit(self, a: str, b: str) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes."""
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = self._merge(list(a + b)) == [a, b]
        return self.fits[key]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the count."""
        grown, found, change = [], None, 0
        for node, last, since in self.states[state]:
            node = self.child.get((node, byte))
            if node is None:
                continue
            if found is None and self.token[node] is not None and (not last or self._fit(last, self.token[node])):
                found, change = self.token[node], 1 - since
            if self.inner[node]:
                grown.append((node, last, since))
        if found is None:
            raise ValueError("the vocabulary does not hold every byte")
        after = (*((node, last, since + change) for node, last, since in grown), (0, found, 0))
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        return self.number[after], change

    # the transitions, an open-addressing table: key = state * 256 + byte

    def _grow(self, size: int) -> None:
        old = getattr(self, "keys", None), getattr(self, "to", None), getattr(self, "change", None)
        self.keys = np.full(size, -1, np.int64)
        self.to, self.change = np.zeros(size, np.int32), np.zeros(size, np.int16)
        self.held, self.mask = 0, size - 1
        if old[0] is not None:
            used = old[0] >= 0
            for k, t, c in zip(old[0][used].tolist(), old[1][used].tolist(), old[2][used].tolist()):
                self._put(k, t, c)

    def _slot(self, keys):
        return ((keys * 0x2545F4914F6CDD) >> 20) & self.mask

    def _put(self, key: int, to: int, change: int) -> None:
        at = (((key * 0x2545F4914F6CDD + (1 << 63)) % (1 << 64) - (1 << 63)) >> 20) & self.mask
        while self.keys[at] >= 0:
            at = (at + 1) & self.mask
        self.keys[at], self.to[at], self.change[at] = key, to, change
        self.held += 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; compiles the transitions that are new."""
        at = self._slot(keys)
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            empty = self.keys[at[wrong]] < 0
            if empty.any():
                for key in set(keys[wrong[empty]].tolist()):
                    self._put(key, *self._compile(key >> 8, key & 255))
                if self.held * 2 > len(self.keys):
                    self._grow(2 * len(self.keys))
                return self._find(keys)
            at[wrong] = (at[wrong] + 1) & self.mask
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return at

    #: States held between batches; beyond them compilation starts anew.
    MOST = 600_000

    def counts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Tokens of each byte string."""
        if len(self.states) > self.MOST:
            start = self.states[0]
            self.number, self.states, self.keys = {start: 0}, [start], None
            self._grow(1 << 16)
        sizes = np.diff(offsets)
        _, total = self._run(data, offsets[:-1], sizes, np.zeros(len(sizes), np.int64), LONG)
        for i in np.flatnonzero(sizes > LONG).tolist():
            total[i] = self._composed(data[offsets[i] : offsets[i + 1]])
        return total

    def _run(self, data: np.ndarray, start: np.ndarray, sizes: np.ndarray, state: np.ndarray, most: int | None = None):
        """States and counts after the byte strings, side by side from their states; those longer than `most` are left out."""
        order = np.argsort(-sizes, kind="stable")
        if most is not None:
            order = order[int((sizes > most).sum()) :]
        begin, length, now = start[order], sizes[order], state[order]
        total = np.zeros(len(order), np.int64)
        live = len(order)
        for j in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length[:live], -j, side="left"))  # those longer than j
            at = self._find(now[:live] * 256 + data[begin[:live] + j])
            now[:live] = self.to[at]
            total[:live] += self.change[at]
        after, counted = state.copy(), np.zeros(len(sizes), np.int64)
        after[order], counted[order] = now, total
        return after, counted

    def _composed(self, data: np.ndarray) -> int:
        """The count of one long piece: its chunks run side by side, each as the map of one state.

        A chunk's state is foreseen by reading the bytes before it, from which the transducer nearly always falls
        into step. The maps compose where each begins with the state in which the one before it ends;
        chunks that do not are run again from that state, until all fit.
        """
        start = np.arange(0, len(data), PART)
        sizes = np.minimum(PART, len(data) - start)
        lead = np.minimum(start, LEAD)
        entry, _ = self._run(data, start - lead, lead, np.zeros(len(start), np.int64))
        after, total = self._run(data, start, sizes, entry)
        while True:
            wrong = np.flatnonzero(after[:-1] != entry[1:]) + 1
            if not len(wrong):
                return int(total.sum())
            entry[wrong] = after[wrong - 1]
            after[wrong], total[wrong] = self._run(data, start[wrong], sizes[wrong], entry[wrong])


_COUNTERS: dict[str, Counter] = {}


def count_run(counter: Counter, kinds: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Tokens of each text of a run."""
    n = len(offsets) - 1
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each character begins
    kind = kinds[points]
    extra = np.zeros(n, np.int64)
    for special in counter.specials:  # each stands for one token and closes what is before it
        at = raw.find(special)
        while at >= 0:
            doc = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(special) <= offsets[doc + 1]:
                extra[doc] += 1
                kind[np.searchsorted(lead, at) : np.searchsorted(lead, at + len(special))] = END
                at = raw.find(special, at + len(special))
            else:
                at = raw.find(special, at + 1)
    ends = np.searchsorted(lead, offsets[1:])  # characters before each text's end
    owner = np.repeat(np.arange(n), np.diff(np.append(0, ends)))
    stream = np.full(len(points) + n, END, np.uint8)
    place = np.arange(len(points)) + owner
    stream[place] = kind
    byte = np.empty(len(stream) + 1, np.int64)
    byte[place] = lead
    byte[ends + np.arange(n)] = offsets[1:]
    byte[-1] = len(data)
    text = np.empty(len(stream), np.int64)
    text[place] = owner
    text[ends + np.arange(n)] = np.arange(n)
    at = begins(stream)
    real = stream[at] != END
    first, last = byte[at], byte[np.append(at[1:], len(stream))]
    first, last, owner = first[real], last[real], text[at[real]]
    if not len(first):
        return extra
    # pieces that lie side by side share offsets; special strings leave gaps, so cut the bytes anew
    if (first[1:] != last[:-1]).any():
        keep = np.concatenate([np.arange(a, b) for a, b in zip(first, last)]) if len(first) else first
        data = data[keep]
        cut = np.append(0, np.cumsum(last - first))
    else:
        data, cut = data[first[0] : last[-1]], np.append(first, last[-1]) - first[0]
    pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    distinct = pieces.dictionary
    _, distinct_at, distinct_data = distinct.buffers()
    counts = counter.counts(np.frombuffer(distinct_at, np.int64)[: len(distinct) + 1], np.frombuffer(distinct_data, np.uint8))
    found = np.bincount(owner, weights=counts[pieces.indices.to_numpy()], minlength=n)
    return found.astype(np.int64) + extra


def count(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    sent = docs.sparkSession.sparkContext.broadcast(character_classes(path))  # a byte a code point

    def rows(batches):
        kinds = np.frombuffer(sent.value, np.uint8)
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            for lo, hi, offsets, data in text_slices(batch.column(1), RUN):
                found = count_run(counter, kinds, offsets, data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(np.diff(offsets)), pa.array(found), pa.array(found > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(tidied(rows), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
