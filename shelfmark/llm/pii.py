"""Personal data: fixed patterns, and spans that a linear-chain conditional random field adds.

The patterns find e-mail and IP addresses, card and phone numbers. The field labels the words of a
text as outside, as part of one of those four kinds, or as a person's name. Its features are
word shapes, read off the bytes in numpy: letter, digit and punctuation classes, lengths, ends,
cues of the two words before. It is trained on a small table of labelled sentences written out below from
templates, by gradient descent on the exact log likelihood (forward and backward in numpy),
and decoded by Viterbi for many texts side by side. Base spans always stay; a span of the field is added where
it overlaps none of them.

Every word of a text is scored. What a word adds to the scores, its own and its neighbours', is looked up by its class,
its shape and the cue it is. A word is an anchor where, whatever stands around it, no best labelling has it
inside: outside scores above every other label by more than all transitions can give back. The best labelling of the text
is then exactly that of the runs between anchors, which Viterbi decodes.

Spans are in code points, the end exclusive.

Defined results: null and empty texts have no spans; equal starts of one kind do not arise; repeated rows
get equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import tidied

KINDS = ("email", "ip", "card", "phone")
NAME = "name"

# The patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: IP without attempts inside a run of digits, which cannot match where its start does not.
_IP_ONCE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL, found from each @: one can only begin where the characters before its @ do."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP_ONCE.finditer(text) if all(len(p) < 4 or len(p.lstrip("0")) < 4 for p in m[0].split(".")) and all(int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
    return found


def joined(spans: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(spans.get(k, ())))


# --- the labelled table ------------------------------------------------------------

LABELS = ("outside", *KINDS, NAME)


def labelled_table(n: int = 1200, seed: int = 71) -> list[tuple[list[str], list[int]]]:
    """Sentences of words with a label each, made from templates and invented values."""
    rng = np.random.default_rng(seed)
    # Words of the templates.
    plain = "the of and to in is was for on with at from report item page order number value line total see text copy list note".split()
    first = "Anna Ben Clara David Emma Frank Grace Henry Iris Jonas Karin Lukas Maria Nora Oscar Paula Robert Sofia Thomas Vera".split()
    last = "Miller Smith Jones Weber Fischer Martin Garcia Lopez Silva Brown Taylor Moreau Bernard Wagner Keller Novak".split()
    name_cues = ("name", "Name:", "contact", "Mr.", "Mrs.", "Ms.", "Dr.", "Herr", "Frau", "Señor", "Madame")
    phone_cues, mail_cues = ("call", "phone", "Tel.", "phone:", "tel:", "mobile"), ("mail", "e-mail", "write", "Email:")
    ip_cues, card_cues = ("host", "server", "IP", "ip:"), ("card", "Card:", "visa", "account")
    digits = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    syllables = "er an th on re in ou de la en te ra mo li se".split()
    invented = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    pick = lambda words: str(rng.choice(words))

    def some(cue_words=()):
        words = [pick(plain) if rng.random() < 0.4 else invented() for _ in range(rng.integers(1, 7))]
        words = [w.capitalize() if rng.random() < 0.15 else w for w in words]
        words = [w + pick([",", "."]) if rng.random() < 0.15 else w for w in words]
        return [(w, 0) for w in words] + ([(pick(cue_words), 0)] if cue_words else [])

    out = []
    for _ in range(n):
        kind = rng.integers(0, 9)
        if kind == 0:
            body = some(mail_cues if rng.random() < 0.5 else ()) + [(f"{invented()}.{digits(2)}@mail{digits(1)}.example.com", 1)]
        elif kind == 1:
            body = some(ip_cues if rng.random() < 0.5 else ()) + [(".".join(str(x) for x in rng.integers(0, 256, 4)), 2)]
        elif kind == 2:
            parts = [digits(16)] if rng.random() < 0.5 else [digits(4) for _ in range(4)]
            body = some(card_cues) + [(p, 3) for p in parts]
        elif kind == 3:
            parts = [f"({digits(3)})", f"{digits(3)}-{digits(4)}"] if rng.random() < 0.5 else [digits(3), digits(3), digits(4)]
            body = some(phone_cues) + [(p, 4) for p in (["+" + digits(1)] if rng.random() < 0.5 else []) + parts]
        elif kind == 4:
            body = some(name_cues) + [(pick(first), 5), (pick(last), 5)]
        elif kind == 5:  # numbers that are no personal data
            body = some() + [(pick([digits(1) + ".", digits(4), digits(1) + "." + digits(1) + ".", digits(3) + "%", "v" + digits(1) + "." + digits(2)]), 0)]
        elif kind == 6:
            body = some() + [(pick(["***", "$$$", "%%%", "&&&", "!!!", "|", "#", "a+b", "@", "password=" + digits(8), "AKIA" + digits(8)]), 0)]
        else:
            body = some()
        body += some()
        out.append(([w for w, _ in body], [y for _, y in body]))
    return out


# --- features ----------------------------------------------------------------------

#: Words that announce a kind.
CUES = {
    "name": "name contact mr mrs ms dr herr frau señor madame",
    "phone": "call phone tel mobile telefon",
    "mail": "mail e-mail email write",
    "ip": "host server ip",
    "card": "card visa account konto",
}
_TRIM = ".,:;!?\"'()"


@lru_cache(maxsize=1)
def _cues() -> dict[str, int]:
    return {w: i for i, words in enumerate(CUES.values()) for w in words.split()}


def shape(word: str) -> list[int]:
    """Indices of the shape features of a word that is not plain."""
    core = word.strip(_TRIM)
    digits = sum(c in "0123456789" for c in word)
    letters = sum(c.isalpha() for c in word)
    out = [0]
    out.append(1 + min(digits, 17))  # 1..18
    out.append(20 + min(letters, 5))  # 20..25
    out.append(26 + min(word.count("."), 4))  # 26..30
    for i, c in enumerate("@+-()=%"):
        if c in word:
            out.append(31 + i)  # 31..37
    if core[:1].isupper() and core[1:].islower():
        out.append(38)
    if core.isupper() and len(core) > 1:
        out.append(39)
    if digits and digits == len(core):
        out.append(40)
    if "@" in core[1:-1] and "." in core.rpartition("@")[2].strip("."):
        out.append(41)
    parts = core.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts):
        out.append(42)
    if word[-1:] in ",.;:":
        out.append(43)
    return out


SHAPES, GROUPS = 44, len(CUES)
#: Feature blocks: the word's shape, its neighbours' shapes, cues one and two words before.
DIM = 3 * SHAPES + 2 * GROUPS


def features(words: list[str]) -> list[list[int]]:
    shapes = [shape(w) for w in words]
    cues = [_cues().get(w.strip(_TRIM).lower(), -1) for w in words]
    out = []
    for i, own in enumerate(shapes):
        f = list(own)
        if i:
            f += [SHAPES + k for k in shapes[i - 1]]
        if i + 1 < len(words):
            f += [2 * SHAPES + k for k in shapes[i + 1]]
        for back in (1, 2):
            if i >= back and cues[i - back] >= 0:
                f.append(3 * SHAPES + (back - 1) * GROUPS + cues[i - back])
        out.append(f)
    return out


class Field:
    """Weights of features by label, of neighbouring labels, and of a text's first label."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.emit, self.move, self.first = emit, move, first

    def scores(self, runs: list[list[list[int]]]) -> np.ndarray:
        """(words, labels) of all runs in a row."""
        flat = [f for run in runs for f in run]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        ids = np.fromiter((k for f in flat for k in f), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.emit[ids], np.cumsum(sizes) - sizes, axis=0)

    def viterbi(self, runs: list[list[list[int]]]) -> list[np.ndarray]:
        """The best labels of each run."""
        if not runs:
            return []
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        path = self.paths(self.scores(runs), length, np.tile(self.first, (len(runs), 1)), np.zeros((len(runs), len(LABELS))))
        return np.split(path, np.cumsum(length)[:-1])

    def paths(self, s: np.ndarray, length: np.ndarray, opening: np.ndarray, closing: np.ndarray) -> np.ndarray:
        """The best labels of runs of words in a row, with what each label adds as a run's first and last.

        All runs take a step together. Ties go to the smaller label.
        """
        begin = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        length, begin = length[order], begin[order]
        best = s[begin] + opening[order]
        back = np.zeros(s.shape, np.int8)
        steps = [begin[: int(np.searchsorted(-length, -t, side="left"))] + t for t in range(1, int(length[0]))]
        for at in steps:
            through = best[: len(at), :, None] + self.move[None]
            back[at] = through.argmax(axis=1)
            best[: len(at)] = through.max(axis=1) + s[at]
        path = np.empty(len(s), np.int8)
        path[begin + length - 1] = (best + closing[order]).argmax(axis=1)
        for at in reversed(steps):
            path[at - 1] = back[at, path[at]]
        return path


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=1)
def trained(epochs: int = 60, rate: float = 0.5, penalty: float = 1e-4) -> Field:
    """The field of the labelled table: full-batch AdaGrad on the log likelihood, sentences side by side."""
    table = labelled_table()
    k, n = len(LABELS), len(table)
    runs = [features(words) for words, _ in table]
    length = np.array([len(r) for r in runs])
    width = int(length.max())
    x = np.zeros((n, width, DIM), np.float32)
    y = np.zeros((n, width), np.int64)
    for i, (run, (_, labels)) in enumerate(zip(runs, table)):
        y[i, : len(labels)] = labels
        for t, f in enumerate(run):
            x[i, t, f] = 1
    live = np.arange(width)[None] < length[:, None]
    field = Field(np.zeros((DIM, k)), np.zeros((k, k)), np.zeros(k))
    parameters = [field.emit, field.move, field.first]
    squares = [np.full_like(p, 1e-8) for p in parameters]
    rows = np.arange(n)
    for _ in range(epochs):
        s = x @ field.emit.astype(np.float32)
        forward = np.zeros((n, width, k))
        backward = np.zeros((n, width, k))
        forward[:, 0] = s[:, 0] + field.first
        for t in range(1, width):
            step = _log_sum(forward[:, t - 1, :, None] + field.move[None], 1) + s[:, t]
            forward[:, t] = np.where(live[:, t, None], step, forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = _log_sum(field.move[None] + (s[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(live[:, t + 1, None], step, 0)
        total = _log_sum(forward[rows, length - 1], 1)
        node = np.exp(forward + backward - total[:, None, None]) * live[..., None]
        wrong = node.copy()
        wrong[rows[:, None], np.arange(width)[None], y] -= live
        g_emit = np.einsum("ntd,ntk->dk", x, wrong)
        g_move = np.zeros((k, k))
        for t in range(1, width):
            edge = np.exp(forward[:, t - 1, :, None] + field.move[None] + (s[:, t] + backward[:, t])[:, None, :] - total[:, None, None])
            g_move += (edge * live[:, t, None, None]).sum(axis=0)
            np.add.at(g_move, (y[:, t - 1][live[:, t]], y[:, t][live[:, t]]), -1)
        for p, g, q in zip(parameters, (g_emit, g_move, wrong[:, 0].sum(axis=0)), squares):
            g = g / n + penalty * p
            q += g * g
            p -= rate * g / np.sqrt(q)
    return field


# --- decoding whole texts ------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words that a task remembers, bytes of such a word, and classes, at most; bytes split, and words scored, at a time.
WORDS, SHORT, CLASSES, PIECE, CHUNK = 200_000, 64, 50_000, 1 << 20, 1 << 16


class Classes(dict):
    """The class of each word (UTF-8): all words of one shape and cue score alike. 0 is no word, to either side of a text."""

    def __init__(self, field: Field):
        self.field, self.ids = field, {}
        none = np.zeros((4, len(LABELS)))
        #: By class: what a word adds to its own scores, to those of the word after it, of the second after it, of the one before it.
        self.added = [none]

    def __missing__(self, raw: bytes) -> int:
        word, emit = raw.decode(), self.field.emit
        own, cue = shape(word), _cues().get(word.strip(_TRIM).lower(), -1)
        key = (tuple(own), cue)
        if key not in self.ids:
            own, none = np.array(own), np.zeros(len(LABELS))
            ahead = [emit[3 * SHAPES + k * GROUPS + cue] if cue >= 0 else none for k in range(2)]
            self.ids[key] = len(self.added)
            self.added.append(np.stack([emit[own].sum(axis=0), emit[SHAPES + own].sum(axis=0) + ahead[0], ahead[1], emit[2 * SHAPES + own].sum(axis=0)]))
        if len(raw) <= SHORT:
            if len(self) >= WORDS:
                self.clear()
            self[raw] = self.ids[key]
        return self.ids[key]

    def of(self, text: str) -> list[np.ndarray]:
        """The classes of all words of a text, split piece by piece."""
        raw, out, a = text.encode(), [], 0
        while a < len(raw):
            space = _SPACE.search(raw, a + PIECE)
            b = space.start() if space else len(raw)
            words = raw[a:b].split()  # bytes part at ASCII white space alone
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            a = b
        return out


def labelled_words(texts: list[str], classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and label of each word that the best labelling of its text does not leave outside, in order."""
    field, gap = classes.field, np.zeros(2, np.int32)
    parts, begin, n = [gap], [], 2
    for text in texts:
        begin.append(n)
        own = classes.of(text)
        parts += [*own, gap]
        n += sum(map(len, own)) + 2
    ids = np.concatenate(parts)
    own, after, second, before = np.stack(classes.added, axis=1)
    # the most by which a label can be ahead of outside before a word is scored, and must not be behind it for what follows
    rise = (field.move - field.move[:, :1]).max(axis=0)
    bound = (field.move[:1] - field.move).min(axis=1)
    at, scores, opens, closes = [], [], [], []
    for lo in range(2, n - 2, CHUNK):
        hi = min(lo + CHUNK, n - 2)
        s = own[ids[lo:hi]] + after[ids[lo - 1 : hi - 1]] + second[ids[lo - 2 : hi - 2]] + before[ids[lo + 1 : hi + 1]]
        opening, closing = ids[lo - 1 : hi - 1] == 0, ids[lo + 1 : hi + 1] == 0
        ahead = s - s[:, :1] + np.where(opening[:, None], field.first - field.first[0], rise) - np.where(closing[:, None], 0, bound)
        loose = np.flatnonzero((ids[lo:hi] != 0) & (ahead[:, 1:].max(axis=1) > -1e-9))
        at.append(loose + lo)
        scores.append(s[loose])
        opens.append(opening[loose])
        closes.append(closing[loose])
    none = np.zeros(0, np.int64)
    at = np.concatenate([none, *at])
    if not len(at):
        return none, none, none
    first = np.flatnonzero(np.append(True, np.diff(at) > 1))
    length = np.diff(np.append(first, len(at)))
    opening = np.where(np.concatenate(opens)[first][:, None], field.first, field.move[0])
    closing = np.where(np.concatenate(closes)[first + length - 1][:, None], 0, field.move[:, 0])
    path = field.paths(np.concatenate(scores), length, opening, closing)
    at, label = at[path > 0], path[path > 0]
    text = np.searchsorted(begin, at, side="right") - 1
    return text, at - np.array(begin, np.int64)[text], label


def windows(text: str):
    """Runs of words that are labelled together, as spans of the words: all words of the text are one run."""
    yield (m.span() for m in _WORD.finditer(text))


def added_spans(texts: list[str], base: list[dict], field: Field, classes: Classes | None = None) -> list[dict]:
    """Spans that the field adds to the base spans of each text, by kind."""
    out: list[dict] = [{} for _ in texts]
    text, place, label = (x.tolist() for x in labelled_words(texts, Classes(field) if classes is None else classes))
    k = 0
    while k < len(text):
        i, spans = text[k], enumerate(w for run in windows(texts[text[k]]) for w in run)
        taken = sorted(x for kind in base[i].values() for x in kind)
        starts, reach = [p for p, _ in taken], list(accumulate((q for _, q in taken), max))
        while k < len(text) and text[k] == i:
            a, b = next(w for n, w in spans if n == place[k])
            last = k
            while last + 1 < len(text) and text[last + 1] == i and place[last + 1] == place[last] + 1 and label[last + 1] == label[k]:
                last += 1
                b = next(spans)[1][1]
            while b > a and texts[i][b - 1] in ".,:;!?\"'":
                b -= 1
            while a < b and texts[i][a] in ".,:;!?\"'":
                a += 1
            met = bisect_left(starts, b)
            if b > a and not (met and reach[met - 1] > a):
                out[i].setdefault(LABELS[label[k]], []).append((a, b))
            k = last + 1
    return out


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    spans holds base spans and those the field adds, by kind (names last) and start.
    """

    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def rows(batches):
        field = sent.value
        classes = Classes(field)
        for batch in batches:
            names, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 500):
                some = texts[lo : lo + 500]
                base = [base_spans(x) for x in some]
                if len(classes.added) > CLASSES:
                    classes = Classes(field)
                added = added_spans(some, base, field, classes)
                digest = [hashlib.sha256(joined(b, KINDS).encode()).hexdigest() for b in base]
                every = [joined({k: b.get(k, []) + a.get(k, []) for k in (*KINDS, NAME)}, (*KINDS, NAME)) for b, a in zip(base, added)]
                counts = {f"n_{k}": pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS}
                columns = {"doc_id": names[lo : lo + len(some)], **counts, "base_sha256": pa.array(digest), "spans": pa.array(every)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(tidied(rows), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
