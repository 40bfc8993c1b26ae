r"""Personal data: fixed patterns, and a linear-chain field over word shapes.

**Base spans** are the leftmost non-overlapping matches of one pattern per kind; a
match that fails its kind's test (part above 255, checksum, number of digits) is
dropped with the text it took up. Every pattern is entered only where it can begin (an
at sign, a plus, the first digit of a run), so a text is read in linear time
whatever runs it holds.

**The field** adds what the patterns lose: a number that a greedy match has run into,
a phone number without a plus, an address in other than ASCII letters. A text is a
chain of words (runs of anything but ASCII white space). A word is known by its shape
(runs of capitals, small letters and digits, signs as they are, with the length of
runs of digits) and a few tests of it; the features of a place are those of its word
and of its neighbours' shapes. Labels say that a word begins or continues a span
of a kind, or neither. A word without a digit or an at sign, or of more than
``LONGEST`` bytes, is always neither. Weights are fitted to a small labelled table by gradient ascent on
the exact conditional likelihood (forward and backward sums over padded chains).

**Decoding** is Viterbi, in numpy, over many stretches at once: between two words that
can only be neither, a chain is cut, and the best path of the whole text is the best
paths of its stretches. Prose is passed over without looking at its words.

Spans of the field lose the signs around them, must pass an exact test of their kind and
must not touch a base span. Spans are code points, end exclusive.

Defined cases: a null text is empty and has no spans; each repeated row is scanned; a
text is scanned whole whatever its length; an empty table gives no rows; only the
named columns are read; without labelled rows the field adds nothing.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Emitter, PieceCache, groups, raw_texts, worker_state
from .personal_examples import EXAMPLES

# The kinds in their order, the base patterns, bounds of the tests.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)

#: Spans of the field: least and most digits of a phone number; signs cut off.
LOOSE_PHONE = (9, 15)
BEFORE, AFTER = "\"'<[{,;:=*|", "\"'>]},;:.!?*|"
#: Fit: epochs, step, ridge. Words in a generation of a worker's cache.
EPOCHS, RATE, RIDGE = 150, 0.1, 2e-3
CACHE_WORDS, MOST_CLASSES, LONGEST = 50_000, 20_000, 400
N_LABELS = 1 + 2 * len(KINDS)          # neither; begins, continues each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _within(n: int, bounds: tuple[int, int]) -> bool:
    return bounds[0] <= n <= bounds[1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start and then kind."""
    found = []
    at = text.find("@")
    free = 0                            # end of the last address
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((start, 0, host.end()))
        free = host.end() if host else at
        at = text.find("@", max(free, at + 1))
    for m in IP.finditer(text):
        if all(len(p) < 20 and int(p) <= 255 for p in map(_short, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 2 * CARD_DIGITS[1]:
            number = digits_of(m[0])
            if _within(len(number), CARD_DIGITS) and luhn(number):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if _within(sum(map(m[0].count, "0123456789")), PHONE_DIGITS):
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _short(part: str) -> str:
    """A number without its leading zeros."""
    return part.lstrip("0") or "0"


# ---- word shapes -------------------------------------------------------------------

_RUN = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^\x00-\x7f]+|.", re.DOTALL)
PLAIN = "a"


def shape(word: str) -> str:
    """Runs of small letters as a, of capitals as A, of other than ASCII as x, of
    digits as 9 and their number (up to 20); signs as they are. At most twelve runs."""
    out = []
    for run in _RUN.findall(word[:400])[:12]:
        c = run[0]
        if c.isdigit() and c < "\x80":
            out.append(f"9{min(len(run), 20)}")
        elif "a" <= c <= "z":
            out.append("a")
        elif "A" <= c <= "Z":
            out.append("A")
        else:
            out.append("x" if c > "\x7f" else c)
    # letters run together: names in any alphabet look alike
    return re.sub(r"[aAx]{2,}", "a", "".join(out))


def trimmed(word: str) -> tuple[int, int]:
    """Start and end of a word without the signs around it; brackets stay in pairs."""
    start, end = 0, len(word)
    while start < end and (word[start] in BEFORE
                           or word[start] == "(" and ")" not in word[start:end]):
        start += 1
    while end > start and (word[end - 1] in AFTER
                           or word[end - 1] == ")" and "(" not in word[start:end]):
        end -= 1
    return start, end


def possible(word: str) -> bool:
    """Whether a word can belong to a span."""
    return bool(re.search("[0-9@]", word)) and len(word.encode()) <= LONGEST


def own_features(word: str) -> list[str]:
    """Features of a possible word by itself: its shape and tests of it."""
    start, end = trimmed(word)
    core = word[start:end]
    number = digits_of(core)
    if number and re.search("[A-Za-z]", core) and not re.search("[@:]", core):
        return ["any", "mixed"]
    found = ["any", "shape=" + shape(core), f"digits={min(len(number), 20)}"]
    if number and len(number) == len(core):
        found.append("whole")
    found += [f"has={c}" for c in "@+().-:/=_%" if c in core]
    if core[:1] == "+":
        found.append("plus")
    if core[:2] == "00":
        found.append("zeros")
    if core.count("@") == 1 and "." in core.split("@")[1].strip("."):
        found.append("address")
    if _within(len(number), CARD_DIGITS) and luhn(number) and not re.search("[^0-9 -]", core):
        found.append("checks")
    if _is_ip(core):
        found.append("ip")
    return found


def near_features(word: str) -> list[str]:
    """What a possible word shows to its neighbours."""
    start, end = trimmed(word)
    core = word[start:end]
    number = digits_of(core)
    kind = "whole" if number and len(number) == len(core) else "broken"
    return [f"near={kind}{min(len(number), 12)}", "plus" if core[:1] == "+" else "noplus",
            *(["bracket"] if "(" in core else []),
            *(["mixed"] if re.search("[A-Za-z]", core) else []),
            *(["stop"] if end < len(word) else [])]


#: What the end of a text, and any word that cannot belong to a span, show.
EDGE, WORD = ["edge"], ["word"]


def _is_ip(text: str) -> bool:
    if text.count(".") != 3 and text.count(":") < 2:
        return False
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return len(text) > 4


def fits(kind: int, text: str) -> bool:
    """Exact test of a span of the field."""
    number = digits_of(text)
    if kind == 0:
        left, _, right = text.partition("@")
        return bool(left) and "@" not in right and "." in right.strip(".")
    if kind == 1:
        return _is_ip(text)
    if kind == 2:
        return _within(len(number), CARD_DIGITS) and luhn(number)
    return _within(len(number), LOOSE_PHONE) and not re.search(r"[^0-9+()./\x20-]", text)


# ---- the field ---------------------------------------------------------------------

def features(words: list[str]) -> list[list[str]]:
    """Features of every place of a chain; none of a word that is always neither."""
    can = [possible(w) for w in words]
    near = [EDGE, *(near_features(w) if c else WORD for w, c in zip(words, can)), EDGE]
    return [["0" + f for f in own_features(w)] + ["-" + f for f in near[i]]
            + ["+" + f for f in near[i + 2]] if c else []
            for i, (w, c) in enumerate(zip(words, can))]


def parsed(example: str) -> tuple[list[str], list[int]]:
    """Words and labels of a labelled line: ``{kind|words}`` marks a span."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"\{(\w+)\|([^}]*)\}", example):
        text += example[at:m.start()]
        spans.append((len(text), len(text) + len(m[2]), 1 + 2 * KINDS.index(m[1])))
        text, at = text + m[2], m.end()
    text += example[at:]
    words, labels = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        label = 0
        for start, end, begins in spans:
            if m.start() < end and start < m.end():
                label = begins + (m.start() > start)
        words.append(m[0])
        labels.append(label)
    return words, labels


@dataclass
class Field:
    """Weights of the features (rows) for the labels, and of label i then j."""

    index: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray

    def table(self, names: list[str], side: str) -> np.ndarray:
        rows = [self.index[side + n] for n in names if side + n in self.index]
        return self.weights[rows].sum(axis=0)


#: Weight that keeps a word that is always neither from any other label.
NEVER = -1e4


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(examples: list[str]) -> Field:
    """Fits the field to labelled lines."""
    chains = [parsed(e) for e in examples]
    index: dict[str, int] = {}
    rows, places, n = [], [], 0
    for words, _ in chains:
        for names in features(words):
            rows += [index.setdefault(name, len(index)) for name in names]
            places += [n] * len(names)
            n += 1
    starts = np.cumsum([0, *(len(own) for _, own in chains)])
    y = np.array([label for _, own in chains for label in own], int)
    shut = np.array([not possible(w) for words, _ in chains for w in words], bool)
    rows, places = np.array(rows, int), np.array(places, int)
    weights, trans = np.zeros((len(index), N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, trans)]
    for step in range(1, EPOCHS + 1):
        if not len(y):
            break
        node = np.zeros((len(y), N_LABELS))
        np.add.at(node, places, weights[rows])
        node[shut, 1:] = NEVER
        slope, t_slope = _slopes(node, trans, starts, y)
        own = np.zeros_like(weights)
        np.add.at(own, rows, slope[places])
        grads = [own / len(chains) - RIDGE * weights, t_slope / len(chains) - RIDGE * trans]
        for p, g, m in zip((weights, trans), grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += RATE * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
    return Field(index, weights, trans)


def _slopes(node: np.ndarray, trans: np.ndarray, starts: np.ndarray,
            y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the log-likelihood in the places' and transitions' weights."""
    slope, t_slope = np.zeros_like(node), np.zeros_like(trans)
    for a, b in zip(starts[:-1], starts[1:]):
        own, n = node[a:b], b - a
        ahead, back = own.copy(), np.zeros_like(own)
        for t in range(1, n):
            ahead[t] += _logsum(ahead[t - 1][:, None] + trans, 0)
        for t in range(n - 2, -1, -1):
            back[t] = _logsum(trans + own[t + 1] + back[t + 1], 1)
        whole = _logsum(ahead[-1], 0)
        slope[a:b] = -np.exp(ahead + back - whole)
        slope[np.arange(a, b), y[a:b]] += 1
        for t in range(n - 1):
            t_slope -= np.exp(ahead[t][:, None] + trans + own[t + 1] + back[t + 1] - whole)
            t_slope[y[a + t], y[a + t + 1]] += 1
    return slope, t_slope


def viterbi(node: np.ndarray, mask: np.ndarray, trans: np.ndarray,
            before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Labels of padded stretches (stretches, longest, labels). ``before`` and
    ``after``: whether a stretch stands after or before a word that is neither."""
    n, longest, labels = node.shape
    size = mask.sum(axis=1)
    score = node[:, 0] + np.where(before[:, None], trans[0], 0)
    come = np.zeros((n, longest, labels), np.int8)
    for t in range(1, longest):
        ways = score[:, :, None] + trans
        come[:, t] = ways.argmax(axis=1)
        score = np.where(mask[:, t, None], ways.max(axis=1) + node[:, t], score)
    at = (score + np.where(after[:, None], trans[:, 0], 0)).argmax(axis=1)
    out = np.zeros((n, longest), np.int8)
    every = np.arange(n)
    for t in range(longest - 1, -1, -1):
        inside = t < size
        out[:, t] = np.where(inside, at, 0)
        at = np.where(inside & (t > 0), come[every, t, at], at)
    return out


@dataclass
class Words:
    """The possible words of some texts, joined by line ends."""

    blob: bytes
    first: np.ndarray        # where each text begins; one more after the last
    begin: np.ndarray        # of the possible words, in bytes
    end: np.ndarray
    follows: np.ndarray      # whether the word before is possible and of the same text
    opens: np.ndarray        # whether it is the first, the last word of its text
    closes: np.ndarray

    @classmethod
    def of(cls, raws: list[bytes]) -> Words:
        blob = b"\n".join([*raws, b""])
        codes = np.frombuffer(blob, np.uint8)
        first = np.cumsum([0, *(len(r) + 1 for r in raws)])
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        begin, end = edges[::2], edges[1::2]
        hits = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
        held = np.unique(np.searchsorted(begin, hits, "right") - 1)
        held = held[end[held] - begin[held] <= LONGEST]
        text = np.searchsorted(first, begin, "right") - 1
        opens = np.diff(text, prepend=-1) != 0
        closes = np.diff(text, append=len(raws)) != 0
        follows = (np.diff(held, prepend=-2) == 1) & ~opens[held]
        return cls(blob, first, begin[held], end[held], follows, opens[held], closes[held])


class Finder:
    """Finds spans in texts; keeps the classes of the words seen."""

    def __init__(self, model: Field):
        self.model = model
        self.pieces = PieceCache(self._classes_of, CACHE_WORDS)
        self._clear()

    def _clear(self) -> None:
        self.classes: dict[tuple, int] = {}
        # of each class: weights as a word, as the word before, as the word after
        self.tables = np.empty((1024, 3, N_LABELS))
        for names in (EDGE, WORD):
            self._class(["none"], names)
        self.pieces.young.clear()
        self.pieces.old.clear()

    def _class(self, own: list[str], near: list[str]) -> int:
        key = (*own, "|", *near)
        n = self.classes.setdefault(key, len(self.classes))
        if n == len(self.tables):
            self.tables = np.concatenate([self.tables, np.empty_like(self.tables)])
        if n == len(self.classes) - 1:
            m = self.model
            self.tables[n] = m.table(own, "0"), m.table(near, "-"), m.table(near, "+")
        return n

    def _classes_of(self, words: list[bytes]) -> list[int]:
        texts = [w.decode("utf-8", "replace") for w in words]
        return [self._class(own_features(w), near_features(w)) for w in texts]

    def spans(self, raws: list[bytes]) -> Iterator[list[tuple[int, int, int, bool]]]:
        """(start, kind number, end, whether a base span) of each text."""
        for start, end in groups(raws):
            own = raws[start:end]
            if len(self.classes) > MOST_CLASSES:
                self._clear()
            by_field = self._of_field(own)
            for i, raw in enumerate(own):
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                found = [(*span, True) for span in base]
                if i in by_field:
                    added = _apart(self._tested(text, raw, by_field[i]), base)
                    found = sorted(found + [(*span, False) for span in added])
                yield found

    def _labels(self, words: Words) -> np.ndarray:
        """The best label of each possible word."""
        n = len(words.begin)
        held = [words.blob[a:b] for a, b in zip(words.begin.tolist(), words.end.tolist())]
        codes = np.array(self.pieces.values([held])[0], np.int64)
        edge, word = 0, 1
        before = np.where(words.opens, edge, word)
        before[1:][words.follows[1:]] = codes[:-1][words.follows[1:]]
        after = np.where(words.closes, edge, word)
        after[:-1][words.follows[1:]] = codes[1:][words.follows[1:]]
        node = self.tables[codes, 0] + self.tables[before, 1] + self.tables[after, 2]
        first = np.flatnonzero(~words.follows)
        size = np.diff(first, append=n)
        labels = np.zeros(n, np.int8)
        power = np.ceil(np.log2(size))
        for p in np.unique(power):
            at = np.flatnonzero(power == p)
            steps = np.arange(size[at].max())
            for part in np.array_split(at, max(1, len(at) * len(steps) // 20_000)):
                mask = steps < size[part][:, None]
                where = np.where(mask, first[part][:, None] + steps, 0)
                last = first[part] + size[part] - 1
                found = viterbi(np.where(mask[..., None], node[where], 0), mask, self.model.trans,
                                ~words.opens[first[part]], ~words.closes[last])
                labels[where[mask]] = found[mask]
        return labels

    def _of_field(self, raws: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """(first byte, kind number, end) of the spans of each text that has any."""
        words = Words.of(raws)
        if not len(words.begin):
            return {}
        labels = self._labels(words)
        out: dict[int, list[tuple[int, int, int]]] = {}
        hits = np.flatnonzero(labels)
        here, prior = labels[hits], labels[np.maximum(hits - 1, 0)]
        # "continues" a kind after "begins" or "continues" it
        goes_on = words.follows[hits] & (here % 2 == 0) & (here == prior + prior % 2)
        for first, last in _runs(hits, goes_on) if len(hits) else ():
            text = int(np.searchsorted(words.first, words.begin[first], "right")) - 1
            base = int(words.first[text])
            out.setdefault(text, []).append(
                (int(words.begin[first]) - base, (int(labels[first]) - 1) // 2,
                 int(words.end[last]) - base))
        return out

    @staticmethod
    def _tested(text: str, raw: bytes, found: list) -> list[tuple[int, int, int]]:
        """Spans in code points, without the signs around them, that pass their test."""
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        out = []
        for begin, kind, end in found:
            start, stop = int(chars[begin]), int(chars[end])
            a, b = trimmed(text[start:stop])
            if fits(kind, text[start + a:start + b]):
                out.append((start + a, kind, start + b))
        return out


def _runs(hits: np.ndarray, goes_on: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of the runs of hits that go on from one to the next."""
    starts = np.flatnonzero(~goes_on)
    ends = np.append(starts[1:], len(hits)) - 1
    yield from zip(hits[starts].tolist(), hits[ends].tolist())


def _apart(added: list, base: list) -> list:
    """The added spans that touch no base span (``base`` is in order)."""
    starts = [start for start, _, _ in base]
    reach = list(accumulate((end for _, _, end in base), max))
    out = []
    for s, k, e in added:
        i = bisect_left(starts, e)                     # base spans that begin before e
        if not i or reach[i - 1] <= s:
            out.append((s, k, e))
    return out


_MODELS: dict[tuple, Field] = {}


def trained(examples: tuple[str, ...] = EXAMPLES) -> Field:
    """The field fitted to the labelled lines (once in a process)."""
    if examples not in _MODELS:
        _MODELS[examples] = fit(list(examples))
    return _MODELS[examples]


def personal_spans(docs: DataFrame, examples: tuple[str, ...] = EXAMPLES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans array<struct<kind string, start int, end int, base boolean>>`` of
    every row, ordered by start and then kind. Narrow: no shuffle. The field
    (some thousand weights) is fitted on the driver and sent with the tasks."""
    model = trained(examples)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                      ("base", pa.bool_())])
    schema = pa.schema([(id_col, pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = worker_state("personal", examples, lambda: Finder(model))
        out = Emitter(schema)
        for batch in batches:
            raws = raw_texts(batch.column(1))
            for key, found in zip(batch.column(0).to_pylist(), finder.spans(raws)):
                rows = [{"kind": KINDS[k], "start": s, "end": e, "base": base}
                        for s, k, e, base in found]
                yield from out.add((key, rows), 32 + 32 * len(rows))
        yield from out.flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
