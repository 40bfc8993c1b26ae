"""Byte-pair encoding and decoding by a tokenization automaton.

Training order fixes which token sequences byte-pair encoding can produce.
The automaton accepts exactly those sequences. It is built from one state with
a loop for every base symbol by one *merge gadget* per merge (u, v) -> w, in
order:

* the state that u-arcs lead to is copied without its v-arc, and all u-arcs are
  led to the copy, so "u then v" is no longer accepted;
* wherever a u-arc leaves, a w-arc is added that leads where "u then v" led.

All arcs with one label lead to one state, and an arc is only ever taken away
when a state is copied. So a state is stored as (parent, taken label, time of
the copy), and the transition table is filled from that on first use.

A word has one accepted token sequence, and so has each of its beginnings:
walking the word once, position by position, with the tokens by their spelling
finds it without looking at merge priorities. Decoding emits the arc labels of the
sequence, joined as the tokenizer file says (it names no decoder: by a space).

Texts are cut at ASCII white space, which the tokenizer drops and across which
nothing can join; each distinct piece is normalised and pre-split by the rules
in the tokenizer file and encoded once while a worker's bounded cache holds it.

Defined cases: a null or empty text has no tokens and decodes to ``""``; a row
with a null id is encoded like any other; repeated rows are encoded each; very
long texts are walked word by word; an empty table gives an empty result. Only
the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import (Emitter, PieceCache, groups, pieces_of, raw_texts, stem_and_sign,
                      worker_state)

#: Distinct pieces in a generation of a worker's cache; filled places of the table.
CACHE_PIECES = 200_000
CACHE_ARCS = 1_000_000
END = "</w>"
_LAST = 1 << 62


class MergeAutomaton:
    """Deterministic automaton over token ids; see the module docstring.

    ``merges``: (left id, right id, merged id) in training order. ``inner`` and
    ``last``: id of each byte's symbol within a word and at its end."""

    def __init__(self, inner: list[int], last: list[int], merges: list[tuple[int, int, int]]):
        n = 1 + max([*inner, *last, *(w for _, _, w in merges)])
        self.left, self.made = [-1] * n, [-1] * n       # of a token: left part, time of its merge
        self.into = [0] * n                              # state that a token's arcs lead to
        self.parent, self.taken, self.born = [0], [-1], [-1]
        self.table: dict[int, bool] = {}
        self.inside = {bytes([b]): t for b, t in enumerate(inner)}   # tokens by spelling
        self.ending = {bytes([b]): t for b, t in enumerate(last)}
        spelling = {t: (s, d) for d in (self.inside, self.ending) for s, t in d.items()}
        for time, (u, v, w) in enumerate(merges):
            q = self.into[u]
            self.left[w], self.made[w] = u, time
            spelling[w] = spelling[u][0] + spelling[v][0], spelling[v][1]
            spelling[w][1][spelling[w][0]] = w
            after = q if u == v else self.into[v]
            if self._arc_while_building(q, v):
                self.parent.append(q)
                self.taken.append(v)
                self.born.append(time)
                self.into[u] = len(self.parent) - 1
            self.into[w] = after
        self.reach: dict[bytes, int] = {}      # longest token by its first three bytes
        for spelled, _ in spelling.values():
            self.reach[spelled[:3]] = max(len(spelled), self.reach.get(spelled[:3], 2))
        self._index_copies()

    def _arc_while_building(self, q: int, x: int) -> bool:
        """Whether an arc labelled ``x`` leaves ``q``, by walking up the copies:
        a copy made after the label's own gadget holds what its parent held,
        an older state has the arc if it has one for the label's left part."""
        while True:
            while self.born[q] > self.made[x]:
                if self.taken[q] == x:
                    return False
                q = self.parent[q]
            if self.left[x] < 0:
                return True
            x = self.left[x]

    def _index_copies(self) -> None:
        """Numbers the tree of copies in preorder. On one path a label is taken
        at most once, so the subtrees in which a label is missing are disjoint
        and one binary search tells whether a state lies in one of them."""
        n = len(self.parent)
        size = [1] * n
        for q in range(n - 1, 0, -1):
            size[self.parent[q]] += size[q]
        self.order, free = [0] * n, [1] * n
        for q in range(1, n):                      # parents come before copies
            p = self.parent[q]
            self.order[q] = self.order[p] + free[p]
            free[p] += size[q]
        self.missing: dict[int, list[tuple[int, int, int]]] = {}
        for q in range(1, n):
            self.missing.setdefault(self.taken[q], []).append(
                (self.order[q], self.order[q] + size[q], self.born[q]))
        for spans in self.missing.values():
            spans.sort()

    def has_arc(self, state: int, token: int) -> bool:
        """Whether an arc labelled ``token`` leaves ``state``: the label, its left
        part, the left part of that, and so on, must not have been taken from a
        state on the path before the label that follows was made."""
        key = state << 20 | token
        known = self.table.get(key)
        if known is None:
            x, until, at = token, len(self.made), self.order[state]
            while True:
                spans = self.missing.get(x, ())
                k = bisect_right(spans, (at, _LAST)) - 1
                if k >= 0 and at < spans[k][1] and spans[k][2] <= until:
                    known = False
                    break
                if self.left[x] < 0:
                    known = True
                    break
                until, x = self.made[x], self.left[x]
            self.table[key] = known
        return known

    def encode(self, word: bytes) -> list[int]:
        """The accepted token sequence that spells ``word``: arcs are tried
        longest first, and a position is given up at most once, because all
        accepted ways to a position end in the same state."""
        whole = self.ending.get(word)
        if whole is not None:           # the first state has every arc
            return [whole]
        inside, ending, into = self.inside, self.ending, self.into
        table, reach, n = self.table, self.reach, len(word)
        path, given_up = [], set()
        at, state, end = 0, 0, min(n, reach.get(word[:3], 2))
        while at < n:
            while end > at:
                token = (ending if end == n else inside).get(word[at:end])
                if token is not None and end not in given_up:
                    arc = table.get(state << 20 | token)
                    if arc is None:
                        arc = self.has_arc(state, token)
                    if arc:
                        path.append((at, state, end, token))
                        at, state = end, into[token]
                        end = min(n, at + reach.get(word[at:at + 3], 2))
                        break
                end -= 1
            else:
                given_up.add(at)
                at, state, end, _ = path.pop()
                end -= 1
        return [step[3] for step in path]


class Codec:
    """Encodes and decodes whole texts with the tokenizer file at ``path``."""

    def __init__(self, path: str, decoded: bool = True):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = regex.compile(next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split")).findall
        vocab = spec["model"]["vocab"]
        self.label = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label |= {i: t for t, i in self.special.items()}
        shown = byte_symbols()
        self.automaton = MergeAutomaton(
            [vocab[c] for c in shown], [vocab[c + END] for c in shown],
            [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]])
        self.decoded = decoded
        self.pieces = PieceCache(self.make, CACHE_PIECES)
        self.words: dict[str, list[int]] = {}

    def plain(self, normal: str) -> list[int]:
        """Ids of normalised text without special tokens."""
        ids: list[int] = []
        for word in self.split(normal):
            known = self.words.get(word)
            if known is None:
                known = self.words[word] = self.automaton.encode(word.encode())
            ids += known
        return ids

    def with_special(self, piece: str) -> list[int]:
        """Special tokens are found in the raw text, leftmost first."""
        ids: list[int] = []
        while found := [(piece.find(s), s) for s in self.special if s in piece]:
            at, s = min(found)
            ids += self.plain(self.normalise(piece[:at])) + [self.special[s]]
            piece = piece[at + len(s):]
        return ids + self.plain(self.normalise(piece))

    def make(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian unsigned 32-bit) and decoded text (if asked for, else
        empty) of each piece.
        The pieces are normalised in one call, which keeps them apart by one
        blank each; those with blanks or special tokens inside go one by one."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        normal = self.normalise(" ".join(texts)).split(" ")
        alone = len(normal) != len(texts)
        out = []
        for i, text in enumerate(texts):
            parts = stem_and_sign(pieces[i])
            stem = self.pieces.get(parts[0]) if parts else None
            if stem is not None:
                sign = self.plain(parts[1].decode())
                out.append((stem[0] + array("I", sign).tobytes(),
                            stem[1] + b" " + self.shown(sign) if self.decoded else b""))
                continue
            if alone or "<|" in text:
                ids = self.with_special(text)
            else:
                ids = self.plain(normal[i])
            out.append((array("I", ids).tobytes(), self.shown(ids)))
        return out

    def shown(self, ids: list[int]) -> bytes:
        return self.decode(ids).encode() if self.decoded else b""

    def texts(self, raws: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers and decoded text."""
        for start, end in groups(raws):
            cuts = [pieces_of(raw) for raw in raws[start:end]]
            values = self.pieces.values(cuts)
            if len(self.automaton.table) > CACHE_ARCS:
                self.automaton.table.clear()
            if len(self.words) > CACHE_PIECES:
                self.words.clear()
            for found in values:
                yield b"".join([x[0] for x in found]), b" ".join([x[1] for x in found if x[1]])

    def decode(self, ids) -> str:
        return " ".join([self.label[i] for i in ids])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: itself if it is printable Latin-1, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def codec(path: str, decoded: bool = True) -> Codec:
    """One codec for each Python worker, built on first use; without ``decoded``
    it keeps ids only."""
    return worker_state("bpe", (path, decoded), lambda: Codec(path, decoded))


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``id, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded
    string`` of every row of ``docs``. Narrow: no shuffle."""
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()),
                        ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_file, out = codec(tokenizer_path), Emitter(schema)
        for batch in batches:
            texts = with_file.texts(raw_texts(batch.column(1)))
            for key, (ids, decoded) in zip(batch.column(0).to_pylist(), texts):
                yield from out.add((key, len(ids) // 4, ids, decoded.decode()),
                                   len(ids) + len(decoded))
        yield from out.flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` long, n_tokens long, ids binary, decoded string")


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``id, n_tokens long, ids array<int>`` of every row."""
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()),
                        ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_file = codec(tokenizer_path, decoded=False)
        for batch in batches:
            keys, raws = batch.column(0).cast(pa.int64()), raw_texts(batch.column(1))
            for at in range(0, len(raws), 500):
                ids = [np.frombuffer(x, "<u4") for x, _ in with_file.texts(raws[at:at + 500])]
                n = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                    pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys[at:at + 500], pa.array(n), lists],
                                                 schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """``id, decoded string`` from an array of ids; a null array decodes to ``""``."""
    schema = pa.schema([(id_col, pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_file, out = codec(tokenizer_path), Emitter(schema)
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = with_file.decode(ids or [])
                yield from out.add((key, text), len(text))
        yield from out.flush()

    return encoded.select(F.col(id_col).cast("long"),
                          F.col(ids_col).cast("array<int>")).mapInArrow(
        run, f"`{id_col}` long, decoded string")
