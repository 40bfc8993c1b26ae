"""Secret scan: keyword automaton, anchored patterns near hits, checksums.

An Aho-Corasick automaton over the lower-cased text finds every keyword of
every kind in one pass. Only at a hit is the kind's regular expression tried,
anchored there, on the text itself. For tokens whose format embeds a checksum
(a prefix, random letters and digits, and the CRC-32 of those in base 62), the
checksum must fit. Runs of hexadecimal digits have no keyword; they are found by
one expression that is entered only at the start of a run.

Spans are code points, end exclusive. Per kind they are leftmost and do not
overlap; a match that fails its kind's length still takes up its text.

Defined cases: a null text is empty and has no spans; each repeated row is
scanned; a text is scanned whole whatever its length; an empty table gives no
rows; only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import Emitter, worker_state

# The kinds, their keywords (lower case), patterns and least lengths.
KINDS = ("assign", "access", "hex", "checked")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


class Scanner:
    def __init__(self):
        import ahocorasick

        self.keywords = ahocorasick.Automaton()
        for kind, words in ((0, ASSIGN_WORDS), (1, (ACCESS_WORD,)), (3, CHECKED_WORDS)):
            for word in words:
                self.keywords.add_word(word, (kind, len(word)))
        self.keywords.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end), by start and then kind."""
        # U+0130 is the one character that lower() makes longer
        low = (text.replace("İ", "i") if "İ" in text else text).lower()
        found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        hits = sorted((end + 1 - n, kind) for end, (kind, n) in self.keywords.iter(low))
        free = [0, 0, 0, 0]
        for at, kind in hits:
            if at < free[kind]:
                continue
            if kind == 0:
                m = ASSIGN.match(text, at)
                fits = m and len(m[2]) >= ASSIGN_LEAST
            elif kind == 1:
                m = ACCESS.match(text, at)
                fits = m and m.end() - at >= ACCESS_LEAST
            else:
                m = CHECKED.match(text, at)
                fits = m and checksum(m[1]) == m[2]
            if m and (fits or kind != 3):
                free[kind] = m.end()
            if fits:
                found.append((at, kind, m.end()))
        return sorted(found)


def scanner() -> Scanner:
    return worker_state("secrets", None, Scanner)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans array<struct<kind string, start int, end int>>`` of every
    row, ordered by start and then kind. Narrow: no shuffle."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([(id_col, pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, out = scanner(), Emitter(schema)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [{"kind": KINDS[k], "start": s, "end": e}
                         for s, k, e in scan.spans(text or "")]
                yield from out.add((key, found), 32 + 24 * len(found))
        yield from out.flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` long, spans array<struct<kind:string,start:int,end:int>>")


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``[kind]`` (spans that
    overlap are replaced together, by the first one's kind) and ``n_chars`` of
    the texts that changed counted anew. All columns of the input stay, in order;
    null texts stay null."""
    names = docs.columns
    kinds = docs.schema
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for batch in batches:
            for piece in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                texts, changed = piece.column(at).to_pylist(), {}
                for i, text in enumerate(texts):
                    if text and (spans := scan.spans(text)):
                        changed[i] = texts[i] = cut_out(text, spans)
                if changed:
                    columns = piece.columns
                    columns[at] = pa.array(texts, type=columns[at].type)
                    if count is not None:
                        n = columns[count].to_pylist()
                        columns[count] = pa.array(
                            [len(changed[i]) if i in changed else x for i, x in enumerate(n)],
                            type=columns[count].type)
                    piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
                yield piece

    return docs.mapInArrow(run, kinds)


def cut_out(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
