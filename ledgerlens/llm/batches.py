"""Small helpers shared by the corpus operators: reading documents and moving
texts between Spark and Python in bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

#: Words everywhere: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of output that a task gathers before it hands them to the JVM.
OUT_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Emitter:
    """Collects result rows and yields them as record batches of about
    ``OUT_BYTES``, so that a task never holds the results of a whole batch of
    long texts."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= OUT_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, type=f.type)
                       for c, f in zip(zip(*self.rows), self.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.rows, self.size = [], 0


_STATE: dict[tuple, object] = {}


def worker_state(stage: str, key, make: Callable[[], object]):
    """What ``make()`` gives, kept for the next tasks of ``stage`` in this Python
    worker. A worker holds the state of one stage and key only: the first task
    of another one drops it, so a run of many stages needs the memory of one."""
    if (stage, key) not in _STATE:
        _STATE.clear()
        _STATE[stage, key] = make()
    return _STATE[stage, key]


class PieceCache:
    """What ``make`` gives for each distinct piece of text, kept in two
    generations of at most about ``limit`` pieces: when the younger is full, it
    becomes the older, and only what is used again moves over. So frequent
    pieces stay and a task's memory is bounded whatever the vocabulary."""

    def __init__(self, make: Callable[[list[bytes]], Iterable], limit: int):
        self.make, self.limit = make, limit
        self.young: dict = {}
        self.old: dict = {}

    def values(self, texts: list[list[bytes]]) -> list[list]:
        """What ``make`` gives (never None) for every piece of every text."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = [list(map(young.get, own)) for own in texts]
        holes = [[i for i, v in enumerate(values) if v is None] if None in values else ()
                 for values in found]
        missing = []
        for piece in {own[i] for own, at in zip(texts, holes) for i in at}:
            if piece in old:
                young[piece] = old[piece]
            else:
                missing.append(piece)
        if missing:
            young.update(zip(missing, self.make(missing)))
        for own, values, at in zip(texts, found, holes):
            for i in at:
                values[i] = young[own[i]]
        return found

    def get(self, piece: bytes):
        found = self.young.get(piece)
        return self.old.get(piece) if found is None else found


def groups(raws: list[bytes], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of ``raws`` of about ``size`` bytes each, one text at least."""
    start = total = 0
    for i, raw in enumerate(raws):
        total += len(raw)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(raws):
        yield start, len(raws)


def pieces_of(raw: bytes) -> list[bytes]:
    """The pieces of a text between ASCII white space, A-Z lower-cased as the
    lower-casing tokenizer does anyway, but not where a special token may stand."""
    return (raw if b"<|" in raw else raw.lower()).split()


def stem_and_sign(piece: bytes) -> tuple[bytes, bytes] | None:
    """A piece that ends in a letter or digit and one full stop or comma, taken
    apart: the tokenizer pre-splits there, so both parts are encoded alone."""
    if piece[-1:] in (b".", b",") and piece[-2:-1].isalnum() and b"<|" not in piece:
        return piece[:-1], piece[-1:]
    return None
