"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a sequence of zstandard frames followed by two skippable frames:

* the *document index*: for each frame, the number of documents before it in
  the file, and the least and greatest id it holds;
* the *seek table* of the public seekable format: for each frame its compressed
  and decompressed size and the low 32 bits of the XXH64 of its contents, then
  the footer (number of frames, descriptor with the checksum flag, magic).

Each frame holds whole documents: their ids, whether the id is null, their
token counts, then all token ids as little-endian unsigned 32-bit integers. A
reader fetches the tail of a file, picks the frames it needs, and decompresses
only those, checking each against its checksum.

Writing: documents are range-partitioned and sorted by id, so file after file
holds ascending ids. Every task writes under a name of its own attempt and then
moves the file to its final name, so a retried or doubled task replaces a file
by an equal one. Reading back is a second job over the manifest, one row per
file; ``start`` adds up the totals in the manifest.

Defined cases: a null or empty text has only the end id; a null id sorts first;
repeated ids lie next to each other, ordered by text; a very long document has a
frame of its own; an empty table writes no file and reads back as no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, shuffle_partitions
from .batches import Emitter, PieceCache, groups, pieces_of, raw_texts, stem_and_sign

#: Token bytes in a frame; tokens in a file. Fixed values of the format follow.
FRAME_BYTES = 1 << 18
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_FRAME = 0x184D2A50
#: Distinct pieces in a generation of a worker's cache.
CACHE_PIECES = 400_000
NO_ID = -(1 << 63)


class LibraryEncoder:
    """Token ids as the tokenizers library gives them for the file at ``path``.
    Nothing joins across ASCII white space, which the tokenizer drops, so each
    distinct piece between is encoded once while the bounded cache holds it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.rules = Tokenizer.from_file(path)
        self.rules.no_truncation()
        self.rules.no_padding()
        self.pieces = PieceCache(self.make, CACHE_PIECES)
        self.signs: dict[bytes, bytes] = {}

    def make(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = []
        asked: list[str] = []
        for p in pieces:
            parts = stem_and_sign(p)
            stem = self.pieces.get(parts[0]) if parts else None
            if stem is None:
                asked.append(p.decode("utf-8", "replace"))
                out.append(None)
            else:
                out.append(stem + self.sign(parts[1]))
        found = (x for at in range(0, len(asked), 1000) for x in self.apart(asked[at:at + 1000]))
        return [next(found) if x is None else x for x in out]

    def apart(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, from one call over all of them with blanks between:
        a token belongs to the text in which it begins."""
        got = self.rules.encode(" ".join(texts), add_special_tokens=False)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        ids = np.array(got.ids, "<u4")
        began = np.array([start for start, _ in got.offsets], np.int64)
        cuts = 4 * np.searchsorted(began, starts)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def sign(self, mark: bytes) -> bytes:
        if mark not in self.signs:
            ids = self.rules.encode(mark.decode(), add_special_tokens=False).ids
            self.signs[mark] = array("I", ids).tobytes()
        return self.signs[mark]

    def texts(self, raws: list[bytes]) -> Iterator[bytes]:
        for start, end in groups(raws):
            cuts = [pieces_of(raw) for raw in raws[start:end]]
            for found in self.pieces.values(cuts):
                yield b"".join(found)


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


class FileWriter:
    """Writes one file of the format to an open binary stream."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.pack = stream, zstandard.ZstdCompressor(level=1)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.texts: list[bytes] = []
        self.size = self.docs = self.tokens = 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.texts.append(tokens)
        self.size += len(tokens)
        if self.size >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        import xxhash

        if not self.ids:
            return
        known = np.array([NO_ID if i is None else i for i in self.ids], "<i8")
        body = b"".join([struct.pack("<I", len(known)), known.tobytes(),
                         np.array([i is None for i in self.ids], "u1").tobytes(),
                         np.array([len(t) // 4 for t in self.texts], "<u4").tobytes(),
                         *self.texts])
        packed = self.pack.compress(body)
        self.stream.write(packed)
        self.frames.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.index.append((self.docs, int(known[0]), int(known[-1])))
        self.docs += len(known)
        self.tokens += self.size // 4
        self.ids, self.texts, self.size = [], [], 0

    def close(self) -> None:
        self.end_frame()
        index = b"".join(struct.pack("<Qqq", *x) for x in self.index)
        self.stream.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FileReader:
    """Reads one file of the format from a seekable binary stream."""

    def __init__(self, stream, size: int):
        import zstandard

        self.stream, self.unpack = stream, zstandard.ZstdDecompressor()
        stream.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE or not descriptor & CHECKSUMS:
            raise ValueError("not a file with a seek table and checksums")
        table = size - 9 - 12 * n
        stream.seek(table)
        raw = stream.read(12 * n)
        self.frames = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        stream.seek(table - 8 - 24 * n)
        raw = stream.read(24 * n)
        self.index = [struct.unpack_from("<Qqq", raw, 24 * i) for i in range(n)]
        self.at = [0]
        for packed, _, _ in self.frames:
            self.at.append(self.at[-1] + packed)

    def frame(self, i: int) -> list[tuple[int | None, bytes]]:
        """The documents of frame ``i``; an error if its checksum differs."""
        import xxhash

        packed, size, want = self.frames[i]
        self.stream.seek(self.at[i])
        body = self.unpack.decompress(self.stream.read(packed), max_output_size=size)
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != want:
            raise ValueError(f"frame {i}: checksum differs")
        n = struct.unpack_from("<I", body)[0]
        ids = np.frombuffer(body, "<i8", n, 4)
        null = np.frombuffer(body, "u1", n, 4 + 8 * n)
        counts = np.frombuffer(body, "<u4", n, 4 + 9 * n)
        ends = 4 + 13 * n + 4 * np.cumsum(counts, dtype=np.int64)
        return [(None if gone else int(i), body[e - 4 * int(c):e])
                for i, gone, c, e in zip(ids, null, counts, ends)]

    def documents(self, wanted: set[int]) -> list[tuple[int, bytes]]:
        """Tokens of the wanted ids; decompresses only frames that may hold one."""
        out = []
        for i, (_, low, high) in enumerate(self.index):
            if any(low <= w <= high for w in wanted):
                out += [x for x in self.frame(i) if x[0] in wanted]
        return out


def _store(uri: str):
    """Arrow's file system for a path (file, hdfs, s3, gs) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs`` into files under ``folder`` in ascending id order and
    returns the manifest: ``file, part, n_docs, n_tokens`` (one row per file)."""
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()),
                        ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = _store(folder)
        part, encode, out = TaskContext.get().partitionId(), encoder(tokenizer_path), None
        for batch in batches:
            texts = encode.texts(raw_texts(batch.column(1)))
            for key, tokens in zip(batch.column(0).to_pylist(), texts):
                if out is None:
                    store.create_dir(base, recursive=True)
                    own = f"{base}/_{uuid.uuid4().hex}"
                    stream = store.open_output_stream(own)
                    out = FileWriter(stream)
                out.add(key, tokens + end)
        if out is not None:
            out.close()
            stream.close()
            name = f"tokens-{part:06d}.zst"
            store.move(own, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], type=f.type)
                 for x, f in zip((name, part, out.docs, out.tokens), schema)], schema=schema)

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    return (rows.repartitionByRange(shuffle_partitions(spark), "id")
            .sortWithinPartitions("id", "text")
            .mapInArrow(run, "file string, part int, n_docs long, n_tokens long"))


def read_files(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``id, file, tokens_before long, tokens binary`` of every document in the files of
    the manifest; ``tokens_before`` counts the tokens before it in its file."""
    schema = pa.schema([(id_col, pa.int64()), ("file", pa.string()),
                        ("tokens_before", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out = Emitter(schema)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as stream:
                    reader, before = FileReader(stream, stream.size()), 0
                    for i in range(len(reader.frames)):
                        for key, tokens in reader.frame(i):
                            yield from out.add((key, name, before, tokens), len(tokens))
                            before += len(tokens) // 4
        yield from out.flush()

    n = max(1, shuffle_partitions(manifest.sparkSession))
    return manifest.select("file").repartition(n, "file").mapInArrow(
        run, f"`{id_col}` long, file string, tokens_before long, tokens binary")


def read_documents(manifest: DataFrame, folder: str, ids: list[int]) -> DataFrame:
    """``doc_id, tokens binary`` of the given ids; only frames that may hold one of them
    are decompressed."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary())])
    wanted = set(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out = Emitter(schema)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as stream:
                    for row in FileReader(stream, stream.size()).documents(wanted):
                        yield from out.add(row, len(row[1]))
        yield from out.flush()

    return manifest.select("file").mapInArrow(run, "doc_id long, tokens binary")


def file_starts(manifest: DataFrame) -> DataFrame:
    """``file, file_start``: tokens in all files before (one row per file)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("file", F.coalesce(F.sum("n_tokens").over(before),
                                              F.lit(0)).alias("file_start"))


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer_path: str,
                   end_id: int) -> DataFrame:
    """Writes ``docs`` to files in the shared folder and returns what the files
    hold: ``doc_id, start, n_tokens, tokens``."""
    from ..session import cut_lineage

    folder = scratch_path(spark, "token-files")
    manifest = cut_lineage(write_files(docs, tokenizer_path, end_id, folder))
    return (read_files(manifest, folder).join(F.broadcast(file_starts(manifest)), "file")
            .select("doc_id", (F.col("file_start") + F.col("tokens_before")).alias("start"),
                    (F.length("tokens") / 4).cast("long").alias("n_tokens"), "tokens"))
