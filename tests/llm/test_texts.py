import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerlens.llm import bpe, fingerprint, secrets, token_files
from ledgerlens.llm.queries import END_ID, tokenizer_path
from ledgerlens.llm.batches import documents
from tests.conftest import SF_SMALL

from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(tokenizer_path())
CODEC = bpe.Codec(tokenizer_path())
CORPUS_TEXT = st.text(alphabet=st.sampled_from(list("abcdethsEINR.,!'|<>/w019 \n\té́İΣ中😀\x1c\xa0")),
                      max_size=60)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(CORPUS_TEXT)
def test_automaton_encodes_and_decodes_as_the_library(text):
    (ids, decoded), = CODEC.texts([text.encode()])
    want = library_ids(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded.decode() == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "<|endoftext|>x<|startoftext|> <|endoftext|", "a<|ENDOFTEXT|>b", "aaaa aaaaaaaaa baaaa",
    "</w> <\\w></w></w>", "it's WE'LL don't. x's, 12, 3.", "word, word. word", "Word,Word."])
def test_automaton_on_chosen_texts(text):
    (ids, _), = CODEC.texts([text.encode()])
    assert np.frombuffer(ids, "<u4").tolist() == library_ids(text)


def test_automaton_of_overlapping_merges():
    inner, last = list(range(256)), list(range(256, 512))
    a, a_end = ord("a"), 256 + ord("a")
    machine = bpe.MergeAutomaton(inner, last, [(a, a, 512), (512, a_end, 513), (512, 512, 514)])
    assert machine.encode(b"aaa") == [513]
    assert machine.encode(b"aaaa") == [512, a, a_end]      # aa a a$: aa is not before a$
    assert machine.encode(b"aaaaa") == [512, 513]
    assert machine.encode(b"a" * 7) == [514, 513]


def test_encode_decode_of_a_table(odd_docs, no_docs):
    path = tokenizer_path()
    rows = bpe.encode_decode(odd_docs, path).collect()
    ids = {r.doc_id: r.ids for r in bpe.encode(odd_docs, path).collect() if r.doc_id is not None}
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            want = library_ids(texts[r.doc_id] or "")
            assert np.frombuffer(r.ids, "<u4").tolist() == want == ids[r.doc_id]
            assert r.n_tokens == len(want)
            assert r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
    decoded = bpe.decode(bpe.encode(odd_docs, path), path)
    assert {(r.doc_id, r.decoded) for r in decoded.collect()} == \
        {(r.doc_id, r.decoded) for r in rows}
    assert bpe.encode_decode(no_docs, path).count() == 0


def test_token_files_round_trip(spark, odd_docs, no_docs, make_docs):
    found = token_files.write_and_read(spark, odd_docs, tokenizer_path(), END_ID).collect()
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for got, (key, text) in zip(sorted(found, key=lambda r: r.start), rows):
        want = struct.pack(f"<{len(library_ids(text or '')) + 1}I", *library_ids(text or ""), END_ID)
        assert (got.doc_id, got.start, bytes(got.tokens)) == (key, at, want)
        assert got.n_tokens == len(want) // 4
        at += got.n_tokens
    assert len(found) == len(rows)
    assert token_files.write_and_read(spark, no_docs, tokenizer_path(), END_ID).count() == 0


def test_reader_fetches_only_wanted_frames_and_checks_them(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    path = tmp_path / "x.zst"
    texts = {i: np.arange(i, i + 20, dtype="<u4").tobytes() for i in range(30)}
    with path.open("wb") as f:
        writer = token_files.FileWriter(f)
        for i, t in texts.items():
            writer.add(i, t)
        writer.close()
    data = path.read_bytes()
    with path.open("rb") as f:
        reader = token_files.FileReader(f, len(data))
        assert len(reader.frames) == 30
        opened = []
        frame = reader.frame
        monkeypatch.setattr(reader, "frame", lambda i: opened.append(i) or frame(i))
        assert reader.documents({4, 17}) == [(4, texts[4]), (17, texts[17])]
        assert opened == [4, 17]
    # any zstandard reader sees the plain frames and skips the two tables
    import io

    import zstandard
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data),
                                                       read_across_frames=True).read()
    assert texts[0] in whole and texts[29] in whole
    broken = bytearray(data)
    table = len(data) - 9 - 12 * 30
    broken[table + 8] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.FileReader(io.BytesIO(bytes(broken)), len(broken)).frame(0)


def test_read_documents_of_a_folder(spark, tmp_path):
    docs = documents(spark, SF_SMALL)
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write_files(docs, tokenizer_path(), END_ID, folder)
    rows = manifest.collect()
    manifest = spark.createDataFrame(rows, manifest.schema)
    got = {r.doc_id: bytes(r.tokens) for r in
           token_files.read_documents(manifest, folder, [3, 77]).collect()}
    text = {r.doc_id: r.text for r in docs.where("doc_id in (3, 77)").collect()}
    assert got == {i: np.array(library_ids(t) + [END_ID], "<u4").tobytes()
                   for i, t in text.items()}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text)
            if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text)
            if m.end() - m.start() >= 24]
    return sorted(out)


SECRET_PARTS = st.sampled_from(["password", "PassWd", "token", "api_key", "APIKEY", "secret", "=", ":",
                                " ", "'", '"', "abcdef", "AKIA", "ABCD1234", "0123456789abcdef",
                                "ſecret", "toKen", "İ", "\n", "é", "x" * 7, "akia", "."])


@settings(max_examples=400, deadline=None)
@given(st.lists(SECRET_PARTS, max_size=14))
def test_secret_spans_equal_plain_expressions(parts):
    text = "".join(parts)
    assert [s for s in secrets.scanner().spans(text) if s[1] != 3] == plain_spans(text)


def test_checksum_tokens_count_only_if_they_fit():
    body = "0123456789abcdefghijABCDEFGHIJ"
    good = "ghp_" + body + secrets.checksum(body)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert (2, 3, 2 + len(good)) in secrets.scanner().spans("x " + good + " y")
    assert not [s for s in secrets.scanner().spans("x " + bad) if s[1] == 3]


def test_secret_table_and_redaction(make_docs, odd_docs, no_docs):
    text = "set password = hunter22 now; AKIA" + "A1" * 10
    docs = make_docs([(1, text), (2, "clean text"), (3, None), (None, text)])
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.secret_spans(docs).collect()}
    assert spans[1] == [("assign", 4, 23), ("access", 29, 53)] and spans[2] == spans[3] == []
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "set [assign] now; [access]" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == "clean text" and rows[3].text is None and rows[3].n_chars is None
    assert secrets.redact(odd_docs).count() == odd_docs.count()
    assert secrets.redact(no_docs).count() == secrets.secret_spans(no_docs).count() == 0


def marks(text):
    return fingerprint.Fingerprint(fingerprint.code_points(text))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.text(max_size=80), st.integers(0, 80), st.integers(0, 80))
def test_common_extension_equals_plain_search(a, b, i, j):
    b = a[:len(a) // 2] + b
    i, j = min(i, len(a)), min(j, len(b))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    x, y = (fingerprint.PrefixHash(fingerprint.code_points(t)) for t in (a, b))
    assert x.common_extension(i, y, j) == n


def test_likeness_follows_shared_text():
    rng = random.Random(6)
    one, two = ("".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(2))
    assert marks(one).likeness(marks(one)) == 1.0
    assert 0.25 < marks(one).likeness(marks(one[:2000] + two[:2000])) < 0.75
    assert marks(one).likeness(marks(two)) < 0.1
    assert marks("").likeness(marks("")) == 1.0 and marks("").likeness(marks("x")) == 0.0


def test_likeness_across_the_lengths(make_docs):
    rng = random.Random(7)

    def dice(a, b, width):
        x, y = ({t[i:i + width] for i in range(len(t) + 1 - width)} for t in (a, b))
        return 2 * len(x & y) / (len(x) + len(y))

    for short, long in ((60, 66), (63, 64), (20, 64), (50, 90)):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(long))
        got = marks(text[:short]).likeness(marks(text))
        assert abs(got - dice(text[:short], text, fingerprint.SHORT_SPAN)) < 0.3 and got > 0.2
        assert got == marks(text).likeness(marks(text[:short]))
    # the case of the review: 85 code points, edited text of 60, 43 of them shared
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(85))
    rows = [(1, text), (2, "an unlike follower"), (3, text[:60]), (4, text[:66])]
    got = {r.doc_id: r for r in fingerprint.compare_neighbours(make_docs(rows)).collect()}
    assert (got[1].n_chars, got[1].common_prefix) == (85, 43) and got[1].near_edited > 0.4
    assert got[3].near_next > 0.7 and got[1].near_next < 0.1


def test_neighbours_across_partitions(make_docs, no_docs, odd_docs):
    rows = [(10 * i, f"text number {i} " * (i + 1)) for i in range(23)] + [(None, None)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r for r in fingerprint.compare_neighbours(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        new = text[:len(text) - half] + following[:half]
        r = got[key]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (r.n_chars, r.fingerprint) == (len(text), marks(text).text)
        assert r.near_next == marks(text).likeness(marks(following))
        assert r.near_edited == marks(text).likeness(marks(new))
    assert fingerprint.compare_neighbours(no_docs).count() == 0
    assert fingerprint.compare_neighbours(odd_docs).count() == odd_docs.count()
    single, = fingerprint.compare_neighbours(make_docs([(5, "abcd")])).collect()
    assert single.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and single.near_next == 1.0


def test_crc_of_tokens(spark):
    from ledgerlens.llm.queries import op8_token_files
    rows = {r.doc_id: r for r in op8_token_files(spark, SF_SMALL).collect()}
    at = 0
    for r in documents(spark, SF_SMALL).orderBy("doc_id").collect():
        ids = np.array(library_ids(r.text) + [END_ID], "<u4").tobytes()
        assert (rows[r.doc_id].start, rows[r.doc_id].ids_crc32) == (at, zlib.crc32(ids))
        at += len(ids) // 4
