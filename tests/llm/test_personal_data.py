"""Personal data: base patterns against plain expressions, the field against enumeration."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import personal_data as pd_
from ledgerlens.llm.queries import op12_personal_data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def good(kind, m):
        n = sum(c in "0123456789" for c in m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= n <= 19 and pd_.luhn(re.sub("[^0-9]", "", m))
        return kind == "email" or 9 <= n <= 15

    return sorted((m.start(), pd_.KINDS.index(kind), m.end()) for kind, p in PLAIN.items()
                  for m in p.finditer(text) if good(kind, m[0]))


PARTS = st.sampled_from([
    "a.b@c.de", "@", "+1 (212) 555-0123", "4111111111111111", "192.0.2.17", "1.2.3.4.5.6.7.8.9",
    "300.1.1.1", " ", "-", ".", "+", "0", "7", "é", "x", "\n", "00000000000000000000000000",
    "a@b@c.d.", "0255.1.1.01", "(", ")"])


@given(st.lists(PARTS, max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_plain_expressions(text):
    assert pd_.base_spans(text) == plain_spans(text)


def test_base_spans_are_linear_in_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a." * 100_000 + "@",
                 "+" * 100_000, "1-" * 100_000, "@" * 100_000):
        pd_.base_spans(text)


def fitted_words(chain):
    """Best labels of a chain of words by trying all."""
    model = pd_.trained()
    near = [["edge"], *([*pd_.near_features(w)] if pd_.possible(w) else ["word"] for w in chain),
            ["edge"]]
    best = None
    for labels in itertools.product(*[range(pd_.N_LABELS) if pd_.possible(w) else [0]
                                      for w in chain]):
        total = 0.0
        for i, (w, y) in enumerate(zip(chain, labels)):
            if pd_.possible(w):
                total += (model.table(pd_.own_features(w), "0") + model.table(near[i], "-")
                          + model.table(near[i + 2], "+"))[y]
            if i:
                total += model.trans[labels[i - 1], y]
        best = max(best or (total, labels), (total, labels))
    return best[1]


@pytest.mark.parametrize("text", [
    "call +1 (269) 555-3296 4524132264652876 now", "1 22 333", "x 1.2.3.4 y a@b.example",
    "0049 30 23125 100", "12 a 555-0199 b 4111 1111"])
def test_viterbi_on_cut_chains_is_the_best_of_all(text):
    chain = text.split()
    finder = pd_.Finder(pd_.trained())
    words = pd_.Words.of([b"before 12", text.encode(), b"", b"9"])
    labels = finder._labels(words)
    own = (words.begin >= words.first[1]) & (words.begin < words.first[2])
    expected = [y for w, y in zip(chain, fitted_words(chain)) if pd_.possible(w)]
    assert labels[own].tolist() == expected


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(2)
    node, trans = rng.normal(size=(3, pd_.N_LABELS)), rng.normal(size=(pd_.N_LABELS,) * 2)
    y, starts = np.array([1, 2, 0]), np.array([0, 3])

    def likelihood(node):
        def total(labels):
            return (node[np.arange(3), list(labels)].sum()
                    + trans[labels[0], labels[1]] + trans[labels[1], labels[2]])
        every = [total(p) for p in itertools.product(range(pd_.N_LABELS), repeat=3)]
        return total(y) - np.logaddexp.reduce(every)

    slope, _ = pd_._slopes(node, trans, starts, y)
    for t, s in ((0, 1), (1, 4), (2, 0)):
        moved = node.copy()
        moved[t, s] += 1e-5
        assert abs((likelihood(moved) - likelihood(node)) / 1e-5 - slope[t, s]) < 1e-3


def test_field_learns_its_table_and_held_out_lines():
    def found(model, line):
        text = re.sub(r"\{(\w+)\|([^}]*)\}", r"\2", line)
        words, labels = pd_.parsed(line)
        cut = pd_.Words.of([text.encode()])
        own = pd_.Finder(model)._labels(cut) if len(cut.begin) else []
        return list(own) == [y for w, y in zip(words, labels) if pd_.possible(w)]

    assert all(found(pd_.trained(), line) for line in pd_.EXAMPLES)
    held_out = pd_.EXAMPLES[::5]
    model = pd_.fit([e for i, e in enumerate(pd_.EXAMPLES) if i % 5])
    right = [found(model, line) for line in held_out]
    assert sum(right) >= 0.75 * len(right)


def test_field_adds_what_the_patterns_lose(spark, make_docs):
    texts = ["so +1 (269) 555-3296 4524132264652876 and", "an jürgen@exämple.de, bald",
             "ring (646) 555-0112 now", "in 1984 there were 4.2.1 and 8812345 of 100 200 300",
             "mail a.b@c.example, host 192.0.2.7", "+1 (212) 555-0123"]
    docs = make_docs(list(enumerate(texts)))
    rows = {r.doc_id: r.spans for r in pd_.personal_spans(docs).collect()}
    got = {i: [(s.kind, texts[i][s.start:s.end], s.base) for s in spans]
           for i, spans in rows.items()}
    assert got[0] == [("phone", "+1 (269) 555-3296", False), ("card", "4524132264652876", False)]
    assert got[1] == [("email", "jürgen@exämple.de", False)]
    assert got[2] == [("phone", "(646) 555-0112", False)]
    assert got[3] == []
    assert got[4] == [("email", "a.b@c.example", True), ("ip", "192.0.2.7", True)]
    assert got[5] == [("phone", "+1 (212) 555-0123", True)]


def test_odd_documents(spark, odd_docs, no_docs):
    assert pd_.personal_spans(no_docs).count() == 0
    rows = pd_.personal_spans(odd_docs)
    assert rows.count() == odd_docs.count() and rows.where("size(spans) > 0").count() == 0
    assert pd_.personal_spans(odd_docs, examples=()).count() == odd_docs.count()


def test_query_keeps_base_spans(spark):
    found = {r.doc_id: r for r in op12_personal_data(spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(found) == len(texts)
    for d in texts:
        row, base = found[d.doc_id], plain_spans(d.text or "")
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(k == i for _, k, _ in base) for i in range(4)]
        assert {f"{pd_.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(row.spans.split(","))
