"""Inverted index against dense products; committed index folders."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions.embed import hashing_embed, hashing_terms
from ledgerlens.operators import postings as ps
from ledgerlens.operators import retrieval
from ledgerlens.plans import qa
from ledgerlens.sources import index as idx

VECTORS = st.lists(st.dictionaries(st.integers(0, 9), st.sampled_from(
    [0.1, 0.25, 0.5, 1.0, 2.0, -0.5]), max_size=6), max_size=25)


def brute(question, docs, ids, k):
    scores = [round(sum(w * d.get(t, 0.0) for t, w in question.items()), 9) for d in docs]
    best = sorted((-s, i) for s, i in zip(scores, ids))[:k]
    return [(i, -s) for s, i in best]


def parts(vector):
    terms = sorted(vector)
    return np.array(terms, np.int64), np.array([vector[t] for t in terms], np.float64)


@given(VECTORS, VECTORS, st.integers(1, 6), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_chunks_with_thresholds_equal_brute_force(questions, docs, k, rows):
    ids = np.array([7 * (i // 2) for i in range(len(docs))], np.int64)       # ids repeat
    found = ps.Searcher([parts(q) for q in questions], k)
    for at in range(0, len(docs), rows):
        own = [parts(d) for d in docs[at:at + rows]]
        found.add(ps.Chunk.of(ids[at:at + rows], [t for t, _ in own], [w for _, w in own]))
    for q, vector in enumerate(questions):
        got = [(int(i), float(s)) for i, s in zip(found.ids[q], found.scores[q])]
        assert got == brute(vector, docs, ids.tolist(), k)


def test_thresholds_leave_out_postings():
    rng = np.random.default_rng(1)
    # rare terms weigh more, as in any weighting for search
    docs = [{int(t): float(np.log(2 + t)) for t in rng.choice(2000, 30, replace=False,
                                                              p=_skewed(2000))}
            for _ in range(4000)]
    asked = [docs[i] for i in range(0, 4000, 200)]
    found = ps.Searcher([parts(q) for q in asked], 5)
    for at in range(0, 4000, 500):
        own = [parts(d) for d in docs[at:at + 500]]
        found.add(ps.Chunk.of(np.arange(at, at + 500), [t for t, _ in own], [w for _, w in own]))
    lists = {}
    for d in docs:
        for t in d:
            lists[t] = lists.get(t, 0) + 1
    every = sum(lists[t] for q in asked for t in q)
    assert found.read < 0.6 * every          # of the questions' own lists
    assert every < 0.25 * len(asked) * len(docs) * 30        # of a product for each pair and term
    for q, vector in enumerate(asked):
        assert found.ids[q].tolist() == [i for i, _ in brute(vector, docs, range(4000), 5)]


def _skewed(n):
    p = 1 / np.arange(1, n + 1)
    return p / p.sum()


TEXTS = ["alpha beta", "beta gamma gamma", None, "", "delta", "alpha alpha delta", "beta", "x y z"]


@pytest.mark.parametrize("together", [20_000, 3])
def test_search_equals_dense_search(spark, monkeypatch, together):
    monkeypatch.setattr(ps, "SLICE", together)
    monkeypatch.setattr(ps, "CHUNK_ROWS", 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "row_id long, t string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "q long, t string")
    got = retrieval.search_texts(asked, "q", "t", docs, "row_id", "t", 4, 24).collect()
    dense = retrieval.retrieve(asked, hashing_embed(docs, "t"), 4, qid="q", qtext="t").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, dense)) and len(got) == 32
    assert retrieval.search_texts(asked.limit(0), "q", "t", docs, "row_id", "t", 4, 24).isEmpty()
    assert retrieval.search_texts(asked, "q", "t", docs.limit(0), "row_id", "t", 4, 0).isEmpty()


def test_sparse_forms_agree(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, t string")
    direct = hashing_terms(docs, "t").collect()
    dense = ps.sparse(hashing_embed(docs, "t"), "row_id", "embedding").collect()
    assert [tuple(r) for r in direct] == [tuple(r) for r in dense]


def _docs(spark, n=8):
    return spark.createDataFrame(
        [(str(i), i, "C", "I", TEXTS[i % 8] or "") for i in range(n)],
        "doc_id string, row_id long, company_code string, industry string, content string")


def test_a_killed_build_is_built_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")

    def killed(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(idx, "build_postings", killed)
        with pytest.raises(RuntimeError):
            idx.build_index(_docs(spark), path)
    assert idx.read_manifest(spark, path) is None            # documents lie there, half an index
    with pytest.raises(ValueError):
        idx.open_index(spark, path)
    assert idx.build_index(_docs(spark), path)
    assert not idx.build_index(_docs(spark, 3), path)          # what is there stays
    manifest = idx.read_manifest(spark, path)
    assert (manifest["rows"], manifest["dimension"], manifest["chunks"]) == (8, 256, 1)
    assert idx.open_index(spark, path).count() == 8
    with pytest.raises(ValueError):
        idx.open_index(spark, path, "another")
    # of two builds the first to commit is the index
    assert not idx.Folder(spark, path).commit(idx.MANIFEST, "{}")
    assert idx.read_manifest(spark, path) == manifest


def test_answers_from_postings_move_no_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    idx.build_index(_docs(spark), path)
    index, lists = idx.open_index(spark, path), idx.open_postings(spark, path)
    asked = spark.createDataFrame([(1, "alpha"), (2, "gamma delta")],
                                  "question_id long, question string")
    hits = retrieval.retrieve(asked, index, 3, postings=lists)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and plan.count("Exchange") == 1       # the merge by question
    dense = retrieval.retrieve(asked, index, 3)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, dense.collect()))
    both = [qa.rag_answers_from_index(asked, index, 3, postings=p).select(
        "question_id", F.md5("prompt")).collect() for p in (None, lists)]
    assert sorted(both[0]) == sorted(both[1])


def test_dense_chunks_are_multiplied_by_blocks_of_questions(monkeypatch):
    """Not searched question by question; exact with chunks that lack terms and with ties."""
    rng = np.random.default_rng(4)
    vectors = [{int(t): float(w) for t, w in zip(rng.choice(40, 15, replace=False),
                                                 rng.choice([0.25, 0.5, 1.0], 15))}
               for _ in range(120)]
    asked = [*vectors[:30], {}, {77: 1.0}]
    monkeypatch.setattr(ps.Chunk, "search", None)
    found = ps.Searcher([parts(q) for q in asked], 4)
    for at in range(0, 120, 25):
        own = [parts(d) for d in vectors[at:at + 25]]
        found.add(ps.Chunk.of(np.arange(at, min(at + 25, 120)), [t for t, _ in own],
                              [w for _, w in own]))
    for q, vector in enumerate(asked):
        got = list(zip(found.ids[q].tolist(), found.scores[q].tolist()))
        assert got == brute(vector, vectors, range(120), 4)
