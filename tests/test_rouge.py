from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.functions import rouge
from ledgerlens.functions.porter import stem
from ledgerlens.functions.rouge import PairScorer, clean_py, lcs_length, rouge_l, tokens

words = st.lists(st.sampled_from(list("abcdefg")), max_size=60)


def _dp(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_lcs_matches_dp_and_is_symmetric(a, b):
    assert lcs_length(a, b) == _dp(a, b) == lcs_length(b, a)


@given(words)
def test_lcs_self(a):
    assert lcs_length(a, a) == len(a)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.text(max_size=80))
def test_rouge_in_unit_interval(a, b):
    assert 0.0 <= rouge_l(a, b) <= 1.0


def test_rouge_edges():
    assert rouge_l("same words here", "same words here") == 1.0
    assert rouge_l("", "x") == 0.0
    assert rouge_l(None, "x") == 0.0
    assert rouge_l("!!! ...", "abc") == 0.0          # non-empty but zero tokens
    assert rouge_l("café", "caf") == 1.0              # accented letter splits the word


def test_tokens_stem_only_long_words():
    assert tokens("The cats were running", True) == ["the", "cat", "were", "run"]


def test_porter_paper_examples():
    cases = {"caresses": "caress", "ponies": "poni", "relational": "relat",
             "hopefulness": "hope", "generalizations": "gener", "adjustable": "adjust",
             "controll": "control", "sky": "sky", "dying": "die"}
    assert {w: stem(w) for w in cases} == cases


texts = st.one_of(st.none(), st.text("ab sing.", max_size=20), st.just(float("nan")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=12), st.booleans())
def test_scores_of_a_batch_equal_those_of_single_pairs(pairs, stemmed):
    scorer = PairScorer(stemmed, 256)
    for pred, ref in pairs:
        tp, tr = ([stem(t) if stemmed and len(t) > 3 else t for t in tokens(clean_py(x), False)]
                  for x in (pred, ref))
        lcs = _dp(tr, tp)
        want = 2 * lcs / (len(tp) + len(tr)) if lcs else 0.0
        assert abs(scorer.rouge(pred, ref) - want) < 1e-12
        assert scorer.cosine(pred, ref) == PairScorer(stemmed, 256).cosine(pred, ref)


def test_stems_stay_bounded(monkeypatch):
    monkeypatch.setattr(rouge, "MAX_STEMS", 3)
    rouge._STEMS.clear()
    words = "running runner jumped jumping walked walks talking".split()
    assert tokens(" ".join(words), True) == [stem(w) for w in words]
    assert len(rouge._STEMS) <= 3
