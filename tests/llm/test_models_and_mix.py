import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import (batches, mixing, near_dups, quality_crf, queries, toxicity_fm,
                            url_filter)
from ledgerlens.llm.batches import documents
from ledgerlens.llm.labelled import fold
from ledgerlens.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def held_out(spark, rows, label, folds, rest):
    truth = {r.doc_id: r[label] for r in read_table(spark, SF, "labels").collect()}
    out = [(r.predicted, truth[r.doc_id]) for r in rows
           if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % folds == rest]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == rest) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    return out


def test_quality_on_held_out_rows(spark):
    found = held_out(spark, queries.op7_quality_crf(spark, SF).collect(), "quality", 3, 1)
    assert np.mean([p == y for p, y in found]) > 0.97


def test_toxicity_on_held_out_rows(spark):
    found = held_out(spark, queries.op5_toxicity_fm(spark, SF).collect(), "toxic", 5, 0)
    assert np.mean([p == y for p, y in found]) > 0.93
    assert all(y for p, y in found if p)                       # clean documents are left alone


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    node, trans = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    ahead, back = quality_crf.messages(node, np.ones((1, 5), bool), trans)
    weight = np.zeros((2,) * 5)
    for at in np.ndindex(*weight.shape):
        weight[at] = np.exp(sum(node[0, i] * s for i, s in enumerate(at))
                            + sum(trans[a, b] for a, b in zip(at, at[1:])))
    for i in range(5):
        good = np.take(weight, 1, axis=i).sum() / weight.sum()
        assert np.isclose(1 / (1 + np.exp(-(ahead + back)[0, i])), good)


def test_field_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    crf = quality_crf.Crf(rng.normal(size=3 * quality_crf.N_OWN), rng.normal(size=(2, 2)), (1., 0.))
    raws = [b"", b"one", b"a\nb\nc", b"x | y\n" * 300, b"\n\n", "é É".encode()]
    alone = [crf.scores([r])[0] for r in raws]
    assert np.allclose(crf.scores(raws), alone)


def test_machine_pairs_equal_the_double_sum():
    rng = np.random.default_rng(3)
    weight, factor = rng.normal(size=9), rng.normal(size=(9, 4))
    sets = [[], [2], [0, 3, 8], list(range(9))]
    n = np.array(list(map(len, sets)))
    raw, _, _ = toxicity_fm._raw(np.concatenate(sets).astype(int), n, 0.5, weight, factor)
    for s, got in zip(sets, raw):
        want = 0.5 + sum(weight[i] for i in s) + sum(
            factor[i] @ factor[j] for a, i in enumerate(s) for j in s[:a])
        assert np.isclose(got, want)


def test_machine_learns_a_pair_that_weights_miss():
    rng = np.random.default_rng(4)
    sets, y = [], []
    for i in range(1200):
        a, b = rng.integers(0, 2, 2)
        noise = rng.integers(100, 130, 5)
        sets.append(np.unique(np.concatenate([noise, [1] * a, [2] * b]).astype(np.int64)))
        y.append(float(a and b))
    machine = toxicity_fm.fit(sets, np.array(y))
    one, two, both = machine.scores([[1], [2], [1, 2]])
    assert both > 0.5 > max(one, two)


@pytest.mark.parametrize("module,label", [(quality_crf, "quality"), (toxicity_fm, "toxic")])
def test_models_on_odd_rows(spark, odd_docs, no_docs, module, label):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (4, 1, 1), (None, 1, 1), (6, None, None)],
                                   "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("doc_id = 3")):
        model = module.train(odd_docs, known, F.lit(True))
        rows = module.score(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.score(no_docs, model).count() == 0
    assert quality_crf.keep_good(no_docs, quality_crf.fit([], [], np.empty(0))).count() == 0


def brute_targets(words):
    order = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + \
        [s for s in words if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(words.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * words[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * words[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mix_meets_its_targets(spark, make_docs, no_docs, odd_docs):
    rows = [(i, "w " * (i * 37 % 90), [None, "b", "a", "É", "z"][0 if i < 300 else i % 5])
            for i in range(700)] + [(5000, None, "a"), (5000, "x y", "a"), (None, "q r s", "b")]
    got = mixing.mixture(make_docs(rows)).collect()
    again = mixing.mixture(make_docs(rows, 7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    words, taken, target = defaultdict(int), defaultdict(int), {}
    for _, text, source in rows:
        words[source] += len((text or "").split())
    want = brute_targets(words)
    for r in got:
        assert r.source_size == words[r.source] and 0 <= r.taken <= 2 * r.size
        assert np.isclose(r.target, want[r.source])
        assert r.taken == sum(t.words for t in r.turns)
        assert all(0 <= t.at <= 1 for t in r.turns)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in words)
    assert mixing.mixture(no_docs).count() == 0
    assert mixing.mixture(odd_docs).count() == odd_docs.count()
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and mixing.mixed_documents(no_docs).count() == 0


def test_documents_without_words_pass_the_mix(odd_docs):
    out = mixing.mixed_documents(odd_docs).where("doc_id in (0, 1, 2)").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(0, None), (1, ""), (2, " \t\n")]


def test_mix_keeps_the_values_of_clashing_columns(spark, make_docs):
    names = ["_at", "_id", "_ats", "row", "ats", "at", "turns", "a.b", "size", "target"]
    docs = make_docs([(i, f"one two {i}", "s" if i % 3 else None) for i in range(30)]
                     + [(None, "no id", "s")]).select("doc_id", "text", "source")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.col("text"), F.lit(f"/{k}")))
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("text")))
    for out in (mixing.mixed_documents(docs), near_dups.keep_one(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{r.text}/{k}" and r.m == {"k": r.text}
                            for r in rows for k, n in enumerate(names))


def test_whole_documents_within_the_line_bound(spark):
    assert quality_crf.within([(1, 5), (2, 9), (3, 4)], 10) == {1, 3}
    docs, labels = documents(spark, SF), read_table(spark, SF, "labels")
    few = quality_crf.train(docs, labels, F.lit(True), sample_lines=300)
    assert not np.allclose(few.weights, quality_crf.train(docs, labels, F.lit(True)).weights)


def test_worker_state_holds_one_stage():
    made = []
    for stage, key in (("a", 1), ("a", 1), ("b", 1), ("a", 1)):
        batches.worker_state(stage, key, lambda: made.append((stage, key)) or object())
    assert made == [("a", 1), ("b", 1), ("a", 1)]


def test_positions_follow_the_schedule(spark, make_docs):
    one = spark.range(1).select(*[
        mixing.position(F.lit(1000.0 * z), F.lit(1000.0), F.lit(a), F.lit(b)).alias(f"c{i}_{j}")
        for i, z in enumerate((0.0, 0.25, 1.0)) for j, (a, b) in enumerate(((1., 1.), (.5, 1.5)))]).first()
    assert [one[f"c{i}_0"] for i in range(3)] == [0.0, 0.25, 1.0]
    t = one["c1_1"]                     # area .5 t + .5 t^2 is a quarter
    assert np.isclose(0.5 * t + 0.5 * t * t, 0.25) and one["c2_1"] == 1.0
    rows = [(i, "w w w", "a" if i % 3 else "b") for i in range(200)]
    order = mixing.training_order(mixing.mixture(make_docs(rows))).orderBy("rank").collect()
    assert [r.rank for r in order] == list(range(len(order)))
    assert [r.at for r in order] == sorted(r.at for r in order)


def test_op2_ranks_follow_its_positions(spark):
    rows = queries.op2_curriculum_mix(spark, SF).collect()
    passes = sorted((k, at) for r in rows for k, at in zip(r.ranks or [], r.positions))
    assert [k for k, _ in passes] == list(range(sum(len(r.positions) for r in rows)))
    assert [at for _, at in passes] == sorted(at for _, at in passes)


def test_machine_learns_pairs_without_effects_of_their_own():
    # toxic with both terms or with neither, so that each term alone says nothing
    rng = np.random.default_rng(8)
    terms = rng.random((1600, 2)) < 0.5
    y = (terms[:, 0] == terms[:, 1]).astype(float)
    filler = [rng.choice(np.arange(100, 400), 12, replace=False) for _ in y]
    sets = [np.unique(np.concatenate([np.flatnonzero(t) + 7, f])) for t, f in zip(terms, filler)]
    machine = toxicity_fm.fit(sets[:1200], y[:1200])
    assert machine.used[[7, 8]].all() and machine.used.sum() < 20
    predicted = machine.scores([s.tolist() for s in sets[1200:]]) >= 0.5
    assert (predicted == (y[1200:] == 1)).mean() > 0.97
    # terms that merely add up are no pair
    plain = (terms[:, 0] | (rng.random(1600) < 0.1)).astype(float)
    held = np.bincount(np.concatenate(sets), minlength=toxicity_fm.BUCKETS)
    assert len(toxicity_fm.paired_terms(sets, plain, held)) == 0


def test_reputation_shrinks_and_blocks(spark):
    hosts = [("a.bad.com", 1, 30), ("b.bad.com", 1, 25), ("new.bad.com", 0, 0),
             ("x.good.com", 0, 40), ("y.good.org", 0, 35), ("one.good.org", 1, 1)]
    outcomes = spark.createDataFrame([(h, bad) for h, bad, n in hosts for _ in range(n)],
                                     "host string, bad int")
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, (h, _, _) in enumerate(hosts)],
                                  "page_id long, url string")
    rows = {r.host: r for r in url_filter.judge(pages, outcomes, rules=()).collect()}
    shares = {h: r.bad_share for h, r in rows.items()}
    # a host without pages takes after its domain, one bad page is no proof
    assert 0.5 < shares["new.bad.com"] < shares["b.bad.com"] < shares["a.bad.com"] < 1
    assert shares["x.good.com"] < 0.2 and shares["y.good.org"] < shares["one.good.org"] < 0.9
    assert all(r.bound < r.bad_share for r in rows.values())
    assert {h for h, r in rows.items() if r.verdict == "block"} >= {"a.bad.com", "b.bad.com"}
    assert rows["x.good.com"].verdict == rows["y.good.org"].verdict == "allow"


def test_one_known_label_is_an_outcome(spark):
    pages = spark.createDataFrame([(i, f"http://h/en/{i}") for i in range(4)],
                                  "page_id long, url string")
    labels = spark.createDataFrame([(0, 0, None), (1, None, 0), (2, None, None), (3, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = queries.page_outcomes(pages, labels).collect()
    assert sorted(r.bad for r in got) == [0, 1, 1]


def brute_rule(host, path):
    best = None
    for h, p, says in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, says)
    return best


def test_urls_and_rules(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/1?x#y", "https://a.example.org/en/12",
            "https://example.org", "http://x.com/fr/", "http://notcom/fr/", "http://b.com/de/?q",
            "x://y://z/es/", "http://h?x/y", "http://h#/y", "http://xexample.org/es/", "http://com/fr/é\n/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = spark.createDataFrame([("h", 1)] * 40 + [("h", None)] + [("b.com", 0)] * 200, "host string, bad int")
    rows = {r.page_id: r for r in url_filter.judge(pages, bad).collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(str.maketrans(*url_filter.LOWER)), m[2]) if m else ("", "")
        assert (rows[i].host, rows[i].path) == (host, path)
        rule = brute_rule(host, path)
        assert rows[i].rule == (rule and rule[0])
        if rule:
            assert rows[i].verdict == rule[1]
    assert rows[10].verdict == "block" and rows[0].verdict == "allow"
    none = url_filter.judge(pages, bad.limit(0)).where("rule is null")
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), bad).count() == 0


def test_pipeline_stages(spark, odd_docs, no_docs, tmp_path):
    docs = documents(spark, SF)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality classifier":
            good = {r.doc_id for r in queries.op7_quality_crf(spark, SF).where("predicted = 1").collect()}
            assert {r.doc_id for r in docs.collect()} == good
        elif name == "near duplicates":
            assert docs.count() < before.count()
            assert docs.count() == docs.select("doc_id").distinct().count()
        elif name == "secret scan":
            assert docs.count() == before.count()
    assert docs.columns == ["doc_id", "n_tokens", "ids"] and docs.count() > 0
    assert docs.where("size(ids) != n_tokens").isEmpty()
    for frame in (odd_docs, no_docs):
        plain = frame.select("doc_id", "text", "lang", "source", "n_chars")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            plain = stage(spark, plain, SF)
            plain.write.parquet(f"{tmp_path}/{id(frame)}-{k}")
            plain = spark.read.parquet(f"{tmp_path}/{id(frame)}-{k}")


def test_folds(spark):
    got = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
