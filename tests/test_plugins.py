from functools import partial

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.functions.embed import model_embed
from ledgerlens.operators import evaluation as ev
from ledgerlens.operators import retrieval
from ledgerlens.plans import qa
from ledgerlens.sources import index as idx
from ledgerlens.sources import sheets as sh
from ledgerlens.streaming import answers as st


def _predict():
    def letters(texts):
        return np.array([[t.lower().count(c) for c in "abcdefgh"] for t in texts], dtype=float)
    return letters


EMBED = partial(model_embed, make_predict=_predict)


def _unit(text):
    v = np.array([text.lower().count(c) for c in "abcdefgh"], dtype=float)
    n = np.linalg.norm(v)
    return v / n if n else v


def test_model_embedder_and_generator_in_index_retrieval_and_stream(spark, tmp_path):
    docs = spark.createDataFrame(
        [("0", 0, "A", "x", "aaa bbb"), ("1", 1, "B", "y", "ccc ddd"), ("2", 2, "C", "z", "eee h")],
        "doc_id string, row_id long, company_code string, industry string, content string")
    path = str(tmp_path / "index")
    idx.build_index(docs, path, "letters", EMBED)
    index = idx.open_index(spark, path, "letters")
    stored = {r.row_id: r.embedding for r in index.collect()}
    assert np.allclose(stored[1], _unit("ccc ddd"))
    asked = spark.createDataFrame([(5, 1, 0, "cd"), (6, 1, 1, "he")],
                                  "question_id long, session_id long, turn long, question string")
    hits = retrieval.retrieve(asked, index, 1, EMBED).collect()
    assert {r.question_id: r.row_id for r in hits} == {5: 1, 6: 2}
    answered = qa.rag_answers_from_index(asked, index, 1, generator=F.upper, embed=EMBED).collect()
    assert all(r.answer == r.prompt.upper() for r in answered)
    companies = spark.createDataFrame(
        [(0, "BHP", 1.0, 2.0)],
        "row_id long, company_name string, rev_fy_2024 double, rev_fy_2025 double")
    source, out = str(tmp_path / "q"), str(tmp_path / "answers")
    asked.write.parquet(source)
    st.run_question_stream(spark, source, companies, index, out, str(tmp_path / "chat"),
                           str(tmp_path / "ckpt"), files_per_trigger=100,
                           generator=lambda p: F.lit("said"), embed=EMBED)
    assert [r.answer for r in spark.read.parquet(out).collect()] == ["said", "said"]


def test_text_cosine_with_a_model(spark):
    df = spark.createDataFrame([(1, "aab", "ab"), (2, "aab", "h"), (3, None, "a"), (4, "aab", "ab")],
                               "id long, x string, y string")
    got = {r.id: r.c for r in ev.with_text_cosine(df, "x", "y", "c", EMBED).collect()}
    assert got == {1: round(float(_unit("aab") @ _unit("ab")), 9), 2: 0.0, 3: 0.0, 4: got[1]}


def test_cohort_summary_is_one_sorted_file(spark, tmp_path):
    rows = [("b", 3, 1.0), ("a", 5, 0.5), ("b", 1, 0.25)]
    df = spark.createDataFrame(rows, "cohort string, k int, rougeL double").select(
        "*", *[F.lit(None).cast("double").alias(c)
               for c in ("semantic_cosine", "good_refusal", "hallucination_rate")])
    path = str(tmp_path / "summary")
    sh.write_summary(df, path)
    assert len(list((tmp_path / "summary").glob("part-*"))) == 1
    got = sh.read_csv(spark, path, sh.SUMMARY_SCHEMA).collect()
    assert [tuple(r)[:3] for r in got] == [("a", 5, 0.5), ("b", 1, 0.25), ("b", 3, 1.0)]
