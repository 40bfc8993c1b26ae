from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.embed import model_embed
from ledgerlens.operators import evaluation as ev
from ledgerlens.sources.embeddings import EmbeddingStore


def _letters():
    return lambda texts: np.array([[t.count(c) for c in "abcd"] for t in texts], dtype=float)


EMBED = partial(model_embed, make_predict=_letters)


def _refuse(*args):
    raise AssertionError("nothing is missing")


def test_a_text_is_embedded_once(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path), "letters/v1")
    texts = spark.createDataFrame([("ab",), ("ab",), (None,), ("",), ("cd d",)], "t string")
    assert store.add_missing(texts, "t", EMBED) == 3
    assert store.add_missing(texts, "t", _refuse) == 0
    more = texts.union(spark.createDataFrame([("new a",)], "t string"))
    seen = []

    def embed(df, text, out):
        seen.extend(r.text for r in df.select("text").collect())
        return EMBED(df, text, out)

    assert store.vectors(more, "t", embed).count() == 4 and seen == ["new a"]
    other = EmbeddingStore(spark, str(tmp_path), "another")
    assert other.stored().isEmpty() and other.add_missing(texts.limit(0), "t", _refuse) == 0


def test_texts_stored_twice_are_read_once(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path), "letters")
    texts = spark.createDataFrame([("ab",), ("c",)], "t string")
    store.add_missing(texts, "t", EMBED)
    batch = store.stored().collect()
    spark.createDataFrame(batch, "text_hash string, vector array<double>").write.parquet(
        f"{store.root}/batch-again")
    assert store.stored().count() == 4
    assert store.vectors(texts, "t", _refuse).count() == 2
    store.compact()
    assert store.stored().count() == 2
    assert sorted(map(str, store.stored().collect())) == sorted(map(str, batch))


@pytest.mark.parametrize("stored", [False, True])
def test_report_takes_an_embedder(spark, tmp_path, stored):
    store = EmbeddingStore(spark, str(tmp_path / "s"), "letters") if stored else None
    rows = [("Known", 0, "q", "c", "ab cd", "ab", "cd", None),
            ("Known", 1, "q", "c", "a", "", "b", "a"),
            ("Out-of-KB", 2, "q", "c", "g", "I cannot", "x", "")]
    sheets = spark.createDataFrame(
        rows, "sheet string, row_id long, query string, expected_company string, gold string, "
        "pred_k1 string, pred_k3 string, pred_k5 string")
    got = {(r.row_id, r.k): r for r in ev.per_query_metrics(sheets, embed=EMBED, store=store)
           .collect()}
    assert len(got) == 9
    half = round(float(np.sqrt(0.5)), 9)
    assert (got[0, 1].semantic_cosine, got[0, 3].semantic_cosine) == (half, half)
    assert got[0, 5].semantic_cosine == 0 and got[1, 1].semantic_cosine == 0
    assert got[1, 3].semantic_cosine == 0 and got[1, 5].semantic_cosine == 1
    plain = {(r.row_id, r.k): r.rougeL for r in ev.per_query_metrics(sheets).collect()}
    assert {key: r.rougeL for key, r in got.items()} == plain
    if stored:
        again = ev.per_query_metrics(sheets, embed=_refuse, store=store)
        assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))
        assert again.where(F.col("k") == 1).count() == 3
