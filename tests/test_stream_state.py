from pyspark.sql import functions as F

from ledgerlens.sources import index as idx
from ledgerlens.streaming import answers as st

SCHEMA = "question_id long, session_id long, turn long, question string"


def test_a_question_delivered_twice_is_answered_once(spark, tmp_path):
    docs = spark.createDataFrame(
        [(str(i), i, "C", "I", t) for i, t in enumerate(["alpha beta", "gamma", "delta"])],
        "doc_id string, row_id long, company_code string, industry string, content string")
    idx.build_index(docs, str(tmp_path / "index"))
    index = idx.open_index(spark, str(tmp_path / "index"))
    lists = idx.open_postings(spark, str(tmp_path / "index"))
    companies = spark.createDataFrame(
        [(0, "BHP", 1.0, 2.0)],
        "row_id long, company_name string, rev_fy_2024 double, rev_fy_2025 double")
    source, answers, chat = (str(tmp_path / n) for n in ("in", "answers", "chat"))

    def deliver(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        st.run_question_stream(spark, source, companies, index, answers, chat,
                               str(tmp_path / "ckpt"), generator=lambda p: F.lit("said"),
                               postings=lists)

    deliver([(11, 1, 0, "alpha"), (12, 1, 1, "gamma"), (11, 1, 0, "alpha"), (21, 2, 0, "delta"),
             (None, 2, 1, "no id")])
    first = {tuple(r) for r in st.replay_chat(spark.read.parquet(chat)).collect()}
    # 12 and 21 come again, in a batch after a restart, among new ones
    deliver([(12, 1, 1, "gamma"), (13, 1, 2, "beta"), (21, 2, 0, "delta"), (9, 1, 3, "late")])
    done = spark.read.parquet(answers).collect()
    assert sorted(r.question_id for r in done) == [9, 11, 12, 13, 21]
    assert all(r.answer == "said" for r in done)
    replay = sorted(st.replay_chat(spark.read.parquet(chat)).collect())
    assert first <= {tuple(r) for r in replay}
    places = [(r.session_id, r.position, r.role, r.question_id) for r in replay]
    assert places == [(1, 2 * i + s + 1, ("user", "assistant")[s], q)
                      for i, q in enumerate((11, 12, 9, 13)) for s in (0, 1)] + [
        (2, 1, "user", 21), (2, 2, "assistant", 21)]
