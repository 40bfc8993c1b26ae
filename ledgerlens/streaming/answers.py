"""ST1 / ST2 / W3: a stream of questions answered in micro-batches and
appended to a chat log that is replayed in order.

* Source: a file stream of question rows (``readStream`` with a declared
  schema; ``maxFilesPerTrigger`` bounds a micro-batch).
* Keyed state (``accept.py``): a question that is delivered twice is answered once, and
  every question gets its number in its session.
* Each micro-batch (``foreachBatch``): stream–static joins against the
  persisted document index and the company table — text questions get a
  retrieved-context answer, chart questions a chart status message. Top-k
  needs a non-time window, which streaming DataFrames reject, hence
  ``foreachBatch`` rather than a continuous operator.
* Sinks: answers and chat-log rows partitioned by ``batch_id`` and written
  with dynamic partition overwrite, so a re-run batch (after a failure)
  replaces its own output instead of duplicating it (idempotent).
* Progress, offsets and state live under the shared checkpoint folder. The accepted
  questions of a batch are written there once and read back, so the state is gone
  through once a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embed import hashing_embed
from ..operators.charts import chart_answers, route
from ..plans.qa import rag_answers_from_index
from ..session import cut_lineage
from .accept import PROVIDER, ROCKSDB, accepted

QUESTION_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("question", T.StringType()),
])


def answer_batch(batch: DataFrame, companies: DataFrame, index: DataFrame, generator=None,
                 embed: Callable = hashing_embed,
                 postings: DataFrame | None = None) -> DataFrame:
    """(question_id, session_id, turn, question, is_chart, answer)."""
    routed = route(batch).select("question_id", "is_chart")
    text = rag_answers_from_index(batch, index, generator=generator, embed=embed,
                                  postings=postings).select("question_id", F.col("answer"))
    charts, _ = chart_answers(batch, companies)
    chart_msg = charts.select("question_id", F.col("message").alias("answer"))
    answers = text.unionByName(chart_msg)
    numbered = [c for c in ("turn_no",) if c in batch.columns]
    return (batch.join(routed, "question_id")
                 .join(answers, "question_id", "left")
                 .select("question_id", "session_id", "turn", "question", "is_chart", "answer",
                         *numbered))


def chat_rows(answered: DataFrame) -> DataFrame:
    """ST2: the user message and the assistant reply of each question, with their place
    in the session (two messages a turn)."""
    msgs = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"),
                 F.col("question").alias("content")),
        F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("role"),
                 F.coalesce(F.col("answer"), F.lit("")).alias("content")))
    place = (2 * F.col("turn_no") - 1 + F.col("_m.seq")).cast("int")
    return answered.select("session_id", "question_id", "turn_no", F.explode(msgs).alias("_m")
                           ).select("session_id", "question_id", "_m.seq", "_m.role",
                                    "_m.content", place.alias("position"))


def _write_partition(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("batch_id").parquet(path))


def run_question_stream(spark: SparkSession, source_dir: str, companies: DataFrame,
                        index: DataFrame, answers_path: str, chat_path: str,
                        checkpoint: str, files_per_trigger: int = 1, generator=None,
                        embed: Callable = hashing_embed,
                        postings: DataFrame | None = None, keep_ms: int | None = None) -> None:
    """Process every question file present now (``availableNow``), then stop. A later
    call with the same ``checkpoint`` goes on with its offsets and its state."""
    stream = (spark.readStream.schema(QUESTION_SCHEMA)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir))

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch)
        answered = answer_batch(batch, companies, index, generator, embed, postings).withColumn(
            "batch_id", F.lit(batch_id))
        _write_partition(answered.drop("turn_no"), answers_path)
        # the log comes from the answers as written, numbered as accepted
        done = spark.read.parquet(answers_path).where(F.col("batch_id") == batch_id).join(
            batch.select("question_id", "turn_no"), "question_id")
        _write_partition(chat_rows(done).withColumn("batch_id", F.lit(batch_id)), chat_path)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)              # which keyed state needs
    try:
        q = (accepted(stream, keep_ms).writeStream.foreachBatch(process)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def replay_chat(chat: DataFrame) -> DataFrame:
    """Messages of each session with their place (1, 2, …), which was given when the
    question was accepted: no session is gathered anywhere."""
    return chat.select("session_id", "position", "role", "content", "question_id")
