"""ST1 / ST2 state: every question is accepted once, with its place in its session.

A keyed state per session (``transformWithState`` over a state store) holds the ids of
the questions accepted and how many there were. A question that is delivered again,
in the same batch, a later one or after a restart, is dropped; a new one gets the next
turn number. State belongs to the query's checkpoint and is versioned by batch, so a
batch that is run again after a failure gives the same numbers.

A session's questions of one batch are ordered by id (batches are bounded by the
trigger). ``keep_ms`` forgets ids that long after they were accepted, which bounds the
state of sessions that never end; without it nothing is forgotten. Questions without
an id are dropped; questions without a session form one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["question_id", "session_id", "turn", "question"]


class AcceptOnce(StatefulProcessor):
    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getMapState("accepted", "question_id long", "turn_no long",
                                           self.keep_ms)
        self.turns = handle.getValueState("turns", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame],
                        timerValues) -> Iterator[pd.DataFrame]:
        turns = self.turns.get()[0] if self.turns.exists() else 0
        asked = pd.concat(list(rows)).dropna(subset=["question_id"]).sort_values("question_id")
        numbers = []
        for question in asked["question_id"].astype("int64"):
            own = (int(question),)
            if self.accepted.containsKey(own):
                numbers.append(None)
            else:
                turns += 1
                numbers.append(turns)
                self.accepted.updateValue(own, (turns,))
        self.turns.update((turns,))
        asked["turn_no"] = pd.array(numbers, dtype="Int64")
        yield asked[asked["turn_no"].notna()][[*COLUMNS, "turn_no"]]

    def close(self) -> None:
        pass


def accepted(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """``question_id, session_id, turn, question, turn_no`` of the questions of
    ``stream`` that come for the first time; turn_no counts from 1 in a session."""
    return (stream.select(*COLUMNS).groupBy("session_id").transformWithStateInPandas(
        AcceptOnce(keep_ms), "question_id long, session_id long, turn long, question string, "
        "turn_no long", "append", "processingTime" if keep_ms else "none"))
