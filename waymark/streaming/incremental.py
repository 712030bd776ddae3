"""Transitions from a stream of steps, with the last position of each person as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_pairs(steps: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(person, src, dst): valid transitions of a stream (person, ord, label).

    Positions of a person arrive in order, over any number of batches, and one position's rows too: it stays open until a
    later one comes, so that a second label makes it ambiguous whenever it arrives. Rows of closed positions come too
    late and are skipped. A row with a null label closes what is open and adds nothing. In a stream that goes on, a
    state that is idle for idle_ms is closed and dropped, so state is bounded by the people of that time. A run over
    what is there must not set it: Spark would run empty batches for ever to look for idle states."""

    def closed(state: tuple, out: list, person) -> tuple:
        """The state (last ord, last label, open ord, open label, ambiguous) once its open position is closed."""
        last, label, at, own, ambiguous = state
        if at is None or ambiguous:
            return last, label, None, None, False
        if last is not None and last + 1 == at and label != own:
            out.append((person, label, own))
        return at, own, None, None, False

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, None, None, None, False)
        out: list[tuple] = []
        if state.hasTimedOut:
            closed(now, out, key[0])
            state.remove()
        else:
            # a person has few rows in a batch: sorting them as a list costs far less than a frame
            rows = [x for b in batches for x in zip(b["ord"].tolist(), b["label"].tolist(), strict=True)]
            for position, label in sorted(rows, key=lambda x: (x[0], x[1] is None or x[1] != x[1], str(x[1]))):
                if now[2] is None or position > now[2]:
                    now = closed(now, out, key[0])
                    if label is not None and label == label and (now[0] is None or position > now[0]):
                        now = (now[0], now[1], int(position), label, False)
                elif position == now[2] and label is not None and label == label and label != now[3]:
                    now = (*now[:4], True)
            state.update(now)
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["person", "src", "dst"])

    kind = "last_ord long, last_label string, open_ord long, open_label string, ambiguous boolean"
    return steps.groupBy("person").applyInPandasWithState(update, "person long, src string, dst string", kind, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def run_available(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, files: int = 2) -> DataFrame:
    """Run the stream over all files of `source` that are there now, a few files a batch; return the pairs."""
    steps = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream_pairs(steps).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return spark.read.schema("person long, src string, dst string").parquet(sink)
