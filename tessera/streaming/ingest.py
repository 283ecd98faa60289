"""Issues as a stream, and session memory as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import prepare_issue, relevant_issues
from ..sources.keyed import KeyedTable


def gated_issues(issues: DataFrame, *, time: str = "fetched_at", late: str = "7 days") -> DataFrame:
    """Issues that name a law, each (issue, url) once; state is dropped once its watermark has passed."""
    fresh = issues.withWatermark(time, late).dropDuplicatesWithinWatermark(["rg_sayi", "url"])
    return prepare_issue(relevant_issues(fresh))


def upsert_points(stream: DataFrame, path: str, checkpoint: str, *, key: str = "point_id", buckets: int = 64) -> StreamingQuery:
    """Encoded chunks into a keyed table, batch by batch: a changed chunk replaces the stored one of its id, and a batch that is run again after a failure counts once.

    An epoch belongs to a checkpoint, so a table has one stream.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        KeyedTable(batch.sparkSession, path, key, buckets).upsert(batch, epoch=epoch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_memory(messages: DataFrame, keep: int = 8, *, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """(session_id, seq, role, content): the last messages of every session that got new ones, kept as state for so long after the last of them."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, roles, contents = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows = list(zip(seqs, roles, contents))
        for b in batches:
            rows += list(zip(b["seq"], b["role"], b["content"]))
        rows = sorted(rows)[-keep:]
        state.update(tuple(list(x) for x in zip(*rows)))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": [key[0]] * len(rows), "seq": [r[0] for r in rows], "role": [r[1] for r in rows], "content": [r[2] for r in rows]})

    return messages.groupBy("session_id").applyInPandasWithState(
        update,
        "session_id long, seq long, role string, content string",
        "seqs array<long>, roles array<string>, contents array<string>",
        "update",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def message_counts(messages: DataFrame, *, time: str = "ts", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Messages per session and time window, late ones up to the watermark included."""
    return messages.withWatermark(time, late).groupBy(F.window(time, window), "session_id").agg(F.count("*").alias("messages"))
