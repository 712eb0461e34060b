"""Streams of trace records and actor calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_stream(events: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each event id once, the first to arrive; with an event time, ids are remembered within the delay only."""
    if event_time:
        return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def checked_stream(events: DataFrame, content: list[str]) -> DataFrame:
    """(event_id, arrival, disposition) of every record of a stream: the first of an id is ACCEPTED, others are DEDUPLICATED if
    all of ``content`` is the same, and a CONFLICT if not.  The state of an id is one digest, kept as long as the stream runs."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (first,) = state.get if state.exists else (None,)
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        out = []
        for arrival, got in zip(rows["arrival"], rows["digest"], strict=True):
            out.append((key[0], int(arrival), "ACCEPTED" if first is None else "DEDUPLICATED" if got == first else "CONFLICT"))
            first = first or got
        state.update((first,))
        yield pd.DataFrame(out, columns=["event_id", "arrival", "disposition"])

    plain = events.select("event_id", F.col("arrival").cast("bigint").alias("arrival"), digest.alias("digest"))
    return plain.groupBy("event_id").applyInPandasWithState(run, "event_id string, arrival bigint, disposition string", "first string", "append", GroupStateTimeout.NoTimeout)


def after_cursor(deaths: DataFrame, cursor: int) -> DataFrame:
    """The suffix of a death log after a cursor; a cursor beyond the head is an error for a batch."""
    if not deaths.isStreaming:
        head = deaths.agg(F.max("epoch")).first()[0] or 0
        if cursor > head:
            raise ValueError(f"cursor {cursor} is beyond the head {head}")
    return deaths.filter(F.col("epoch") > cursor)


def mailbox_stream(calls: DataFrame) -> DataFrame:
    """Calls of (actor, generation, caller) in contiguous numbers from 0, as gaps close; repeats are marked cached.

    The generation is part of the state's key: a restarted actor begins with an empty mailbox.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, waiting = state.get if state.exists else (0, "")
        held = {int(x) for x in waiting.split(",") if x}
        rows = []
        for frame in frames:
            for seq in frame.sort_values("arrival")["seq"]:
                seq = int(seq)
                if seq < expected or seq in held:
                    rows.append((*key, seq, "CACHED"))
                    continue
                held.add(seq)
                while expected in held:
                    held.remove(expected)
                    rows.append((*key, expected, "RUN"))
                    expected += 1
        state.update((expected, ",".join(map(str, sorted(held)))))
        yield pd.DataFrame(rows, columns=["actor", "generation", "caller", "seq", "state"])

    return calls.groupBy("actor", "generation", "caller").applyInPandasWithState(
        run, "actor string, generation bigint, caller bigint, seq bigint, state string", "expected bigint, waiting string", "append", GroupStateTimeout.NoTimeout
    )


class BoundedSink:
    """A sink for ``writeStream.foreachBatch`` that keeps the first rows of a stream in memory, up to a limit, and counts the rest.

    Batches are taken once by their id, so a repeated batch changes nothing.
    """

    def __init__(self, limit: int = 10_000):
        self.limit, self.rows, self.dropped, self.seen = limit, [], 0, set()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.seen:
            return
        self.seen.add(batch_id)
        room = self.limit - len(self.rows)
        total = batch.count()
        if room > 0:
            self.rows.extend(batch.limit(room).collect())
        self.dropped += max(0, total - room)
