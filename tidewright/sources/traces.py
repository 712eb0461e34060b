"""Trace files: an ordered JSON-lines sink, its source, and the total order of a trace."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.shared import materialize

TRACE_SCHEMA = "event_id string, timestamp_ns bigint, process_id string, process_sequence bigint, component string, event string, entity_kind string, entity_id string, cause_event_id string, fields map<string,string>"
ORDER = ["process_id", "process_sequence", "event_id"]


def total_order(rows: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """``rows`` with place: their number, from 1, in the order of columns.

    Rows are dealt by range and sorted within partitions; a partition's offset is the number of rows before it, so no task
    sees all rows.  One count for each partition comes to the driver.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at"))
    placed = materialize(placed, "ordered")
    part, inside = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_part bigint, _before bigint"))
    return placed.join(offsets, part == F.col("_part")).select(*rows.columns, (F.col("_before") + inside + 1).alias("place"))


def write_trace(events: DataFrame, path: str) -> None:
    """A folder of JSON lines, globally ordered by process (as text), sequence and id: part files follow each other in order."""
    events.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.json(path, ignoreNullFields=False)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE_SCHEMA).json(path)


def export_trace(events: DataFrame, path: str) -> int:
    """One local file, byte for byte in order with sorted keys, replaced atomically; rows are streamed, not collected at once."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    n = 0
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        for row in events.orderBy(*ORDER).toLocalIterator(prefetchPartitions=True):
            f.write(json.dumps(row.asDict(recursive=True), sort_keys=True, ensure_ascii=False) + "\n")
            n += 1
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
    return n


def append_trace(events: DataFrame, path: str) -> None:
    """Append a batch to a folder of JSON lines."""
    events.write.mode("append").json(path)
