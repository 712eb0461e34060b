"""Exact deduplication: a tree merge of sorted digest runs.

Every partition turns its rows into one run sorted by digest, holding the smallest identifier and the number of rows of
each digest.  The runs then meet in binomial rounds: in round r a partition talks only to the partitions whose number
differs from its own in digit r (base ``fan_in``), and each takes over the digests whose own digit r is its digit.  Every
round merges the ``fan_in`` sorted runs it receives and keeps, for each digest, the smallest identifier; a digest that
fills a third of all rows is one entry of each run from the start.  After log(partitions) rounds each digest stands in
one place, with the row that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import materialize, neutral

RUN = "digest binary, keep_id bigint, n_keep bigint, group_size bigint, dest int"
RUN_SCHEMA = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n_keep", pa.int64()), ("group_size", pa.int64())])
#: Groups with more than this share of the rows are joined by broadcast: there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.001


def normalized(text) -> F.Column:
    """``text`` with every run of ASCII white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _merge(level: int, rounds: int, fan_in: int):
    """Combine a partition that is sorted by digest; ``dest`` is the partition each digest goes to in the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        here, carry = TaskContext.get().partitionId() % fan_in**rounds, None

        def combined(table: pa.Table) -> pa.Table:
            # Digests are verified in full here: rows count as equal only when all 32 bytes are.
            lowest = table.group_by("digest", use_threads=False).aggregate([("keep_id", "min"), ("group_size", "sum")])
            lowest = lowest.rename_columns(["digest", "lowest", "group_size"])
            own = pc.take(lowest["lowest"], pc.index_in(table["digest"], lowest["digest"].combine_chunks()))
            at_lowest = pc.if_else(pc.is_null(table["keep_id"]), pc.is_null(own), pc.fill_null(pc.equal(table["keep_id"], own), False))
            ties = table.append_column("tie", pc.if_else(at_lowest, table["n_keep"], 0)).group_by("digest", use_threads=False).aggregate([("tie", "sum")])
            return pa.table({"digest": lowest["digest"], "keep_id": lowest["lowest"], "n_keep": pc.cast(ties["tie_sum"], pa.int64()), "group_size": pc.cast(lowest["group_size"], pa.int64())})

        def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
            head = pc.cast(table["digest"], pa.binary()).combine_chunks()
            data = np.frombuffer(b"".join(x[:4] for x in head.to_pylist()), ">u4").astype(np.int64)
            bucket = (data * fan_in**rounds) >> 32
            if level < rounds:
                step = fan_in**level
                dest = here - (here // step % fan_in) * step + (bucket // step % fan_in) * step
            else:
                dest = bucket
            yield from table.append_column("dest", pa.array(dest.astype(np.int32))).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(RUN_SCHEMA.names).cast(RUN_SCHEMA)
            table = combined(pa.concat_tables([carry, table]) if carry is not None else table)
            carry = table.slice(table.num_rows - 1)
            if table.num_rows > 1:
                yield from sent(table.slice(0, table.num_rows - 1))
        if carry is not None:
            yield from sent(carry)

    return run


def merge_runs(digests: DataFrame, fan_in: int = 4) -> DataFrame:
    """(digest, keep_id, n_keep, group_size), one row for each digest of ``digests(digest, id)``.

    ``keep_id`` is the smallest identifier (null only if all are null) and ``n_keep`` how many rows carry it.
    """
    spark = digests.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while fan_in**rounds < wanted:
        rounds += 1
    runs = digests.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("n_keep"), F.lit(1).cast("bigint").alias("group_size"))
    for level in range(rounds + 1):
        if level:
            runs = runs.repartitionById(fan_in**rounds, F.col("dest"))
        runs = runs.sortWithinPartitions("digest", F.col("keep_id").asc_nulls_last()).mapInArrow(_merge(level, rounds, fan_in), RUN)
    return runs.drop("dest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after white space is normalised; of equal texts the row with the smallest id
    stays.  Defined cases: a null text counts as empty; an empty table gives an empty result; other columns are ignored;
    null ids come after all others and stand for a group only when it has no other; where the smallest id itself is
    repeated in a group, all its rows have ``kept`` and ``n_keep`` says how many there are.
    """
    digests = materialize(docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(normalized(F.col(text_col)), 256)).alias("digest")), "digests")
    merged = materialize(merge_runs(digests, fan_in), "digest-runs")
    # Groups that hold a large share of all rows are few, so they are joined by broadcast; no key of the other join is hot.
    heavy = F.col("group_size") > F.greatest(F.lit(1000.0), F.lit(digests.count() * HEAVY_SHARE))
    rest = digests.join(F.broadcast(merged.filter(heavy)), "digest", "left").select("id", "digest", "keep_id", "n_keep", "group_size")
    found = rest.filter("group_size is not null")
    others = rest.filter("group_size is null").select("id", "digest").join(merged.filter(~heavy), "digest")
    return found.select("id", "digest", "keep_id", "n_keep", "group_size").union(others.select("id", "digest", "keep_id", "n_keep", "group_size")).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_keep"
    )


def exact_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, in the columns of ``docs``.

    Of repeated rows with the same id and equal texts one stays, null ids too.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("digest"), "n_keep").distinct()
    kept = materialize(kept, "kept-ids")
    rows, names = neutral(docs)
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    rows = rows.withColumn("own", F.unhex(F.sha2(normalized(text), 256)))
    out = rows.join(kept, key.cast("bigint").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")))
    if not kept.filter("n_keep > 1").isEmpty():
        again = out.filter("n_keep > 1").dropDuplicates(["id", "digest"])
        return out.filter("n_keep = 1").select(*names).union(again.select(*names))
    return out.select(*names)
