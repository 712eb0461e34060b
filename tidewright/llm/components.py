"""Connected components over edge tables by hooking to the smallest neighbour and jumping pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; nodes of one component share a root, which is one of them.

    Each round every node hooks to the smallest of its neighbours and itself, two pointer jumps shorten the trees, and
    the edges are relabelled and made distinct, so the graph shrinks to nothing in logarithmically many rounds.  All steps
    are aggregations with map-side combining and equi-joins; round results are written tables, so no lineage grows.
    """
    spark = edges.sparkSession
    live = materialize(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    labels = kept = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("up")), "hooks")
        jump = first.select(F.col("node").alias("up"), F.col("up").alias("next"))
        hooks = materialize(first.join(jump, "up").select("node", F.col("next").alias("up")), "jumps")
        discard(first)
        parent = hooks.select(F.col("node").alias("root"), F.col("up").alias("next"))
        if labels is None:
            labels, kept = hooks.select("node", F.col("up").alias("root")), hooks
        else:
            labels = materialize(labels.join(parent, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
            discard(kept)
            kept = labels
        ends = live.join(hooks.select(F.col("node").alias("u"), F.col("up").alias("a")), "u").select("a", "v")
        moved = ends.join(hooks.select(F.col("node").alias("v"), F.col("up").alias("b")), "v")
        moved = materialize(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
        discard(live, *(() if kept is hooks else (hooks,)))
        live = moved
    else:
        raise RuntimeError("connected components did not converge")
    if labels is None:
        return spark.createDataFrame([], live.select(F.col("u").alias("node"), F.col("v").alias("root")).schema)
    return labels
