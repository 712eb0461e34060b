"""Every registered query of the runtime-decision and trace operators, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import ids
from tidewright.operators import folds, graphs, lifecycle, objects, scheduling, traces  # noqa: F401  (they register their decisions)
from tidewright.operators.decision import REGISTRY, Decision
from tidewright.plans.projections import BASE_TABLES, project, projection_sql
from tidewright.runtime import run_tasks
from tidewright.sources.shared import materialize
from tidewright.sources.traces import total_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet") if name in BASE_TABLES else project(spark, sf_dir, name)


def _query(d: Decision) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return d.apply(spark, **{t: _table(spark, sf_dir, t) for t in d.inputs})

    run.__name__ = run.__qualname__ = d.name
    run.__doc__ = d.doc
    return run


def with_projections(sql: str, inputs: tuple[str, ...], recursive: bool = False) -> str:
    """DuckDB text: the projections as common tables around ``sql``, which names them in braces."""
    named = [t for t in inputs if t not in BASE_TABLES]
    body = sql.format(**{t: t for t in inputs})
    if not named:
        return body
    head = ", ".join(f"{t} AS ({projection_sql(t)})" for t in named)
    return f"WITH {head} SELECT * FROM ({body}) result"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {d.name: _query(d) for d in REGISTRY.values()}
ORACLES: dict[str, str] = {d.name: with_projections(d.check or d.sql, d.inputs) for d in REGISTRY.values()}


def _tables(names: str):
    """Give a query function the projected tables it names."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(_table(spark, sf_dir, n) for n in names.split()))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        return run

    return wrap


@_tables("task_events")
def retry_fold(task_events: DataFrame) -> DataFrame:
    return folds.retry_fold(task_events)


@_tables("lease_ops")
def lease_lifecycle(lease_ops: DataFrame) -> DataFrame:
    return folds.lease_lifecycle(lease_ops)


@_tables("ledger_ops node_resources")
def ledger_fold(ledger_ops: DataFrame, node_resources: DataFrame) -> DataFrame:
    op = F.when(F.col("pick") < 6, "ALLOCATE").when(F.col("pick") < 8, "RELEASE").when(F.col("pick") < 9, "YIELD_CPU").otherwise("REACQUIRE_CPU")
    totals = node_resources.filter("resource = 'CPU'").select(F.col("node").alias("ledger"), "total")
    return folds.ledger_fold(ledger_ops.select("ledger", "seq", op.alias("op"), "token", "milli"), totals)


@_tables("reservation_ops")
def reservation_fold(reservation_ops: DataFrame) -> DataFrame:
    return folds.reservation_fold(reservation_ops)


@_tables("actor_lifecycle")
def actor_exit_fold(actor_lifecycle: DataFrame) -> DataFrame:
    return folds.actor_exit_fold(actor_lifecycle)


@_tables("stages")
def publication_fold(stages: DataFrame) -> DataFrame:
    return folds.publication_fold(stages)


@_tables("ledger_ops")
def store_fold(ledger_ops: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("CREATE", "CREATE", "CREATE", "WRITE", "WRITE", "SEAL", "PIN", "UNPIN", "DELETE", "DELETE")))
    ops = ledger_ops.select(F.col("ledger").alias("store"), "seq", names[F.col("pick").cast("int")].alias("op"), F.col("token").alias("object"), F.col("milli").alias("size"))
    return folds.store_fold(ops, 20_000)


@_tables("actor_calls")
def mailbox_execution(actor_calls: DataFrame) -> DataFrame:
    return folds.mailbox_execution(actor_calls)


@_tables("lineage_edges")
def lineage_closure(edges: DataFrame) -> DataFrame:
    """For each object that nothing was made from: everything it goes back to."""
    ends = edges.select(F.col("src").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return graphs.reachable(edges, ends)


@_tables("lineage_edges")
def cycle_members(edges: DataFrame) -> DataFrame:
    """Objects on a cycle when every seventh object's edge is there in the other direction too."""
    back = edges.filter("src % 7 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graphs.cycle_members(edges.union(back))


@_tables("holdings orders")
def gc_cascade(holdings: DataFrame, orders: DataFrame) -> DataFrame:
    """Everything that is freed when only open orders are still referenced."""
    every = holdings.select(F.explode(F.array("src", "dst")).alias("object")).distinct()
    held = orders.filter("o_orderstatus = 'O'").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("object"))
    return graphs.gc_cascade(every, held, holdings).select("object")


@_tables("order_states lineage_edges")
def reconstruction_preflight(order_states: DataFrame, edges: DataFrame) -> DataFrame:
    """What rebuilding every lost object needs."""
    return graphs.preflight(order_states, edges, order_states.filter("state = 'LOST'").select(F.col("object").alias("node")))


@_tables("trace_events")
def trace_cause_chains(trace_events: DataFrame) -> DataFrame:
    return graphs.cause_chains(trace_events, trace_events.filter("event = 'rpc_reply_received'").select(F.col("event_id").alias("node")))


@_tables("trace_events")
def trace_reachability(trace_events: DataFrame) -> DataFrame:
    """How far into each process the first record of each component reaches."""
    first = trace_events.groupBy("component").agg(F.min(F.struct("process_id", "process_sequence", "event_id")).alias("e"))
    return graphs.causal_reach(trace_events, first.select(F.col("e.event_id").alias("seed"), "e.process_id", "e.process_sequence"))


@_tables("trace_events")
def trace_order_rules(trace_events: DataFrame) -> DataFrame:
    """For each two components: whether the first record of the second comes causally after the first record of the first."""
    first = trace_events.groupBy("component").agg(F.min(F.struct("process_id", "process_sequence", "event_id")).alias("e"))
    first = materialize(first.select("component", F.col("e.event_id").alias("seed"), "e.process_id", "e.process_sequence"), "first")
    reach = graphs.causal_reach(trace_events, first.select("seed", "process_id", "process_sequence"))
    later = first.select(F.col("component").alias("after"), F.col("process_id").alias("p"), F.col("process_sequence").alias("s"))
    pairs = first.select(F.col("component").alias("before"), "seed").crossJoin(F.broadcast(later)).filter("before <> after")
    held = pairs.join(reach, (pairs["seed"] == reach["seed"]) & (pairs["p"] == reach["process_id"]), "left")
    return held.select("before", "after", F.coalesce(F.col("first_sequence") <= F.col("s"), F.lit(False)).alias("holds"))


@_tables("trace_events")
def trace_export_order(trace_events: DataFrame) -> DataFrame:
    """Each record's place in the total order of the trace."""
    return total_order(trace_events.select("event_id", "process_id", "process_sequence"), ["process_id", "process_sequence", "event_id"])


@_tables("tasks")
def derived_ids(tasks: DataFrame) -> DataFrame:
    return tasks.select("task", ids.derived_id("driver-task", F.col("task")).alias("id"))


@_tables("tasks nodes")
def seeded_topk(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """One of the first max(2, 2 % of all nodes, dead ones counted) live nodes for each task."""
    sizes = nodes.agg(F.count("*").alias("cluster"), F.count_if("alive").alias("alive")).first()
    eligible = min(sizes["alive"], max(2, int(sizes["cluster"] * 0.02)))
    first = nodes.filter("alive").orderBy("node").limit(eligible)
    ranked = first.select(F.col("node").alias("chosen"), (F.row_number().over(Window.orderBy("node")) - 1).alias("rank"))
    drawn = tasks.select("task", ids.seeded_rank(F.col("task"), eligible).alias("rank"))
    return drawn.join(F.broadcast(ranked), "rank", "left").select("task", "chosen")


@_tables("tasks")
def execute_tasks(tasks: DataFrame) -> DataFrame:
    """Outcome rows of pushed tasks: a user's exception is an outcome, not a failed Spark task."""
    return run_tasks(tasks.select("task", "cpu"), _divide, "task bigint, cpu bigint")


def _divide(row: dict) -> str:
    return str(row["cpu"] * 10 // (row["task"] % 11))


_REACH = """
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({edges_sql}) x),
walk AS (SELECT seed, dst AS node, CAST(1 AS BIGINT) AS depth FROM ({seeds_sql}) s JOIN e ON e.src = s.seed
  UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < {limit})
SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node
"""
ORACLES["trace_export_order"] = with_projections(
    "SELECT event_id, process_id, process_sequence, row_number() OVER (ORDER BY process_id, process_sequence, event_id) AS place FROM {trace_events}", ("trace_events",)
)
ORACLES["retry_fold"] = with_projections(folds.RETRY_CHECK, ("task_events",))
ORACLES["reservation_fold"] = with_projections(folds.RESERVATION_CHECK, ("reservation_ops",))
ORACLES["publication_fold"] = with_projections(folds.PUBLICATION_CHECK, ("stages",))
ORACLES["mailbox_execution"] = with_projections(folds.MAILBOX_CHECK, ("actor_calls",))
ORACLES["reconstruction_preflight"] = with_projections(
    """
WITH RECURSIVE e AS (SELECT DISTINCT d.src, d.dst FROM {lineage_edges} d JOIN {order_states} o ON o.object = d.src WHERE o.state <> 'READY'),
walk AS (
  SELECT object AS seed, object AS node, CAST(0 AS BIGINT) AS depth FROM {order_states} WHERE state = 'LOST'
  UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node),
levels AS (SELECT node, max(depth) AS depth FROM (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node) t GROUP BY node)
SELECT l.node AS object, l.depth, CASE WHEN o.state = 'READY' THEN 'SKIP' WHEN o.state = 'PENDING' AND NOT o.recovering THEN 'REJECT_PENDING' WHEN o.state = 'PENDING' THEN 'JOIN'
       WHEN o.retries_left > 0 THEN 'REBUILD' ELSE 'REJECT_BUDGET' END AS action
FROM levels l JOIN {order_states} o ON o.object = l.node
""",
    ("lineage_edges", "order_states"),
)
ORACLES["ledger_fold"] = with_projections(folds.LEDGER_CHECK, ("ledger_ops", "node_resources"))
ORACLES["store_fold"] = with_projections(folds.STORE_CHECK, ("ledger_ops",))
ORACLES["actor_exit_fold"] = with_projections(folds.ACTOR_CHECK, ("actor_lifecycle",))
ORACLES["execute_tasks"] = with_projections(
    """
SELECT task, cpu, CASE WHEN task % 11 = 0 THEN 'APPLICATION_ERROR' ELSE 'OK' END AS status, CASE WHEN task % 11 <> 0 THEN CAST(cpu * 10 // (task % 11) AS STRING) END AS value,
       CASE WHEN task % 11 = 0 THEN 'ZeroDivisionError' END AS error FROM {tasks}
""",
    ("tasks",),
)
ORACLES["lease_lifecycle"] = with_projections(folds.LEASE_CHECK, ("lease_ops",))
ORACLES["lineage_closure"] = with_projections(
    _REACH.format(edges_sql="SELECT src, dst FROM {lineage_edges}", seeds_sql="SELECT DISTINCT src AS seed FROM {lineage_edges} WHERE src NOT IN (SELECT dst FROM {lineage_edges})", limit=1000), ("lineage_edges",)
)
ORACLES["cycle_members"] = with_projections(
    """
WITH RECURSIVE e AS (SELECT src, dst FROM {lineage_edges} UNION SELECT dst, src FROM {lineage_edges} WHERE src % 7 = 0),
walk AS (SELECT src AS seed, dst AS node FROM e UNION SELECT w.seed, e.dst FROM walk w JOIN e ON e.src = w.node)
SELECT DISTINCT node FROM walk WHERE seed = node
""",
    ("lineage_edges",),
)
ORACLES["gc_cascade"] = with_projections(
    """
WITH RECURSIVE kept AS (
  SELECT concat('o', o_orderkey) AS object FROM {orders} WHERE o_orderstatus = 'O'
  UNION SELECT h.dst FROM kept k JOIN {holdings} h ON h.src = k.object)
SELECT object FROM (SELECT src AS object FROM {holdings} UNION SELECT dst FROM {holdings}) t WHERE object NOT IN (SELECT object FROM kept)
""",
    ("holdings", "orders"),
)
ORACLES["trace_reachability"] = with_projections(
    """
WITH RECURSIVE e AS (
  SELECT cause_event_id AS src, event_id AS dst FROM {trace_events} WHERE cause_event_id IS NOT NULL
  UNION SELECT event_id, following FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY process_id ORDER BY process_sequence) AS following FROM {trace_events}) t WHERE following IS NOT NULL),
first AS (SELECT event_id AS seed FROM (SELECT event_id, row_number() OVER (PARTITION BY component ORDER BY process_id, process_sequence, event_id) AS k FROM {trace_events}) t WHERE k = 1),
walk AS (SELECT f.seed, e.dst AS node FROM first f JOIN e ON e.src = f.seed UNION SELECT w.seed, e.dst FROM walk w JOIN e ON e.src = w.node)
SELECT w.seed, t.process_id, min(t.process_sequence) AS first_sequence FROM walk w JOIN {trace_events} t ON t.event_id = w.node GROUP BY w.seed, t.process_id
""",
    ("trace_events",),
)
ORACLES["trace_cause_chains"] = with_projections(
    _REACH.format(edges_sql="SELECT event_id AS src, cause_event_id AS dst FROM {trace_events} WHERE cause_event_id IS NOT NULL", seeds_sql="SELECT event_id AS seed FROM {trace_events} WHERE event = 'rpc_reply_received'", limit=10),
    ("trace_events",),
)
ORACLES["trace_order_rules"] = with_projections(
    """
WITH RECURSIVE e AS (
  SELECT cause_event_id AS src, event_id AS dst FROM {trace_events} WHERE cause_event_id IS NOT NULL
  UNION SELECT event_id, following FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY process_id ORDER BY process_sequence) AS following FROM {trace_events}) t WHERE following IS NOT NULL),
first AS (SELECT component, event_id FROM (SELECT component, event_id, row_number() OVER (PARTITION BY component ORDER BY process_id, process_sequence, event_id) AS k FROM {trace_events}) t WHERE k = 1),
walk AS (SELECT f.event_id AS seed, e.dst AS node FROM first f JOIN e ON e.src = f.event_id UNION SELECT w.seed, e.dst FROM walk w JOIN e ON e.src = w.node)
SELECT a.component AS before, b.component AS after, w.node IS NOT NULL AS holds
FROM first a JOIN first b ON a.component <> b.component LEFT JOIN walk w ON w.seed = a.event_id AND w.node = b.event_id
""",
    ("trace_events",),
)
