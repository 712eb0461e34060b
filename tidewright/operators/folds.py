"""Order-dependent reducers: each key's operations in sequence, streamed through a state.

A fold can't be a window function, because whether one operation is accepted depends on what became of those before it.
Rows are dealt by key and sorted within partitions, so a task holds one key's state at a time and never its rows.  Task,
lease, reservation and publication states have a fixed size; a ledger's grows with its tokens, because a released token must
never come back, and a store's with the objects that it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidewright.sources.shared import materialize
from tidewright.sources.traces import total_order


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """One output row per input row: ``step(state, row)`` changes the state and returns the columns of ``schema``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for row in batch.to_pylist():
                if row[key] != current:
                    current, state = row[key], start()
                got = step(state, row)
                for n in names:
                    out[n].append(got[n])
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _retry_start() -> dict:
    return {"attempt": 0, "retries": 0, "state": "RUNNING"}


#: Events of the current attempt that contradict how the task has ended; others of the kind that ended it are repeats.
_CONTRADICTS = {
    "SUCCEEDED": ("APPLICATION", "SYSTEM"),
    "APPLICATION_FAILED": ("SUCCESS", "SYSTEM"),
    "SYSTEM_FAILED": ("SUCCESS", "APPLICATION"),
}


def _retry_step(s: dict, r: dict) -> dict:
    event = r["event"]
    if r["attempt"] != s["attempt"]:
        action = "FENCE_STALE_ATTEMPT"  # before the event is looked at
    elif event not in ("SUCCESS", "APPLICATION", "SYSTEM"):
        raise ValueError(f"unknown failure: {event}")
    elif event in _CONTRADICTS.get(s["state"], ()):
        action = "ERROR:CONTRADICTION"
    elif event == "SUCCESS":
        action, s["state"] = "ACCEPT_SUCCESS", "SUCCEEDED"
    elif event == "APPLICATION":
        action, s["state"] = "FAIL_APPLICATION", "APPLICATION_FAILED"
    elif s["state"] == "RUNNING" and s["retries"] < r["max_retries"]:
        action, s["retries"], s["attempt"] = "RETRY_TASK", s["retries"] + 1, s["attempt"] + 1
    else:
        action, s["state"] = "FAIL_RETRY_EXHAUSTED", "SYSTEM_FAILED"
    return {"task": r["task"], "seq": r["seq"], "action": action, "attempt": s["attempt"], "state": s["state"]}


def retry_fold(events: DataFrame) -> DataFrame:
    """What each event of a task's attempts leads to: stale attempts are fenced, system failures retried while the budget lasts.

    After the end, a repeat of what ended the task is accepted again, and a contradiction is an error that changes nothing.
    """
    return ordered_fold(events, "task", ["seq"], _retry_start, _retry_step, "task bigint, seq bigint, action string, attempt bigint, state string")


#: The same decisions as a table of transitions.
RETRY_CHECK = """
WITH RECURSIVE rule(state, event, budget, action, next) AS (VALUES
  ('RUNNING', 'SUCCESS', NULL, 'ACCEPT_SUCCESS', 'SUCCEEDED'), ('RUNNING', 'APPLICATION', NULL, 'FAIL_APPLICATION', 'APPLICATION_FAILED'),
  ('RUNNING', 'SYSTEM', TRUE, 'RETRY_TASK', 'RUNNING'), ('RUNNING', 'SYSTEM', FALSE, 'FAIL_RETRY_EXHAUSTED', 'SYSTEM_FAILED'),
  ('SUCCEEDED', 'SUCCESS', NULL, 'ACCEPT_SUCCESS', 'SUCCEEDED'), ('SUCCEEDED', 'APPLICATION', NULL, 'ERROR:CONTRADICTION', 'SUCCEEDED'), ('SUCCEEDED', 'SYSTEM', NULL, 'ERROR:CONTRADICTION', 'SUCCEEDED'),
  ('APPLICATION_FAILED', 'SUCCESS', NULL, 'ERROR:CONTRADICTION', 'APPLICATION_FAILED'), ('APPLICATION_FAILED', 'APPLICATION', NULL, 'FAIL_APPLICATION', 'APPLICATION_FAILED'),
  ('APPLICATION_FAILED', 'SYSTEM', NULL, 'ERROR:CONTRADICTION', 'APPLICATION_FAILED'), ('SYSTEM_FAILED', 'SUCCESS', NULL, 'ERROR:CONTRADICTION', 'SYSTEM_FAILED'),
  ('SYSTEM_FAILED', 'APPLICATION', NULL, 'ERROR:CONTRADICTION', 'SYSTEM_FAILED'), ('SYSTEM_FAILED', 'SYSTEM', NULL, 'FAIL_RETRY_EXHAUSTED', 'SYSTEM_FAILED')),
walk AS (
  SELECT task, CAST(0 AS BIGINT) AS seq, CAST('' AS STRING) AS action, CAST(0 AS BIGINT) AS attempt, CAST('RUNNING' AS STRING) AS state FROM (SELECT DISTINCT task FROM {task_events}) t
  UNION ALL
  SELECT e.task, e.seq, CASE WHEN e.attempt <> w.attempt THEN 'FENCE_STALE_ATTEMPT' ELSE r.action END,
         CASE WHEN e.attempt = w.attempt AND r.action = 'RETRY_TASK' THEN w.attempt + 1 ELSE w.attempt END, CASE WHEN e.attempt <> w.attempt THEN w.state ELSE r.next END
  FROM walk w JOIN {task_events} e ON e.task = w.task AND e.seq = w.seq + 1
  JOIN rule r ON r.state = w.state AND r.event = e.event AND (r.budget IS NULL OR r.budget = (w.attempt < e.max_retries)))
SELECT * FROM walk WHERE seq > 0
"""


def _lease_start() -> dict:
    return {"state": "GRANTED"}


_LEASE = {
    ("GRANTED", "START"): "RUNNING",
    ("RUNNING", "COMPLETE"): "COMPLETED",
    ("GRANTED", "CANCEL"): "ABANDONED",
    ("GRANTED", "WORKER_EXIT"): "WORKER_LOST",
    ("RUNNING", "WORKER_EXIT"): "WORKER_LOST",
}


def _lease_step(s: dict, r: dict) -> dict:
    before = s["state"]
    s["state"] = _LEASE.get((before, r["op"]), before)
    return {"lease": r["lease"], "seq": r["seq"], "state": s["state"], "applied": s["state"] != before, "released": s["state"] != before and s["state"] != "RUNNING"}


def lease_lifecycle(ops: DataFrame) -> DataFrame:
    """A lease's states: started once, completed once, cancelled only before it runs; resources are released exactly once."""
    return ordered_fold(ops, "lease", ["seq"], _lease_start, _lease_step, "lease bigint, seq bigint, state string, applied boolean, released boolean")


LEASE_CHECK = """
WITH RECURSIVE walk AS (
  SELECT lease, CAST(0 AS BIGINT) AS seq, CAST('GRANTED' AS STRING) AS state, FALSE AS applied FROM (SELECT DISTINCT lease FROM {lease_ops}) t
  UNION ALL
  SELECT o.lease, o.seq, n.state, n.state <> w.state
  FROM walk w JOIN {lease_ops} o ON o.lease = w.lease AND o.seq = w.seq + 1,
  LATERAL (SELECT CASE WHEN w.state = 'GRANTED' AND o.op = 'START' THEN 'RUNNING' WHEN w.state = 'RUNNING' AND o.op = 'COMPLETE' THEN 'COMPLETED'
                       WHEN w.state = 'GRANTED' AND o.op = 'CANCEL' THEN 'ABANDONED'
                       WHEN w.state IN ('GRANTED', 'RUNNING') AND o.op = 'WORKER_EXIT' THEN 'WORKER_LOST' ELSE w.state END AS state) n)
SELECT lease, seq, state, applied, applied AND state <> 'RUNNING' AS released FROM walk WHERE seq > 0
"""


def ledger_fold(ops: DataFrame, totals: DataFrame) -> DataFrame:
    """Acceptance of ledger operations in order: token-idempotent, never oversold; yielding returns CPU and may leave a debt.

    ``ops`` has (ledger, seq, op, token, milli) and ``totals`` (ledger, total).  A token allocated twice counts once, with
    another amount it is an error, and after its release it can't come back.
    """

    def start() -> dict:
        return {"free": None, "tokens": {}}

    def step(s: dict, r: dict) -> dict:
        if s["free"] is None:
            s["free"] = r["total"]
        held = s["tokens"].get(r["token"])
        op, ok, error = r["op"], True, None
        if op == "ALLOCATE":
            if held is not None:
                ok = held[0] == r["milli"] and held[1] != "RELEASED"
                error = None if ok else "RELEASED" if held[1] == "RELEASED" else "CONFLICT"
            elif r["milli"] > s["free"]:
                ok, error = False, "CAPACITY"
            else:
                s["free"] -= r["milli"]
                s["tokens"][r["token"]] = [r["milli"], "ACTIVE"]
        elif held is None:
            ok, error = False, "UNKNOWN"
        elif op == "RELEASE":
            ok = held[1] != "RELEASED"
            s["free"] += held[0] if held[1] == "ACTIVE" else 0
            held[1] = "RELEASED"
        elif op == "YIELD_CPU":
            ok = held[1] == "ACTIVE"
            if ok:
                s["free"] += held[0]
                held[1] = "CPU_YIELDED"
        else:
            ok = held[1] == "CPU_YIELDED"
            if ok:
                s["free"] -= held[0]
                held[1] = "ACTIVE"
        return {"ledger": r["ledger"], "seq": r["seq"], "ok": ok, "error": error, "available": max(0, s["free"]), "debt": max(0, -s["free"])}

    joined = ops.join(totals, "ledger")
    return ordered_fold(joined, "ledger", ["seq"], start, step, "ledger bigint, seq bigint, ok boolean, error string, available bigint, debt bigint")


def reservation_fold(ops: DataFrame) -> DataFrame:
    """Two-phase reservations (pg, seq, op, payload, and child for START and END): idempotent, with new payloads a conflict.

    An abort or removal before the prepare fences it.  A committed reservation lends to children; its removal keeps new ones
    out, and it is only given back once every child that started has ended, however little the child holds.
    """

    def start() -> dict:
        return {"phase": "NONE", "payload": None, "live": set(), "ended": set()}

    def step(s: dict, r: dict) -> dict:
        op, phase, error = r["op"], s["phase"], None
        if op == "PREPARE":
            if phase == "NONE":
                s["phase"], s["payload"] = "PREPARED", r["payload"]
            elif s["payload"] is not None and s["payload"] != r["payload"]:
                error = "CONFLICT"
            elif phase == "ABORTED":
                error = "FENCED"
        elif op == "COMMIT":
            if phase in ("PREPARED", "COMMITTED"):
                s["phase"] = "COMMITTED"
            else:
                error = "NOT_PREPARED"
        elif op == "START":
            if phase != "COMMITTED":
                error = "NOT_COMMITTED"
            elif r["child"] in s["ended"]:
                error = "RELEASED"
            else:
                s["live"].add(r["child"])
        elif op == "END":
            if r["child"] in s["live"]:
                s["live"].remove(r["child"])
                s["ended"].add(r["child"])
            elif r["child"] not in s["ended"]:
                error = "UNKNOWN"
        elif op == "FINALIZE_REMOVE" and phase not in ("REMOVING", "ABORTED"):
            error = "NOT_REMOVING"
        elif phase in ("NONE", "PREPARED"):
            s["phase"] = "ABORTED"
        elif phase != "ABORTED":
            s["phase"] = "REMOVING"
            if op != "BEGIN_REMOVE":
                error = "CHILDREN" if s["live"] else None
                s["phase"] = "REMOVING" if s["live"] else "ABORTED"
        return {"pg": r["pg"], "seq": r["seq"], "phase": s["phase"], "live": len(s["live"]), "error": error}

    if "child" not in ops.columns:
        ops = ops.withColumn("child", F.lit(None).cast("bigint"))
    return ordered_fold(ops, "pg", ["seq"], start, step, "pg bigint, seq bigint, phase string, live bigint, error string")


def actor_exit_fold(events: DataFrame) -> DataFrame:
    """Exits and restarts of actors in order: (actor, seq, event, detection, generation, node, route_epoch, node_alive,
    max_restarts, home), an actor beginning alive at home in generation 0 and route 0.

    An applied detection that comes again is ALREADY_APPLIED if it says the same and a CONFLICT if not.  An exit of an older
    generation is STALE; one that doesn't fit the actor's record, or whose node is dead, a CONFLICT.  An applied exit takes a
    restart from the budget, or ends the actor; RESTARTED brings a waiting actor back on the next route.
    """

    def start() -> dict:
        return {"state": "ALIVE", "generation": 0, "route": 0, "used": 0, "node": None, "applied": {}}

    def step(s: dict, r: dict) -> dict:
        exit_ = (r["generation"], r["node"], r["route_epoch"])
        node = r["home"] if s["node"] is None else s["node"]
        if r["event"] == "RESTARTED":
            said = "APPLIED" if s["state"] == "RESTARTING" else "CONFLICT"
            if said == "APPLIED":
                s["state"], s["route"], s["node"] = "ALIVE", s["route"] + 1, r["node"]
        elif r["detection"] in s["applied"]:
            said = "ALREADY_APPLIED" if s["applied"][r["detection"]] == exit_ else "CONFLICT"
        elif r["generation"] < s["generation"]:
            said = "STALE"
        elif s["state"] != "ALIVE" or not r["node_alive"] or exit_ != (s["generation"], node, s["route"]):
            said = "CONFLICT"
        else:
            said, s["applied"][r["detection"]], s["route"] = "APPLIED", exit_, s["route"] + 1
            if s["used"] < r["max_restarts"]:
                s["state"], s["used"], s["generation"] = "RESTARTING", s["used"] + 1, s["generation"] + 1
            else:
                s["state"] = "DEAD"
        return {"actor": r["actor"], "seq": r["seq"], "disposition": said, "state": s["state"], "generation": s["generation"], "restarts_used": s["used"]}

    return ordered_fold(events, "actor", ["seq"], start, step, "actor bigint, seq bigint, disposition string, state string, generation bigint, restarts_used bigint")


ACTOR_CHECK = """
WITH RECURSIVE ops AS (SELECT *, concat(detection, '|', generation, '|', node, '|', route_epoch) AS record, row_number() OVER (PARTITION BY actor ORDER BY seq) AS r FROM {actor_lifecycle}),
walk AS (
  SELECT actor, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS r, CAST('' AS STRING) AS disposition, CAST('ALIVE' AS STRING) AS state, CAST(0 AS BIGINT) AS generation, CAST(0 AS BIGINT) AS route,
         CAST(0 AS BIGINT) AS used, min(home) AS at, CAST([] AS VARCHAR[]) AS applied FROM ops GROUP BY actor
  UNION ALL
  SELECT x.actor, x.seq, x.r, x.said, CASE WHEN x.said <> 'APPLIED' THEN x.state WHEN x.event = 'RESTARTED' THEN 'ALIVE' WHEN x.used < x.max_restarts THEN 'RESTARTING' ELSE 'DEAD' END,
         CASE WHEN x.said = 'APPLIED' AND x.event = 'EXIT' AND x.used < x.max_restarts THEN x.generation + 1 ELSE x.generation END, CASE WHEN x.said = 'APPLIED' THEN x.route + 1 ELSE x.route END,
         CASE WHEN x.said = 'APPLIED' AND x.event = 'EXIT' AND x.used < x.max_restarts THEN x.used + 1 ELSE x.used END, CASE WHEN x.said = 'APPLIED' AND x.event = 'RESTARTED' THEN x.node ELSE x.at END,
         CASE WHEN x.said = 'APPLIED' AND x.event = 'EXIT' THEN list_append(x.applied, x.record) ELSE x.applied END
  FROM (SELECT o.actor, o.seq, o.r, o.event, o.max_restarts, o.node, o.record, w.state, w.generation, w.route, w.used, w.at, w.applied,
               CASE WHEN o.event = 'RESTARTED' THEN CASE WHEN w.state = 'RESTARTING' THEN 'APPLIED' ELSE 'CONFLICT' END
                    WHEN list_contains(w.applied, o.record) THEN 'ALREADY_APPLIED' WHEN len(list_filter(w.applied, lambda a: starts_with(a, concat(o.detection, '|')))) > 0 THEN 'CONFLICT'
                    WHEN o.generation < w.generation THEN 'STALE' WHEN w.state = 'ALIVE' AND o.node_alive AND o.generation = w.generation AND o.node = w.at AND o.route_epoch = w.route THEN 'APPLIED'
                    ELSE 'CONFLICT' END AS said
        FROM walk w JOIN ops o ON o.actor = w.actor AND o.r = w.r + 1) x)
SELECT actor, seq, disposition, state, generation, used AS restarts_used FROM walk WHERE r > 0
"""


_PRIOR = {"INTENT": (), "PREPARED": ("INTENT",), "ARMED": ("PREPARED",), "TERMINAL": ("ARMED",), "COMMITTED": ("PREPARED", "TERMINAL"), "ADOPTED": ("COMMITTED",), "FENCED": ("INTENT",), "RETIRED": ("FENCED",)}


def publication_fold(requests: DataFrame) -> DataFrame:
    """Stage requests (ref, is_put, seq, stage) of publications: a stage needs its prerequisites, and a replay returns the first
    receipt without a new number.  A put has no terminal stage and commits without one; a fenced publication only retires."""

    def start() -> dict:
        return {"receipts": {}}

    def step(s: dict, r: dict) -> dict:
        got, stage, error = s["receipts"], r["stage"], None
        if stage not in got:
            if r["is_put"] and stage == "TERMINAL":
                error = "NO_TERMINAL_STAGE"
            elif any(p not in got for p in _PRIOR[stage] if not (r["is_put"] and p == "TERMINAL")):
                error = "PREREQUISITE"
            elif "FENCED" in got and stage not in ("FENCED", "RETIRED"):
                error = "FENCED"
            else:
                got[stage] = len(got) + 1
        return {"ref": r["ref"], "seq": r["seq"], "stage": stage, "accepted": error is None, "receipt": got.get(stage), "error": error, "graph_active": "PREPARED" in got and "RETIRED" not in got}

    return ordered_fold(requests, "ref", ["seq"], start, step, "ref bigint, seq bigint, stage string, accepted boolean, receipt bigint, error string, graph_active boolean")


def store_fold(ops: DataFrame, capacity: int) -> DataFrame:
    """Object stores (store, seq, op, object, size): the whole size is reserved at creation, a full store is an error, sealing
    needs every byte and happens once, and a pinned object isn't deleted."""

    def start() -> dict:
        return {"used": 0, "objects": {}}

    def step(s: dict, r: dict) -> dict:
        op, item, error = r["op"], s["objects"].get(r["object"]), None
        if op == "CREATE":
            if item is not None:
                error = "EXISTS"
            elif s["used"] + r["size"] > capacity:
                error = "FULL"
            else:
                s["used"] += r["size"]
                s["objects"][r["object"]] = {"size": r["size"], "written": 0, "sealed": False, "pins": 0}
        elif item is None:
            error = "UNKNOWN"
        elif op == "WRITE":
            if item["sealed"]:
                error = "SEALED"
            else:
                item["written"] = min(item["size"], item["written"] + r["size"])
        elif op == "SEAL":
            if item["sealed"] or item["written"] < item["size"]:
                error = "SEALED" if item["sealed"] else "INCOMPLETE"
            else:
                item["sealed"] = True
        elif op in ("PIN", "UNPIN"):
            item["pins"] = max(0, item["pins"] + (1 if op == "PIN" else -1))
        elif item["pins"]:
            error = "PINNED"
        else:
            s["used"] -= item["size"]
            del s["objects"][r["object"]]
        return {"store": r["store"], "seq": r["seq"], "ok": error is None, "error": error, "used": s["used"]}

    return ordered_fold(ops, "store", ["seq"], start, step, "store bigint, seq bigint, ok boolean, error string, used bigint")


LEDGER_CHECK = """
WITH RECURSIVE ops AS (
  SELECT o.ledger, o.seq, o.token, o.milli, t.total, CASE WHEN o.pick < 6 THEN 'ALLOCATE' WHEN o.pick < 8 THEN 'RELEASE' WHEN o.pick < 9 THEN 'YIELD_CPU' ELSE 'REACQUIRE_CPU' END AS op,
         row_number() OVER (PARTITION BY o.ledger ORDER BY o.seq) AS r
  FROM {ledger_ops} o JOIN {node_resources} t ON t.node = o.ledger AND t.resource = 'CPU'),
walk AS (
  SELECT ledger, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS r, CAST(NULL AS BOOLEAN) AS ok, CAST(NULL AS STRING) AS error, CAST(min(total) AS BIGINT) AS free,
         CAST([] AS BIGINT[]) AS toks, CAST([] AS BIGINT[]) AS amounts, CAST([] AS VARCHAR[]) AS states FROM ops GROUP BY ledger
  UNION ALL
  SELECT ledger, seq, r, error IS NULL AND moves, error,
         free + CASE WHEN error IS NOT NULL OR NOT moves THEN 0 WHEN op = 'ALLOCATE' THEN CASE WHEN spot = 0 THEN -milli ELSE 0 END WHEN op = 'REACQUIRE_CPU' THEN -amount WHEN op = 'RELEASE' AND state = 'CPU_YIELDED' THEN 0 ELSE amount END,
         CASE WHEN op = 'ALLOCATE' AND spot = 0 AND error IS NULL THEN list_append(toks, token) ELSE toks END,
         CASE WHEN op = 'ALLOCATE' AND spot = 0 AND error IS NULL THEN list_append(amounts, milli) ELSE amounts END,
         CASE WHEN error IS NOT NULL OR NOT moves THEN states WHEN op = 'ALLOCATE' THEN CASE WHEN spot = 0 THEN list_append(states, 'ACTIVE') ELSE states END
              ELSE list_concat(list_concat(states[1:spot - 1], [CASE op WHEN 'RELEASE' THEN 'RELEASED' WHEN 'YIELD_CPU' THEN 'CPU_YIELDED' ELSE 'ACTIVE' END]), states[spot + 1:]) END
  FROM (
    SELECT *, CASE WHEN op = 'RELEASE' THEN state <> 'RELEASED' WHEN op = 'YIELD_CPU' THEN state = 'ACTIVE' WHEN op = 'REACQUIRE_CPU' THEN state = 'CPU_YIELDED' ELSE TRUE END AS moves,
           CASE WHEN spot = 0 AND op <> 'ALLOCATE' THEN 'UNKNOWN' WHEN op = 'ALLOCATE' AND spot = 0 AND milli > free THEN 'CAPACITY'
                WHEN op = 'ALLOCATE' AND state = 'RELEASED' THEN 'RELEASED' WHEN op = 'ALLOCATE' AND amount <> milli THEN 'CONFLICT' END AS error
    FROM (SELECT o.*, w.free, w.toks, w.amounts, w.states, w.spot, w.amounts[nullif(w.spot, 0)] AS amount, w.states[nullif(w.spot, 0)] AS state
          FROM (SELECT w.*, o2.token AS asked, coalesce(list_position(w.toks, o2.token), 0) AS spot FROM walk w JOIN ops o2 ON o2.ledger = w.ledger AND o2.r = w.r + 1) w
          JOIN ops o ON o.ledger = w.ledger AND o.r = w.r + 1) y) x)
SELECT ledger, seq, coalesce(ok, FALSE) AS ok, error, greatest(0, free) AS available, greatest(0, -free) AS debt FROM walk WHERE r > 0
"""

STORE_CHECK = """
WITH RECURSIVE ops AS (
  SELECT ledger AS store, seq, token AS object, milli AS size, ['CREATE', 'CREATE', 'CREATE', 'WRITE', 'WRITE', 'SEAL', 'PIN', 'UNPIN', 'DELETE', 'DELETE'][pick + 1] AS op,
         row_number() OVER (PARTITION BY ledger ORDER BY seq) AS r FROM {ledger_ops}),
walk AS (
  SELECT store, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS r, CAST(NULL AS STRING) AS error, CAST(0 AS BIGINT) AS used,
         CAST([] AS STRUCT(object BIGINT, size BIGINT, written BIGINT, sealed BOOLEAN, pins BIGINT)[]) AS held FROM ops GROUP BY store
  UNION ALL
  SELECT store, seq, r, error, used + CASE WHEN error IS NOT NULL THEN 0 WHEN op = 'CREATE' THEN size WHEN op = 'DELETE' THEN -item.size ELSE 0 END,
         CASE WHEN error IS NOT NULL THEN held WHEN op = 'CREATE' THEN list_append(held, {{'object': object, 'size': size, 'written': CAST(0 AS BIGINT), 'sealed': FALSE, 'pins': CAST(0 AS BIGINT)}})
              WHEN op = 'DELETE' THEN others
              ELSE list_append(others, {{'object': object, 'size': item.size, 'written': CASE WHEN op = 'WRITE' THEN least(item.size, item.written + size) ELSE item.written END, 'sealed': item.sealed OR op = 'SEAL',
                                        'pins': CASE WHEN op = 'PIN' THEN item.pins + 1 WHEN op = 'UNPIN' THEN greatest(0, item.pins - 1) ELSE item.pins END}}) END
  FROM (
    SELECT *, CASE WHEN op = 'CREATE' THEN CASE WHEN item IS NOT NULL THEN 'EXISTS' WHEN used + size > 20000 THEN 'FULL' END WHEN item IS NULL THEN 'UNKNOWN' WHEN op IN ('WRITE', 'SEAL') AND item.sealed THEN 'SEALED'
                   WHEN op = 'SEAL' AND item.written < item.size THEN 'INCOMPLETE' WHEN op = 'DELETE' AND item.pins > 0 THEN 'PINNED' END AS error
    FROM (SELECT o.store, o.seq, o.r, o.op, o.object, o.size, w.used, w.held, list_filter(w.held, lambda h: h.object = o.object)[1] AS item, list_filter(w.held, lambda h: h.object <> o.object) AS others
          FROM walk w JOIN ops o ON o.store = w.store AND o.r = w.r + 1) y) x)
SELECT store, seq, error IS NULL AS ok, error, used FROM walk WHERE r > 0
"""

RESERVATION_CHECK = """
WITH RECURSIVE ops AS (SELECT *, row_number() OVER (PARTITION BY pg ORDER BY seq) AS r FROM {reservation_ops}),
walk AS (
  SELECT pg, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS r, CAST('NONE' AS STRING) AS phase, CAST(NULL AS BIGINT) AS payload, CAST([] AS BIGINT[]) AS live, CAST([] AS BIGINT[]) AS ended,
         CAST(NULL AS STRING) AS error FROM (SELECT DISTINCT pg FROM ops) t
  UNION ALL
  SELECT o.pg, o.seq, o.r,
         CASE WHEN o.op = 'PREPARE' AND w.phase = 'NONE' THEN 'PREPARED' WHEN o.op = 'COMMIT' AND w.phase = 'PREPARED' THEN 'COMMITTED'
              WHEN o.op IN ('ABORT', 'BEGIN_REMOVE') AND w.phase IN ('NONE', 'PREPARED') THEN 'ABORTED' WHEN o.op = 'BEGIN_REMOVE' AND w.phase = 'COMMITTED' THEN 'REMOVING'
              WHEN (o.op = 'ABORT' AND w.phase IN ('COMMITTED', 'REMOVING') OR o.op = 'FINALIZE_REMOVE' AND w.phase = 'REMOVING') THEN CASE WHEN len(w.live) > 0 THEN 'REMOVING' ELSE 'ABORTED' END
              ELSE w.phase END,
         CASE WHEN o.op = 'PREPARE' AND w.phase = 'NONE' THEN o.payload ELSE w.payload END,
         CASE WHEN o.op = 'START' AND w.phase = 'COMMITTED' AND NOT list_contains(w.live, o.child) AND NOT list_contains(w.ended, o.child) THEN list_append(w.live, o.child)
              WHEN o.op = 'END' THEN list_filter(w.live, lambda x: x <> o.child) ELSE w.live END,
         CASE WHEN o.op = 'END' AND list_contains(w.live, o.child) THEN list_append(w.ended, o.child) ELSE w.ended END,
         CASE WHEN o.op = 'PREPARE' AND w.payload <> o.payload THEN 'CONFLICT' WHEN o.op = 'PREPARE' AND w.phase = 'ABORTED' THEN 'FENCED'
              WHEN o.op = 'COMMIT' AND w.phase NOT IN ('PREPARED', 'COMMITTED') THEN 'NOT_PREPARED' WHEN o.op = 'START' AND w.phase <> 'COMMITTED' THEN 'NOT_COMMITTED'
              WHEN o.op = 'START' AND list_contains(w.ended, o.child) THEN 'RELEASED' WHEN o.op = 'END' AND NOT list_contains(w.live, o.child) AND NOT list_contains(w.ended, o.child) THEN 'UNKNOWN'
              WHEN o.op = 'FINALIZE_REMOVE' AND w.phase NOT IN ('REMOVING', 'ABORTED') THEN 'NOT_REMOVING'
              WHEN (o.op = 'ABORT' AND w.phase IN ('COMMITTED', 'REMOVING') OR o.op = 'FINALIZE_REMOVE' AND w.phase = 'REMOVING') AND len(w.live) > 0 THEN 'CHILDREN' END
  FROM walk w JOIN ops o ON o.pg = w.pg AND o.r = w.r + 1)
SELECT pg, seq, phase, len(live) AS live, error FROM walk WHERE r > 0
"""

PUBLICATION_CHECK = """
WITH RECURSIVE needs(stage, prior) AS (VALUES ('PREPARED', 'INTENT'), ('ARMED', 'PREPARED'), ('TERMINAL', 'ARMED'), ('COMMITTED', 'PREPARED'), ('COMMITTED', 'TERMINAL'),
  ('ADOPTED', 'COMMITTED'), ('FENCED', 'INTENT'), ('RETIRED', 'FENCED')),
asked AS (
  SELECT s.ref, s.is_put, s.seq, s.stage, row_number() OVER (PARTITION BY s.ref ORDER BY s.seq) AS r,
         (SELECT coalesce(list(n.prior), []) FROM needs n WHERE n.stage = s.stage AND NOT (s.is_put AND n.prior = 'TERMINAL')) AS priors
  FROM {stages} s),
walk AS (
  SELECT ref, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS r, CAST('' AS STRING) AS stage, CAST([] AS VARCHAR[]) AS got, CAST(NULL AS STRING) AS error FROM (SELECT DISTINCT ref FROM asked) t
  UNION ALL
  SELECT x.ref, x.seq, x.r, x.stage, CASE WHEN x.error IS NULL AND NOT list_contains(x.got, x.stage) THEN list_append(x.got, x.stage) ELSE x.got END, x.error
  FROM (SELECT a.ref, a.seq, a.r, a.stage, w.got,
               CASE WHEN list_contains(w.got, a.stage) THEN NULL WHEN a.is_put AND a.stage = 'TERMINAL' THEN 'NO_TERMINAL_STAGE' WHEN NOT list_has_all(w.got, a.priors) THEN 'PREREQUISITE'
                    WHEN list_contains(w.got, 'FENCED') AND a.stage NOT IN ('FENCED', 'RETIRED') THEN 'FENCED' END AS error
        FROM walk w JOIN asked a ON a.ref = w.ref AND a.r = w.r + 1) x)
SELECT ref, seq, stage, error IS NULL AS accepted, nullif(list_position(got, stage), 0) AS receipt, error, list_contains(got, 'PREPARED') AND NOT list_contains(got, 'RETIRED') AS graph_active
FROM walk WHERE r > 0
"""


def mailbox_execution(calls: DataFrame) -> DataFrame:
    """Order in which an actor runs its calls: by arrival, but each caller's calls in contiguous numbers; repeats are cached.

    A call runs when the last of its caller's calls up to its number has arrived, and calls that one arrival sets free run by
    their numbers.  So places are a total order by that arrival, counted from the first of each actor: no task holds an
    actor's calls, only a caller's.
    """
    plain = calls.select("actor", "caller", "seq", "arrival")
    first = plain.groupBy("actor", "caller", "seq").agg(F.min("arrival").alias("arrival"), F.count("*").alias("n"))
    upto = Window.partitionBy("actor", "caller").orderBy("seq")
    placed = first.withColumn("place", F.row_number().over(upto) - 1).withColumn("due", F.max("arrival").over(upto))
    placed = materialize(placed, "calls")
    ran = total_order(placed.filter("seq = place").select("actor", "due", "caller", "seq"), ["actor", "due", "seq", "caller"])
    start = ran.groupBy("actor").agg(F.min("place").alias("start"))
    run = ran.join(F.broadcast(start), "actor") if placed.select("actor").distinct().count() < BROADCAST_ACTORS else ran.join(start, "actor")
    run = run.select("actor", "caller", "seq", F.lit("RUN").alias("state"), (F.col("place") - F.col("start")).alias("run_order"))
    none = F.lit(None).cast("bigint").alias("run_order")
    held = placed.filter("seq <> place").select("actor", "caller", "seq", F.lit("BUFFERED").alias("state"), none)
    again = placed.filter("n > 1").select("actor", "caller", "seq", F.lit("CACHED").alias("state"), none, F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    return run.union(held).union(again.select("actor", "caller", "seq", "state", "run_order"))


#: Actors whose first places are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ACTORS = 100_000

MAILBOX_CHECK = """
WITH once AS (SELECT actor, caller, seq, min(arrival) AS arrival FROM {actor_calls} GROUP BY actor, caller, seq),
numbered AS (SELECT a.*, (SELECT count(*) FROM once b WHERE b.actor = a.actor AND b.caller = a.caller AND b.seq < a.seq) = a.seq AS runs,
                    max(arrival) OVER (PARTITION BY actor, caller ORDER BY seq) AS due FROM once a)
SELECT actor, caller, seq, CASE WHEN runs THEN 'RUN' ELSE 'BUFFERED' END AS state,
       CASE WHEN runs THEN row_number() OVER (PARTITION BY actor, runs ORDER BY due, seq) - 1 END AS run_order FROM numbered
UNION ALL
SELECT actor, caller, seq, 'CACHED', NULL FROM (SELECT *, row_number() OVER (PARTITION BY actor, caller, seq ORDER BY arrival) AS k FROM {actor_calls}) t WHERE k > 1
"""
