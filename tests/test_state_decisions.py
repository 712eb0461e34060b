"""Decisions over state columns, folds and graphs against plain Python versions."""

import random

import pytest

from tidewright.operators import folds, graphs
from tidewright.operators.decision import REGISTRY


def decide(spark, name, **tables):
    return {tuple(r) for r in REGISTRY[name].apply(spark, **tables).collect()}


def test_unknown_failures_are_errors(spark):
    events = spark.createDataFrame([(1, 1, "SYSTEM", 0, 1), (1, 2, "SUCCESS", 0, 1)], "task bigint, seq bigint, event string, attempt bigint, max_retries bigint")
    assert decide(spark, "failure_classification", task_events=events) == {(1, 1, "SYSTEM", "SYSTEM", True), (1, 2, "SUCCESS", "NONE", False)}
    for odd in ("TIMEOUT", None):
        with pytest.raises(Exception, match="unknown failure"):
            decide(spark, "failure_classification", task_events=events.selectExpr("task", "seq", f"cast({'null' if odd is None else repr(odd)} as string) as event", "attempt", "max_retries"))


def test_what_a_task_does_after_its_end(spark):
    ends = {"SUCCESS": "ACCEPT_SUCCESS", "APPLICATION": "FAIL_APPLICATION", "SYSTEM": "FAIL_RETRY_EXHAUSTED"}
    events, expected = [], {}
    for t, (first, again) in enumerate((a, b) for a in ends for b in ends):
        events += [(t, 0, 1, 0, first), (t, 0, 2, 0, again), (t, 0, 3, 7, again)]
        expected |= {(t, 1): ends[first], (t, 2): ends[first] if first == again else "ERROR:CONTRADICTION", (t, 3): "FENCE_STALE_ATTEMPT"}
    got = folds.retry_fold(spark.createDataFrame(events, "task bigint, max_retries bigint, seq bigint, attempt bigint, event string")).collect()
    assert {(r["task"], r["seq"]): r["action"] for r in got} == expected


def test_exits_of_one_actor_in_order(spark):
    exit_, home = ("EXIT", 1, 0, 5, 0, True), 5
    rows = [exit_, exit_, ("EXIT", 1, 0, 6, 0, True), ("EXIT", 2, 0, 5, 0, True), ("EXIT", 3, 1, 5, 1, True), ("RESTARTED", 0, 1, 5, 0, True), ("EXIT", 4, 1, 5, 2, False), ("EXIT", 4, 1, 5, 2, True), ("RESTARTED", 0, 1, 5, 0, True), exit_]
    schema = "actor bigint, seq bigint, event string, detection bigint, generation bigint, node bigint, route_epoch bigint, node_alive boolean, max_restarts bigint, home bigint"
    got = folds.actor_exit_fold(spark.createDataFrame([(1, i, *r, 1, home) for i, r in enumerate(rows)], schema)).orderBy("seq").collect()
    assert [(r["disposition"], r["state"]) for r in got] == [
        ("APPLIED", "RESTARTING"), ("ALREADY_APPLIED", "RESTARTING"), ("CONFLICT", "RESTARTING"), ("STALE", "RESTARTING"), ("CONFLICT", "RESTARTING"), ("APPLIED", "ALIVE"),
        ("CONFLICT", "ALIVE"), ("APPLIED", "DEAD"), ("CONFLICT", "DEAD"), ("ALREADY_APPLIED", "DEAD"),
    ]
    assert got[-1]["generation"] == 1 and got[-1]["restarts_used"] == 1


def test_collectable_needs_everything_released(spark):
    states = spark.createDataFrame([(i, "READY_STORED" if i == 2 else "READY_INLINE", i == 3, i == 4, i == 5) for i in range(1, 11)], "object bigint, state string, collecting boolean, publishing boolean, has_lineage boolean")
    refs = spark.createDataFrame([(1, 0, 1, False), (1, 0, 1, True), (6, 0, 1, False)], "object bigint, kind int, token bigint, released boolean")
    where = spark.createDataFrame([(7, 1)], "object bigint, node bigint")
    edges = spark.createDataFrame([(8, 1, "CONTAINED"), (9, 1, "LINEAGE")], "src bigint, dst bigint, kind string")
    assert decide(spark, "collectable_objects", object_states=states, object_refs=refs, object_locations=where, object_edges=edges) == {(1,), (10,)}


def test_a_replica_goes_only_on_its_full_identity(spark):
    objects = spark.createDataFrame([(1, 5, 2, 7, "c")], "object bigint, size bigint, attempt bigint, owner bigint, checksum string")
    replicas = spark.createDataFrame([(1, 10)], "object bigint, node bigint")
    asked = [(1, 2, 10, 7, "c"), (1, 1, 10, 7, "c"), (1, 2, 11, 7, "c"), (1, 2, 10, 8, "c"), (1, 2, 10, 7, "d")]
    got = decide(spark, "drop_exact_replica", drop_requests=spark.createDataFrame(asked, "object bigint, attempt bigint, node bigint, owner bigint, checksum string"), objects=objects, replicas=replicas)
    assert got == {(*a, 1, i == 0) for i, a in enumerate(asked)}


def test_trace_records_that_differ_anywhere_conflict(spark):
    base = ("e", "p", 1, "c", "x", None, 1, 2, 3)
    rows = [("a", *base[1:], 5), ("a", *base[1:], 9), ("b", *base[1:], 6), ("c", *base[1:], 7), ("c", *base[1:7], 9, 3, 8), ("d", *base[1:], 1), ("d", *base[1:5], "cause", *base[6:], 2)]
    schema = "event_id string, process_id string, process_sequence bigint, component string, event string, cause_event_id string, rpc_id bigint, object_id bigint, task_id bigint, arrival bigint"
    assert decide(spark, "trace_dedup", trace_deliveries=spark.createDataFrame(rows, schema)) == {("a", 5, 1, False), ("b", 6, 0, False), ("c", 7, 1, True), ("d", 1, 1, True)}


def _components(edges):
    """Strong components with a cycle, by plain reachability."""
    nodes = {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in reach[n]:
                    reach[n].add(b)
                    todo.insert(0, b)
            todo.pop()
    return {frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", range(6))
def test_strong_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    n = r.choice([4, 9, 16])
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.choice([n, int(1.4 * n)]))}
    if seed % 2:
        edges |= {(100 + i, 100 + (i + 1) % 7) for i in range(7)} | {(100, 0), (1, 103)} | {(200, 201), (201, 202), (300, 300)}
    got = {}
    for x in graphs.strong_components(spark.createDataFrame(sorted(edges), "src bigint, dst bigint")).collect():
        assert x["node"] not in got
        got[x["node"]] = x["component"]
    groups = {}
    for node, c in got.items():
        groups.setdefault(c, set()).add(node)
    assert {frozenset(g) for g in groups.values()} == _components(edges)


def test_a_ring_and_a_chain_of_many_nodes(spark):
    n = 100_000
    ring = spark.range(n).selectExpr("id as src", f"(id + 1) % {n} as dst")
    chain = spark.range(n).selectExpr(f"id + {n} as src", f"id + {n + 1} as dst")
    assert graphs.cycle_members(ring.union(chain)).count() == n
    assert graphs.cycle_members(chain.limit(0)).count() == 0


def test_bounds_on_rounds_are_errors(spark):
    edges = spark.range(6).selectExpr("id as src", "id + 1 as dst")
    seeds = spark.range(1).selectExpr("id as node")
    assert graphs.reachable(edges, seeds, max_depth=6).count() == 6
    with pytest.raises(RuntimeError):
        graphs.reachable(edges, seeds, max_depth=5)


def test_mailboxes_against_a_plain_run(spark):
    r = random.Random(4)
    calls, arrival = [], 0
    for actor in "xy":
        for caller in range(5):
            seqs = list(range(8)) + r.choices(range(10), k=3)
            if caller == 3:
                seqs.remove(2)
            calls += [[actor, caller, s] for s in seqs]
    r.shuffle(calls)
    calls = [(*c, i) for i, c in enumerate(calls)]
    expected = []
    for actor in "xy":
        upto, held, order, seen = {}, set(), 0, set()
        for a, caller, seq, _ in calls:
            if a != actor:
                continue
            if (caller, seq) in seen:
                expected.append((actor, caller, seq, "CACHED", None))
                continue
            seen.add((caller, seq))
            held.add((caller, seq))
            while (caller, upto.get(caller, 0)) in held:
                now = upto.get(caller, 0)
                held.remove((caller, now))
                expected.append((actor, caller, now, "RUN", order))
                order, upto[caller] = order + 1, now + 1
        expected += [(actor, c, s, "BUFFERED", None) for c, s in held]
    got = folds.mailbox_execution(spark.createDataFrame(calls, "actor string, caller bigint, seq bigint, arrival bigint")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert folds.mailbox_execution(spark.createDataFrame([], "actor string, caller bigint, seq bigint, arrival bigint")).count() == 0


def test_collection_counts_every_holder(spark):
    r = random.Random(2)
    for _ in range(3):
        edges = {(a, b) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(40)) if a < b}
        held = set(r.sample(range(30), 4))
        kept, todo = set(held), list(held)
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in kept:
                    kept.add(b)
                    todo.append(b)
        dead = spark.range(30).selectExpr("id as object")
        got = {x["object"] for x in graphs.gc_cascade(dead, spark.createDataFrame([(h,) for h in held], "object bigint"), spark.createDataFrame(sorted(edges), "src bigint, dst bigint")).collect()}
        assert got == set(range(30)) - kept
