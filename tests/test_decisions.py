"""Decisions on small hand-made state tables."""

import pytest

from tidewright.operators import folds, graphs
from tidewright.operators.decision import REGISTRY
from tidewright.plans import catalog


def rows(spark, sql):
    return spark.sql(f"SELECT * FROM VALUES {sql}")


def decide(spark, name, **tables):
    return {tuple(r) for r in REGISTRY[name].apply(spark, **tables).collect()}


def locality(spark, objects, fallback):
    """objects: (object, size, nodes)."""
    deps = spark.createDataFrame([(1, i, o, 0, False) for i, (o, _, _) in enumerate(objects)], "task bigint, pos int, object bigint, owner bigint, nested boolean")
    sizes = spark.createDataFrame([(o, s, 0) for o, s, _ in objects], "object bigint, size bigint, attempt int").distinct()
    replicas = spark.createDataFrame([(o, n) for o, _, ns in objects for n in ns], "object bigint, node bigint").distinct()
    tasks = spark.createDataFrame([(1, fallback)], "task bigint, fallback bigint")
    return REGISTRY["locality_preferred_node"].apply(spark, tasks=tasks, task_deps=deps, objects=sizes, replicas=replicas).first()["preferred_node"]


@pytest.mark.parametrize(
    ("objects", "fallback", "expected"),
    [
        ([(0, 40, [1]), (1, 40, [1]), (2, 100, [2])], 1, 2),
        ([(0, 100, [1]), (1, 60, [2]), (2, 50, [2])], 1, 2),
        ([(0, 40, [2, 2]), (0, 40, [2]), (1, 60, [1])], 2, 1),
        ([(0, 80, [1, 2]), (1, 30, [1]), (2, 20, [2]), (3, 105, [3])], 3, 1),
        ([(0, 80, [1, 3])], 3, 3),
        ([(0, 80, [1]), (1, 80, [2])], 3, 1),
        ([(0, 100, [])], 1, None),
        ([(1, 0, [1, 2])], 1, None),
    ],
)
def test_locality(spark, objects, fallback, expected):
    assert locality(spark, objects, fallback) == expected


def cluster(spark, nodes):
    """nodes: (node, alive, cpu total, cpu free, gpu total, gpu free)."""
    alive = spark.createDataFrame([(n, a) for n, a, *_ in nodes], "node bigint, alive boolean")
    res = [(n, "CPU", t, f) for n, _, t, f, _, _ in nodes] + [(n, "GPU", t, f) for n, _, _, _, t, f in nodes if t]
    return alive, spark.createDataFrame(res, "node bigint, resource string, total bigint, available bigint")


def hybrid(spark, nodes, cpu, gpu=0, preferred=99):
    alive, res = cluster(spark, nodes)
    tasks = spark.createDataFrame([(1, cpu, gpu, preferred)], "task bigint, cpu bigint, gpu bigint, preferred bigint")
    return decide(spark, "hybrid_schedule", tasks=tasks, nodes=alive, node_resources=res)


@pytest.mark.parametrize(
    ("nodes", "cpu", "gpu", "preferred", "expected"),
    [
        ([(1, True, 2000, 0, 0, 0)], 1000, 0, 99, ("PENDING_CAPACITY", None)),
        ([(1, True, 2000, 0, 0, 0)], 3000, 0, 99, ("INFEASIBLE", None)),
        ([(1, True, 4000, 4000, 0, 0), (2, True, 4000, 4000, 1000, 1000)], 1000, 0, 2, ("SELECTED", 1)),
        ([(1, True, 4000, 4000, 1000, 1000)], 1000, 0, 99, ("SELECTED", 1)),
        ([(1, True, 10000, 9000, 0, 0), (2, True, 10000, 6000, 0, 0)], 1000, 0, 2, ("SELECTED", 2)),
        ([(1, True, 10000, 9000, 0, 0), (2, True, 10000, 5000, 0, 0)], 1000, 0, 2, ("SELECTED", 1)),
        ([(1, False, 4000, 4000, 0, 0), (2, True, 1000, 1000, 0, 0)], 1000, 0, 1, ("SELECTED", 2)),
    ],
)
def test_hybrid(spark, nodes, cpu, gpu, preferred, expected):
    assert hybrid(spark, nodes, cpu, gpu, preferred) == {(1, *expected)}


def place(spark, name, nodes, b0, b1):
    alive, res = cluster(spark, nodes)
    bundles = spark.createDataFrame([(1, *b0, *b1)], "pg bigint, cpu0 bigint, gpu0 bigint, cpu1 bigint, gpu1 bigint")
    return next(iter(decide(spark, name, bundles=bundles, nodes=alive, node_resources=res)))[1:]


def test_placement(spark):
    two = [(1, True, 4000, 4000, 0, 0), (2, True, 4000, 4000, 0, 0)]
    assert place(spark, "placement_strict_pack", two, (1000, 0), (1000, 0)) == ("PLACED", 1)
    assert place(spark, "placement_strict_spread", two, (1000, 0), (1000, 0)) == ("PLACED", 1, 2)
    small = [(1, True, 2000, 2000, 0, 0), (2, True, 2000, 2000, 0, 0)]
    assert place(spark, "placement_strict_pack", small, (2000, 0), (2000, 0)) == ("INFEASIBLE", None)
    mixed = [(1, True, 1000, 1000, 1000, 1000), (2, True, 1000, 1000, 0, 0)]
    assert place(spark, "placement_strict_spread", mixed, (1000, 0), (0, 1000)) == ("PLACED", 2, 1)
    busy = [(1, True, 4000, 0, 0, 0)]
    assert place(spark, "placement_strict_pack", busy, (1000, 0), (1000, 0)) == ("PENDING", None)
    assert place(spark, "placement_strict_pack", busy, (4000, 0), (4000, 0)) == ("INFEASIBLE", None)
    assert place(spark, "placement_strict_spread", [two[0], (2, True, 4000, 0, 0, 0)], (1000, 0), (1000, 0)) == ("PENDING", None, None)
    assert place(spark, "placement_strict_spread", two[:1], (1000, 0), (1000, 0)) == ("INFEASIBLE", None, None)


def test_ranges_against_a_plain_merge(spark):
    import random

    r = random.Random(1)
    chunks = [(t, s, s + r.randint(0, 6), 0) for t in range(30) for s in (r.randint(0, 60) for _ in range(12))]
    expected = set()
    for t in range(30):
        merged = []
        for s, e in sorted((s, e) for k, s, e, _ in chunks if k == t and e > s):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        expected |= {(t, s, e) for s, e in merged}
    assert decide(spark, "range_coverage", chunks=spark.createDataFrame(chunks, "transfer bigint, s bigint, e bigint, payload bigint")) == expected


def test_pull(spark):
    state = spark.createDataFrame([(1, False, False, None, 10), (2, True, True, 5, 10), (3, False, True, None, 10), (4, False, False, 7, 10), (5, False, False, None, 10)], "object bigint, local_ready boolean, failed boolean, active_transfer bigint, requester bigint")
    where = spark.createDataFrame([(1, 10, False), (1, 11, True), (1, 12, False), (1, 13, False), (5, 10, False)], "object bigint, node bigint, excluded boolean")
    assert decide(spark, "pull_decision", pull_state=state, locations=where) == {(1, "START_PULL", 12), (2, "LOCAL_READY", None), (3, "FAILED", None), (4, "JOIN_PULL", None), (5, "WAIT_FOR_LOCATION", None)}


def test_liveness_needs_every_release(spark):
    objects = spark.createDataFrame([(1,), (2,)], "object bigint")
    refs = spark.createDataFrame([(1, 0, 1, 0, False), (1, 0, 1, 0, True), (1, 2, 1, 0, False), (1, 2, 1, 0, False), (2, 1, 4, 0, False), (2, 1, 4, 0, True)], "object bigint, kind int, token bigint, worker bigint, released boolean")
    assert decide(spark, "object_liveness", objects=objects, object_refs=refs) == {(1, 1, True), (2, 0, False)}


def test_mailbox_order(spark):
    calls = spark.createDataFrame([("x", "a", 1, 1), ("x", "b", 0, 2), ("x", "a", 0, 3), ("x", "a", 0, 4), ("x", "c", 3, 5)], "actor string, caller string, seq bigint, arrival bigint")
    numbered = calls.selectExpr("actor", "ascii(caller) as caller", "seq", "arrival").selectExpr("actor", "cast(caller as bigint) caller", "seq", "arrival")
    got = {(chr(r["caller"]), r["seq"], r["state"], r["run_order"]) for r in folds.mailbox_execution(numbered).collect()}
    assert got == {("b", 0, "RUN", 0), ("a", 0, "RUN", 1), ("a", 1, "RUN", 2), ("a", 0, "CACHED", None), ("c", 3, "BUFFERED", None)}


def test_retry(spark):
    events = [(1, 3, 1, 0, "APPLICATION"), (2, 1, 1, 0, "SYSTEM"), (2, 1, 2, 0, "SUCCESS"), (2, 1, 3, 1, "SYSTEM"), (3, 0, 1, 0, "SUCCESS")]
    got = folds.retry_fold(spark.createDataFrame(events, "task bigint, max_retries bigint, seq bigint, attempt bigint, event string")).collect()
    assert {(r["task"], r["seq"], r["action"]) for r in got} == {(1, 1, "FAIL_APPLICATION"), (2, 1, "RETRY_TASK"), (2, 2, "FENCE_STALE_ATTEMPT"), (2, 3, "FAIL_RETRY_EXHAUSTED"), (3, 1, "ACCEPT_SUCCESS")}


def test_ledger(spark):
    ops = [(1, 1, "ALLOCATE", 1, 300), (1, 2, "ALLOCATE", 1, 300), (1, 3, "ALLOCATE", 1, 200), (1, 4, "YIELD_CPU", 1, 0), (1, 5, "ALLOCATE", 2, 900), (1, 6, "REACQUIRE_CPU", 1, 0), (1, 7, "ALLOCATE", 3, 100), (1, 8, "RELEASE", 1, 0), (1, 9, "RELEASE", 1, 0), (1, 10, "ALLOCATE", 1, 300)]
    got = folds.ledger_fold(spark.createDataFrame(ops, "ledger bigint, seq bigint, op string, token bigint, milli bigint"), spark.createDataFrame([(1, 1000)], "ledger bigint, total bigint"))
    assert [(r["ok"], r["error"], r["available"], r["debt"]) for r in got.orderBy("seq").collect()] == [
        (True, None, 700, 0), (True, None, 700, 0), (False, "CONFLICT", 700, 0), (True, None, 1000, 0), (True, None, 100, 0), (True, None, 0, 200), (False, "CAPACITY", 0, 200), (True, None, 100, 0), (False, None, 100, 0), (False, "RELEASED", 100, 0),
    ]


def test_reservation(spark):
    ops = [(1, 1, "PREPARE", 5), (1, 2, "PREPARE", 5), (1, 3, "PREPARE", 6), (1, 4, "COMMIT", 5), (1, 5, "COMMIT", 5), (1, 6, "ABORT", 5), (2, 1, "ABORT", 1), (2, 2, "PREPARE", 1), (3, 1, "COMMIT", 1)]
    got = folds.reservation_fold(spark.createDataFrame(ops, "pg bigint, seq bigint, op string, payload bigint"))
    assert [(r["pg"], r["phase"], r["error"]) for r in got.orderBy("pg", "seq").collect()] == [
        (1, "PREPARED", None), (1, "PREPARED", None), (1, "PREPARED", "CONFLICT"), (1, "COMMITTED", None), (1, "COMMITTED", None), (1, "ABORTED", None), (2, "ABORTED", None), (2, "ABORTED", "FENCED"), (3, "NONE", "NOT_PREPARED"),
    ]


def test_reservations_wait_for_their_children(spark):
    ops = [("PREPARE", None), ("START", 1), ("COMMIT", None), ("START", 1), ("START", 2), ("FINALIZE_REMOVE", None), ("BEGIN_REMOVE", None), ("START", 3), ("FINALIZE_REMOVE", None), ("END", 1), ("ABORT", None), ("END", 2), ("END", 2), ("END", 9), ("FINALIZE_REMOVE", None), ("FINALIZE_REMOVE", None), ("COMMIT", None)]
    got = folds.reservation_fold(spark.createDataFrame([(1, i, op, 5, child) for i, (op, child) in enumerate(ops)], "pg bigint, seq bigint, op string, payload bigint, child bigint")).orderBy("seq").collect()
    assert [(r["phase"], r["live"], r["error"]) for r in got] == [
        ("PREPARED", 0, None), ("PREPARED", 0, "NOT_COMMITTED"), ("COMMITTED", 0, None), ("COMMITTED", 1, None), ("COMMITTED", 2, None), ("COMMITTED", 2, "NOT_REMOVING"), ("REMOVING", 2, None), ("REMOVING", 2, "NOT_COMMITTED"),
        ("REMOVING", 2, "CHILDREN"), ("REMOVING", 1, None), ("REMOVING", 1, "CHILDREN"), ("REMOVING", 0, None), ("REMOVING", 0, None), ("REMOVING", 0, "UNKNOWN"), ("ABORTED", 0, None), ("ABORTED", 0, None), ("ABORTED", 0, "NOT_PREPARED"),
    ]


def test_publication(spark):
    stages = ["INTENT", "PREPARED", "ARMED", "TERMINAL", "COMMITTED", "ADOPTED", "PREPARED", "FENCED", "RETIRED"]
    rows = [(1, False, i, s) for i, s in enumerate(stages)] + [(2, True, 0, "INTENT"), (2, True, 1, "TERMINAL"), (2, True, 2, "COMMITTED"), (2, True, 3, "PREPARED"), (2, True, 4, "COMMITTED"), (3, False, 0, "INTENT"), (3, False, 1, "FENCED"), (3, False, 2, "PREPARED")]
    got = folds.publication_fold(spark.createDataFrame(rows, "ref bigint, is_put boolean, seq bigint, stage string")).orderBy("ref", "seq").collect()
    assert [r["receipt"] for r in got[:9]] == [1, 2, 3, 4, 5, 6, 2, 7, 8] and [r["graph_active"] for r in got[6:9]] == [True, True, False]
    assert [r["error"] for r in got[9:]] == [None, "NO_TERMINAL_STAGE", "PREREQUISITE", None, None, None, None, "FENCED"]


def test_store(spark):
    ops = [("CREATE", 1, 5), ("CREATE", 2, 4), ("SEAL", 1, 0), ("WRITE", 1, 3), ("SEAL", 1, 0), ("WRITE", 1, 2), ("SEAL", 1, 0), ("SEAL", 1, 0), ("PIN", 1, 0), ("DELETE", 1, 0), ("UNPIN", 1, 0), ("DELETE", 1, 0), ("DELETE", 1, 0)]
    rows = [(1, i, *o) for i, o in enumerate(ops)]
    got = folds.store_fold(spark.createDataFrame(rows, "store bigint, seq bigint, op string, object bigint, size bigint"), 8).orderBy("seq").collect()
    assert [r["error"] for r in got] == [None, "FULL", "INCOMPLETE", None, "INCOMPLETE", None, None, "SEALED", None, "PINNED", None, None, "UNKNOWN"] and got[-1]["used"] == 0


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 7), (7, 6), (8, 8), (9, 6)], "src bigint, dst bigint")
    assert {r["node"] for r in graphs.cycle_members(edges).collect()} == {6, 7, 8}
    reach = {(r["seed"], r["node"], r["depth"]) for r in graphs.reachable(edges, spark.createDataFrame([(1,), (9,)], "node bigint")).collect()}
    assert reach == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 3), (9, 6, 1), (9, 7, 2)}
    chain = spark.createDataFrame([(10, 11)], "src bigint, dst bigint")
    assert graphs.admits(chain, spark.createDataFrame([(11, 12)], "src bigint, dst bigint"))
    assert not graphs.admits(chain, spark.createDataFrame([(11, 10)], "src bigint, dst bigint"))
    assert not graphs.admits(chain, spark.createDataFrame([(5, 5)], "src bigint, dst bigint"))
    dead = spark.createDataFrame([(i,) for i in range(1, 6)], "object bigint")
    got = {(r["object"], r["round"]) for r in graphs.gc_cascade(dead, spark.createDataFrame([(3,)], "object bigint"), edges).collect()}
    assert got == {(1, 1), (2, 2)}


def test_preflight(spark):
    lineage = spark.createDataFrame([(1, "LOST", False, 1), (2, "LOST", False, 1), (3, "PENDING", True, 0), (4, "READY", False, 0), (5, "LOST", False, 0), (7, "LOST", False, 1), (8, "LOST", False, 1)], "object bigint, state string, recovering boolean, retries_left bigint")
    deps = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (2, 5), (4, 6), (7, 8), (8, 7)], "src bigint, dst bigint")
    got = {(r["object"], r["depth"], r["action"]) for r in graphs.preflight(lineage, deps, spark.createDataFrame([(1,)], "node bigint")).collect()}
    assert got == {(1, 0, "REBUILD"), (2, 1, "REBUILD"), (3, 1, "JOIN"), (4, 2, "SKIP"), (5, 2, "REJECT_BUDGET")}
    ring = {(r["object"], r["action"]) for r in graphs.preflight(lineage, deps, spark.createDataFrame([(7,)], "node bigint")).collect()}
    assert ring == {(7, "REJECT_CYCLE"), (8, "REJECT_CYCLE")}


def test_missing_tables_are_named(spark):
    with pytest.raises(TypeError, match="replicas"):
        REGISTRY["node_loss_partition"].apply(spark, objects=spark.range(1))


def test_seeded_topk_draws_from_a_share_of_all_nodes(spark, tmp_path):
    import random

    spark.range(1, 1001).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1, 2001).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    live = [n for n in range(1, 1001) if n % 11][:20]
    got = {r["task"]: r["chosen"] for r in catalog.QUERIES["seeded_topk"](spark, str(tmp_path)).collect()}
    assert got == {t: random.Random(f"42:{t}").choice(live) for t in range(1, 2001)}


def test_location_removal_decides_every_node(spark):
    results = rows(spark, "(1, 1, 11, 5), (1, 2, 11, 5), (1, 1, 12, 5), (2, 3, 20, 5), (2, 3, 20, 5), (2, 1, 21, 5) t(object, attempt, node, payload)")
    objects = rows(spark, "(1, 9, 2), (2, 9, 3) t(object, size, attempt)")
    assert decide(spark, "location_removal", results=results, objects=objects) == {(1, 11, True, 2), (1, 12, False, 1), (2, 20, True, 2), (2, 21, False, 1)}


def test_ledger_conservation_sums_every_allocation(spark):
    resources = rows(spark, "(1, 'CPU', 8000, 1000), (1, 'GPU', 1000, 1000), (2, 'CPU', 4000, 1000) t(node, resource, total, available)")
    allocations = rows(
        spark,
        "(1, 'CPU', 'ACTIVE', 2000), (1, 'CPU', 'ACTIVE', 1000), (1, 'CPU', 'PREPARED', 1000), (1, 'CPU', 'COMMITTED', 3000), (1, 'CPU', 'RELEASED', 5000),"
        " (1, 'GPU', 'RELEASED', 1000), (2, 'CPU', 'PREPARED', 2000), (2, 'GPU', 'ACTIVE', 1000) t(node, resource, state, milli)",
    )
    expected = {(1, "CPU", 8000, 1000, 7000, True), (1, "GPU", 1000, 1000, 0, True), (2, "CPU", 4000, 1000, 2000, False), (2, "GPU", 0, 0, 1000, False)}
    assert decide(spark, "ledger_conservation", node_resources=resources, allocations=allocations) == expected
