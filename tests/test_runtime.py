"""The driver facade, traces, streams and identity columns."""

import json
import time

import pytest

from tidewright import runtime as rt
from tidewright.functions import ids
from tidewright.sources import traces
from tidewright.streaming.traces import BoundedSink, after_cursor, checked_stream, dedup_stream, mailbox_stream


@pytest.fixture
def running(spark):
    rt.init(spark, num_cpus=2, num_nodes=2, node_resources={"custom": 1})
    yield rt
    rt.shutdown()


def test_calls(running):
    square = rt.remote(lambda x: x * x)
    refs = [square.remote(i) for i in range(3)]
    assert rt.get(refs) == [0, 1, 4] and rt.get(square.remote(rt.put(7))) == 49
    nested = square.remote(square.remote(3))
    assert rt.get(nested) == 81
    with pytest.raises(TypeError):
        rt.get("text")
    with pytest.raises(TypeError):
        rt.remote(num_cats=1)(lambda: 1)
    with pytest.raises(rt.RuntimeFailure):
        square.options(num_cpus=64).remote(1)
    with pytest.raises(RuntimeError):
        rt.init()


def test_errors_and_retries(running):
    @rt.remote(max_retries=3)
    def bad():
        raise ValueError("no")

    with pytest.raises(rt.TaskError) as e:
        rt.get(bad.remote())
    assert isinstance(e.value.__cause__, ValueError)


def test_wait(running):
    def nap(s):
        time.sleep(s)
        return s

    slow, fast = rt.remote(nap).remote(3), rt.remote(nap).remote(0)
    ready, rest = rt.wait([slow, fast], num_returns=1, timeout=30)
    assert ready == [fast] and rest == [slow]
    assert rt.wait([slow], timeout=0) == ([], [slow])
    with pytest.raises(TimeoutError):
        rt.get(slow, timeout=0.01)
    with pytest.raises(ValueError):
        rt.wait([slow], num_returns=2)


def test_drop_and_rebuild(running):
    ref = rt.remote(max_retries=1)(lambda: 5).remote()
    assert rt.get(ref) == 5 and rt.drop_object(ref) and rt.get(ref) == 5
    assert rt.drop_object(ref)
    with pytest.raises(rt.UnreconstructableError):
        rt.get(ref)
    value = rt.put(1)
    rt.drop_object(value)
    with pytest.raises(rt.UnreconstructableError):
        rt.get(value)


def test_store_is_bounded(spark):
    rt.init(spark, inline_threshold=10, object_store_bytes=1000)
    try:
        rt.put(b"x" * 700)
        rt.put(1)
        with pytest.raises(rt.RuntimeFailure):
            rt.put(b"x" * 700)
    finally:
        rt.shutdown()


def test_dropping_gives_space_back(spark):
    rt.init(spark, inline_threshold=10, object_store_bytes=1000)
    try:
        for _ in range(3):
            assert rt.drop_object(rt.put(b"x" * 700))
    finally:
        rt.shutdown()


def test_one_deadline_for_a_whole_call(running):
    def nap(s):
        time.sleep(s)
        return s

    refs = [rt.remote(nap).remote(s) for s in (0.2, 2.5, 2.5, 0.2)]
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        rt.get(refs, timeout=1.0)
    assert time.monotonic() - began < 1.8
    ready, rest = rt.wait(refs, num_returns=4, timeout=0.5)
    assert time.monotonic() - began < 2.4 and len(ready) + len(rest) == 4
    rt.get(refs)


def test_resources_are_held(spark):
    rt.init(spark, num_cpus=1, node_resources={"custom": 1})
    try:
        def span(s):
            began = time.time()
            time.sleep(s)
            return began, time.time()

        one = rt.remote(span)
        (a, b), (c, d) = rt.get([one.remote(0.5), one.remote(0.5)])
        assert c >= b or a >= d
        free = rt.remote(num_cpus=0)(span)
        (a, b), (c, d) = rt.get([free.remote(1.5), free.remote(1.5)])
        assert c < b and a < d
        with pytest.raises(ValueError):
            rt.remote(num_cpus=1, resources={"CPU": 2})(span)
        assert rt.get(rt.remote(num_cpus=1, resources={"CPU": 1, "custom": 1})(lambda: 3).remote()) == 3
    finally:
        report = rt.shutdown()
    assert report["submitted"] == report["finished"] == 5 and report["failed"] == report["cancelled"] == 0


def test_tasks_in_placement_groups(running):
    group = rt.placement_group([{"CPU": 2}])
    inside = rt.remote(placement_group=group, bundle_index=0)(lambda x: x)
    assert rt.get(inside.remote(4)) == 4
    with pytest.raises(rt.RuntimeFailure):
        inside.options(num_cpus=3).remote(1)
    with pytest.raises(ValueError):
        inside.options(bundle_index=1).remote(1)
    nap = inside.options(num_cpus=2)
    nap.function = lambda x: time.sleep(x)
    running_, waiting = nap.remote(1.5), nap.remote(0)
    assert rt.remove_placement_group(group)
    with pytest.raises(rt.RuntimeFailure):
        rt.get(waiting)
    rt.get(running_)
    assert rt._state.free == {0: {"CPU": 2000, "custom": 1000}, 1: {"CPU": 2000, "custom": 1000}}
    with pytest.raises(rt.RuntimeFailure):
        inside.remote(1)


def test_many_waiting_calls_need_no_threads(running):
    ref = rt.remote(num_cpus=1)(lambda x: x + 1).remote(0)
    for _ in range(90):
        ref = rt.remote(num_cpus=0)(lambda x: x + 1).remote(ref)
    assert rt.get(ref) == 91


def test_failpoints_spend_the_retry_budget(running):
    add = rt.remote(max_retries=2, failpoint=("system_error", 2))(lambda x: x + 1)
    assert rt.get(add.remote(1)) == 2
    with pytest.raises(rt.SystemTaskError):
        rt.get(add.options(failpoint=("system_error", 3)).remote(1))
    assert rt.get(add.options(max_retries=1, failpoint=("crash", 1)).remote(4)) == 5
    with pytest.raises(ValueError):
        add.options(failpoint=("lightning", 1))
    assert rt.debug_snapshot()["failed"] == 1


def test_loss_of_a_node(running):
    def nap(s):
        time.sleep(s)
        return s

    group = rt.placement_group([{"CPU": 1}, {"CPU": 1}], strategy="STRICT_SPREAD")
    assert rt.debug_snapshot(group)["strategy"] == "STRICT_SPREAD" and rt.debug_snapshot()["nodes"][1]["free"]["CPU"] == 1000
    kept, lost = rt.remote(num_cpus=1, max_retries=1)(nap).remote(1.5), rt.remote(num_cpus=1)(nap).remote(1.5)
    time.sleep(0.3)
    rt.crash_node(0)
    # The group went with its node.
    assert rt.debug_snapshot()["groups"] == [] and rt.debug_snapshot()["nodes"][0]["alive"] is False
    got = []
    for ref in (kept, lost):
        try:
            got.append(rt.get(ref))
        except rt.SystemTaskError:
            got.append(None)
    assert got[0] == 1.5  # retried on the other node if it ran on the lost one
    assert rt.debug_snapshot(kept) == {"ready": True, "dropped": False, "stored_bytes": 0, "rebuildable": True}
    with pytest.raises(rt.RuntimeFailure):
        rt.remote(num_cpus=3)(nap).remote(0)
    rt.crash_node(1)
    with pytest.raises(rt.RuntimeFailure):
        rt.get(rt.remote(nap).remote(0))
    with pytest.raises(ValueError):
        rt.crash_node(1)
    with pytest.raises(TypeError):
        rt.debug_snapshot("text")


def test_actor(running):
    @rt.remote
    class Counter:
        def __init__(self, n):
            self.n = n

        def add(self, k):
            self.n += k
            return self.n

        def fail(self):
            raise KeyError("x")

    c = Counter.remote(10)
    assert rt.get([c.add.remote(1), c.add.remote(2), c.add.remote(3)]) == [11, 13, 16]
    with pytest.raises(rt.TaskError):
        rt.get(c.fail.remote())
    assert rt.get(c.add.remote(1)) == 17 and c.debug_snapshot()["generation"] == 0
    with pytest.raises(AttributeError):
        c._private  # noqa: B018


def test_placement_groups(running):
    a = rt.placement_group([{"CPU": 1}, {"CPU": 1}], strategy="STRICT_SPREAD")
    assert len(set(rt._state.groups[a]["nodes"])) == 2
    b = rt.placement_group([{"CPU": 1}])
    with pytest.raises(rt.RuntimeFailure):
        rt.placement_group([{"CPU": 2}])
    assert rt.remove_placement_group(a) and rt.remove_placement_group(b) and not rt.remove_placement_group(b)
    with pytest.raises(ValueError):
        rt.placement_group([], strategy="STRICT_PACK")
    with pytest.raises(ValueError):
        rt.placement_group([{"CPU": 1}], strategy="PACK")


def test_trace_of_calls(running, tmp_path):
    rt.get(rt.remote(lambda: 1).remote())
    assert [r["event"] for r in rt.trace()] == ["task_submitted", "task_finished"]
    assert rt.export_trace(str(tmp_path / "t.jsonl")) == 2
    assert [json.loads(x)["event"] for x in (tmp_path / "t.jsonl").read_text().splitlines()] == ["task_submitted", "task_finished"]


def test_not_running():
    assert not rt.is_initialized() and rt.shutdown() is None
    with pytest.raises(RuntimeError):
        rt.put(1)


def records(spark, reverse=False):
    rows = [
        ("e1", 5, "10", 1, "owner", "submitted", "task", "t1", None, {"task_id": "t1"}),
        ("e2", 4, "9", 1, "node", "granted", "lease", "l1", "e1", {"task_id": "t1", "lease_id": "l1"}),
        ("e3", 3, "9", 2, "node", "started", "lease", "l1", None, {"task_id": "t1", "lease_id": "l1"}),
        ("e4", 2, "10", 2, "owner", "finished", "task", "t1", "e3", {"task_id": "t1"}),
        ("e5", 1, "10", 3, "owner", "finished", "task", "t2", None, {"task_id": "t2"}),
    ]
    return spark.createDataFrame(rows[::-1] if reverse else rows, traces.TRACE_SCHEMA)


def test_trace_files(spark, tmp_path):
    events = records(spark)
    traces.write_trace(events, str(tmp_path / "a"))
    order = lambda d: sorted(d.collect(), key=lambda r: r["event_id"])
    assert order(traces.read_trace(spark, str(tmp_path / "a"))) == order(events)
    traces.append_trace(events, str(tmp_path / "a"))
    assert traces.read_trace(spark, str(tmp_path / "a")).count() == 10
    traces.export_trace(events, str(tmp_path / "one"))
    assert [json.loads(x)["event_id"] for x in (tmp_path / "one").read_text().splitlines()] == ["e1", "e4", "e5", "e2", "e3"]


def run_stream(spark, tmp_path, rows, schema, f):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = f(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_dedup_stream(spark, tmp_path):
    got = run_stream(spark, tmp_path, [[("a", 1), ("b", 2)], [("a", 1), ("c", 3)]], "event_id string, n int", dedup_stream)
    assert sorted(r["event_id"] for r in got) == ["a", "b", "c"]


def test_checked_stream_tells_conflicts(spark, tmp_path):
    rows = [[("a", 1, "x", None), ("b", 2, "x", None)], [("a", 3, "x", None), ("b", 4, "x", "cause"), ("c", 5, "z", None), ("c", 6, "z", None)]]
    got = run_stream(spark, tmp_path, rows, "event_id string, arrival bigint, event string, cause_event_id string", lambda d: checked_stream(d, ["event", "cause_event_id"]))
    assert sorted((r["event_id"], r["arrival"], r["disposition"]) for r in got) == [
        ("a", 1, "ACCEPTED"), ("a", 3, "DEDUPLICATED"), ("b", 2, "ACCEPTED"), ("b", 4, "CONFLICT"), ("c", 5, "ACCEPTED"), ("c", 6, "DEDUPLICATED"),
    ]


def test_mailbox_stream(spark, tmp_path):
    rows = [[("x", 0, 7, 1, 1), ("x", 0, 7, 0, 2), ("x", 0, 7, 3, 3)], [("x", 0, 7, 2, 4), ("x", 0, 7, 1, 5), ("x", 1, 7, 0, 6)]]
    got = run_stream(spark, tmp_path, rows, "actor string, generation bigint, caller bigint, seq bigint, arrival bigint", mailbox_stream)
    assert sorted((r["generation"], r["seq"], r["state"]) for r in got if r["state"] == "RUN") == [(0, 0, "RUN"), (0, 1, "RUN"), (0, 2, "RUN"), (0, 3, "RUN"), (1, 0, "RUN")]
    assert [(r["generation"], r["seq"]) for r in got if r["state"] == "CACHED"] == [(0, 1)]


def test_bounded_sink(spark):
    sink = BoundedSink(3)
    for i in (0, 1, 1):
        sink(spark.range(2), i)
    assert len(sink.rows) == 3 and sink.dropped == 1


def test_cursor(spark):
    deaths = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "node bigint, epoch bigint")
    assert after_cursor(deaths, 1).count() == 2 and after_cursor(deaths, 3).count() == 0
    with pytest.raises(ValueError):
        after_cursor(deaths, 4)


def test_ids(spark):
    from pyspark.sql import functions as F

    got = spark.range(3).select(ids.derived_id("task", F.col("id")).alias("x")).collect()
    assert len({r["x"] for r in got}) == 3 and got[0]["x"] == ids.digest(b"task", b"0").hex()
    assert ids.digest(b"ab", b"c") != ids.digest(b"a", b"bc")


def test_milli(spark):
    from pyspark.sql import functions as F

    good = spark.createDataFrame([("0.1",), ("2",), ("1.234",)], "t string")
    assert [r[0] for r in good.select(ids.milli(F.col("t"))).collect()] == [100, 2000, 1234]
    for bad in ("1.2345", "-1", "NaN", "0.0001", None):
        with pytest.raises(Exception, match="milli-units"):
            spark.createDataFrame([(bad,)], "t string").select(ids.milli(F.col("t"))).collect()


def test_vectors(spark):
    df = spark.sql("select map('CPU', 1000L, 'GPU', 0L) a, map('CPU', 400L) b")
    from pyspark.sql import functions as F

    r = df.select(ids.fits(F.col("b"), F.col("a")), ids.fits(F.col("a"), F.col("b")), ids.add_vectors(F.col("a"), F.col("b")), ids.subtract_vectors(F.col("a"), F.col("b"))).first()
    assert tuple(r) == (True, False, {"CPU": 1400}, {"CPU": 600})
    with pytest.raises(Exception, match="underflow"):
        df.select(ids.subtract_vectors(F.col("b"), F.col("a"))).collect()


def test_seeded_choice_doesnt_depend_on_partitions(spark):
    rows = spark.range(50).selectExpr("id as task", "array(4L, 5L, 6L) as c", "10 as n")
    one = {r["task"]: r["chosen"] for r in ids.seeded_choice(rows.repartition(1), "task", "c", 2, 0.0, "n").collect()}
    many = {r["task"]: r["chosen"] for r in ids.seeded_choice(rows.repartition(7), "task", "c", 2, 0.0, "n").collect()}
    assert one == many and set(one.values()) == {4, 5}
