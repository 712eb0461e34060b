"""Trace contracts: a small round trip with a nested call, and every way to break it."""

import json

import pytest

from tidewright.operators.contracts import ContractError, ContractMismatch, check_contract, load_contract, read_contract_text
from tidewright.sources.traces import TRACE_SCHEMA, total_order

CONTRACT = {
    "name": "one_task",
    "title": "a task that its worker reports",
    "participants": {"owner": "Owner", "node": "Node", "worker": "Worker"},
    "input_bindings": ["task_id"],
    "events": [
        {"key": "submitted", "component": "owner", "event": "task_submitted", "fields": {"task_id": "$task_id", "object_id": "$object_id"}, "max_count": 1},
        {"key": "started", "component": "worker", "event": "task_started", "fields": {"task_id": "$task_id", "worker_id": "$worker_id"}, "max_count": 1},
        {"key": "done", "component": "owner", "event": "task_done", "fields": {"object_id": "$object_id", "status": "OK"}, "show_fields": ["status", "object_id"]},
    ],
    "rpcs": [
        {"key": "push", "client": "owner", "server": "worker", "handler": "push_task", "round_trip": True, "reply_ok": "true", "after_event": "submitted", "reply_event": "done", "server_event": "started"},
        {"key": "report", "client": "worker", "server": "node", "client_component": "transport", "handler": "report", "after_event": "started"},
    ],
    "orders": [{"before": "submitted", "after": "started"}, {"before": "push.reply_sent", "after": "done"}, {"before": "report", "after": "push.reply_received"}],
    "forbidden": [{"component": "owner", "event_prefixes": ["task_lost", "task_retried"], "fields": {"task_id": "$task_id"}}],
    "render_order": ["submitted", "push", "started", "report", "push.reply_received", "done"],
}


def call(handler, rpc, **more):
    return {"handler": handler, "rpc_id": rpc, **more}


ROWS = {
    "a1": ("10", 1, "owner", "task_submitted", None, {"task_id": "t1", "object_id": "o1"}),
    "a2": ("10", 2, "owner", "rpc_request_sent", "a1", call("push_task", "r1")),
    "b1": ("9", 1, "worker", "rpc_request_received", "a2", call("push_task", "r1")),
    "b2": ("9", 2, "worker", "task_started", "b1", {"task_id": "t1", "worker_id": "w1"}),
    "b3": ("9", 3, "transport", "rpc_request_sent", "b2", call("report", "r2")),
    "c1": ("8", 1, "node", "rpc_request_received", "b3", call("report", "r2")),
    "b4": ("9", 4, "worker", "rpc_reply_sent", "b2", call("push_task", "r1", ok="true")),
    "a3": ("10", 3, "owner", "rpc_reply_received", "b4", call("push_task", "r1", ok="true")),
    "a4": ("10", 4, "owner", "task_done", "a3", {"object_id": "o1", "status": "OK"}),
    "a5": ("10", 5, "owner", "task_retried", None, {"task_id": "t2"}),
}


def trace(spark, reverse=False, **changes):
    rows = [(i, 0, p, s, c, e, None, None, cause, f) for i, (p, s, c, e, cause, f) in {**ROWS, **changes}.items() if c]
    return spark.createDataFrame(rows[::-1] if reverse else rows, TRACE_SCHEMA)


@pytest.mark.parametrize("reverse", [False, True])
def test_a_trace_that_keeps_its_contract(spark, tmp_path, reverse):
    (tmp_path / "c.json").write_text(json.dumps(CONTRACT))
    check = check_contract(trace(spark, reverse), load_contract(str(tmp_path / "c.json")), task_id="t1").require()
    assert check.bound == {"task_id": "t1", "object_id": "o1", "worker_id": "w1"} and check.counts == {"submitted": 1, "started": 1, "done": 1}
    assert {k: v["event_id"] for k, v in check.calls["push"].items()} == {"request_sent": "a2", "request_received": "b1", "reply_sent": "b4", "reply_received": "a3", "reply_event": "a4", "server_event": "b2"}
    assert check.explain() == "one_task: kept"
    assert check.render().splitlines() == [
        "one_task: a task that its worker reports",
        "01. Owner : task_submitted",
        "02. Owner -> Worker : push_task [request; round trip verified]",
        "03. Worker : task_started",
        "04. Worker -> Node : report [request edge]",
        "05. Worker -> Owner : push_task [reply_received, transport_ok=true, status=OK, object_id=<object>]",
        "06. Owner : task_done [status=OK, object_id=<object>]",
    ] or reverse


GONE = ("", 0, "", "", None, {})


@pytest.mark.parametrize(
    ("changes", "said"),
    [
        ({"b2": GONE}, "event started"),
        ({"a9": ("10", 9, "owner", "task_submitted", None, {"task_id": "t1", "object_id": "o1"})}, "event submitted"),
        ({"a4": ("10", 4, "owner", "task_done", "a3", {"object_id": "o2", "status": "OK"})}, "event done"),
        ({"b1": ("9", 1, "worker", "rpc_request_received", None, call("push_task", "r1"))}, "call push"),
        ({"b1": ("9", 1, "worker", "rpc_request_received", "a2", call("push_task", "r9"))}, "call push"),
        ({"b4": ("9", 4, "worker", "rpc_reply_sent", "b2", call("push_task", "r1", ok="false"))}, "call push"),
        ({"b4": ("9", 4, "worker", "rpc_reply_sent", None, call("push_task", "r1", ok="true"))}, "call push"),
        ({"a4": ("10", 4, "owner", "task_done", "a2", {"object_id": "o1", "status": "OK"})}, "call push"),
        ({"c1": ("9", 9, "node", "rpc_request_received", "b3", call("report", "r2"))}, "call report"),
        ({"b3": ("9", 5, "transport", "rpc_request_sent", "b2", call("report", "r2"))}, "order: push.reply_received"),
        ({"a5": ("10", 5, "owner", "task_retried", None, {"task_id": "t1"})}, "forbidden: owner.task_retried"),
    ],
)
def test_violations(spark, changes, said):
    check = check_contract(trace(spark, **changes), read_contract_text(json.dumps(CONTRACT)), task_id="t1")
    assert any(v.startswith(said) for v in check.violations), check.violations
    with pytest.raises(ContractMismatch, match="one_task"):
        check.require()


def test_repeated_ids_and_missing_bindings(spark):
    twice = trace(spark).union(trace(spark).filter("event_id = 'a5'"))
    assert check_contract(twice, read_contract_text(json.dumps(CONTRACT))).violations[:2] == ["event ids repeat", "no value for $task_id"]


def test_a_request_serves_one_rule_only(spark):
    rule = {"key": "again", "client": "worker", "server": "node", "client_component": "transport", "handler": "report"}
    check = check_contract(trace(spark), read_contract_text(json.dumps({**CONTRACT, "rpcs": [*CONTRACT["rpcs"], rule]})), task_id="t1")
    assert [v.split(":")[0] for v in check.violations] == ["call again"]


@pytest.mark.parametrize("text", ["{", "[]", '{"events": [{"key": "a"}]}', '{"rpcs": [{"key": "a", "client": "b", "server": "c", "handler": "d", "after_event": "x"}]}'])
def test_contracts_that_cant_be_read(text):
    with pytest.raises(ContractError):
        read_contract_text(text)


def test_total_order(spark):
    rows = spark.range(5000).selectExpr("cast(id % 37 as string) p", "(id * 7919) % 5000 as s").repartition(6)
    got = [(r["p"], r["s"], r["place"]) for r in total_order(rows, ["p", "s"]).collect()]
    assert [x[2] for x in sorted(got)] == list(range(1, 5001))
    assert total_order(rows.limit(0), ["p", "s"]).count() == 0
