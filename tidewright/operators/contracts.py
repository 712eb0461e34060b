"""Trace contracts: patterns of events and calls that a causal trace must show, from a file to a verdict.

Each rule is a filter or a join over the trace, and only what it selects comes back: the first record of an event rule with
its count, the four records of a call rule.  Rules bind names one after the other, so there is a query for each of them; the
records that any rule could name are written once before, and causes are followed between those a rule asks for.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.graphs import causal_reach, reachable
from tidewright.sources.shared import materialize

ORDER = ["process_id", "process_sequence", "event_id"]
#: The records of a call, by the names that contracts give them.
POINTS = ("request_sent", "request_received", "reply_sent", "reply_received")


class ContractError(ValueError):
    """A contract that can't be read."""


class ContractMismatch(AssertionError):
    """A trace that doesn't show what its contract asks for."""


def load_contract(path: str) -> dict:
    """A contract file: JSON with lists of events, rpcs, orders and forbidden, checked for the keys that rules need."""
    with open(path, encoding="utf-8") as f:
        return read_contract_text(f.read())


def read_contract_text(text: str) -> dict:
    try:
        contract = json.loads(text)
    except json.JSONDecodeError as e:
        raise ContractError(f"not JSON: {e}") from e
    needs = {"events": ("key", "component", "event"), "rpcs": ("key", "client", "server", "handler"), "orders": ("before", "after"), "forbidden": ("component",)}
    if not isinstance(contract, dict):
        raise ContractError("a contract is an object")
    for kind, keys in needs.items():
        for rule in contract.setdefault(kind, []):
            if missing := [k for k in keys if not rule.get(k)]:
                raise ContractError(f"a rule of {kind} lacks {', '.join(missing)}")
    keys = [r["key"] for r in contract["events"] + contract["rpcs"]]
    if len(keys) != len(set(keys)):
        raise ContractError("keys of rules must differ")
    for rule in contract["rpcs"]:
        for end in ("after_event", "before_event", "reply_event", "server_event"):
            if rule.get(end) and rule[end] not in [e["key"] for e in contract["events"]]:
                raise ContractError(f"{rule['key']} names an unknown event {rule[end]}")
    return contract


@dataclass
class ContractCheck:
    """What a trace shows of a contract: bound names, selected records by rule, and violations in rule order."""

    contract: dict
    bound: dict[str, str]
    events: dict[str, dict] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    calls: dict[str, dict[str, dict]] = field(default_factory=dict)
    violations: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.violations

    def explain(self) -> str:
        name = self.contract.get("name", "contract")
        return f"{name}: kept" if self.ok else "\n".join([f"{name}: {len(self.violations)} violations", *(f"- {v}" for v in self.violations)])

    def require(self) -> ContractCheck:
        if not self.ok:
            raise ContractMismatch(self.explain())
        return self

    def point(self, name: str) -> dict | None:
        """The record that an order or a rendering names: an event, a call's request, or ``call.reply_sent`` and the like."""
        if name in self.events:
            return self.events[name]
        key, _, end = name.partition(".")
        return self.calls.get(key, {}).get(end or POINTS[0])

    def _value(self, name: str, pattern: str | None, value: str) -> str:
        """A field as text that doesn't differ between runs: ids become the names of what they identify."""
        if pattern is not None and pattern.startswith("$"):
            return f"<{pattern[1:].removesuffix('_id')}>"
        if name.endswith(("_id", "_ids")):
            return f"<{name.rstrip('s').removesuffix('_id')}>"
        return value if pattern is None else pattern

    def render(self) -> str:
        """The canonical sequence, one line for each entry of the contract's render order."""
        self.require()
        people, rules = self.contract.get("participants", {}), {r["key"]: r for r in self.contract["events"] + self.contract["rpcs"]}

        def shown(rule: dict) -> list[str]:
            fields = self.events[rule["key"]]["fields"]
            return [f"{f}={self._value(f, rule.get('fields', {}).get(f), fields.get(f, ''))}" for f in rule.get("show_fields", ())]

        lines = [f"{self.contract.get('name', 'contract')}: {self.contract.get('title', '')}"]
        for number, name in enumerate(self.contract.get("render_order", ()), 1):
            key, _, end = name.partition(".")
            rule = rules[key]
            if "event" in rule:
                text, notes = f"{people.get(rule['component'], rule['component'])} : {rule['event']}", shown(rule)
            else:
                reply = end in POINTS[2:]
                ends = (rule["server"], rule["client"]) if reply else (rule["client"], rule["server"])
                text = f"{people.get(ends[0], ends[0])} -> {people.get(ends[1], ends[1])} : {rule['handler']}"
                notes = [end or ("request; round trip verified" if rule.get("round_trip") else "request edge")]
                if reply and rule.get("reply_ok") is not None:
                    notes.append(f"transport_ok={rule['reply_ok']}")
                if end == POINTS[3] and rule.get("reply_event"):
                    notes += shown(rules[rule["reply_event"]])
            lines.append(f"{number:02d}. {text}" + (f" [{', '.join(notes)}]" if notes else ""))
        return "\n".join(lines)


def _fields(expected: dict[str, str], bound: dict[str, str], capture: bool) -> list[Column]:
    """Conditions on a record's fields; unbound names only ask that the field is there, if they may be captured."""
    out = []
    for name, pattern in expected.items():
        value = F.col("fields")[name]
        if not pattern.startswith("$"):
            out.append(value == pattern)
        elif pattern[1:] in bound:
            out.append(value == bound[pattern[1:]])
        else:
            out.append(value.isNotNull() if capture else F.lit(False))
    by_name: dict[str, list[str]] = {}
    for name, pattern in expected.items():
        if pattern.startswith("$") and pattern[1:] not in bound:
            by_name.setdefault(pattern, []).append(name)
    # A name that a rule uses twice must have one value in the record that binds it.
    out += [F.col("fields")[a] == F.col("fields")[b] for same in by_name.values() for a, b in zip(same, same[1:])]
    return out


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def _records(alias: str) -> list[Column]:
    return [F.col(f"{alias}.{c}").alias(f"{alias}_{c}") for c in ("event_id", "process_id", "process_sequence")]


def _find_call(trace: DataFrame, links: DataFrame, rule: dict, anchors: dict[str, DataFrame], ends: dict[str, dict], used: list[str]) -> dict[str, dict] | None:
    """The first call in order that a rule describes: its records by POINTS, and anchor records by their keys."""
    client, server = rule.get("client_component") or rule["client"], rule.get("server_component") or rule["server"]

    def side(component: str, event: str, ok: bool = False) -> DataFrame:
        where = [F.col("component") == component, F.col("event") == event, F.col("fields")["handler"] == rule["handler"], F.coalesce(F.col("fields")["rpc_id"], F.lit("")) != ""]
        if ok and rule.get("reply_ok") is not None:
            where.append(F.col("fields")["ok"] == rule["reply_ok"])
        return trace.filter(_all(where)).withColumn("rpc", F.col("fields")["rpc_id"])

    sent = side(client, "rpc_request_sent").filter(~F.col("event_id").isin(used))
    for end, later in (("after_event", True), ("before_event", False)):
        if known := ends.get(rule.get(end)):
            place = F.col("process_sequence") > known["process_sequence"] if later else F.col("process_sequence") < known["process_sequence"]
            sent = sent.filter((F.col("process_id") == known["process_id"]) & place)
    got = side(server, "rpc_request_received")
    pairs = sent.alias("s").join(got.alias("r"), (F.col("r.cause_event_id") == F.col("s.event_id")) & (F.col("r.rpc") == F.col("s.rpc")) & (F.col("r.process_id") != F.col("s.process_id")))
    # A request counts with the first receipt in order only.
    first = F.min(F.struct(*(F.col(f"r.{c}") for c in (*ORDER, "rpc")))).alias("r")
    pairs = pairs.groupBy(*(F.col(f"s.{c}").alias(f"s_{c}") for c in ORDER)).agg(first).select("*", *_records("r"), F.col("r.rpc").alias("s_rpc")).drop("r")
    parts = ["s", "r"]
    if rule.get("round_trip"):
        names, replies = pairs.columns, side(server, "rpc_reply_sent", True)
        pairs = pairs.join(replies.alias("p"), (F.col("p.rpc") == F.col("s_rpc")) & (F.col("p.process_id") == F.col("r_process_id")) & (F.col("p.process_sequence") > F.col("r_process_sequence")))
        pairs = materialize(pairs.select(*names, *_records("p")), "calls")
        # The reply must follow the receipt by causes that were recorded, not by its place in the process.
        behind = materialize(reachable(links, pairs.select(F.col("p_event_id").alias("node")).distinct()).select(F.col("seed").alias("_late"), F.col("node").alias("_early")), "causes")
        pairs = pairs.join(behind, (F.col("_late") == F.col("p_event_id")) & (F.col("_early") == F.col("r_event_id")), "left_semi")
        names, back = pairs.columns, side(client, "rpc_reply_received", True)
        pairs = pairs.join(back.alias("q"), (F.col("q.cause_event_id") == F.col("p_event_id")) & (F.col("q.rpc") == F.col("s_rpc")) & (F.col("q.process_id") == F.col("s_process_id")) & (F.col("q.process_sequence") > F.col("s_process_sequence")))
        pairs = pairs.select(*names, *_records("q"))
        parts += ["p", "q"]
        if key := rule.get("reply_event"):
            names = pairs.columns
            late = (F.col("a.process_id") == F.col("s_process_id")) & (F.col("a.process_sequence") > F.col("q_process_sequence")) & (F.col("a.cause_event_id") == F.col("q_event_id"))
            pairs = pairs.join(anchors[key].alias("a"), late).select(*names, *_records("a"))
            parts.append("a")
        if key := rule.get("server_event"):
            inside = (F.col("b.process_id") == F.col("r_process_id")) & (F.col("b.process_sequence") > F.col("r_process_sequence")) & (F.col("b.process_sequence") < F.col("p_process_sequence"))
            names = pairs.columns
            pairs = pairs.join(anchors[key].alias("b"), inside).select(*names, *_records("b"))
            fore = reachable(links, pairs.select(F.col("b_event_id").alias("node")).distinct()).select(F.col("seed").alias("_late"), F.col("node").alias("_early"))
            pairs = pairs.join(fore, (F.col("_late") == F.col("b_event_id")) & (F.col("_early") == F.col("r_event_id")), "left_semi")
            pairs = pairs.join(behind, (F.col("_late") == F.col("p_event_id")) & (F.col("_early") == F.col("b_event_id")), "left_semi")
            parts.append("b")
    rank = F.struct(*(F.struct(*(F.col(f"{p}_{c}").alias(c) for c in ORDER)).alias(p) for p in parts))
    best = pairs.agg(F.min(rank).alias("best")).first()["best"]
    if best is None:
        return None
    names = {"s": POINTS[0], "r": POINTS[1], "p": POINTS[2], "q": POINTS[3], "a": "reply_event", "b": "server_event"}
    return {names[p]: best[p].asDict() for p in parts}


def check_contract(events: DataFrame, contract: dict, **bindings: object) -> ContractCheck:
    """Hold a trace against a contract; ``bindings`` are names that the caller knows.

    ``events`` has event_id, process_id, process_sequence, component, event, cause_event_id and fields (a map of texts).
    """
    check = ContractCheck(contract, {k: str(v) for k, v in bindings.items()})
    events = events.select("event_id", "process_id", "process_sequence", "component", "event", "cause_event_id", "fields")
    if not events.groupBy("event_id").count().filter("count > 1").isEmpty():
        check.violations.append("event ids repeat")
    check.violations += [f"no value for ${name}" for name in contract.get("input_bindings", ()) if name not in check.bound]
    named = [(F.col("component") == r["component"]) & (F.col("event") == r["event"]) for r in contract["events"]]
    named += [(F.col("component") == r["component"]) & (F.col("event") == r["event"] if r.get("event") else F.lit(True)) for r in contract["forbidden"]]
    named += [F.col("event").isin([f"rpc_{p}" for p in POINTS]) & F.col("component").isin([c for c in (r.get(f"{end}_component") or r[end] for end in ("client", "server"))]) for r in contract["rpcs"]]
    trace = materialize(events.filter(reduce(or_, named, F.lit(False))), "contract")
    record = F.struct(*ORDER, F.map_entries("fields").alias("entries"))

    for rule in contract["events"]:
        expected = rule.get("fields", {})
        kind = (F.col("component") == rule["component"]) & (F.col("event") == rule["event"])
        got = trace.filter(kind & _all(_fields(expected, check.bound, True))).agg(F.min(record).alias("first"), F.count("*").alias("n")).first()
        n = got["n"]
        if got["first"] is not None:
            first = {c: got["first"][c] for c in ORDER} | {"fields": {e["key"]: e["value"] for e in got["first"]["entries"]}}
            check.events[rule["key"]] = first
            fresh = {p[1:]: first["fields"][f] for f, p in expected.items() if p.startswith("$") and p[1:] not in check.bound}
            check.bound |= fresh
            if fresh and n > 1:
                n = trace.filter(kind & _all(_fields(expected, check.bound, False))).count()
        check.counts[rule["key"]] = n
        least, most = rule.get("min_count", 1), rule.get("max_count")
        if n < least:
            check.violations.append(f"event {rule['key']} ({rule['component']}.{rule['event']}): {n} of at least {least}")
        if most is not None and n > most:
            check.violations.append(f"event {rule['key']} ({rule['component']}.{rule['event']}): {n} of at most {most}")

    links = events.filter("cause_event_id is not null").select(F.col("event_id").alias("src"), F.col("cause_event_id").alias("dst"))
    rules, selected, used = {r["key"]: r for r in contract["events"]}, {}, []
    for rule in contract["rpcs"]:
        anchors = {}
        for key in (rule.get("reply_event"), rule.get("server_event")):
            if key:
                # An observation that a call has taken stays the one that later rules mean.
                own = [F.col("event_id") == selected[key]] if key in selected else _fields(rules[key].get("fields", {}), check.bound, False)
                anchors[key] = trace.filter((F.col("component") == rules[key]["component"]) & (F.col("event") == rules[key]["event"]) & _all(own))
        call = _find_call(trace, links, rule, anchors, check.events, used)
        if call is None:
            check.violations.append(f"call {rule['key']}: no {'round trip' if rule.get('round_trip') else 'request'} {rule['client']} -> {rule['server']}: {rule['handler']}")
            continue
        used.append(call[POINTS[0]]["event_id"])
        check.calls[rule["key"]] = call
        for end in ("reply_event", "server_event"):
            if end in call:
                key, at = rule[end], call[end]
                selected[key] = at["event_id"]
                entries = trace.filter(F.col("event_id") == at["event_id"]).select(F.map_entries("fields").alias("e")).first()["e"]
                check.events[key] = at | {"fields": {e["key"]: e["value"] for e in entries or ()}}

    points = [(o, check.point(o["before"]), check.point(o["after"])) for o in contract["orders"]]
    points = [(o, a, b) for o, a, b in points if a is not None and b is not None]
    if points:
        spark = events.sparkSession
        seeds = spark.createDataFrame(sorted({(a["event_id"], a["process_id"], a["process_sequence"]) for _, a, _ in points}), "seed string, process_id string, process_sequence bigint")
        ends = spark.createDataFrame(sorted({(b["process_id"],) for _, _, b in points}), "process_id string")
        found = causal_reach(events, seeds).join(F.broadcast(ends), "process_id", "left_semi").collect()
        reach = {(r["seed"], r["process_id"]): r["first_sequence"] for r in found}
        for o, a, b in points:
            if reach.get((a["event_id"], b["process_id"]), b["process_sequence"] + 1) > b["process_sequence"]:
                check.violations.append(f"order: {o['after']} isn't caused by {o['before']}")

    for rule in contract["forbidden"]:
        where = [F.col("component") == rule["component"], *_fields(rule.get("fields", {}), check.bound, False)]
        if rule.get("event"):
            where.append(F.col("event") == rule["event"])
        if rule.get("event_prefixes"):
            where.append(reduce(or_, (F.col("event").startswith(p) for p in rule["event_prefixes"])))
        seen = [r["event"] for r in trace.filter(_all(where)).select("event").distinct().orderBy("event").limit(3).collect()]
        if seen:
            check.violations.append(f"forbidden: {', '.join(f'{rule['component']}.{e}' for e in seen)}")
    return check
