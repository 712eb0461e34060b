"""Graph decisions by frontier iteration: reachability, lineage closure, cycles, cascading collection, cause chains.

Each round is a join of the frontier with the edges and an anti-join with what is known; rounds are written to the shared
checkpoint folder, so plans stay short and lost executors cost one round.  What is known is kept as runs that are merged
when they have grown alike, so a row is rewritten a logarithmic number of times and not once a round.  A bound on rounds is
an error when it is reached: no incomplete result comes back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.sources.shared import materialize


class Runs:
    """Written tables of one schema, of growing sizes, that together are what is known."""

    def __init__(self):
        self.parts: list[tuple[int, DataFrame]] = []

    def add(self, rows: DataFrame, n: int) -> None:
        self.parts.append((n, rows))
        while len(self.parts) > 1 and self.parts[-2][0] <= 2 * self.parts[-1][0]:
            (m, older), (n, newer) = self.parts[-2:]
            self.parts[-2:] = [(m + n, materialize(older.union(newer), "run"))]

    def table(self) -> DataFrame:
        return reduce(DataFrame.union, [t for _, t in self.parts])


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): nodes other than by the empty path that each seed reaches along ``edges(src, dst)``; shortest depth.

    With ``max_depth`` a graph that goes deeper is an error.
    """
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    frontier = seeds.select(F.col("node").alias("seed"), "node").distinct()
    known, depth = Runs(), 0
    while True:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        if known.parts:
            step = step.join(known.table().select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = materialize(step.withColumn("depth", F.lit(depth).cast("bigint")), "frontier")
        n = frontier.count()
        if not n:
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"paths of more than {max_depth} steps")
        known.add(frontier, n)
    return known.table() if known.parts else frontier


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chain nodes (one way in, one way out): (node, up, down), the nodes that end their chains, and (node, ring) of pure rings.

    Ends are found by pointer jumping, so rounds grow with the logarithm of the longest chain.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ways"), F.first("dst").alias("down"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ways"), F.first("src").alias("up"))
    inner = out.filter("ways = 1").drop("ways").join(into.filter("ways = 1").drop("ways"), "node").filter("up <> node")
    # least: the smallest node seen on the way; in a pure ring it becomes the ring's name.
    here = materialize(inner.select("node", "up", "down", F.col("node").alias("least")), "chains")
    before = -1
    while True:
        ahead = here.select(F.col("node").alias("d"), F.col("down").alias("dd"), F.col("least").alias("dl"))
        behind = here.select(F.col("node").alias("u"), F.col("up").alias("uu"))
        moved = here.join(ahead, here["down"] == F.col("d"), "left").join(behind, here["up"] == F.col("u"), "left")
        least = F.least("least", F.coalesce("dl", "least"))
        moved = moved.select("node", F.coalesce("uu", "up").alias("up"), F.coalesce("dd", "down").alias("down"), least.alias("least"), F.col("dd").isNotNull().alias("on"), (least < F.col("least")).alias("changed"))
        moved = materialize(moved, "chains")
        seen = moved.agg(F.count_if("on").alias("on"), F.count_if("changed").alias("changed")).first()
        here = moved.select("node", "up", "down", "least")
        # Jumps double, so while a chain is longer some node of it comes to its end, and while a ring is, some node of it
        # hears of a smaller one: when neither happens, all chains have ended and all rings know their smallest node.
        if not seen["on"] or (seen["on"] == before and not seen["changed"]):
            break
        before = seen["on"]
    # What still points at a chain node goes round a pure ring.
    names = here.select(F.col("node").alias("down"))
    rings = here.join(names, "down", "left_semi").select("node", F.col("least").alias("ring"))
    return here.join(rings, "node", "left_anti").select("node", "up", "down"), rings


def _peel(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have a way in and a way out, to the last."""
    n = edges.count()
    while n:
        inner = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        inner = materialize(inner.select("src", "dst"), "live")
        m = inner.count()
        if m == n:
            break
        edges, n = inner, m
    return edges


def _one_each(rows: DataFrame) -> DataFrame:
    """One component for each node; a component of another's name goes before a node's own loop."""
    best = rows.groupBy("node").agg(F.max(F.struct((F.col("component") != F.col("node")).alias("other"), "component")).alias("c"))
    return materialize(best.select("node", F.col("c.component").alias("component")), "components")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a directed cycle, self-loops included; a component is named by one of its nodes.

    Chains are replaced by one edge and dead ends peeled off, by turns, until neither changes anything; what is left is split
    by colours: every node takes the largest node that reaches it, and what reaches that node back within its colour is one
    component.  Then chains get the component of their ends where those agree.
    """
    live = materialize(edges.select("src", "dst").distinct(), "live")
    loops = live.filter("src = dst").select(F.col("src").alias("node"))
    levels, found = [], []
    while not live.isEmpty():
        chains, rings = _chains(live)
        chains, rings = materialize(chains, "chains"), materialize(rings, "rings")
        found.append(rings.select("node", F.col("ring").alias("component")))
        inner = chains.select("node").union(rings.select("node"))
        kept = live.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        bridged = chains.select(F.col("up").alias("src"), F.col("down").alias("dst"))
        after = _peel(materialize(kept.union(bridged).distinct(), "live"))
        levels.append(chains)
        # Loops at one node are cycles of their own; without them a node may become part of a chain.
        round_ = after.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
        found.append(materialize(round_, "loops"))
        after = materialize(after.filter("src <> dst"), "live")
        done = inner.isEmpty() and after.count() == live.count()
        live = after
        if done:
            break
    while not live.isEmpty():
        nodes = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = materialize(nodes.select("node", F.col("node").alias("colour")), "colours")
        while True:
            sent = live.join(colours, live["src"] == colours["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("got"))
            new = materialize(colours.join(sent, "node", "left").select("node", F.greatest("colour", F.coalesce("got", "colour")).alias("colour"), (F.col("got") > F.col("colour")).alias("changed")), "colours")
            changed = not new.filter("changed").isEmpty()
            colours = new.select("node", "colour")
            if not changed:
                break
        a, b = colours.select(F.col("node").alias("src"), F.col("colour").alias("ca")), colours.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
        within = materialize(live.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst", F.col("ca").alias("colour")), "within")
        frontier = materialize(colours.filter("node = colour").select("node", F.col("colour").alias("component")), "frontier")
        members = Runs()
        while n := frontier.count():
            members.add(frontier, n)
            back = within.join(frontier, within["dst"] == frontier["node"]).select(within["src"].alias("node"), "component").distinct()
            frontier = materialize(back.join(members.table().select("node"), "node", "left_anti"), "frontier")
        members = members.table()
        found.append(members)
        live = live.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        live = _peel(materialize(live.select("src", "dst"), "live"))
    empty = loops.select("node", F.col("node").alias("component")).limit(0)
    named = _one_each(reduce(DataFrame.union, [x.select("node", "component") for x in found], empty))
    for chains in reversed(levels):
        up, down = named.select(F.col("node").alias("up"), F.col("component").alias("cu")), named.select(F.col("node").alias("down"), F.col("component").alias("cd"))
        inside = chains.join(up, "up").join(down, "down").filter("cu = cd").select("node", F.col("cu").alias("component"))
        named = _one_each(named.union(inside))
    size = named.groupBy("component").agg(F.count("*").alias("n"))
    loops = loops.withColumn("loop", F.lit(True)).distinct()
    # A core node that no other joined is on a cycle only by a loop, its own or one made of a chain (then the chain joined it).
    return named.join(size, "component").join(loops, "node", "left").filter("n > 1 or loop").select("node", "component")


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle, self-loops included."""
    return strong_components(edges).select("node").distinct()


def admits(edges: DataFrame, candidate: DataFrame) -> bool:
    """Whether adding the candidate's edges keeps the active graph free of cycles."""
    return cycle_members(edges.select("src", "dst").union(candidate.select("src", "dst"))).isEmpty()


def gc_cascade(dead: DataFrame, held: DataFrame, edges: DataFrame) -> DataFrame:
    """(object, round): collecting an object frees what only it held, until nothing more is freed.

    ``dead(object)`` are objects without tokens, ``held(object)`` objects that something else keeps, ``edges(src, dst)`` who
    holds whom.  An object is collected when it is dead, not kept, and every holder of it has been collected.  Holders are
    counted once; a round only looks at what its frontier held, and at the counts of that.
    """
    candidates = materialize(dead.select("object").distinct().join(held.select("object"), "object", "left_anti"), "candidates")
    live = materialize(edges.select(F.col("src").alias("object"), "dst").distinct(), "holders")
    holders = materialize(candidates.join(live.groupBy(F.col("dst").alias("object")).agg(F.count("*").alias("holders")), "object", "left"), "counts")
    free = materialize(holders.filter("holders is null").select("object", F.lit(1).cast("bigint").alias("round")), "free")
    gone, freed, number = Runs(), Runs(), 1
    while n := free.count():
        gone.add(free, n)
        number += 1
        touched = materialize(free.join(live, "object").groupBy(F.col("dst").alias("object")).agg(F.count("*").alias("n")), "touched")
        freed.add(touched, touched.count())
        past = freed.table().join(touched.select("object"), "object", "left_semi").groupBy("object").agg(F.sum("n").alias("n"))
        free = materialize(holders.join(past, "object").filter("n = holders").select("object", F.lit(number).cast("bigint").alias("round")), "free")
    return gone.table() if gone.parts else free


def causal_reach(events: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(seed, process_id, first_sequence): the earliest record of each process that a seed reaches by causes and process order.

    Everything later in a process is reached as well, so a process needs one number instead of its records, and rounds count
    hops between processes only.  ``seeds`` has (seed, process_id, process_sequence); the seed itself isn't reached by it.
    """
    records = events.select("event_id", "process_id", "process_sequence")
    causes = events.filter("cause_event_id is not null").select(F.col("cause_event_id"), F.col("process_id").alias("to_process"), F.col("process_sequence").alias("to_sequence"))
    hops = materialize(causes.join(records.withColumnRenamed("event_id", "cause_event_id"), "cause_event_id").select("process_id", "process_sequence", "to_process", "to_sequence"), "hops")
    own = seeds.select("seed", "process_id", (F.col("process_sequence") + 1).alias("first_sequence"))
    own = own.join(records.groupBy("process_id").agg(F.max("process_sequence").alias("last")), "process_id").filter("first_sequence <= last").select("seed", "process_id", "first_sequence")
    direct = seeds.join(hops, ["process_id", "process_sequence"]).select("seed", F.col("to_process").alias("process_id"), F.col("to_sequence").alias("first_sequence"))
    known = materialize(own.union(direct).groupBy("seed", "process_id").agg(F.min("first_sequence").alias("first_sequence")), "reach")
    frontier, rounds = known, 0
    while True:
        step = frontier.join(hops, "process_id").filter("process_sequence >= first_sequence").groupBy("seed", F.col("to_process").alias("process_id")).agg(F.min("to_sequence").alias("next"))
        step = step.join(known, ["seed", "process_id"], "left").filter("first_sequence is null or next < first_sequence")
        frontier = materialize(step.select("seed", "process_id", F.col("next").alias("first_sequence")), "frontier")
        if frontier.isEmpty():
            break
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"causes of more than {max_rounds} hops between processes")
        known = materialize(known.union(frontier).groupBy("seed", "process_id").agg(F.min("first_sequence").alias("first_sequence")), "reach")
    return known


def cause_chains(events: DataFrame, starts: DataFrame) -> DataFrame:
    """(seed, node, depth): the chain of explicit causes behind each record of ``starts(node)``."""
    links = events.filter("cause_event_id is not null").select(F.col("event_id").alias("src"), F.col("cause_event_id").alias("dst"))
    return reachable(links, starts)


def preflight(lineage: DataFrame, deps: DataFrame, targets: DataFrame) -> DataFrame:
    """(object, depth, action): what rebuilding ``targets(node)`` needs, dependencies deeper than what needs them.

    ``lineage`` has (object, state, retries_left), ``deps`` (src, dst): an object's producer needs dst.  Ready objects end the
    search; a pending one must be under recovery; a lost one needs budget.  Objects on a cycle are rejected.
    """
    lost = lineage.filter("state <> 'READY'").select(F.col("object").alias("src"))
    walk = deps.join(lost, "src", "left_semi").select("src", "dst")
    levels = targets.select("node", F.lit(0).cast("bigint").alias("depth")).union(reachable(walk, targets).select("node", "depth"))
    levels = levels.groupBy("node").agg(F.max("depth").alias("depth"))
    rings = cycle_members(walk).withColumn("ring", F.lit(True))
    joined = levels.join(lineage, levels["node"] == lineage["object"]).join(rings, "node", "left")
    action = (
        F.when(F.col("state") == "READY", "SKIP")
        .when(F.col("ring"), "REJECT_CYCLE")
        .when((F.col("state") == "PENDING") & ~F.col("recovering"), "REJECT_PENDING")
        .when(F.col("state") == "PENDING", "JOIN")
        .when(F.col("retries_left") > 0, "REBUILD")
        .otherwise("REJECT_BUDGET")
    )
    return joined.select("object", "depth", action.alias("action"))
