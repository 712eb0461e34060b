"""MinHash near-deduplication with sequential Bayesian verification.

1. Each text becomes its set of hashed five-word shingles, a MinHash signature and the keys of its bands.  Texts with the
   same set form one class; only classes go on, so groups of copies cost one row.
2. In each band bucket every class is compared with the bucket's first class (a star, not all pairs).
3. Candidates are compared batch of signature values by batch: as soon as the posterior probability that their similarity
   reaches the threshold falls to the miss probability, they are pruned.  Survivors are checked on their full shingle sets.
4. Buckets whose classes are then still in several components get the pairs between different components, in cells of
   bounded size.  Exact distances from the bucket's first class rule out most of them (Jaccard distance is a metric), and
   the same pruning most of the others.  So no link is lost to the star, and a bucket of one component costs nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm._bytehash import mix, set_digest, shingles
from tidewright.llm._common import discard, give_back, materialize, neutral, slices, text_buffer, worker_cache
from tidewright.llm.components import connected_components

BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
BATCH = 16
#: Members of a bucket that are compared in one row; larger buckets are compared in cells of two groups of members.
BLOCK = 256
#: Members and bytes of shingle sets that a group holds on average.
GROUP_ROWS, GROUP_BYTES = 6144, 24 << 20
#: Probability at which a pair that reaches the threshold is given up, over all looks at it.
MISS = 1e-6


def least_matches(similarity: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """(n, m): after n signature values, fewer than m matches prune a pair.

    With a uniform prior the similarity given m matches of n is Beta(m + 1, n - m + 1), and the probability that it reaches
    ``similarity`` is the lower tail of Binomial(n + 1, similarity) up to m.  Each look has an equal part of ``miss``.
    """
    out = []
    miss /= hashes // batch
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail > miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def _permutations():
    import numpy as np

    cache = worker_cache("permutations", "near_dedup")
    if "ab" not in cache:
        seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
        cache["ab"] = (seeds[:HASHES] >> np.uint64(32)).astype(np.uint32), (seeds[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return cache["ab"]


def signatures(values, bounds):
    """MinHash signatures (one row of uint32 for each set); empty sets have zeros."""
    import numpy as np

    xor, odd = _permutations()
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, HASHES), np.uint32)
    if len(full):
        high = (values >> np.uint64(32)).astype(np.uint32)
        scratch = np.empty_like(high)
        for j in range(HASHES):
            np.bitwise_xor(high, xor[j], out=scratch)
            scratch *= odd[j]
            out[full, j] = np.minimum.reduceat(scratch, bounds[full])
    return out


def band_keys(sigs):
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    import numpy as np

    out = np.zeros((len(sigs), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sigs), b + 1, np.uint64)
        for j in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
            h = mix(h ^ sigs[:, j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[:, b] = h
    return out.view(np.int64)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            values, bounds = shingles(data, offsets, k)
            digest, sigs = set_digest(values, bounds), signatures(values, bounds)
            keys = band_keys(sigs)
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "n_shingles": pa.array(np.diff(bounds).astype(np.int64)),
                    "node": pa.array([x.tobytes() for x in digest], pa.binary()),
                    "sig": pa.array([x.tobytes() for x in sigs], pa.binary()),
                    "bands": pa.ListArray.from_arrays(np.arange(0, (len(sigs) + 1) * BANDS, BANDS, dtype=np.int32), keys.ravel()),
                }
            )
        give_back()

    return run


def _sets(k: int):
    """Full shingle sets of texts whose class is still ``node`` (ids may repeat with other texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            values, bounds = shingles(data, offsets, k)
            digest = [x.tobytes() for x in set_digest(values, bounds)]
            nodes = batch.column("node").to_pylist()
            good = [i for i, n in enumerate(nodes) if n == digest[i]]
            yield pa.record_batch({"node": pa.array([nodes[i] for i in good], pa.binary()), "members": pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in good], pa.binary())})
        give_back()

    return run


def _prune(similarity: float, miss: float):
    """Sequential Bayesian pruning of pairs (u, v, su, sv); survivors carry their share of equal signature values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        steps = least_matches(similarity, miss)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(n, HASHES) for c in ("su", "sv"))
            alive, matches, done = np.arange(n), np.zeros(n, np.int64), 0
            for upto, least in steps:
                matches[alive] += (a[alive, done:upto] == b[alive, done:upto]).sum(1)
                alive, done = alive[matches[alive] >= least], upto
            yield pa.record_batch({"u": batch.column("u").take(pa.array(alive)), "v": batch.column("v").take(pa.array(alive)), "matches": pa.array(matches[alive])})
        give_back()

    return run


class Group:
    """Members of a bucket as arrays: names, signatures, distances from the bucket's leader, numbers of roots, sets."""

    def __init__(self, rows: list[dict], number: dict[bytes, int]):
        import numpy as np

        self.nodes, self.names = [x["node"] for x in rows], [x["root"] for x in rows]
        self.sig = np.frombuffer(b"".join(x["sig"] for x in rows), np.uint32).reshape(-1, HASHES)
        self.distance = np.array([x["distance"] for x in rows])
        self.root = np.array([number.setdefault(x["root"], len(number)) for x in rows], np.int64)
        self.sets = [np.frombuffer(x["members"], np.uint64) for x in rows] if rows and "members" in rows[0] else None


def _candidates(a: Group, b: Group, place: int, similarity: float, steps):
    """Pairs (i, j) of two groups of a bucket that could be linked and are this bucket's to test, strip by strip, likeliest
    first.  Roots are looked at when a strip comes, so pairs that were connected meanwhile aren't given."""
    import numpy as np

    for first in range(0, len(a.root), 256):
        strip = slice(first, first + 256)
        sa, sb = a.sig[strip], b.sig
        differ = a.root[strip, None] != b.root[None, :]
        if a is b:
            differ &= np.arange(first, first + len(sa))[:, None] < np.arange(len(sb))[None, :]
        # Jaccard distance is a metric: what stands at unlike distances from the leader can't be near each other.
        differ &= np.abs(a.distance[strip, None] - b.distance[None, :]) <= 1 - similarity + 1e-9
        # Of the buckets that two classes share, the one of the first band tests them.
        for p in range(place):
            band = slice(p * BAND_ROWS, (p + 1) * BAND_ROWS)
            keys = [np.ascontiguousarray(x[:, band]).view([("", np.uint32)] * BAND_ROWS).ravel() for x in (sa, sb)]
            differ &= keys[0][:, None] != keys[1][None, :]
        i, j = np.nonzero(differ)
        matches, done = np.zeros(len(i), np.int64), 0
        for upto, least in steps:
            matches += (sa[i, done:upto] == sb[j, done:upto]).sum(1)
            keep = matches >= least
            i, j, matches, done = i[keep], j[keep], matches[keep], upto
        order = np.argsort(-matches, kind="stable")
        yield i[order] + first, j[order], matches[order]


def _blocks(similarity: float, miss: float):
    """Pairs of different components within a small bucket that survive the pruning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = least_matches(similarity, miss)
        for batch in batches:
            for row in batch.to_pylist():
                group = Group(row["block"], {})
                for i, j, matches in _candidates(group, group, row["place"], similarity, steps):
                    if len(i):
                        ends = [([c[x] for x in i], [c[x] for x in j]) for c in (group.nodes, group.names)]
                        yield pa.record_batch({"u": pa.array(ends[0][0], pa.binary()), "v": pa.array(ends[0][1], pa.binary()), "matches": pa.array(matches), "ru": pa.array(ends[1][0], pa.binary()), "rv": pa.array(ends[1][1], pa.binary())})
        give_back()

    return run


#: Bytes of the bit maps that a comparison of sets holds at once, and pairs that are compared at once.
MAP_BYTES, AT_ONCE = 32 << 20, 4096


class Overlaps:
    """Exact sizes of intersections between the sets of two groups, by bit maps over the values that sets share."""

    def __init__(self, groups: list[Group]):
        import numpy as np

        sets = [x for g in groups for x in g.sets]
        self.start = {id(g): sum(len(h.sets) for h in groups[:i]) for i, g in enumerate(groups)}
        self.sizes = np.array([len(x) for x in sets], np.int64)
        values = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(values)
        values = values[order]
        new = np.append(True, values[1:] != values[:-1])[: len(values)]
        del values
        # What only one set has is in no intersection: columns are the values that come again.
        again = ~(new & np.append(new[1:], True)[: len(new)])
        ends = np.cumsum(self.sizes)
        order = order[again]
        row = np.searchsorted(ends, order, "right").astype(np.int32)
        del order
        column = (np.cumsum(new[again]) - 1).astype(np.int64)
        width = int(column[-1]) + 1 if len(column) else 0
        step = max(64, MAP_BYTES // max(1, len(sets)) * 8 // 64 * 64)
        self.maps = []
        for low in range(0, width, step):
            inside = (column >= low) & (column < low + step)
            flags = np.zeros((len(sets), -(-min(step, width - low) // 64) * 8), np.uint8)
            at = column[inside] - low
            np.bitwise_or.at(flags, (row[inside], at >> 3), (1 << (at & 7)).astype(np.uint8))
            self.maps.append(flags.view(np.uint64))

    def common(self, a: Group, b: Group, i, j):
        import numpy as np

        x, y = i + self.start[id(a)], j + self.start[id(b)]
        out = np.zeros(len(x), np.int64)
        for flags in self.maps:
            for k in range(0, len(x), AT_ONCE):
                part = slice(k, k + AT_ONCE)
                out[part] += np.bitwise_count(flags[x[part]] & flags[y[part]]).sum(1, dtype=np.int64)
        return out, self.sizes[x] + self.sizes[y]


def _cells(similarity: float, miss: float):
    """Exact links within the cells of large buckets, one or two groups each, rows sorted by cell: pairs are compared in place,
    strip by strip, and none whose ends are connected by then."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        steps = least_matches(similarity, miss)

        def links(rows: list[dict]) -> pa.RecordBatch | None:
            number: dict[bytes, int] = {}
            x, y = rows[0]["x"], rows[0]["y"]
            groups = [Group([r for r in rows if r["member_group"] == g], number) for g in sorted({x, y})]
            a, b = groups[0], groups[-1]
            overlaps, found = None, ([], [])
            for i, j, _ in _candidates(a, b, rows[0]["place"], similarity, steps):
                if not len(i):
                    continue
                overlaps = overlaps or Overlaps(groups)
                common, both = overlaps.common(a, b, i, j)
                good = 100 * common >= percent * (both - common)
                for p, q in zip(i[good].tolist(), j[good].tolist(), strict=True):
                    u, v = a.root[p], b.root[q]
                    if u != v:
                        for g in groups:
                            g.root[g.root == max(u, v)] = min(u, v)
                        found[0].append(a.nodes[p])
                        found[1].append(b.nodes[q])
            return pa.record_batch({"u": pa.array(found[0], pa.binary()), "v": pa.array(found[1], pa.binary())}) if found[0] else None

        cell, rows = None, []
        for batch in batches:
            for piece in slices([batch], "members", 4 << 20):
                for row in piece.to_pylist():
                    key = (row["band"], row["x"], row["y"])
                    if key != cell:
                        if rows and (got := links(rows)) is not None:
                            yield got
                        cell, rows = key, []
                    rows.append(row)
        if rows and (got := links(rows)) is not None:
            yield got
        del rows
        give_back()

    return run


def _compare(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Exact sizes of intersection and union for the pairs (u, v) of a block, given the full sets of its nodes."""
    import numpy as np

    members = {n: np.frombuffer(m.as_buffer(), np.uint64) for n, m in zip(sets["node"].to_pylist(), sets["members"], strict=True)}
    common, union = [], []
    for u, v in zip(pairs["u"].to_pylist(), pairs["v"].to_pylist(), strict=True):
        both = np.concatenate([members[u], members[v]])
        both.sort()
        common.append(int((both[1:] == both[:-1]).sum()))
        union.append(len(both) - common[-1])
    return pa.table({"u": pairs["u"].cast(pa.binary()), "v": pairs["v"].cast(pa.binary()), "common": pa.array(common, pa.int64()), "union": pa.array(union, pa.int64())})


#: Pairs that a block of the exact comparison holds on average.
GRID_PAIRS = 1000
PAIR = "u binary, v binary, matches bigint"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.75, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept, node (the class of equal sets).

    Defined cases: a null or blank text has no shingles and is linked with nothing (its component is its own id); an empty
    table gives an empty result; repeated rows share a class; a null id takes part but never names a component that has
    another id; other columns are ignored.  A pair of the threshold's similarity is lost with a probability of about 5e-6 (32
    bands of 4) plus ``miss``; no link is reported that the full sets of 64-bit shingle hashes don't confirm.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(base.mapInArrow(_sign(k), "id bigint, n_shingles bigint, node binary, sig binary, bands array<bigint>"), "signatures")
    classes = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("n_shingles").cast("int").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    members = classes.select(F.posexplode("bands").alias("place", "band"), "node", "size")
    leaders = members.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    sides = materialize(members.join(leaders, "band").select("band", "place", "leader", "node", "size", "n"), "buckets")
    sigs = classes.select("node", "sig")

    def pruned(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u").join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")
        return materialize(full.select("u", "v", "su", "sv").mapInArrow(_prune(similarity, miss), PAIR), name)

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        nodes = pairs.select(F.col("u").alias("node")).distinct().union(pairs.select(F.col("v").alias("node")).distinct()).distinct()
        wanted = nodes.join(classes.select("node", "rep"), "node")
        texts = base.join(wanted, F.col("id").eqNullSafe(F.col("rep"))).select("node", "text")
        sets = materialize(texts.mapInArrow(_sets(k), "node binary, members binary").dropDuplicates(["node"]), name + "-sets")
        # A grid of blocks over both ends: a block gets the set of each of its nodes once, however many pairs share it.
        side = max(1, math.isqrt(-(-pairs.count() // GRID_PAIRS)))
        grid = pairs.select("u", "v", (F.pmod(F.xxhash64("u"), F.lit(side)) * side + F.pmod(F.xxhash64("v"), F.lit(side))).alias("cell"))
        ends = [grid.select(F.col("cell").alias("part"), F.col(c).alias("node")).distinct() for c in ("u", "v")]
        full = ends[0].union(ends[1]).distinct().join(sets, "node").select("part", "node", "members")
        found = grid.groupBy("cell").cogroup(full.groupBy("part")).applyInArrow(_compare, "u binary, v binary, common bigint, union bigint")
        found = materialize(found, name)
        discard(sets)
        return found

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        return compared(pairs, name).filter(F.col("common") * 100 >= F.col("union") * round(similarity * 100)).select("u", "v")

    def crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        r = pairs.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
        return r.filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v", "matches")

    stars = pruned(sides.filter("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), "stars")
    best = stars.groupBy("v").agg(F.max_by("u", "matches").alias("u"), F.max("matches").alias("matches")).select("u", "v", "matches")
    links = verified(materialize(best, "best"), "links-1")
    roots = connected_components(links)
    more = materialize(crossing(stars.join(best.select("u", "v"), ["u", "v"], "left_anti"), roots), "more")
    if not more.isEmpty():
        links = links.union(verified(more, "links-2"))
        roots = connected_components(links)

    rooted = sides.filter("n > 2").join(roots, "node", "left").select("band", "place", "leader", "node", "size", F.coalesce("root", "node").alias("root"))
    open_bands = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).filter("a <> b").select("band", "n")
    rooted = materialize(rooted.join(open_bands, "band"), "open")
    if not rooted.isEmpty():
        stand = compared(rooted.filter("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), "stand")
        stand = stand.select(F.col("u").alias("leader"), F.col("v").alias("node"), (1 - F.col("common") / F.col("union")).alias("distance"))
        spread = rooted.join(stand, ["leader", "node"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))

        # Large buckets are tested in place on full sets, and no row is made for a pair.  Members are dealt to groups by a
        # hash, as many as their number and the bytes of their sets ask for, and a cell is two groups: so a bucket's work is
        # dealt by cell, whatever its size, and a member is sent once for each group, not for each partner.
        large = spread.filter(F.col("n") > BLOCK)
        wanted = rooted.filter(F.col("n") > BLOCK).select("node").distinct().join(classes.select("node", "rep", "sig"), "node")
        texts = base.join(wanted.select("node", "rep"), F.col("id").eqNullSafe(F.col("rep"))).select("node", "text")
        sets = texts.mapInArrow(_sets(k), "node binary, members binary").dropDuplicates(["node"])
        sets = materialize(sets.join(wanted.select("node", "sig"), "node"), "large-sets")
        load = rooted.filter(F.col("n") > BLOCK).groupBy("band").agg(F.sum(8 * F.col("size").cast("bigint")).alias("bytes"))
        groups = F.greatest(F.ceil(F.col("n") / GROUP_ROWS), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int")
        dealt = large.join(load, "band").withColumn("groups", groups).withColumn("member_group", F.pmod(F.xxhash64("node", "band"), F.col("groups")).cast("int"))
        dealt = dealt.join(sets, "node").select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other"))
        dealt = dealt.select("band", F.least("member_group", "other").alias("x"), F.greatest("member_group", "other").alias("y"), "place", "member_group", "node", "root", "sig", "distance", "members")
        dealt = dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
        direct = materialize(dealt.mapInArrow(_cells(similarity, miss), "u binary, v binary").distinct(), "links-large")
        discard(sets)
        if not direct.isEmpty():
            links = links.union(direct)
            roots = connected_components(links)

        # Small buckets fit one row, and what their pairs leave is compared by the grid.
        member = F.struct("node", "root", "sig", "distance")
        pairs = spread.filter(F.col("n") <= BLOCK).join(sigs, "node").groupBy("band", "place").agg(F.collect_list(member).alias("block")).select("place", "block")
        ordered = [F.when(F.col("u") < F.col("v"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("u", "v"), ("v", "u"), ("ru", "rv"), ("rv", "ru"))]
        rest = materialize(pairs.mapInArrow(_blocks(similarity, miss), PAIR + ", ru binary, rv binary").select(*ordered, "matches").distinct(), "rest")
        # Two components need one link: the likeliest pair of each two comes first, and the others only where it fails.
        likeliest = rest.groupBy(F.least("ru", "rv").alias("a"), F.greatest("ru", "rv").alias("b")).agg(F.max_by(F.struct("u", "v"), F.struct("matches", "u", "v")).alias("p"), F.max("matches").alias("matches"))
        likeliest = materialize(likeliest.select("p.u", "p.v", "matches"), "likeliest")
        if not likeliest.isEmpty():
            links = links.union(verified(likeliest, "links-3"))
            roots = connected_components(links)
            last = materialize(crossing(rest.select("u", "v", "matches").join(likeliest.select("u", "v"), ["u", "v"], "left_anti"), roots), "last")
            if not last.isEmpty():
                links = links.union(verified(last, "links-4"))
                roots = connected_components(links)

    named = classes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(lowest, "root").select("node", "component_id"), "components")
    # Classes of many copies are few; they are joined by broadcast, so no key of the other join is hot.
    sizes = signed.filter("n_shingles > 0").groupBy("node").agg(F.count("*").alias("copies"))
    heavy = sizes.filter(F.col("copies") > F.greatest(F.lit(1000.0), F.lit(signed.count() * 0.001))).select("node", F.lit(True).alias("hot"))
    tagged = signed.select("id", "n_shingles", "node").join(F.broadcast(heavy), "node", "left")
    hot = tagged.filter("hot").join(F.broadcast(named.join(F.broadcast(heavy), "node").drop("hot")), "node")
    plain = tagged.filter("hot is null").join(named, "node", "left")
    out = hot.select("id", "n_shingles", "node", "component_id").union(plain.select("id", "n_shingles", "node", "component_id"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "node")


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one for each group of near-duplicates, in the columns of ``docs``.

    Texts without words are linked with nothing and stay.  Repeated rows of the id that stays stay once; where an id that
    stays is repeated with other texts, each of its texts stays once.
    """
    kept = near_duplicates(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("id"), "node").groupBy("id").agg(F.count("*").alias("n"))
    kept = materialize(kept, "kept")
    rows, names = neutral(docs)
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    out = rows.join(kept, key.cast("bigint").eqNullSafe(F.col("id")))
    if not kept.filter("n > 1").isEmpty():
        again = out.filter("n > 1").withColumn("own", F.sha2(F.coalesce(text, F.lit("")), 256)).dropDuplicates(["id", "own"])
        return out.filter("n = 1").select(*names).union(again.select(*names))
    return out.select(*names)
