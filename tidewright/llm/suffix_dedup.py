"""Removal of repeated byte strings across a corpus by external induced suffix sorting.

Which strings could repeat is found first, so that only those are sorted.  Each window of ``length`` bytes chooses its
anchor, the n-gram in it with the smallest hash; equal windows choose equal anchors at equal places.  A run of windows with
one anchor is a segment.  Segments whose anchor stands nowhere else can't repeat.  Segments that are equal as a whole (by
their BLAKE2b digests of 128 bits) repeat as a whole.  The texts of the other segments, one for each distinct content, go to
shards by their anchors, and each shard's suffixes are sorted by external induction with common-prefix values: a window
repeats when its suffix shares ``length`` bytes with a neighbour.  Every window belongs to one segment, so no place is
counted twice.  Anchors with many distinct segments are cut again by a second anchor, which equal windows share as well, and
so spread over shards; a shard of any size is sorted in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm._bytehash import mix, prefix, spans
from tidewright.llm._common import discard, give_back, materialize, slices, text_buffer, worker_cache
from tidewright.llm.suffix_sort import Store, repeated

LENGTH, GRAM = 400, 100
#: Bytes of segment text that a shard holds on average and that a task sorts on average, and a sorter's memory for arrays and queues.
SHARD_BYTES, TASK_BYTES, SORT_BYTES = 2 << 20, 32 << 20, 64 << 20
#: Anchors with more distinct segments than this are cut again, this many times at most.
MANY, RECUTS = 4096, 3
_LOW = 30
KEY = ["anchor", "content", "check", "windows"]
SEGMENT = "id bigint, key bigint, at bigint, windows int, anchor bigint, content bigint, check bigint"


def segments(data, offsets, length: int, gram: int, salt: int = 0):
    """Arrays (document, first window, number of windows, anchor hash, content digests) of the segments of texts."""
    import hashlib

    import numpy as np

    n, width = len(data), length - gram + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, np.zeros((0, 2), np.int64)
    sums = prefix(data)
    at = np.arange(n - gram + 1)
    grams = spans(sums, at, at + gram)
    if salt:
        grams = mix(grams ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    # Hash above, place below (later places smaller), so that the least value tells both; ties go to the last place.
    low = np.uint64((1 << _LOW) - 1)
    keys = (grams & ~low) | (low - at.astype(np.uint64))
    padded = np.full(-(-len(keys) // width) * width, ~np.uint64(0))
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    chosen = (low - (least & low)).astype(np.int64)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:windows]
    inside = np.arange(windows) + length <= offsets[1:][owner]
    valid = np.flatnonzero(inside)
    if not len(valid):
        return empty, empty, empty, empty, np.zeros((0, 2), np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (chosen[valid][1:] != chosen[valid][:-1]) | (owner[valid][1:] != owner[valid][:-1])
    first = valid[new]
    count = np.diff(np.append(np.flatnonzero(new), len(valid)))
    view = memoryview(data)
    digests = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)])
    document = owner[first]
    return document, first - offsets[document], count, grams[chosen[first]].view(np.int64), np.frombuffer(digests, np.int64).reshape(-1, 2)


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none", "suffixes")  # drops what other operators left in this worker
        for batch in slices(batches, "text", 1 << 20):
            document, at, count, anchor, content = segments(*text_buffer(batch.column("text")), length, gram)
            rows = pa.array(document)
            yield pa.record_batch(
                {
                    "id": batch.column("id").take(rows),
                    "key": batch.column("key").take(rows),
                    "at": pa.array(at),
                    "windows": pa.array(count.astype("int32")),
                    "anchor": pa.array(anchor),
                    "content": pa.array(content[:, 0]),
                    "check": pa.array(content[:, 1]),
                }
            )

    return run


_KINDS = {"anchor": pa.int64(), "content": pa.int64(), "check": pa.int64(), "windows": pa.int32()}
TEXTS = "anchor bigint, content bigint, check bigint, windows int, segment binary"


def _cut(length: int):
    """The texts of wanted segments: one row for each of a document's requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = {k: [] for k in (*KEY, "segment")}
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                data = text.as_buffer()
                for w in wanted:
                    for k in KEY:
                        out[k].append(w[k])
                    out["segment"].append(data[w["at"] : w["at"] + w["windows"] + length - 1].to_pybytes())
            yield pa.record_batch({k: pa.array(v, {**_KINDS, "segment": pa.binary()}[k]) for k, v in out.items()})

    return run


PART = "anchor bigint, content bigint, check bigint, windows int, part_at bigint, part_windows int, part_anchor bigint, part_content bigint, part_check bigint"


def _recut(length: int, gram: int, salt: int):
    """Segments cut again by anchors of another hash; the new anchor goes with the old one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, "segment", 1 << 20):
            row, at, count, anchor, content = segments(*text_buffer(batch.column("segment")), length, gram, salt)
            rows = pa.array(row)
            old = batch.column("anchor").to_numpy(zero_copy_only=False).astype(np.int64)[row].view(np.uint64)
            yield pa.record_batch(
                {k: batch.column(k).take(rows) for k in KEY}
                | {
                    "part_at": pa.array(at),
                    "part_windows": pa.array(count.astype("int32")),
                    "part_anchor": pa.array(mix(mix(old) ^ anchor.view(np.uint64)).view(np.int64)),
                    "part_content": pa.array(content[:, 0]),
                    "part_check": pa.array(content[:, 1]),
                }
            )

    return run


FOUND = "anchor bigint, content bigint, check bigint, windows int, runs array<int>"


def _runs(flags):
    """Starts and ends, by turns, of the runs of true values."""
    import numpy as np

    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge).tolist()


def _shards(length: int, sort_bytes: int):
    """Sort the suffixes of each shard's segments, shard after shard, and tell which windows repeat.

    A shard's text and keys are written to scratch files as they arrive, so a shard may be far larger than memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        worker_cache("none", "suffixes")
        store = current = text = keys = None

        def add(piece: pa.RecordBatch) -> None:
            # Characters: 0 ends the shard, 1 ends a segment, bytes follow.  A window never holds an end, so matches stay inside.
            data, offsets = text_buffer(piece.column("segment"))
            np.insert(data.astype(np.uint16) + np.uint16(2), offsets[1:], np.uint16(1)).tofile(text)
            columns = [piece.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in KEY]
            np.column_stack([*columns, np.diff(offsets)]).tofile(keys)

        def finish() -> Iterator[pa.RecordBatch]:
            np.zeros(1, np.uint16).tofile(text)
            text.close()
            keys.close()
            rows = store.read(keys.name, np.int64).reshape(-1, len(KEY) + 1)
            hit, at = repeated(store.read(text.name, np.uint16), length, store), 0
            for i in range(0, len(rows), 4096):
                part, found = np.array(rows[i : i + 4096]), []
                for windows, size in part[:, -2:].tolist():
                    found.append(_runs(hit[at : at + windows]))
                    at += size + 1
                yield pa.record_batch({k: pa.array(part[:, j], pa.int64()).cast(_KINDS[k]) for j, k in enumerate(KEY)} | {"runs": pa.array(found, pa.list_(pa.int32()))})

        try:
            for batch in batches:
                shards = batch.column("shard").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if shards[a] != current:
                        if store is not None:
                            yield from finish()
                            store.close()
                        store, current = Store(sort_bytes), shards[a]
                        text, keys = open(store.path(), "wb"), open(store.path(), "wb")  # noqa: SIM115
                    add(batch.slice(a, b - a))
            if store is not None:
                yield from finish()
        finally:
            if store is not None:
                text.close()
                keys.close()
                store.close()
            give_back()

    return run


def _remove(length: int):
    """Cut the union of a document's repeated windows out of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in slices(batches, "text"):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("found").to_pylist(), strict=True):
                data = memoryview(text.as_py() or b"")
                merged: list[list[int]] = []
                for a, b in sorted((x["at"] + s, x["at"] + e + length - 1) for x in found or () for s, e in zip(x["runs"][::2], x["runs"][1::2], strict=True)):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                digest, at, kept = hashlib.sha256(), 0, []
                for a, b in [*merged, [len(data), len(data)]]:
                    digest.update(data[at:a])
                    kept.append(bytes(data[at:a]))
                    at = b
                out["n_bytes"].append(len(data))
                out["n_removed"].append(sum(b - a for a, b in merged))
                out["n_spans"].append(len(merged))
                out["kept_sha256"].append(digest.hexdigest())
                out["kept"].append(b"".join(kept))
                out["spans"].append([x for m in merged for x in m])
            kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.int64())}
            yield pa.record_batch({"id": batch.column("id")} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def _skewless(rows: DataFrame, small: DataFrame, on: list[str], weight: str, limit) -> DataFrame:
    """``rows`` joined to ``small`` (unique keys): keys of more weight than ``limit`` by broadcast, the others by shuffle."""
    heavy = F.broadcast(small.filter(F.col(weight) > limit))
    light = small.filter(F.col(weight) <= limit)
    columns = [*rows.columns, *(c for c in small.columns if c not in on)]
    apart = rows.join(heavy.select(*on), on, "left_anti")
    return rows.join(heavy, on).select(*columns).union(apart.join(light, on).select(*columns))


def _contents(found: DataFrame) -> DataFrame:
    """The distinct contents of segments whose anchor occurs more than once: KEY, copies, a place, distinct_contents."""
    # Partial aggregation leaves one row of a content for each task, so groups of copies don't pile up.
    contents = found.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min(F.struct("id", "key", "at")).alias("place"))
    contents = materialize(contents, "contents")
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("distinct_contents"), F.sum("copies").alias("occurrences")).filter("occurrences > 1")
    anchors = materialize(anchors, "anchors")
    bound = F.greatest(F.lit(1000.0), F.lit(contents.count() * 0.001))
    live = materialize(_skewless(contents, anchors, ["anchor"], "distinct_contents", bound), "live")
    discard(contents, anchors)
    return live


def _texts(base: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """KEY and the bytes of each content, cut out of the document of its place."""
    wanted = F.struct(*KEY, F.col("place.at").alias("at"))
    wanted = contents.groupBy(F.col("place.key").alias("key"), F.col("place.id").alias("id")).agg(F.collect_list(wanted).alias("wanted"))
    same = (F.col("d.key") == F.col("w.key")) & F.col("d.id").eqNullSafe(F.col("w.id"))
    texts = base.alias("d").join(wanted.alias("w"), same).select("d.text", "w.wanted")
    return materialize(texts.mapInArrow(_cut(length), TEXTS).dropDuplicates(KEY), "texts")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), spans.

    A byte is removed when a ``length``-byte string that covers it also starts anywhere else in the corpus.  Defined cases: a
    null text is empty; texts below ``length`` bytes keep everything; an empty table gives an empty result; repeated rows
    repeat each other and lose what is long enough; null ids take part; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("key"), F.encode(text, "UTF-8").alias("text"))
    found = materialize(base.filter(F.octet_length("text") >= length).mapInArrow(_segments(length, gram), SEGMENT), "segments")
    # Occurrences and contents by rounds of cutting.  Those of anchors that are cut again stay where they are: nothing will
    # be found under their old anchors.
    cuts, lives = [found], []
    for salt in range(1, RECUTS + 2):
        live = _contents(found)
        many = live.filter(F.col("distinct_contents") > MANY)
        if salt > RECUTS or many.isEmpty():
            lives.append(live)
            break
        lives.append(live.filter(F.col("distinct_contents") <= MANY))
        texts = _texts(base, many, length)
        parts = materialize(texts.mapInArrow(_recut(length, gram, salt), PART), "parts")
        limit = F.greatest(F.lit(1000.0), F.lit(found.count() * 0.001))
        marked = materialize(_skewless(found, many.select(*KEY, "copies"), KEY, "copies", limit).withColumn("hot", F.col("copies") > limit), "many")
        # Contents of many copies are few, so their parts are broadcast and no key is hot in the shuffle beside it.
        hot = F.broadcast(parts.join(F.broadcast(marked.filter("hot").select(*KEY).distinct()), KEY))
        rows = marked.filter("hot").join(hot, KEY).unionByName(marked.filter("not hot").join(parts, KEY))
        rows = rows.select("id", "key", (F.col("at") + F.col("part_at")).alias("at"), F.col("part_windows").alias("windows"), F.col("part_anchor").alias("anchor"), F.col("part_content").alias("content"), F.col("part_check").alias("check"))
        found = materialize(rows, "segments")
        cuts.append(found)
        discard(texts, parts, marked)
    live = reduce(DataFrame.unionByName, lives)

    texts = _texts(base, live.filter("distinct_contents > 1"), length)
    total = texts.agg(F.sum(F.length("segment"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    tasks = max(-(-total // TASK_BYTES), min(shards, 4 * spark.sparkContext.defaultParallelism))
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartition(tasks, "shard").sortWithinPartitions("shard")
    sorted_ = dealt.mapInArrow(_shards(length, SORT_BYTES), FOUND)
    sorted_ = materialize(sorted_.filter(F.size("runs") > 0), "runs")
    discard(texts)

    # Contents that occur more than once repeat as a whole; the others repeat where the sorting says.
    whole = live.filter("copies > 1").select(*KEY, "copies", F.array(F.lit(0), F.col("windows")).alias("runs"))
    some = live.filter("copies = 1").select(*KEY, "copies").join(sorted_, KEY)
    hits = materialize(whole.unionByName(some.select(*whole.columns)), "hits")
    rows = reduce(DataFrame.union, (_skewless(x, hits, KEY, "copies", F.greatest(F.lit(1000.0), F.lit(x.count() * 0.001))) for x in cuts))
    spans_ = rows.groupBy("key", "id").agg(F.collect_set(F.struct("at", "runs")).alias("found"))
    same = (F.col("d.key") == F.col("s.key")) & F.col("d.id").eqNullSafe(F.col("s.id"))
    out = base.alias("d").join(spans_.alias("s"), same, "left").select("d.id", "d.text", "s.found")
    removed = out.mapInArrow(_remove(length), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<bigint>")
    return removed.withColumnRenamed("id", id_col)
