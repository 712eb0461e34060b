"""Best-fit packing of tokenised documents by bin completion.

Documents are tokenised once, in parallel; documents longer than a sequence are cut into pieces.  What the packing needs is
only how many pieces have each length, a table of at most ``capacity`` rows whatever the corpus.  On that table the driver
runs bin completion: the fillings around the largest remaining piece that no other filling dominates are enumerated, the
search is bounded by the waste that an improvement on the incumbent may still have, and best-fit solutions are the
incumbents.  A filling is applied as often as its lengths allow, so a solution is a list of at most a few thousand patterns
with multiplicities.  Pieces then find their places by their rank among the pieces of their length, without a global sort.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm._common import give_back, materialize, slices, worker_cache

CAPACITY = 2048
#: Bytes of text that are encoded at once, entries of a worker's two caches (about 40 bytes each), and their longest key (bytes).
BATCH_BYTES, CACHE_ENTRIES, CACHE_LONGEST = 3 << 20, 250_000, 100
#: Words that go to the library in one call.
AT_ONCE = 8192
#: Separators that str.split() cuts at and the tokenizer doesn't.
ODD = "\x1c\x1d\x1e\x1f"
PIECES = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int"


def gather(starts, counts, slots, ids):
    """The ids of the entries ``slots``, end to end, and their bounds."""
    import numpy as np

    n = counts[slots]
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat(starts[slots] - ends[:-1], n) + np.arange(ends[-1])], ends


class Cache:
    """Ids of strings in flat arrays; strings that it lacks are asked of ``make``, those used once leave when it is full."""

    def __init__(self, make):
        import numpy as np

        self.make, self.keys = make, pa.array([], pa.large_string())
        self.starts, self.counts, self.used, self.ids = (np.zeros(0, np.int64) for _ in range(4))
        self.ids = np.zeros(0, np.uint32)

    def _keep(self, rows) -> None:
        import numpy as np

        self.ids, ends = gather(self.starts, self.counts, np.flatnonzero(rows), self.ids)
        self.keys, self.starts, self.counts, self.used = self.keys.filter(pa.array(rows)), ends[:-1], self.counts[rows], self.used[rows]

    def slots(self, strings: pa.Array):
        """Places of distinct strings; they hold until ``trim``."""
        import numpy as np

        at = pa.compute.index_in(strings, value_set=self.keys)
        missing = strings.filter(pa.compute.is_null(at))
        out = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[out[out >= 0]] += 1
        if len(missing):
            ids, ends = self.make(missing)
            out[out < 0] = len(self.keys) + np.arange(len(missing))
            self.starts = np.concatenate([self.starts, len(self.ids) + ends[:-1]])
            self.counts, self.used = np.concatenate([self.counts, np.diff(ends)]), np.concatenate([self.used, np.ones(len(missing), np.int64)])
            self.ids, self.keys = np.concatenate([self.ids, ids]), pa.concat_arrays([self.keys, missing])
        return out

    def trim(self) -> None:
        """Long strings serve their batch only; a full cache keeps what several batches used, half of its entries at most."""
        import numpy as np

        short = pa.compute.less_equal(pa.compute.binary_length(self.keys), CACHE_LONGEST).to_numpy(zero_copy_only=False)
        if len(self.keys) > CACHE_ENTRIES:
            often = np.partition(self.used, -CACHE_ENTRIES // 2)[-CACHE_ENTRIES // 2]
            short &= self.used > max(1, often)
        if not short.all():
            self._keep(short)


class Encoder:
    """Token ids of whole columns of texts, equal to the library's.

    The tokenizer drops white space, cuts the rest into words (runs of letters, digits, runs of marks), and nothing it does
    looks across a word.  So texts are cut into white-space units, of which Arrow finds the distinct ones of a batch; units
    that no cache has are cut into words, and words that no cache has are encoded, all in one call.
    """

    def __init__(self, path: str):
        import json

        import numpy as np
        import regex
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            config = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in config["added_tokens"]]
        suffix = config["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.last[i] = bool(suffix) and piece.endswith(suffix)
        splits = (config.get("pre_tokenizer") or {}).get("pretokenizers") or []
        pattern = next((x["pattern"]["Regex"] for x in splits if x["type"] == "Split" and x["invert"] and x["behavior"] == "Removed"), None)
        self.cut = regex.compile(pattern).findall if pattern and suffix else None
        self.units, self.words = Cache(self._units), Cache(self._words)

    def _whole(self, text: str):
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _each(self, texts: list[str]):
        import numpy as np

        ids = [self._whole(x) for x in texts]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])

    def _words(self, words: pa.Array):
        """Ids and bounds of words: each word's last piece ends one, so a joined text can be cut again."""
        import numpy as np

        words, parts = words.to_pylist(), []
        for i in range(0, len(words), AT_ONCE):
            some = words[i : i + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                parts.append((ids, np.diff(ends, prepend=0)))
            else:
                ids, ends = self._each(some)
                parts.append((ids, np.diff(ends)))
        return np.concatenate([x[0] for x in parts]), np.concatenate([[0], np.cumsum(np.concatenate([x[1] for x in parts]))])

    def _units(self, units: pa.Array):
        """Ids and bounds of units, by the words in them."""
        import numpy as np

        marked = np.zeros(len(units), bool)
        for x in self.special:
            marked |= pa.compute.match_substring(units, x).to_numpy(zero_copy_only=False)
        if marked.any():
            return self._each(units.to_pylist())
        plain = pa.compute.ascii_is_alpha(units).to_numpy(zero_copy_only=False)  # one word each
        cut, normal, rest = self.cut, self.tokenizer.normalizer.normalize_str, units.filter(pa.array(~plain)).to_pylist()
        parts = [cut(x.lower() if x.isascii() else normal(x)) for x in rest]
        sizes = np.ones(len(units), np.int64)
        sizes[~plain] = [len(x) for x in parts]
        simple = pa.compute.ascii_lower(units.filter(pa.array(plain)))
        coded = pa.concat_arrays([simple, pa.array([w for x in parts for w in x], pa.large_string())]).dictionary_encode()
        slots = self.words.slots(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        # Words of plain units come first, then those of the others: put them into the order of units.
        first = np.zeros(len(units), np.int64)
        first[plain] = np.arange(len(simple))
        first[~plain] = len(simple) + np.cumsum(sizes[~plain]) - sizes[~plain]
        slots, bounds = gather(first, sizes, np.arange(len(units)), slots)
        ids, ends = gather(self.words.starts, self.words.counts, slots, self.words.ids)
        return ids, ends[bounds]

    def encode(self, column: pa.Array):
        """Ids of all texts of a column, end to end, and their bounds; null counts as empty."""
        import numpy as np

        texts = column.cast(pa.large_string()).fill_null("")
        odd = np.full(len(texts), self.cut is None)
        for c in ODD:
            odd |= pa.compute.match_substring(texts, c).to_numpy(zero_copy_only=False)
        if odd.any():
            parts = [self._each([x.as_py()]) if o else self.encode(texts.slice(i, 1)) for i, (x, o) in enumerate(zip(texts, odd, strict=True))]
            return np.concatenate([x[0] for x in parts]), np.concatenate([[0], np.cumsum([x[1][-1] for x in parts])])
        split = pa.compute.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        slots = self.units.slots(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        ids, ends = gather(self.units.starts, self.units.counts, slots, self.units.ids)
        self.units.trim()
        self.words.trim()
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        return ids, ends[offsets - offsets[0]]


def _pieces(path: str, capacity: int, end_id: int):
    """(id, piece, start, length, crc) of each piece of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, cache = TaskContext.get().partitionId(), worker_cache("tokenizers", "packing")
        if path not in cache:
            cache[path] = Encoder(path)
        for batch in slices(batches, "text", BATCH_BYTES, 1 << 16):
            ids, bounds = cache[path].encode(batch.column("text"))
            ids, sizes = np.insert(ids, bounds[1:], np.uint32(end_id)), np.diff(bounds) + 1
            pieces = -(-sizes // capacity)
            rows = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[rows] - start)
            ends = np.cumsum(length)
            data = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch(
                {
                    "id": batch.column("id").take(pa.array(rows)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                    "part": pa.array(np.full(len(rows), part, np.int32)),
                }
            )
        give_back()

    return run


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's second bound: pieces over capacity - k are alone, those over half can't share."""
    total = sum(x * n for x, n in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for k in [0, *(x for x in lengths if 2 * x <= capacity)]:
        alone = sum(n for x, n in counts.items() if x > capacity - k)
        half = [(x, n) for x, n in counts.items() if capacity - k >= x and 2 * x > capacity]
        small = sum(x * n for x, n in counts.items() if k <= x and 2 * x <= capacity)
        big = sum(n for _, n in half)
        room = big * capacity - sum(x * n for x, n in half)
        best = max(best, alone + big + max(0, -(-(small - room) // capacity)))
    return best


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` can be put, in groups, into the pieces of ``a``: then ``b`` needn't be tried."""

    def fit(rest: list[int], items: tuple[int, ...]) -> bool:
        if not items:
            return True
        tried = set()
        for i, r in enumerate(rest):
            if r >= items[0] and r not in tried:
                tried.add(r)
                rest[i] -= items[0]
                if fit(rest, items[1:]):
                    return True
                rest[i] += items[0]
        return False

    return a != b and sum(a) >= sum(b) and fit(list(a), b)


def fillings(room: int, lengths: list[int], counts: dict[int, int], most: int | None = 6, nodes: int | None = 400) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` by pieces of ``counts`` (ascending ``lengths``), least waste and largest pieces first.

    ``most`` bounds the fillings that come back and ``nodes`` the sets that are looked at; None leaves either open.
    """
    if counts.get(room, 0):
        return [(room,)]  # a piece of that very length dominates every other filling
    found: list[tuple[int, tuple[int, ...]]] = []
    left = nodes

    def add(waste: int, filling: tuple[int, ...]) -> None:
        found.append((waste, filling))
        if most is not None:
            found.sort(key=lambda f: f[0])
            del found[4 * most :]

    def visit(rest: int, upto: int, chosen: tuple[int, ...]) -> None:
        nonlocal left
        if left is not None:
            left -= 1
        top = bisect_right(lengths, min(rest, upto)) - 1
        fits, tried = False, 0
        while top >= 0 and (left is None or left > 0):
            x = lengths[top]
            top -= 1
            if counts[x] <= chosen.count(x):
                continue
            fits = True
            if most is not None and (tried >= most or len(found) >= most and found[-1][0] == 0):
                break
            tried += 1
            need = rest - x
            if need == 0:
                add(0, chosen + (x,))
            elif need < x and counts.get(need, 0) > chosen.count(need):
                add(0, chosen + (x, need))
                if most is None:
                    visit(need, x, chosen + (x,))
            else:
                visit(need, x, chosen + (x,))
        if not fits:
            add(rest, chosen)

    visit(room, room, ())
    ranked = sorted(set(found), key=lambda f: (f[0], len(f[1]), tuple(-x for x in f[1])))
    kept: list[tuple[int, ...]] = []
    for _, f in ranked:
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
        if len(kept) == most:
            break
    return kept


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, effort: int | None = 2) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, largest first) and multiplicities that pack ``counts`` into few bins.

    The first dive takes the first filling everywhere, as often as lengths allow: that best-fit solution is the first
    incumbent, and it always ends.  The search then returns to its bins, the latest first, and takes other undominated
    fillings, giving up a branch when its waste exceeds what a solution with one bin less could have.  It ends at the lower
    bound, or ``effort`` times as many patterns after the first dive as that dive took.  With None nothing is cut short: a
    pattern is applied once at a time and all undominated fillings are tried, which is exact and for small tables only.
    """
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    total, least = sum(x * n for x, n in counts.items()), lower_bound(counts, capacity)
    bounds = (None, None) if effort is None else (6, 400)

    def choices(state: dict[int, int], lengths: list[int]) -> list[tuple[int, ...]]:
        top = lengths[-1]
        state[top] -= 1
        got = [(top, *f) for f in fillings(capacity - top, lengths, state, *bounds)] if capacity > top else [(top,)]
        state[top] += 1
        return got

    def times(state: dict[int, int], pattern: tuple[int, ...]) -> int:
        return 1 if effort is None else min(state[x] // pattern.count(x) for x in set(pattern))

    best: list[tuple[tuple[int, ...], int]] | None = None
    best_bins = budget = 0
    # Branches are kept as the number of patterns before them and another pattern; states are made again when needed.
    done: list[tuple[tuple[int, ...], int]] = []
    branches: list[tuple[int, tuple[int, ...]]] = []
    while True:
        state = dict(counts)
        for pattern, n in done:
            for x in pattern:
                state[x] -= n
        state = {x: n for x, n in state.items() if n}
        lengths = sorted(state)
        bins, waste = sum(n for _, n in done), sum(n * (capacity - sum(p)) for p, n in done)
        while state and (best is None or waste <= (best_bins - 1) * capacity - total):
            options = choices(state, lengths)
            branches.extend((len(done), other) for other in reversed(options[1:]))
            n = times(state, options[0])
            for x in options[0]:
                state[x] -= n
            for x in set(options[0]):
                if not state[x]:
                    del state[x]
                    lengths.remove(x)
            done.append((options[0], n))
            bins, waste = bins + n, waste + n * (capacity - sum(options[0]))
            budget -= 1
            if best is not None and effort is not None and budget <= 0:
                break
        if not state and (best is None or bins < best_bins):
            if best is None:
                budget = (effort or 0) * len(done)
            best, best_bins = list(done), bins
        if best_bins == least or not branches or effort is not None and budget <= 0:
            return best
        at, other = branches.pop()
        del done[at:]
        state = dict(counts)
        for pattern, n in done:
            for x in pattern:
                state[x] -= n
        done.append((other, times(state, other)))
        budget -= 1


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, list[int]]:
    """For each length and run of ranks: the first sequence, how many pieces of that length a sequence holds, and where."""
    out = {k: [] for k in ("length", "first", "each", "sequence", "offset")}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for x in dict.fromkeys(pattern):
            each = pattern.count(x)
            for k, v in zip(out, (x, used.get(x, 0), each, sequence, offset), strict=True):
                out[k].append(v)
            used[x] = used.get(x, 0) + each * n
            offset += each * x
        sequence += n
    return out


def _place(slots: dict[str, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = {k: np.array(v, np.int64) for k, v in slots.items()}
        order = np.lexsort((table["first"], table["length"]))
        table = {k: v[order] for k, v in table.items()}
        keys = table["length"] << 44 | table["first"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            inside = rank - table["first"][at]
            columns = {c: batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(table["sequence"][at] + inside // table["each"][at])
            columns["offset"] = pa.array(table["offset"][at] + inside % table["each"][at] * length)
            yield pa.record_batch(columns)
        give_back()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", effort: int | None = 2) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    The search for fewer sequences is bounded by ``effort`` (see ``bin_completion``, None is exact); the packing is whole
    whatever the bound.  ``lower_bound`` of the lengths' counts tells how far a packing is from the best.

    Defined cases: a null text counts as empty and an empty text is the end id alone; an empty table gives an empty result;
    repeated rows and null ids are packed row by row; other columns are ignored; texts of any length are cut whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    pieces = materialize(base.mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES), "pieces")
    # At most ``capacity`` rows reach the driver, whatever the corpus.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slot_table(bin_completion(counts, capacity, effort))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "part", "base")
    own = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("row", F.row_number().over(own)).join(before, ["length", "part"]).withColumn("rank", F.col("base") + F.col("row") - 1)
    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(slots), "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.withColumnRenamed("id", id_col)
