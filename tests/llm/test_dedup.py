import hashlib
import random

import pytest

from helpers import SCHEMA, awkward, components, key, normal, repeats, table
from tidewright.llm import near_dedup, suffix_dedup, suffix_sort
from tidewright.llm.components import connected_components
from tidewright.llm.exact_dedup import exact_dedup, exact_dedup_rows, merge_runs
from tidewright.llm.near_dedup import least_matches, near_duplicate_rows, near_duplicates
from tidewright.llm.suffix_dedup import remove_repeats
from tidewright.llm.suffix_sort import Sorter, Store, repeated


def test_exact_dedup(spark):
    rows = awkward()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(normal(t), []).append(i)
    expected = []
    for i, t, _ in rows:
        ids = groups[normal(t)]
        keep = min((x for x in ids if x is not None), default=None)
        expected.append((i, keep, len(ids), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    got = exact_dedup(table(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_exact_dedup_rows_keeps_columns_and_one_row(spark):
    rows = awkward()
    docs = table(spark, rows)
    out = exact_dedup_rows(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len({normal(t) for _, t, _ in rows})
    assert sorted(normal(r["text"]) for r in got) == sorted({normal(t) for _, t, _ in rows})


def test_exact_dedup_hot_group_and_rounds(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same' else concat('t', id) end as text").repartition(7)
    for fan_in in (2, 4):
        got = exact_dedup(docs, fan_in=fan_in)
        assert got.count() == 6000
        assert got.filter("kept").count() == 4001
        assert got.filter("group_size = 2000 and keep_id = 0").count() == 2000


def test_merge_runs_counts_rows_of_the_smallest_id(spark):
    rows = spark.createDataFrame([(b"x" * 32, 3), (b"x" * 32, 3), (b"x" * 32, 5), (b"y" * 32, None)], "digest binary, id bigint")
    got = {bytes(r["digest"][:1]): (r["keep_id"], r["n_keep"], r["group_size"]) for r in merge_runs(rows).collect()}
    assert got == {b"x": (3, 2, 3), b"y": (None, 1, 1)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for f in (exact_dedup, exact_dedup_rows, near_duplicates, near_duplicate_rows, remove_repeats):
        assert f(docs).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rows = awkward()
    got = [tuple(r) for r in near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=key) == sorted(components(rows), key=key)


def test_near_duplicates_chain_needs_open_buckets(spark):
    """Texts drift away from the first one, so that links exist only between neighbours; blocks of two force many block pairs."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words), "a"))
        at = r.randrange(100)
        words[at] = f"x{i}"
    old = near_dedup.BLOCK
    near_dedup.BLOCK = 2
    try:
        got = [tuple(x) for x in near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()]
    finally:
        near_dedup.BLOCK = old
    assert sorted(got) == sorted(components(rows))


def test_near_duplicate_rows(spark):
    rows = awkward()
    docs = table(spark, rows)
    out = near_duplicate_rows(docs)
    assert out.columns == docs.columns
    kept = {c for i, _, c in components(rows) if c == i and i is not None}
    ids = [r["doc_id"] for r in out.collect()]
    assert {i for i in ids if i is not None} == kept
    assert len([i for i in ids if i == 4]) == 1


def test_pruning_is_rarer_than_the_miss_probability_says():
    steps = dict(least_matches(0.75))
    assert all(0 < steps[n] < 0.75 * n for n in steps if n >= 32)


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    pairs = [(a, b) for a in got for b in got if a < b]
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a, b in pairs)


def _check_sorted(text, depth, positions, common):
    assert sorted(positions) == list(range(len(text)))
    for i in range(1, len(positions)):
        a, b = text[positions[i - 1] :][:depth], text[positions[i] :][:depth]
        assert b <= a
        shared = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[i] == shared, (i, common[i], shared)


@pytest.mark.parametrize("narrow", [suffix_sort.NARROW, 0])
def test_suffix_sorter_with_queues_on_disk(narrow, monkeypatch):
    """Also with every level above the memory for names, and with the queues of large alphabets on every level."""
    import numpy as np

    monkeypatch.setattr(suffix_sort, "NARROW", narrow)
    r = random.Random(3)
    for _ in range(120):
        n, k, depth = r.randint(1, 90), r.choice([1, 2, 3, 20]), r.choice([2, 5, 11])
        monkeypatch.setattr(suffix_sort, "BATCH", r.choice([3, 16, 1 << 18]))
        text = [r.randint(1, k) for _ in range(n)] + [0]
        if r.random() < 0.3:
            text = (text[:-1] * 4)[: 4 * n] + [0]
        store = Store(r.choice([0, 300, 1 << 20]))
        sorter = Sorter(np.array(text, np.uint16), depth, store, names=r.choice([1, 4, 1 << 20]))
        positions, common = [], []
        for p, c in sorter.runs():
            positions += p.tolist()
            common += c.tolist()
        store.close()
        _check_sorted(text, depth, positions, common)


def test_suffix_sorter_far_beyond_its_memory(monkeypatch):
    """Four levels of names, 50 times the budget in arrays and queues: what is in memory stays below the budget."""
    import numpy as np

    monkeypatch.setattr(suffix_sort, "BATCH", 1 << 10)
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(200)]
    data = " ".join(r.choice(words) for _ in range(6000)).encode()
    data += data[5000:9000]
    text = np.append(np.frombuffer(data, np.uint8).astype(np.uint16), np.uint16(0))
    budget = 20_000
    store, most = Store(budget), 0
    fits = store.fits
    monkeypatch.setattr(store, "fits", lambda size: (fits(size), most_used())[0])

    def most_used():
        nonlocal most
        most = max(most, store.used)

    got = repeated(text, 60, store, names=500)
    assert most <= budget and store.spilled > 50 * budget and len(text) * 2 > 3 * budget
    seen = {}
    for i in range(len(data)):
        seen.setdefault(data[i : i + 60], []).append(i)
    expected = sorted(i for k, v in seen.items() if len(k) == 60 and len(v) > 1 for i in v)
    assert np.flatnonzero(got).tolist() == expected
    store.close()


def test_repeated_marks_both_ends():
    import numpy as np

    text = np.frombuffer(b"abcdeXabcdeY", np.uint8).astype(np.uint16)
    store = Store(1 << 20)
    assert np.flatnonzero(repeated(np.append(text, np.uint16(0)), 4, store)).tolist() == [0, 1, 6, 7]
    store.close()


def _repeats(spark, rows, length, gram):
    got = remove_repeats(table(spark, rows), length=length, gram=gram).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256").collect()
    expected = [(i, *x[:3], x[3], hashlib.sha256(x[3]).hexdigest()) for (i, _, _), x in zip(rows, repeats([t for _, t, _ in rows], length), strict=True)]
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4]), r[5]) for r in got), key=key) == sorted(expected, key=key)


def test_remove_repeats_against_all_windows(spark):
    _repeats(spark, awkward(), 60, 20)


def test_remove_repeats_within_and_across_texts(spark):
    r = random.Random(8)
    passage = "".join(r.choice("abcd é") for _ in range(150))
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 200))) + passage + "".join(r.choice("xyz") for _ in range(50)), "a") for i in range(12)]
    rows += [(50, "ab" * 100, "a"), (51, "a" * 130, "a"), (52, passage + "!" + passage, "b"), (53, None, "b")]
    _repeats(spark, rows, 40, 15)


def test_remove_repeats_with_anchors_cut_again(spark, monkeypatch):
    """Also with shards of one row's size, so that many go to a task, and next to no memory for a sorter."""
    monkeypatch.setattr(suffix_dedup, "MANY", 1)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 1000)
    _repeats(spark, awkward(2), 60, 20)
