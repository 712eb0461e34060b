import dataclasses
import math
import zlib

import public_tokenizers
import pytest

from helpers import SCHEMA, awkward, key, normal, table
from tidewright.llm import packing, quality, toxicity
from tidewright.llm.mixing import mix, mixed_rows, source_shares, temperature, token_count
from tidewright.llm.packing import bin_completion, dominates, fillings, lower_bound, pack
from tidewright.llm.token_counts import frequent_table, frequent_units, separable, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "a\n\nb", " a", "a ", "a  b", "a \n b", "\n a\n", "  \n\n  x", "a▁b", " ▁ x", "\ta\t", "a\r\nb\r\n 'x';\r\n", "<s> </s>", "é́ ﬁ １", "x" * 3000,
       "😀 😀\n😀", "\x00a b", "a　b\xa0\xa0c", "a\x1cb !\x1d!", "I'm 'S x's", "<|endoftext|>x <|startoftext|>", "İstanbul ΑΣ Σ", "1234 x１ ²Ⅷ", "á ́b", None]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t, "a") for i, t in enumerate(ODD)] + awkward()
    got = token_counts(table(spark, rows), PIECES, limit=50).collect()
    expected = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 50) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_table_of_frequent_pre_tokens(spark):
    import sentencepiece
    from array import array

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert separable(model)
    docs = spark.createDataFrame([("b a a\na",), ("a b▁c",), ("",), ("x" * 300,)], "text string")
    assert frequent_units(docs) == ["a", "b", "\na", "c"] and frequent_units(docs, limit=2) == ["a", "b"]
    assert frequent_units(docs.limit(0)) == [] and frequent_table(PIECES, []) == ("", b"")
    words, counts = frequent_table(PIECES, ["a", "\na"])
    assert words == "a \na" and list(array("I", counts)) == [len(model.encode("a")), len(model.encode("x\na")) - len(model.encode("x"))]


def test_token_counts_of_empty_tables_and_without_a_cache(spark, monkeypatch):
    from tidewright.llm import token_counts as module

    assert token_counts(table(spark, []), PIECES).count() == 0
    monkeypatch.setattr(module, "MAX_FREQUENT", 1)
    monkeypatch.setattr(module, "CACHE_ENTRIES", 2)
    test_token_counts_equal_the_library(spark)


def test_packing_of_empty_tables(spark):
    assert pack(table(spark, []), WORDS).count() == 0


def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows, got, capacity):
    import numpy as np

    expected = []
    for i, t, _ in rows:
        ids = np.array(_ids(t), "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((i, p, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack(spark):
    rows = [(i, t, "a") for i, t in enumerate(ODD)] + awkward()
    got = pack(table(spark, rows), WORDS, capacity=64).collect()
    used = check_packing(rows, got, 64)
    counts = {}
    for r in got:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert lower_bound(counts, 64) <= used <= lower_bound(counts, 64) + 1


def test_encoder_with_tiny_caches():
    import pyarrow as pa

    old = packing.CACHE_ENTRIES, packing.CACHE_LONGEST
    packing.CACHE_ENTRIES, packing.CACHE_LONGEST = 6, 4
    try:
        encoder = packing.Encoder(WORDS)
        texts = [*ODD, "Plain words, words again.", "it's 12 o'clock; IT'S", "a" * 300, "été ÉTÉ naïve Ω ς"]
        for some in (texts, texts[3:], texts[:2], [], texts):
            ids, bounds = encoder.encode(pa.array(some, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [_ids(t)[:-1] for t in some]
            assert len(encoder.units.keys) <= 6 and len(encoder.words.keys) <= 6
    finally:
        packing.CACHE_ENTRIES, packing.CACHE_LONGEST = old


def _fewest(items, capacity):
    """Fewest bins by trying everything."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_is_optimal_on_small_cases(seed):
    import random

    r = random.Random(seed)
    items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
    counts = {x: items.count(x) for x in items}
    patterns = bin_completion(counts, 20)
    packed = {}
    for p, n in patterns:
        assert sum(p) <= 20
        for x in p:
            packed[x] = packed.get(x, 0) + n
    assert packed == counts
    exact = bin_completion(counts, 20, effort=None)
    assert sum(n for _, n in exact) == _fewest(items, 20)
    assert sum(n for _, n in patterns) == _fewest(items, 20)


def test_dominance_and_exact_fillings():
    assert dominates((8,), (5, 3)) and not dominates((5, 3), (8,)) and not dominates((4,), (5,))
    assert fillings(8, [3, 5, 8], {3: 1, 5: 1, 8: 1}) == [(8,)]
    assert (5, 3) in fillings(9, [3, 5], {3: 2, 5: 1})
    assert bin_completion({}) == []


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * 10, "big") for i in range(3000)] + [(5000 + i, "w " * 10, f"s{i % 4}") for i in range(400)]
    docs = table(spark, rows)
    drawn = mix(docs, target_entropy=0.8, budget_passes=1.0)
    total = drawn.selectExpr("sum(mix_copies * mix_tokens) as t").first()["t"]
    by = {r["source"]: r["t"] / total for r in drawn.groupBy("source").agg({"mix_tokens": "max"}).join(drawn.selectExpr("source as s", "mix_copies * mix_tokens as t").groupBy("s").sum("t").withColumnRenamed("sum(t)", "t"), drawn["source"].eqNullSafe(__import__("pyspark").sql.functions.col("s"))).collect()}
    entropy = -sum(p * math.log(p) for p in by.values())
    assert abs(entropy - 0.8 * math.log(5)) < 0.02
    assert abs(total - 34_000) < 400
    shares = source_shares(docs.select("source", token_count(docs["text"]).alias("tokens")).withColumnRenamed("source", "source_key"))
    assert temperature(shares, max_repeats=1.0) == pytest.approx(1.0, abs=1e-6)
    a = temperature(shares, max_repeats=2.0)
    assert 0 < a < 1


def test_mixing_targets_on_both_sides_of_the_natural_shares(spark):
    def entropy(p):
        return -sum(x * math.log(x) for x in p if x)

    for sizes in ([90, 10], [50, 30, 15, 5], [40, 40, 20], [7, 7, 7]):
        p = [x / sum(sizes) for x in sizes]
        shares = spark.createDataFrame([(str(i), 1, n, x) for i, (n, x) in enumerate(zip(sizes, p))], "source_key string, n_docs bigint, n_tokens bigint, share double")
        top = math.log(len(p))
        for target in (0.2, 0.5, 0.8, 0.95, 1.0):
            floor = math.log(sizes.count(max(sizes)))  # what is left as the exponent grows
            if target * top < floor - 1e-6:
                with pytest.raises(ValueError):
                    temperature(shares, target_entropy=target)
                continue
            if abs(target * top - floor) < 1e-6 and len(set(sizes)) > 1:
                continue
            a = temperature(shares, target_entropy=target)
            q = [x**a for x in p]
            got = entropy([x / sum(q) for x in q])
            assert got <= target * top + 1e-6 and (a == 0 or got > target * top - 1e-4), (sizes, target, a)
        with pytest.raises(ValueError):
            temperature(shares, max_repeats=0.5)
        assert temperature(shares.limit(1), target_entropy=0.1) == 1.0


def test_mixing_against_plain_dealing(spark):
    """Weights, passes, blocks, places and copies of every row, dealt in plain Python from the hashes that SQL gives."""
    from pyspark.sql import functions as F
    from tidewright.llm import mixing

    rows = [(i, " ".join(["w"] * (i % 17)), ["big", "b", "c", None][min(3, i % 9)] if i % 9 < 4 else "big") for i in range(2500)] + [(3, "w w", "b"), (None, "x", "c")]
    docs = table(spark, rows)
    got = mix(docs, max_repeats=2.0)
    tag = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))
    hashed = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(11), tag).alias("h"), F.xxhash64(F.lit(12), tag).alias("k")).collect()
    tokens = [len((r["text"] or "").split()) for r in hashed]
    total, by, members = sum(tokens), {}, {}
    for r, n in zip(hashed, tokens):
        by[r["source"]] = by.get(r["source"], 0) + n
        members[r["source"]] = members.get(r["source"], 0) + 1
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        z = sum((x / total) ** a for x in by.values())
        if max((x / total) ** (a - 1) for x in by.values()) / z > 2.0:
            low = a
        else:
            high = a
    z = sum((x / total) ** high for x in by.values())
    weight = {s: (x / total) ** high / z for s, x in by.items()}
    passes = {s: weight[s] / (by[s] / total) for s in by}
    blocks = {}
    for r, n in zip(hashed, tokens):
        blocks.setdefault((r["source"], r["h"] % -(-members[r["source"]] // mixing.BLOCK_ROWS)), []).append((r["k"], r["doc_id"] is not None, r["doc_id"], n))
    expected = []
    for (s, b), inside in blocks.items():
        inside.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        part, before = (passes[s] - int(passes[s])) * sum(x[3] for x in inside), 0
        for place, (_, _, i, n) in enumerate(inside):
            expected.append((i, s, n, round(weight[s], 6), round(passes[s], 6), b, place, int(passes[s]) + (before + n / 2 <= part and part > 0)))
            before += n
    columns = ["doc_id", "source", "mix_tokens", "mix_weight", "mix_passes", "mix_block", "mix_position", "mix_copies"]
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(expected, key=key)


def test_mixing_awkward_rows(spark):
    docs = table(spark, awkward())
    drawn = mix(docs, max_repeats=3.0)
    assert drawn.count() == docs.count()
    assert drawn.filter("mix_copies is null or mix_copies < 0").count() == 0
    out = mixed_rows(docs)
    assert out.columns == docs.columns
    assert sorted({normal(r["text"]) for r in out.collect()}) == sorted({normal(r["text"]) for r in docs.collect()})
    assert {r["mix_copies"] for r in out.collect()} == {9}
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0 and mixed_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def _labelled(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice(["th", "er", "in", "on", "an", "re"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(60)]
        bad, toxic = i % 6 == 0, i % 7 == 0
        if toxic:
            for w in ("grumblebug", "nastyfish")[: 1 + i % 2]:
                words[r.randrange(60)] = w
        text = " ".join(w + "%%%" if bad else w for w in words)
        rows.append((i, text, "a"))
        if i % 3:
            labels.append((i, 0 if bad else 1, int(toxic)))
    return rows, table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_importance_resampling(spark):
    rows, docs, labels = _labelled(spark)
    got = {r["doc_id"]: r for r in quality.importance_resample(docs, labels).collect()}
    good = [i for i, _, _ in rows if i % 6]
    assert sum(got[i]["selected"] for i in good) >= 0.98 * len(good)
    assert sum(got[i]["selected"] for i in range(0, 600, 6)) <= 3
    ten = quality.importance_resample(docs, labels, k=10).filter("selected")
    assert ten.count() == 10
    assert quality.importance_resample(docs, labels, k=0).filter("selected").count() == 0
    out = quality.quality_rows(docs, labels)
    assert out.columns == docs.columns and out.count() == sum(r["selected"] for r in got.values())


def _plain_weights(rows, good):
    """Log weights by plain counting of hashed n-grams, text by text."""
    import re

    import numpy as np

    def bucket(values):
        h = len(values)
        for v in values:
            h = ((h ^ v) * 0x9E3779B1) & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 16

    def grams(text):
        data = (text or "").encode()
        lengths = [min(63, len(w)) for w in re.findall(rb"[^\x20\x09-\x0d]+", data)]
        return [[bucket(v[i : i + n]) for i in range(len(v) - n + 1)] for v, n in [*((data, n) for n in quality.SIZES), *((lengths, n) for n in quality.LENGTHS)]]

    raw, target = (np.zeros((quality.KINDS, quality.BUCKETS)) for _ in range(2))
    for i, t, _ in rows:
        for kind, got in enumerate(grams(t)):
            for b in got:
                raw[kind, b] += 1
                target[kind, b] += i in good
    ratio = np.zeros_like(raw)
    for kind in range(quality.KINDS):
        p = (raw[kind] + 0.5) / (raw[kind] + 0.5).sum()
        q = p * (target[kind] + quality.PRIOR) / (target[kind].sum() * p + quality.PRIOR)
        ratio[kind] = np.log(q / q.sum()) - np.log(p)
    return [sum(ratio[kind, b] for kind, got in enumerate(grams(t)) for b in got) for _, t, _ in rows]


def test_importance_resampling_against_plain_counts(spark):
    rows = _labelled(spark)[0][:150] + awkward()[:-1]
    labels = [(i, int(i % 6 != 0)) for i, _, _ in rows if i is not None and i % 3] + [(7, 0), (None, 1)]
    good = {i for i, q in labels if q and i is not None} - {7}
    docs = table(spark, rows)
    got = quality.importance_resample(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    plain = sorted((str(i), round(w, 3)) for (i, _, _), w in zip(rows, _plain_weights(rows, good), strict=True))
    assert [x[0] for x in plain] == sorted(str(r["doc_id"]) for r in got)
    for (_, a), (_, b) in zip(plain, sorted((str(r["doc_id"]), round(r["log_weight"], 3)) for r in got), strict=True):
        assert abs(a - b) < 0.002
    k = sum(r["log_weight"] >= 0 for r in got)
    cut = sorted((r["gumbel_key"] for r in got), reverse=True)[k - 1]
    assert all(r["selected"] == (r["gumbel_key"] >= cut) for r in got if abs(r["gumbel_key"] - cut) > 1e-6 or r["gumbel_key"] == cut)


def test_gumbel_top_k_samples_by_weight(spark):
    """Of two rows whose weights differ by log 3, the heavier one is drawn first three times out of four."""
    unit = "(pmod(xxhash64(id, seed), 4503599627370496L) + 0.5) / 4503599627370496D"
    seen = spark.range(2).crossJoin(spark.range(4000).withColumnRenamed("id", "seed")).selectExpr("seed", "id", f"id * ln(3) - ln(-ln({unit})) as k")
    first = seen.groupBy("seed").agg({"k": "max"}).withColumnRenamed("max(k)", "k").join(seen, ["seed", "k"])
    assert 0.72 < first.filter("id = 1").count() / 4000 < 0.78


def test_importance_resampling_awkward_rows(spark):
    docs = table(spark, awkward())
    labels = spark.createDataFrame([(10, 1, 0), (None, 1, None), (40, 0, 1), (10, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.importance_resample(docs, labels).count() == docs.count()
    assert quality.importance_resample(docs, labels.limit(0)).filter("log_weight <> 0").count() == 0
    assert quality.importance_resample(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 * 1000000007 + 5 as v")
    for k in (1, 17, 500, 1000):
        assert quality.kth_largest(rows, "v", k) == (1000 - k) * 1000000007 + 5


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    import random

    import numpy as np

    terms = [("idiot", False), ("moron", False), ("disgusting", False), ("scum", False), ("lowe", True)]
    automaton = toxicity.build(terms)
    r = random.Random(1)
    for _ in range(1500):
        w = list(r.choice(["idiot", "moron", "disgusting", "scum", "lowe"]))
        for _ in range(r.randint(0, 3)):
            p = r.randrange(len(w) + 1)
            kind = r.random()
            if kind < 0.4 and p < len(w):
                w[p] = r.choice("idotxé*")
            elif kind < 0.7:
                w.insert(p, r.choice("idotxé*"))
            elif p < len(w) and len(w) > 1:
                del w[p]
        w = "".join(w)
        hits = [(_distance(w, t), i) for i, (t, stem) in enumerate(terms) if not stem and _distance(w, t) <= toxicity.reach(t, False)]
        hits += [(0, 4)] if w.startswith("lowe") else []
        best = min(hits, default=None)
        got = toxicity._match(automaton, np.array([ord(c) for c in w], np.uint32), np.array([0]), np.array([len(w)]))[0]
        assert got == (-1 if best is None else 2 * best[1] + (best[0] > 0)), w


def test_toxicity_held_out_and_misspelt(spark):
    rows, docs, labels = _labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, _, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    right = sum(got[i]["predicted"] == int(i % 7 == 0) for i, _, _ in rows)
    assert right >= 0.99 * len(rows)
    more = table(spark, [(1, "the grumblebugg in", "a"), (2, "the gr*mblebug in", "a"), (3, "than there", "a"), (4, None, "a"), (5, "", "a")])
    model = spark.sparkContext.broadcast(dataclasses.astuple(toxicity.fit(docs, labels)))
    scored = {r["id"]: r["score"] for r in more.selectExpr("doc_id as id", "coalesce(text, '') as text").mapInArrow(toxicity._score(model), "id bigint, score double, terms array<string>").collect()}
    assert scored[1] >= 0.5 and scored[2] >= 0.5 and scored[3] < 0.5 and scored[4] == scored[5] == scored[3]


def test_toxicity_quotation_weighs_less():
    automaton = toxicity.build([("grumblebug", False)])
    plain, quoted, reported = toxicity._features(automaton, ["you grumblebug there", 'he was "grumblebug" once', "they called grumblebug names"])
    assert plain == {0} and quoted == {1} and reported == {1}
    weights = toxicity.weigh({0: (50, 1)}, [10], 60, 500)
    assert weights[1] < weights[0] and weights[3] < weights[2] < weights[0]


def test_toxicity_awkward_rows(spark):
    docs = table(spark, awkward())
    labels = spark.createDataFrame([(10, 1, 0), (None, 1, None), (40, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(docs, labels.limit(0)).filter("score is null").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_contradictory_labels_count_as_toxic_in_any_order(spark):
    rows, docs, labels = _labelled(spark)
    more = spark.createDataFrame([(i, 1, 0) for i in range(0, 600, 7)], "doc_id bigint, quality int, toxic int")
    a = toxicity.fit(docs, labels.union(more))
    b = toxicity.fit(docs, more.union(labels))
    assert a.terms and a.terms == b.terms and a.weights == b.weights


def test_toxicity_words_beside_weaker_stems():
    terms = toxicity.choose_terms([("loser$", 95, 0), ("los", 116, 217), ("grumble", 60, 0), ("grumbler$", 30, 0)], 0.09, 1000)
    assert sorted(terms) == [("grumble", True), ("los", True), ("loser", False)]
    automaton = toxicity.build(terms)
    n = {t: i for i, (t, _) in enumerate(terms)}
    hits = {"loser": "loser", "l0ser": "loser", "lozer": "loser~", "lser": "loser~", "loserr": "loser~", "los": "los", "losange": "los", "grumblers": "grumble", "grunblers": "grumble~"}
    for word, hit in hits.items():
        assert toxicity._features(automaton, [word]) == [{8 * n[hit.rstrip("~")] + 2 * hit.endswith("~")}], word
    assert toxicity._features(automaton, ["lo", "gramplers"]) == [set(), set()]
