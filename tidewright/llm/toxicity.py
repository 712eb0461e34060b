"""Toxicity scores from a learned lexicon, matched with spelling errors.

Terms (words, and stems that many words share) are learned from labelled rows.  Their trie is intersected with Levenshtein
automata: the product, made deterministic, reads a word's characters once and says which term it is within how many edits.
Each hit is then scored by its context window, so that a quoted or reported term weighs less than the same term used on
its own.  All weights are log odds counted on the training labels.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm._bytehash import shingles
from tidewright.llm._common import give_back, materialize, slices, text_buffer, worker_cache

#: Labelled rows that lexicon and weights are fitted on at most.
LABELLED = 20_000
STEMS = range(3, 9)
WINDOW = 24
#: Characters from which on a misspelt term is hardly met by chance.
LONG = 7
QUOTES = frozenset("\"“”„«»‹›‘’`")
REPORTING = ("said", "says", "called", "wrote", "quote", "quoted", "reported", "alleged", "dijo", "sagte", "nannte", "zitat", "citation", "disait")


@dataclass
class Automaton:
    """Deterministic product of the lexicon's trie with Levenshtein automata over character classes; state 0 is dead."""

    alphabet: str
    table: list[list[int]] = field(default_factory=list)
    accept: list[int] = field(default_factory=list)  # 2 * term + (1 if misspelt), or -1


def reach(term: str, stem: bool) -> int:
    """Edits allowed for a term, by its own length: short words and stems must match as they are."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def build(terms: list[tuple[str, bool]]) -> Automaton:
    """The automaton of ``terms`` (text, whether it is a stem)."""
    alphabet = "".join(sorted({c for t, _ in terms for c in t}))
    children: list[dict[str, int]] = [{}]
    ends: list[list[int]] = [[]]
    bound = [0]
    for i, (term, stem) in enumerate(terms):
        node, most = 0, reach(term, stem)
        bound[0] = max(bound[0], most)
        for c in term:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append([])
                bound.append(0)
            node = children[node][c]
            bound[node] = max(bound[node], most)
        ends[node].append(i)

    def closed(states: dict[int, int]) -> frozenset:
        todo = list(states.items())
        while todo:
            node, e = todo.pop()
            if node < 0 or states[node] < e:
                continue
            for child in children[node].values():  # a character of the term is left out
                if e + 1 <= bound[child] and states.get(child, 99) > e + 1:
                    states[child] = e + 1
                    todo.append((child, e + 1))
        for node, e in list(states.items()):
            for i in ends[node] if node >= 0 else ():
                if terms[i][1] and e <= reach(*terms[i]) and states.get(-1 - i, 99) > e:
                    states[-1 - i] = e  # a stem has matched: the rest of the word is free
        return frozenset(states.items())

    def step(states: frozenset, c: str) -> frozenset:
        out: dict[int, int] = {}

        def add(node: int, e: int) -> None:
            if out.get(node, 99) > e:
                out[node] = e

        for node, e in states:
            if node < 0:
                add(node, e)
                continue
            if e + 1 <= bound[node]:
                add(node, e + 1)
            for char, child in children[node].items():
                cost = e + (char != c)
                if cost <= bound[child]:
                    add(child, cost)
        return closed(out)

    def accepted(states: frozenset) -> int:
        hits = [(e, i) for node, e in states for i in ((-1 - node,) if node < 0 else [i for i in ends[node] if not terms[i][1]]) if e <= reach(*terms[i])]
        # A stem yields to a word below it: the word was kept because it says more.
        words = [terms[i][0] for _, i in hits if not terms[i][1]]
        best = min(((e, i) for e, i in hits if not terms[i][1] or not any(w.startswith(terms[i][0]) for w in words)), default=None)
        return -1 if best is None else 2 * best[1] + (best[0] > 0)

    start = closed({0: 0})
    numbers = {frozenset(): 0, start: 1}
    order = [frozenset(), start]
    out = Automaton(alphabet)
    at = 0
    while at < len(order):
        row = []
        for c in ["\0", *alphabet]:  # class 0 stands for every character that no term has
            to = step(order[at], c)
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
            row.append(numbers[to])
        out.table.append(row)
        out.accept.append(accepted(order[at]))
        at += 1
    return out


def _kinds():
    """For each code point: 0 a mark, 1 a letter or digit, 2 white space."""
    import numpy as np

    cache = worker_cache("kinds", "toxicity")
    if "kinds" not in cache:
        text = [chr(i) for i in range(0x110000)]
        cache["kinds"] = np.fromiter((1 if c.isalnum() else 2 if c.isspace() else 0 for c in text), np.uint8, 0x110000)
    return cache["kinds"]


def _words(texts: list[str]):
    """Code points of the lower-cased texts, text borders, and words: outer and inner bounds, without marks at their ends."""
    import numpy as np

    lowered = [t.lower() for t in texts]
    data = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    borders = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    kind = _kinds()[data]
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = kind != 2
    step = np.diff(solid)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    index = np.arange(len(data))
    letter = kind == 1
    following = np.minimum.accumulate(np.where(letter, index, len(data))[::-1])[::-1]
    previous = np.maximum.accumulate(np.where(letter, index, -1))
    first = following[starts]
    keep = first < ends
    starts, ends, first = starts[keep], ends[keep], first[keep]
    return data, borders, starts, ends, first, previous[ends - 1] + 1


def _match(automaton: Automaton, data, first, last):
    """The accepted code of each word [first, last), -1 where there is none."""
    import numpy as np

    lut = np.zeros(0x110000, np.uint8)
    for i, c in enumerate(automaton.alphabet):
        lut[ord(c)] = i + 1
    table, accept = np.array(automaton.table, np.int32), np.array(automaton.accept, np.int64)
    classes = lut[data]
    state = np.ones(len(first), np.int32)
    live, at = np.arange(len(first)), 0
    while len(live):
        state[live] = table[state[live], classes[first[live] + at]]
        at += 1
        live = live[(first[live] + at < last[live]) & (state[live] != 0)]
    return accept[state]


def _quoted(data, low: int, high: int, start: int, end: int) -> bool:
    """Whether the context window of a hit [start, end) in a text [low, high) quotes or reports it."""
    before = "".join(map(chr, data[max(low, start - WINDOW) : start]))
    after = "".join(map(chr, data[end : min(high, end + WINDOW)]))
    opened = sum(c in QUOTES for c in before) % 2 == 1 and any(c in QUOTES for c in after)
    return opened or any(w.strip(".,:;\"'") in REPORTING for w in before.split()[-3:])


def _features(automaton: Automaton, texts: list[str]) -> list[set[int]]:
    """For each text the codes 8 * term + 4 * repeated + 2 * misspelt + quoted of its hits."""
    import numpy as np

    found: list[dict[int, int]] = [{} for _ in texts]
    data, borders, starts, ends, first, last = _words(texts)
    if not len(first):
        return [set() for _ in texts]
    code = _match(automaton, data, first, last)
    hits = np.flatnonzero(code >= 0)
    owner = np.searchsorted(borders, first[hits], "right") - 1
    kinds = _kinds()
    for h, o in zip(hits, owner, strict=True):
        if code[h] & 1 and (kinds[data[first[h] : last[h]]] == 0).any() or any(48 <= c < 58 for c in data[first[h] : last[h]]):
            code[h] &= ~1  # digits and marks within a word disguise a term; they are no chance likeness
        term, misspelt = divmod(int(code[h]), 2)
        key = 8 * term + 2 * misspelt + _quoted(data, int(borders[o]), int(borders[o + 1]), int(first[h]), int(last[h]))
        found[o][key] = found[o].get(key, 0) + 1
    return [{k + 4 * (n > 1) for k, n in x.items()} for x in found]


def _candidates(text: str) -> set[str]:
    """Stems of the words of a text, and its whole words with an end mark."""
    out = set()
    data, _, _, _, first, last = _words([text])
    lowered = text.lower()
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        word = lowered[a:b]
        out.add(word + "$")
        out.update(word[:n] for n in STEMS if n <= len(word))
    return out


def _toxic_candidates():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            values, bounds = shingles(data, offsets)
            for i, text in enumerate(batch.column("text").to_pylist()):
                # Near copies mostly share their smallest shingle: a group of them is little evidence, however large.
                cluster = int(values[bounds[i]] >> 1) if bounds[i + 1] > bounds[i] else 0
                terms = sorted(_candidates(text))
                yield pa.record_batch({"term": pa.array(terms, pa.string()), "cluster": pa.array([cluster] * len(terms), pa.int64())})
        give_back()

    return run


def _count_terms(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value
        counts: dict[str, int] = {}
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                for term in _candidates(text) & wanted:
                    counts[term] = counts.get(term, 0) + 1
        yield pa.record_batch({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        give_back()

    return run


def _tail(k: int, n: int, p: float) -> float:
    """log10 of an upper bound (Chernoff) on the probability of k or more of n at rate p."""
    if k <= n * p:
        return 0.0
    q = k / n
    d = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)
    return -n * d / math.log(10)


def _bar(tried: int) -> float:
    """log10 of the chance that a term has to stay below, with ``tried`` of them looked at."""
    return -math.log10(max(1, tried)) - 1.3


def choose_terms(rows: list[tuple[str, int, int]], base: float, tried: int) -> list[tuple[str, bool]]:
    """Terms of (candidate, toxic, clean) that can't be chance; of a family the longest with the same support.

    A whole word below a stem is left to it only where the stem's clean rate is no worse, or worse only by what may be chance.
    """
    good, bar = [], _bar(tried)
    for term, toxic, clean in rows:
        chance = _tail(toxic, toxic + clean, base)
        if toxic >= 0.3 * (toxic + clean) and chance < bar:
            good.append((round(chance, 6), term, toxic, clean))
    good.sort(key=lambda r: (r[0], -len(r[1]), r[1]))
    kept: dict[str, tuple[str, int, int]] = {}
    order: list[str] = []  # the kept terms in the order of text, so that those of one stem stand together

    def left_to(stem: tuple[str, int, int], other: tuple[str, int, int]) -> bool:
        return not other[0].endswith("$") or not stem[2] or _tail(other[1], other[1] + other[2], stem[1] / (stem[1] + stem[2])) >= bar

    for _, *row in good:
        new = tuple(row)
        term, toxic, _ = new
        stems = (kept.get(term[:n]) for n in range(1, len(term) + 1))
        if any(k is not None and not k[0].endswith("$") and left_to(k, new) for k in stems):
            continue
        if not term.endswith("$"):
            first = bisect_left(order, term)
            last = first
            while last < len(order) and order[last].startswith(term):
                last += 1
            below = order[first:last]
            if any(kept[k][1] >= 0.9 * toxic for k in below):
                continue
            for k in below:
                if left_to(new, kept[k]):
                    order.remove(k)
                    del kept[k]
        kept[term] = new
        insort(order, term)
    return [(t.rstrip("$"), not t.endswith("$")) for t in kept]


def _log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def weigh(counts: dict[int, tuple[int, int]], lengths: list[int], n_toxic: int, n_clean: int) -> list[float]:
    """Weights of the codes 8 * term + 4 * repeated + 2 * misspelt + quoted, drawn to a wider class where they were seen rarely.

    Words within an edit of a short term are often other words, so misspelt short terms share what was counted for them;
    a long term is hardly met by chance and keeps most of its weight.
    """
    pooled = [[0, 0] for _ in range(8)]
    for code, (toxic, clean) in counts.items():
        if not code & 2 or lengths[code // 8] < LONG:
            pooled[code % 8][0] += toxic
            pooled[code % 8][1] += clean

    def drawn(n: int, own: float, wider: float) -> float:
        return (n * own + 5 * wider) / (n + 5)

    def wide(kind: int, wider: float) -> float:
        return drawn(sum(pooled[kind]), _log_odds(*pooled[kind], n_toxic, n_clean), wider)

    exact = _log_odds(*pooled[0], n_toxic, n_clean) if sum(pooled[0]) else 0.0
    plain = [exact, wide(1, 0.25 * exact), wide(2, 0.6 * exact)]
    plain.append(wide(3, 0.25 * plain[2]))
    out = []
    for t, n in enumerate(lengths):
        long = [*plain[:2], 0.6 * exact, 0.15 * exact] if n >= LONG else plain
        single = [drawn(sum(counts.get(8 * t + k, (0, 0))), _log_odds(*counts.get(8 * t + k, (0, 0)), n_toxic, n_clean), long[k]) for k in range(4)]
        # A term used twice weighs at least about as much as one used once.
        out += single + [drawn(sum(counts.get(8 * t + 4 + k, (0, 0))), _log_odds(*counts.get(8 * t + 4 + k, (0, 0)), n_toxic, n_clean), single[k]) for k in range(4)]
    return out


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    automaton: Automaton
    weights: list[float]
    prior: float


def _hits(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for batch in slices(batches, "text"):
            for y, codes in zip(batch.column("y").to_pylist(), _features(Automaton(*automaton.value), batch.column("text").to_pylist()), strict=True):
                for code in codes:
                    counts[code, y] = counts.get((code, y), 0) + 1
        yield pa.record_batch({"code": pa.array([c for c, _ in counts], pa.int32()), "y": pa.array([y for _, y in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})
        give_back()

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> Model:
    """Lexicon and weights from at most about ``labelled`` labelled rows, taken by a hash of their id; fold 0 is never used."""
    spark = docs.sparkSession
    known = labels.filter("toxic is not null").select(F.col(id_col).cast("bigint").alias("id"), F.col("toxic").cast("int").alias("y")).filter("id is not null")
    # Ids and texts that are labelled both ways count as toxic, in whatever order they come.
    known = known.groupBy("id").agg(F.max("y").alias("y")).filter(~held_out(F.col("id")))
    part = min(1.0, labelled / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(part * 1_000_000))
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = materialize(base.join(F.broadcast(known), "id").filter("text <> ''").groupBy("text").agg(F.max("y").alias("y")), "toxicity-sample")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model([], build([]), [], math.log((n_toxic + 0.5) / (n_clean + 0.5)))
    stems = materialize(sample.filter("y = 1").mapInArrow(_toxic_candidates(), "term string, cluster bigint").groupBy("term").agg(F.countDistinct("cluster").alias("n")), "stems")
    tried = stems.count()
    # Every candidate that could pass the test, were it never seen in a clean text: bounded by the labelled rows alone.
    share = n_toxic / (n_toxic + n_clean)
    fewest = _bar(tried) / math.log10(share)
    frequent = {r["term"]: r["n"] for r in stems.filter(F.col("n") > F.lit(fewest)).collect()}
    wanted = spark.sparkContext.broadcast(frozenset(frequent))
    clean = {r["term"]: r["n"] for r in sample.filter("y = 0").mapInArrow(_count_terms(wanted), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    terms = choose_terms([(t, n, clean.get(t, 0)) for t, n in frequent.items()], share, tried)
    automaton = build(terms)
    shared = spark.sparkContext.broadcast(astuple(automaton))
    counts: dict[int, list[int]] = {}
    for r in sample.mapInArrow(_hits(shared), "code int, y int, n bigint").groupBy("code", "y").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["code"], [0, 0])[r["y"] == 0] += r["n"]
    weights = weigh({k: tuple(v) for k, v in counts.items()}, [len(t) for t, _ in terms], n_toxic, n_clean)
    return Model(terms, automaton, weights, math.log(n_toxic / n_clean))


def held_out(key):
    """Fold 0 of 5: crc32 of the id as text."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, automaton, weights, prior = model.value
        m = Model(terms, Automaton(*automaton), weights, prior)
        for batch in slices(batches, "text"):
            scores, spotted = [], []
            for codes in _features(m.automaton, [t or "" for t in batch.column("text").to_pylist()]):
                logit = max(-30.0, min(30.0, m.prior + sum(m.weights[c] for c in sorted(codes))))
                scores.append(round(1 / (1 + math.exp(-logit)), 9))
                spotted.append(sorted({m.terms[c // 8][0] for c in codes}))
            yield pa.record_batch({"id": batch.column("id"), "score": pa.array(scores, pa.float64()), "terms": pa.array(spotted, pa.list_(pa.string()))})
        give_back()

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, terms (the lexicon terms found).

    Only the text is scored.  Defined cases: a null or empty text has the score of a text without hits; an empty table gives
    an empty result; without both labels every text has the same score; a null id is never held out; repeated rows are scored
    row by row; other columns are ignored; long texts are read whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(astuple(fit(docs, labels, id_col, text_col, labelled)))
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = base.mapInArrow(_score(model), "id bigint, score double, terms array<string>")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "terms")
