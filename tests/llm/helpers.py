"""Brute-force versions of the operators and a table of awkward rows."""

from __future__ import annotations

import random
import re

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(f"[^{SPACE}]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, text_key string, digest string, kept boolean, source_key string, mix_copies int, node string"


def table(spark, rows):
    """A documents table of (doc_id, text, source), with extra columns whose names operators use for themselves."""
    return spark.createDataFrame([(i, t, "en", s, 0, 5, "k", "d", False, "x", 9, "n") for i, t, s in rows], SCHEMA)


def awkward(seed=1):
    """Nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    base = [word() for _ in range(120)]
    rows = [(1, None, "a"), (2, "", "a"), (3, "   \n", None), (4, "one two", "b"), (4, "one two", "b"), (None, "one  two", "b"), (None, None, None)]
    for i in range(10, 30):
        near = list(base)
        for _ in range(r.randint(0, 6)):
            near[r.randrange(len(near))] = word()
        rows.append((i, r.choice([" ", "\n", "  "]).join(near), "a"))
    for i in range(30, 60):
        rows.append((i, " ".join(word() for _ in range(r.randint(1, 80))), r.choice("abc")))
    rows += [(60 + i, rows[20][1], "c") for i in range(5)]
    rows.append((70, " ".join(word() for _ in range(6000)), "c"))
    return rows


def normal(text):
    return re.sub(f"[{SPACE}]+", " ", text or "")


def shingles(text, k=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(rows):
    """component of each row by linking all pairs."""
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    lowest = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], len(sets[i]), lowest[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def repeats(texts, length):
    """For each text (bytes, removed, spans, kept) by counting every window."""
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - length + 1):
            count[d[i : i + length]] = count.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return out


def key(row):
    return tuple((x is None, str(x)) for x in row)
