"""Token counts of whole texts: a map-side lookup in two tiers, without any shuffle of pre-tokens.

A pre-token is a run of spaces and the non-spaces after it.  No piece of the vocabulary holds a space after another
character, and none holds a line feed, so pre-tokens (and what follows a line feed) are encoded independently.  Tier one is
a compact table of the corpus' frequent pre-tokens and their token counts, of bounded size, broadcast once.  Tier two is a bounded cache in each Python worker
that lives on between tasks; only what both miss is encoded.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import slices, worker_cache

MARK = "▁"
#: Entries of a worker's cache (about 100 bytes each) and the longest pre-token that is kept in it.
CACHE_ENTRIES, CACHE_LONGEST = 400_000, 200
MAX_FREQUENT = 65_536
#: Texts whose pre-tokens are counted for the table of frequent ones.
SAMPLE = 4_000


def _model(path: str):
    import sentencepiece

    cache = worker_cache("sentencepiece", "token_counts")
    if path not in cache:
        cache[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return cache[path]


def separable(model) -> bool:
    """Whether texts can be cut at spaces and line feeds without changing how they are encoded."""
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    inner = any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
    return not inner and model.encode("a  b ", out_type=str)[-1] == MARK and model.encode("１ ﬁ") == model.encode(MARK.join(["１", "ﬁ"]))


def frequent_units(docs: DataFrame, limit: int = MAX_FREQUENT, sample: int = SAMPLE) -> list[str]:
    """The most frequent pre-tokens of about ``sample`` texts of ``docs(text)``, taken by a hash: at most ``limit``.

    The table only saves time: what it lacks is encoded, so counts don't depend on the sample.
    """
    share = min(1.0, sample / max(1, docs.count()))
    taken = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    cut = F.split(F.replace(F.replace(F.col("text"), F.lit(MARK), F.lit(" ")), F.lit("\n"), F.lit(" \n")), " ")
    units = taken.select(F.explode(cut).alias("unit")).filter(F.length("unit").between(1, CACHE_LONGEST))
    return [r["unit"] for r in units.groupBy("unit").count().orderBy(F.desc("count"), "unit").limit(limit).collect()]


def frequent_table(path: str, units: list[str]) -> tuple[str, bytes]:
    """Pre-tokens joined by spaces, which none of them holds, and their token counts, four bytes each."""
    model = _model(path)
    counts = [len(x) - u.startswith("\n") for u, x in zip(units, model.encode(units, num_threads=1), strict=True)] if units else []
    return " ".join(units), array("I", counts).tobytes()


def _counter(path: str, table) -> Iterator:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _model(path), worker_cache("piece-counts", "token_counts")
        if path not in cache:
            words, counts = table.value
            cache[path] = dict(zip(words.split(" ") if words else [], array("I", counts), strict=True)), {}, separable(model)
        first, second, cut = cache[path]
        first.setdefault("", 1)
        spaced = re.compile(" +[^ ]*")

        def encode(unit: str) -> int:
            # A unit that starts with a line feed stands without a space before it.
            if unit == "":
                return 1
            return len(model.encode(unit)) - (unit[0] == "\n")

        def count(text: str) -> int:
            if not text:
                return 0
            if not cut:
                return len(model.encode(text))
            if MARK in text:
                text = text.replace(MARK, " ")
            if "  " in text or text[0] == " ":
                # The first space of a unit is what the encoder puts before every text.
                units = []
                for unit in spaced.findall(" " + text):
                    head, *tail = unit[1:].split("\n")
                    units += [head, *("\n" + x for x in tail)]
            else:
                units = text.replace("\n", " \n").split(" ")
            got = list(map(first.get, units))
            total = 0
            if None in got:
                for i, n in enumerate(got):
                    if n is None:
                        unit = units[i]
                        n = second.get(unit)
                        if n is None:
                            n = encode(unit)
                            if len(unit) <= CACHE_LONGEST:
                                if len(second) >= CACHE_ENTRIES:
                                    second.clear()
                                second[unit] = n
                        total += n
                    else:
                        total += n
                return total
            return sum(got)

        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            yield pa.record_batch({"id": batch.column("id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array([count(t) if t else 0 for t in texts], pa.int64())})

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of sentencepiece for the model at ``model_path``, without begin or end tokens; strings that look like
    special tokens are ordinary text, as is the library's default.  Defined cases: a null or empty text has 0 bytes and 0
    tokens; an empty table gives an empty result; ids may be null or repeated; other columns are ignored; long texts are
    counted whole.  Models whose texts can't be cut at spaces are encoded whole.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    # At most MAX_FREQUENT pre-tokens of at most CACHE_LONGEST characters: the broadcast is bounded whatever the corpus.
    table = spark.sparkContext.broadcast(frequent_table(model_path, frequent_units(base)))
    out = base.mapInArrow(_counter(model_path, table), "id bigint, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
