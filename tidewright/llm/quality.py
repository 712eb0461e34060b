"""Quality selection by importance resampling.

A text is modelled as bags of hashed n-grams: of bytes, and of the lengths of consecutive words.  For each kind there are
two generative models, one of target text (rows labelled good) and one of the raw corpus, counted n-gram by n-gram.  A
document's log importance weight is the sum over its n-grams of log p_target - log p_raw.  Documents are sampled without
replacement in proportion to their weights by the Gumbel top-k trick: each log weight gets Gumbel noise, and the k largest
stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm._bytehash import words
from tidewright.llm._common import give_back, materialize, neutral, slices, text_buffer, worker_cache

#: Hash buckets of each kind of n-gram.
BUCKETS = 1 << 16
#: Bytes of a byte n-gram, and words of an n-gram of word lengths (in bytes, 63 at most).
SIZES, LENGTHS = (2, 4), (3, 5)
KINDS = len(SIZES) + len(LENGTHS)
#: Labelled rows that the target model is fitted on at most.
LABELLED = 20_000
#: Expected target n-grams that the raw model stands for in each bucket (the shape of a gamma prior around the raw rate).
PRIOR = 10.0


def _hashed(values, size: int, left):
    """Buckets of the n-grams of ``size`` values from each place on; BUCKETS where fewer are ``left``."""
    import numpy as np

    n = len(values)
    h = np.full(n, size, np.uint32)
    for i in range(min(size, n)):
        h[: n - i] = (h[: n - i] ^ values[i:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    bucket = (h >> np.uint32(16)).astype(np.int32)
    bucket[left < size] = BUCKETS
    return bucket


def _grams(data, offsets):
    """For each kind of n-gram: buckets by place, and the bounds of texts in them."""
    import numpy as np

    def left(bounds):
        return np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])

    wide = data.astype(np.uint32)
    out = [(_hashed(wide, size, left(offsets)), offsets) for size in SIZES]
    starts, ends, first = words(data, offsets)
    lengths = np.minimum(ends - starts, 63).astype(np.uint32)
    return out + [(_hashed(lengths, size, left(first)), first) for size in LENGTHS]


def _count():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        worker_cache("none", "quality")  # drops what other operators left in this worker
        raw, target = np.zeros((KINDS, BUCKETS + 1), np.int64), np.zeros((KINDS, BUCKETS + 1), np.int64)
        for batch in slices(batches, "text", 1 << 20):
            marked = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for kind, (grams, bounds) in enumerate(_grams(*text_buffer(batch.column("text")))):
                raw[kind] += np.bincount(grams, minlength=BUCKETS + 1)
                target[kind] += np.bincount(grams[np.repeat(marked, np.diff(bounds))], minlength=BUCKETS + 1)
        raw, target = raw[:, :BUCKETS].ravel(), target[:, :BUCKETS].ravel()
        used = np.flatnonzero(raw)
        yield pa.record_batch({"bucket": pa.array(used.astype(np.int32)), "raw": pa.array(raw[used]), "target": pa.array(target[used])})
        give_back()

    return run


def _weigh(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        worker_cache("none", "quality")
        ratio = np.hstack([np.frombuffer(table.value, np.float64).reshape(KINDS, BUCKETS), np.zeros((KINDS, 1))])
        for batch in slices(batches, "text", 1 << 20):
            weight, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for kind, (grams, bounds) in enumerate(_grams(*text_buffer(batch.column("text")))):
                full = np.flatnonzero(np.diff(bounds))
                if len(full):
                    # Each text is summed on its own, so its weight doesn't depend on its batch.
                    weight[full] += np.add.reduceat(ratio[kind][grams], bounds[full])
                    count[full] += np.add.reduceat((grams < BUCKETS).astype(np.int64), bounds[full])
            yield pa.record_batch({"id": batch.column("id"), "text_key": batch.column("text_key"), "n_grams": pa.array(count), "log_weight": pa.array(np.round(weight, 6))})
        give_back()

    return run


def log_ratios(raw, target):
    """log p_target - log p_raw of each bucket (rows are kinds), from counts of n-grams.

    A bucket's rate in target text has a gamma prior around its raw rate, worth PRIOR expected n-grams, so buckets without
    evidence weigh nothing; the target model is then normalised to 1 over the buckets.
    """
    import numpy as np

    p_raw = (raw + 0.5) / (raw.sum(1, keepdims=True) + 0.5 * BUCKETS)
    expected = target.sum(1, keepdims=True) * p_raw
    p_target = p_raw * (target + PRIOR) / (expected + PRIOR)
    return np.log(p_target / p_target.sum(1, keepdims=True) / p_raw)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED):
    """The log ratios of all buckets, as bytes of float64.

    The raw model counts every n-gram of every document.  The target model is fitted on at most about ``labelled`` rows
    labelled good, taken by a hash of their id, so what is broadcast for it is bounded.  Ids labelled both ways aren't good.
    """
    import numpy as np

    known = labels.filter("quality is not null").groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min("quality").alias("least"))
    good = known.filter("id is not null and least = 1").select("id")
    share = min(1.0, labelled / max(1, good.count()))
    good = good.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).withColumn("hit", F.lit(True))
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = base.join(F.broadcast(good), "id", "left").select("text", F.coalesce("hit", F.lit(False)).alias("target"))
    # Each task sends one count for a bucket at most; KINDS x BUCKETS rows come to the driver.
    rows = marked.mapInArrow(_count(), "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(KINDS * BUCKETS), np.zeros(KINDS * BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.any():
        return np.zeros(KINDS * BUCKETS).tobytes()
    return log_ratios(raw.reshape(KINDS, BUCKETS), target.reshape(KINDS, BUCKETS)).tobytes()


#: Added to whole-number keys, so that they aren't negative.
SHIFT = 1 << 60


def kth_largest(keys: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a bigint column of values from 0 on, by four rounds of 65,536-way counting.

    Each round brings at most 65,536 counts to the driver; nothing is sorted or collected whole.
    """
    lowest, width = 0, 64
    while width:
        width -= 16
        part = keys.filter(F.col(column).between(lowest, lowest + (1 << min(63, width + 16)) - 1 if lowest or width < 48 else (1 << 63) - 1))
        slots = part.groupBy(F.shiftright(F.col(column) - F.lit(lowest), width).alias("slot")).count().collect()
        for slot, n in sorted(((r["slot"], r["count"]) for r in slots), reverse=True):
            if n >= k:
                lowest += slot << width
                break
            k -= n
    return lowest


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_grams, log_weight, gumbel_key, selected, text_key.

    The key is the log weight plus standard Gumbel noise, and the ``k`` rows with the largest keys are selected; by default
    ``k`` is the number of rows that the target model finds at least as likely as the raw model does (log weight 0 or more).
    Defined cases: a null or empty text has weight 0; an empty table gives an empty result; without good labels every weight
    is 0; rows of equal id and text get equal keys, and all rows that tie with the k-th key are selected; null ids take
    part, but labels of null ids count for nothing; other columns are ignored.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    weights = base.mapInArrow(_weigh(table), "id bigint, text_key bigint, n_grams bigint, log_weight double")
    unit = (F.pmod(F.xxhash64(F.coalesce("id", F.lit(-1)), "text_key", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(unit)))
    # Keys as whole numbers, so that the cut is exact.
    keyed = materialize(keyed.withColumn("ordinal", F.round(F.col("gumbel_key") * 1e6).cast("bigint") + F.lit(SHIFT)), "weights")
    sizes = keyed.agg(F.count("*").alias("rows"), F.count_if(F.col("log_weight") >= 0).alias("likely")).first()
    k = sizes["likely"] if k is None else k
    if k <= 0:
        chosen = F.lit(False)
    elif k >= sizes["rows"]:
        chosen = F.lit(True)
    else:
        chosen = F.col("ordinal") >= kth_largest(keyed, "ordinal", k)
    return keyed.select(F.col("id").alias(id_col), "n_grams", "log_weight", "gumbel_key", chosen.alias("selected"), "text_key")


def quality_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the sampling selects, in the columns of ``docs``."""
    # What is rejected is the smaller part; the join keeps every other row, repeated ones too.
    gone = importance_resample(docs, labels, id_col=id_col, text_col=text_col).filter("not selected").select(F.col(id_col).alias("id"), "text_key").distinct()
    rows, names = neutral(docs)
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    same = key.cast("bigint").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("text_key"))
    return rows.join(gone, same, "left_anti").select(*names)
