"""Audio columns: chroma fingerprints and the alignment of recordings.

A recording is turned into frames of twelve pitch-class energies.  Filters over an integral image of frames and pitch
classes compare areas; each gives two bits, and sixteen of them one 32-bit integer for each place in time.  Two recordings
are aligned by histograms of offsets: an index of the leading bits of two integers a few frames apart finds where they
agree, every agreement votes for an offset, and each offset with enough votes is judged by the share of differing bits.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import materialize, worker_cache

RATE, FRAME, HOP = 4000, 512, 256
NOTE = 512
#: (kind, lowest pitch class, pitch classes, frames) of the filters; kinds as in ``area_difference``.
FILTERS = [(k, y, h, w) for k, y, h, w in [
    (0, 0, 3, 15), (1, 0, 4, 14), (1, 4, 4, 14), (1, 8, 4, 11), (2, 0, 4, 8), (2, 4, 4, 8), (2, 8, 4, 8), (3, 0, 6, 4),
    (3, 3, 6, 8), (3, 6, 6, 4), (4, 0, 6, 10), (4, 3, 6, 6), (4, 6, 6, 16), (5, 0, 6, 9), (5, 6, 6, 9), (2, 0, 12, 4),
]]
WIDEST = 16
#: Filter values at which the two bits of a filter change.
STEPS = (-0.06, 0.0, 0.06)
ALIGN_BITS = 16
#: Frames between the two integers whose leading bits make a key of the index, and the votes that an offset needs.
GAPS, LEAST_HITS = (3, 4), 2
#: Integers that have to overlap at least, and their share of the shorter recording.
LEAST_OVERLAP, LEAST_SHARE = 16, 0.5
MOST_ERRORS = 0.15
#: Keys and padded integers of queries up to which their index is broadcast; a larger one is joined by its keys.
BROADCAST_KEYS = 4_000_000
#: Frames that are transformed at once.
FRAMES = 4096


def to_wav(samples) -> bytes:
    """A mono 16-bit WAV file of samples in [-1, 1]."""
    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def from_wav(data: bytes):
    """Samples in [-1, 1] of a WAV file, mixed to mono and taken at RATE by the nearest sample; None where it isn't PCM."""
    import numpy as np

    try:
        with wave.open(io.BytesIO(data)) as w:
            channels, rate, width, frames = w.getnchannels(), w.getframerate(), w.getsampwidth(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if not rate or not channels or width not in (1, 2, 3, 4):
        return None
    frames = frames[: len(frames) // (width * channels) * width * channels]
    if width == 1:
        samples = (np.frombuffer(frames, np.uint8).astype(np.float64) - 128) / 128
    else:
        # Samples of any width as the high bytes of 32-bit integers.
        wide = np.zeros((len(frames) // width, 4), np.uint8)
        wide[:, 4 - width :] = np.frombuffer(frames, np.uint8).reshape(-1, width)
        samples = wide.view("<i4").ravel().astype(np.float64) / 2**31
    if channels > 1:
        samples = samples.reshape(-1, channels).mean(1)
    if rate != RATE and len(samples):
        samples = samples[(np.arange(int(len(samples) * RATE / rate)) * rate / RATE).astype(np.int64)]
    return samples


def melody(values) -> bytes:
    """A WAV file that plays a vector: one note a value, its pitch a semitone for each 0.025, over two octaves from A3."""
    import numpy as np

    values = np.nan_to_num(np.asarray(values, np.float64))
    pitch = np.floor(values * 40).astype(np.int64) % 24
    cache = worker_cache("notes", "media")
    if "table" not in cache:
        t = np.arange(NOTE) / RATE
        cache["table"] = np.stack([0.6 * np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t) for p in range(24)])
    return to_wav(cache["table"][pitch].ravel())


def chroma(samples):
    """Energies (frames, 12) by pitch class, smoothed over frames and normalised; silence is all zeros."""
    import numpy as np

    if len(samples) < FRAME:
        return np.zeros((0, 12))
    cache = worker_cache("chroma", "media")
    if "map" not in cache:
        freq = np.fft.rfftfreq(FRAME, 1 / RATE)
        used = np.flatnonzero((freq >= 80) & (freq <= 1760))
        classes = np.zeros((len(freq), 12))
        classes[used, np.round(12 * np.log2(freq[used] / 440)).astype(int) % 12] = 1
        cache["map"] = classes, np.hanning(FRAME)
    classes, window = cache["map"]
    n = (len(samples) - FRAME) // HOP + 1
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[:: HOP][:n]
    energy = np.concatenate([np.abs(np.fft.rfft(frames[i : i + FRAMES] * window, axis=1)) ** 2 @ classes for i in range(0, n, FRAMES)])
    padded = np.pad(energy, ((2, 2), (0, 0)))
    smooth = sum(c * padded[i : i + n] for i, c in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-6), 0.0)


def fingerprint(samples):
    """uint32 integers, one for each frame at which the widest filter fits."""
    import numpy as np

    image = chroma(samples)
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(0).cumsum(1)
    x = np.arange(n)

    def area(x1, y1, x2, y2):
        return integral[x2, y2] - integral[x1, y2] - integral[x2, y1] + integral[x1, y1]

    def area_difference(kind, y, h, w):
        if kind == 0:  # the whole area
            return area(x, y, x + w, y + h), 0.0
        if kind == 1:  # upper against lower half
            return area(x, y + h // 2, x + w, y + h), area(x, y, x + w, y + h // 2)
        if kind == 2:  # later against earlier half
            return area(x + w // 2, y, x + w, y + h), area(x, y, x + w // 2, y + h)
        if kind == 3:  # opposite quarters
            a = area(x, y + h // 2, x + w // 2, y + h) + area(x + w // 2, y, x + w, y + h // 2)
            return a, area(x, y, x + w // 2, y + h // 2) + area(x + w // 2, y + h // 2, x + w, y + h)
        if kind == 4:  # the middle third of the pitch classes against the others
            a = area(x, y + h // 3, x + w, y + 2 * h // 3)
            return a, area(x, y, x + w, y + h // 3) + area(x, y + 2 * h // 3, x + w, y + h)
        a = area(x + w // 3, y, x + 2 * w // 3, y + h)  # the middle third of the frames against the others
        return a, area(x, y, x + w // 3, y + h) + area(x + 2 * w // 3, y, x + w, y + h)

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        a, b = area_difference(kind, y, h, w)
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0)) - (np.log1p(w * h / 12) if kind == 0 else 0)
        step = np.searchsorted(STEPS, value.round(9), "right").astype(np.uint32)
        out = (out << np.uint32(2)) | (step ^ (step >> np.uint32(1)))  # Gray code: near values differ in one bit
    return out


def _fingerprint():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                heard = (None if a is None else from_wav(a) for a in part.column("audio").to_pylist())
                prints = [None if x is None else fingerprint(x).tobytes() or None for x in heard]
                yield pa.record_batch({"id": part.column("id"), "print": pa.array(prints, pa.binary())})

    return run


def _render():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield pa.record_batch({"id": part.column("id"), "audio": pa.array([None if not v else melody(v) for v in part.column("vector").to_pylist()], pa.binary())})

    return run


def render_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, audio): a WAV file for each vector; null where the vector is null or empty."""
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(_render(), "id bigint, audio binary")


def _popcount(x):
    import numpy as np

    return np.bitwise_count(x).astype(np.int64)


def keys_of(prints):
    """(key, place) of a fingerprint: for each gap, the leading bits of every two integers that far apart."""
    import numpy as np

    lead = prints.astype(np.int64) >> (32 - ALIGN_BITS)
    keys, places = [], []
    for number, gap in enumerate(GAPS):
        n = max(0, len(lead) - gap)
        keys.append((np.int64(number) << 2 * ALIGN_BITS) | (lead[:n] << ALIGN_BITS) | lead[gap : gap + n])
        places.append(np.arange(n))
    return np.concatenate(keys), np.concatenate(places)


def align(query, other):
    """(offset, bit errors, bits compared, hits) of the best offset with enough votes, or None."""
    import numpy as np

    index = Index([(0, query.tobytes())])
    found = index.search(other)
    return None if not len(found["query"]) else tuple(int(found[k][0]) for k in ("offset", "bit_errors", "bits", "hits"))


def judge(query, other, offset: int, votes: int):
    """Bit errors over the overlap of two fingerprints at an offset (of ``other`` against ``query``)."""
    a, b = max(0, -offset), max(0, offset)
    n = min(len(query) - a, len(other) - b)
    if n < max(LEAST_OVERLAP, LEAST_SHARE * min(len(query), len(other))):
        return None
    errors = int(_popcount(query[a : a + n] ^ other[b : b + n]).sum())
    return offset, errors, 32 * n, votes


FOUND = ("offset", "bit_errors", "bits", "hits")
MATCH = "query_class bigint, match_class bigint, offset int, bit_errors bigint, bits bigint, hits bigint"


class Index:
    """Fingerprints of queries (name, bytes) with their keys in order."""

    def __init__(self, queries):
        import numpy as np

        prints = [np.frombuffer(p, np.uint32) for _, p in queries]
        self.names, self.sizes = np.array([n for n, _ in queries], np.int64), np.array([len(p) for p in prints], np.int64)
        self.prints = np.zeros((len(prints), int(self.sizes.max(initial=0))), np.uint32)
        for row, p in zip(self.prints, prints, strict=True):
            row[: len(p)] = p
        pairs = [keys_of(p) for p in prints]
        empty = np.zeros(0, np.int64)
        keys, place = np.concatenate([empty, *(k for k, _ in pairs)]), np.concatenate([empty, *(x for _, x in pairs)])
        owner = np.repeat(np.arange(len(prints)), [len(k) for k, _ in pairs])
        order = np.argsort(keys, kind="stable")
        self.keys, self.place, self.owner = keys[order], place[order], owner[order]

    def search(self, other) -> dict:
        """The best offset of each query that aligns with ``other``."""
        import numpy as np

        keys, places = keys_of(other)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        count = high - low
        at = np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count)
        span = self.prints.shape[1] + len(other) + 1
        code, votes = np.unique(self.owner[at] * span + np.repeat(places, count) - self.place[at] + self.prints.shape[1], return_counts=True)
        code, votes = code[votes >= LEAST_HITS], votes[votes >= LEAST_HITS]
        return self.judged(code // span, code % span - self.prints.shape[1], votes, other)

    def judged(self, query, offset, votes, other) -> dict:
        """Of the offsets that have few enough bit errors the best of each query: fewest errors, then the nearest."""
        import numpy as np

        errors, bits = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        across = np.arange(self.prints.shape[1])
        step = max(1, (1 << 20) // max(1, len(across)))
        for i in range(0, len(query), step):
            q, to = query[i : i + step], across[None, :] + offset[i : i + step, None]
            valid = (to >= 0) & (to < len(other)) & (across[None, :] < self.sizes[q][:, None])
            differ = self.prints[q] ^ other[np.clip(to, 0, max(0, len(other) - 1))]
            errors[i : i + step] = (_popcount(differ) * valid).sum(1)
            bits[i : i + step] = 32 * valid.sum(1)
        enough = bits >= 32 * np.maximum(LEAST_OVERLAP, LEAST_SHARE * np.minimum(self.sizes[query], len(other)))
        good = np.flatnonzero(enough & (errors <= MOST_ERRORS * bits))
        good = good[np.lexsort((offset[good], np.abs(offset[good]), errors[good] / np.maximum(1, bits[good]), query[good]))]
        good = good[np.append(True, query[good][1:] != query[good][:-1])[: len(good)]]
        return {"query": query[good], "offset": offset[good], "bit_errors": errors[good], "bits": bits[good], "hits": votes[good]}


def _rows(parts: list[tuple], match: list) -> pa.RecordBatch:
    """Results of searches: (names of queries, found) for each recording in ``match``."""
    import numpy as np

    def column(values, kind):
        return pa.array(np.concatenate([np.zeros(0, np.int64), *values]).astype(np.int64), pa.int64()).cast(kind)

    kinds = {"offset": pa.int32(), "bit_errors": pa.int64(), "bits": pa.int64(), "hits": pa.int64()}
    names = {"query_class": column([n for n, _ in parts], pa.int64()), "match_class": pa.array([m for m, (n, _) in zip(match, parts, strict=True) for _ in range(len(n))], pa.int64())}
    return pa.record_batch(names | {k: column([f[k] for _, f in parts], t) for k, t in kinds.items()})


def _search(queries):
    """Search the broadcast index with every recording."""
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        cache = worker_cache("index", "media")
        if token not in cache:
            cache.clear()
            cache[token] = Index(queries.value)
        index = cache[token]
        for batch in batches:
            found = [index.search(np.frombuffer(p, np.uint32)) for p in batch.column("print").to_pylist()]
            yield _rows([(index.names[f["query"]], f) for f in found], batch.column("rep").to_pylist())

    return run


def _keys():
    """One row for each key of a recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for rep, p in zip(batch.column("rep").to_pylist(), batch.column("print").to_pylist(), strict=True):
                keys, places = keys_of(np.frombuffer(p, np.uint32))
                yield pa.record_batch({"rep": pa.array([rep] * len(keys), pa.int64()), "key": pa.array(keys), "place": pa.array(places.astype(np.int32))})

    return run


def _judge():
    """The best offset of each pair of recordings, given its offsets with their votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            parts, match = [], []
            for row in batch.to_pylist():
                index = Index([(row["query_class"], row["query_print"])])
                offset, votes = (np.array([o[k] for o in row["offsets"]], np.int64) for k in ("offset", "hits"))
                found = index.judged(np.zeros(len(offset), np.int64), offset, votes, np.frombuffer(row["match_print"], np.uint32))
                parts.append((index.names[found["query"]], found))
                match.append(row["match_class"])
            yield _rows(parts, match)

    return run


def _joined(classes: DataFrame) -> DataFrame:
    """Matches by a join of the queries' keys with all keys; votes are counted before anything is shuffled by pair."""
    index = classes.mapInArrow(_keys(), "rep bigint, key bigint, place int")
    asked = classes.filter("asked").mapInArrow(_keys(), "rep bigint, key bigint, place int")
    pairs = index.select("key", F.col("rep").alias("match_class"), "place").join(asked.select("key", F.col("rep").alias("query_class"), F.col("place").alias("query_place")), "key")
    votes = pairs.groupBy("query_class", "match_class", (F.col("place") - F.col("query_place")).alias("offset")).agg(F.count("*").alias("hits")).filter(F.col("hits") >= LEAST_HITS)
    each = votes.groupBy("query_class", "match_class").agg(F.collect_list(F.struct("offset", "hits")).alias("offsets"))
    each = each.join(classes.filter("asked").select(F.col("rep").alias("query_class"), F.col("print").alias("query_print")), "query_class")
    each = each.join(classes.select(F.col("rep").alias("match_class"), F.col("print").alias("match_print")), "match_class")
    return each.mapInArrow(_judge(), MATCH)


def match_recordings(media: DataFrame, id_col: str = "id", audio_col: str = "audio", every: int = 100) -> tuple[DataFrame, DataFrame]:
    """(members, matches) of a search of every recording whose id is divisible by ``every`` against all recordings.

    ``members`` has (id, class_id, n_prints): recordings with equal fingerprints are one class, named by its smallest id.
    ``matches`` has, for each class that holds a query, the other classes it aligns with: the offset in frames, bit errors,
    bits compared, and the hits of the best offset: recordings align when at some offset they overlap by 16 integers and half
    of the shorter one at least, with at most 15 % of the bits differing.  Copies aren't expanded into pairs: they share a
    class.  Defined cases: null audio, audio too short for a fingerprint, and bytes that are no PCM WAV file have no class
    and no match; an empty table gives empty results;
    repeated rows share a class; null ids take part but never name a class with other ids; other columns are ignored.
    """
    prints = media.select(F.col(id_col).cast("bigint").alias("id"), F.col(audio_col).alias("audio")).mapInArrow(_fingerprint(), "id bigint, print binary")
    prints = materialize(prints, "prints")
    known = prints.filter("print is not null")
    classes = known.groupBy("print").agg(F.min("id").alias("rep"), F.max(F.coalesce(F.col("id") % every == 0, F.lit(False))).alias("asked"))
    classes = materialize(classes, "print-classes")
    # A class can go without a name (all its ids are null): it is searched for, but can't be asked for.
    asked = classes.filter("asked")
    size = asked.agg(F.count("*").alias("n"), F.max(F.length("print") / 4).alias("longest")).first()
    if size["n"] * (size["longest"] or 0) * len(GAPS) <= BROADCAST_KEYS:
        queries = media.sparkSession.sparkContext.broadcast([(r["rep"], bytes(r["print"])) for r in asked.select("rep", "print").collect()])
        found = classes.select("rep", "print").mapInArrow(_search(queries), MATCH)
    else:
        found = _joined(classes)
    found = found.filter("match_class is null or query_class <> match_class")
    heavy = known.groupBy("print").count().filter(F.col("count") > F.greatest(F.lit(1000.0), F.lit(prints.count() * 0.001))).select("print")
    sized = classes.select("print", "rep")
    hot = known.join(F.broadcast(sized.join(F.broadcast(heavy), "print")), "print").select("id", "print", "rep")
    rest = known.join(F.broadcast(heavy), "print", "left_anti").join(sized, "print").select("id", "print", "rep")
    none = prints.filter("print is null").select("id", "print", F.lit(None).cast("bigint").alias("rep"))
    members = hot.union(rest).union(none).select("id", F.col("rep").alias("class_id"), F.coalesce(F.length("print") / 4, F.lit(0)).cast("bigint").alias("n_prints"))
    return members, found


def media_search(media: DataFrame, id_col: str = "id", audio_col: str = "audio", every: int = 100) -> DataFrame:
    """Both results of ``match_recordings`` in one table: kind 'member' (id, class_id, n_prints) or 'match'."""
    members, found = match_recordings(media, id_col, audio_col, every)
    empty = F.lit(None).cast("bigint")
    one = members.select(F.lit("member").alias("kind"), "id", "class_id", "n_prints", *(empty.alias(c) for c in ("match_class", "offset", "bit_errors", "bits", "hits")))
    two = found.select(F.lit("match").alias("kind"), empty.alias("id"), F.col("query_class").alias("class_id"), empty.alias("n_prints"), "match_class", F.col("offset").cast("bigint").alias("offset"), "bit_errors", "bits", "hits")
    return one.union(two)
