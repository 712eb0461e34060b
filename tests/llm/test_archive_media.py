import hashlib
import math

import pytest

from helpers import key
from tidewright.llm import media
from tidewright.llm.warc import archive_round_trip, export_warc, import_warc, parse_records, parse_warc, read_archive, write_archive

PAGES = [(3, "http://x/3", "p" * 200), (1, "http://x/1", "p" * 200), (2, None, "small"), (5, "u", "small"), (6, "http://x/6", None), (7, "http://x/7", ""), (9, "http://é/9", "é\r\n\r\nWARC/1.1" * 20),
         (10, "http://x/10", "é\r\n\r\nWARC/1.1" * 20), (None, "n", "p" * 200), (1, "http://x/1", "p" * 200), (12, "http://x/12", "q" * 5000)]


def pages(spark):
    return spark.createDataFrame([(i, u, h, "e", "r") for i, u, h in PAGES], "page_id bigint, url string, html string, digest string, record_type string")


def expected():
    out = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        keep = min(j for j, _, k in PAGES if (k or "") == (h or "") and j is not None)
        again = len(data) >= 100 and i != keep
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", keep if again else None))
    return out


def test_archive_round_trip(spark):
    got = archive_round_trip(pages(spark))
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=key) == sorted(expected(), key=key)
    assert sorted(((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in got.collect()), key=key) == sorted(((i, u, h or "") for i, u, h in PAGES), key=key)
    assert archive_round_trip(pages(spark).limit(0)).count() == 0


def test_payloads_are_stored_once_and_damage_is_seen(spark, tmp_path):
    path = str(tmp_path / "archive")
    write_archive(pages(spark), path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    assert read_archive(spark, path).filter("not verified").count() == 0
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast(concat('x', cast(payload as string)) as binary) as payload")
    bad.write.parquet(f"{path}/other")
    import shutil

    shutil.rmtree(f"{path}/payloads")
    shutil.move(f"{path}/other", f"{path}/payloads")
    assert read_archive(spark, path).filter("verified").count() == 0


def test_plain_warc_files(spark, tmp_path):
    path, target = str(tmp_path / "archive"), str(tmp_path / "warc")
    write_archive(pages(spark), path)
    export_warc(spark, path, target)
    got = import_warc(spark, f"{target}/part-*").collect()
    again = read_archive(spark, path).collect()
    assert sorted((r["header"], bytes(r["payload"])) for r in got) == sorted((r["header"], bytes(r["payload"])) for r in again)
    assert all("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in r["header"] for r in got)
    assert list(parse_warc(b"")) == [] and list(parse_warc(b"\r\n\r\n")) == []


def test_empty_archive_as_plain_files(spark, tmp_path):
    write_archive(pages(spark).limit(0), str(tmp_path / "archive"))
    export_warc(spark, str(tmp_path / "archive"), str(tmp_path / "warc"))
    assert import_warc(spark, str(tmp_path / "warc")).count() == 0


def test_records_in_chunks_of_any_size_and_broken_files():
    one = b"WARC/1.1\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n"
    data = one * 3
    for size in (1, 2, 7, 1000):
        got = list(parse_records(data[i : i + size] for i in range(0, len(data), size)))
        assert got == [("WARC/1.1\r\nContent-Length: 5\r\n\r\n", b"a\r\n\r\n")] * 3
    for bad in (one[:20], one[:34], b"WARC/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(parse_warc(bad))


def test_hot_payloads_are_read_in_parts(spark, tmp_path):
    from pyspark.sql import functions as F

    many = spark.range(6000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("h" * 150)).otherwise(F.concat(F.lit("p"), "id")).alias("html"))
    write_archive(many, str(tmp_path / "archive"))
    got = read_archive(spark, str(tmp_path / "archive"))
    assert got.count() == 6000 and got.filter("not verified").count() == 0 and got.filter("record_type = 'revisit' and refers_to = 0").count() == 1999


def tune(seed, n=64):
    import numpy as np

    return np.random.default_rng(seed).normal(0, 0.3, n)


def test_fingerprint_is_stable_and_silence_is_empty_of_notes():
    import numpy as np

    wav = media.melody(tune(1))
    assert (media.fingerprint(media.from_wav(wav)) == media.fingerprint(media.from_wav(wav))).all()
    assert len(media.fingerprint(np.zeros(100))) == 0
    assert len(set(media.fingerprint(np.zeros(40_000)).tolist())) == 1


def test_align_finds_offset_under_noise():
    import numpy as np

    samples = media.from_wav(media.melody(tune(2)))
    rng = np.random.default_rng(0)
    a = media.fingerprint(samples)
    b = media.fingerprint(np.concatenate([media.from_wav(media.melody(tune(9, 8))), samples])[: len(samples)] + rng.normal(0, 0.005, len(samples)))
    offset, errors, bits, votes = media.align(a, b)
    assert offset == 8 * media.NOTE // media.HOP and errors < media.MOST_ERRORS * bits and votes >= media.LEAST_HITS


def _brute(prints, queries):
    """Best alignment of each query with each other class over all offsets: (offset, errors, bits)."""
    out = {}
    for q in queries:
        for o in prints:
            if o == q:
                continue
            a, b = prints[q], prints[o]
            judged = [g for s in range(-len(a), len(b)) if (g := media.judge(a, b, s, 0))]
            good = [g[:3] for g in judged if g[1] <= media.MOST_ERRORS * g[2]]
            if good:
                out[q, o] = min(good, key=lambda g: (g[1] / g[2], abs(g[0]), g[0]))
    return out


@pytest.mark.parametrize("keys", [media.BROADCAST_KEYS, 0])
def test_search_against_brute_force(spark, monkeypatch, keys):
    """Pairs, offsets, errors and votes, with the index of queries broadcast and joined."""
    monkeypatch.setattr(media, "BROADCAST_KEYS", keys)
    import numpy as np

    rng = np.random.default_rng(3)
    rows, prints = [], {}
    for i in range(60):
        samples = media.from_wav(media.melody(tune(i % 20)))
        if i >= 20:
            samples = np.roll(samples, int(rng.integers(0, 30)) * media.HOP) + rng.normal(0, [0.003, 0.02][i % 2], len(samples))
        wav = media.to_wav(samples)
        rows.append((i * 10, bytearray(wav)))
        prints[i * 10] = media.fingerprint(media.from_wav(wav))
    rows += [(7, rows[0][1]), (8, None), (9, bytearray(media.to_wav(np.zeros(50)))), (None, rows[3][1])]
    members, found = media.match_recordings(spark.createDataFrame(rows, "id bigint, audio binary"))
    classes = {r["id"]: r["class_id"] for r in members.collect()}
    assert len(rows) == members.count() and classes[7] == classes[0] == 0 and classes[8] is None and classes[9] is None and classes[None] == 30
    got = {(r["query_class"], r["match_class"]): r for r in found.collect()}
    truth = _brute(prints, [q for q in prints if q % 100 == 0])
    assert truth and set(got) <= set(truth) and len(got) >= 0.9 * len(truth)
    assert sum((r["offset"], r["bit_errors"], r["bits"]) == truth[k] for k, r in got.items()) >= 0.9 * len(got)
    for (q, o), r in got.items():
        (a, x), (b, y) = media.keys_of(prints[q]), media.keys_of(prints[o])
        assert r["hits"] == sum(int((b == k).astype(int) @ (y - p == r["offset"])) for k, p in zip(a, x))


def test_search_of_nothing(spark):
    members, found = media.match_recordings(spark.createDataFrame([], "id bigint, audio binary"))
    assert members.count() == 0 and found.count() == 0
    rendered = media.render_vectors(spark.createDataFrame([(1, None), (2, []), (3, [0.1, math.nan])], "vec_id bigint, embedding array<float>")).collect()
    assert rendered[0]["audio"] is None and rendered[1]["audio"] is None and rendered[2]["audio"] is not None


def test_audio_that_cant_be_read(spark):
    import io
    import wave

    import numpy as np

    samples = media.from_wav(media.melody(tune(4)))
    prints = []
    for width in (1, 2, 3, 4):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(media.RATE)
            whole = np.round(samples * (2 ** (8 * width - 1) - 1)).astype(np.int64)
            raw = (whole + 128).astype(np.uint8) if width == 1 else whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width]
            w.writeframes(raw.tobytes())
        prints.append(media.fingerprint(media.from_wav(out.getvalue())))
    assert all(media.align(prints[1], p)[1] < 0.1 * 32 * len(p) for p in prints)
    rows = [(1, bytearray(b"not audio")), (2, bytearray(b"")), (3, bytearray(media.melody(tune(1))[:60])), (4, bytearray(media.melody(tune(1))))]
    members, found = media.match_recordings(spark.createDataFrame([(i, a, 1, "p") for i, a in rows], "id bigint, audio binary, rep int, print string"))
    assert {r["id"]: r["class_id"] for r in members.collect()} == {1: None, 2: None, 3: None, 4: 4} and found.count() == 0


def test_a_very_long_recording():
    import numpy as np

    samples = np.tile(media.from_wav(media.melody(tune(5))), 60)
    p = media.fingerprint(samples)
    part = media.fingerprint(samples[: len(samples) // 2])
    assert len(p) > 7000 and media.align(p, part)[1] <= 0.15 * 32 * len(part)


@pytest.mark.parametrize("rate", [4000, 8000])
def test_wav_of_other_rates(rate):
    import io
    import wave

    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.zeros(2 * rate, "<i2").tobytes())
    assert len(media.from_wav(out.getvalue())) == media.RATE
