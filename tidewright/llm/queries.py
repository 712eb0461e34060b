"""The training-data operators on their whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import read_table
from tidewright.llm.exact_dedup import exact_dedup
from tidewright.llm.media import media_search, render_vectors
from tidewright.llm.mixing import mix
from tidewright.llm.near_dedup import near_duplicates
from tidewright.llm.packing import pack
from tidewright.llm.quality import importance_resample
from tidewright.llm.suffix_dedup import remove_repeats
from tidewright.llm.token_counts import token_counts
from tidewright.llm.toxicity import toxicity
from tidewright.llm.warc import archive_round_trip


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_round_trip(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix(read_table(spark, sf_dir, "documents"), target_entropy=0.95, max_repeats=4.0, budget_passes=1.0)
    return drawn.select("doc_id", "source", "mix_tokens", F.round("mix_weight", 6).alias("mix_weight"), F.round("mix_passes", 6).alias("mix_passes"), "mix_block", "mix_position", "mix_copies")


def op5_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_search(render_vectors(read_table(spark, sf_dir, "embeddings")))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), length=400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_grams", F.round("log_weight", 4).alias("log_weight"), F.round("gumbel_key", 4).alias("gumbel_key"), "selected")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archive": op1_warc_archive,
    "op2_token_counts": op2_token_counts,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_temperature_mixing": op4_temperature_mixing,
    "op5_chroma_fingerprints": op5_chroma_fingerprints,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_importance_resampling": op7_importance_resampling,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op1_warc_archive": r"""
SELECT page_id, strlen(p) AS payload_bytes, sha256(p) AS payload_digest,
       CASE WHEN strlen(p) >= 100 AND page_id <> min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p) >= 100 AND page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS p FROM pages)
WINDOW w AS (PARTITION BY p)
""",
    "op8_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
WINDOW w AS (PARTITION BY n)
""",
}
