"""Identity columns: derived 128-bit ids, exact milli-unit quantities, vector arithmetic, seeded choices."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Personalisation of derived ids.
PERSON = b"tidewright-id-1"
BYTES = 16


def digest(*parts: bytes, person: bytes = PERSON) -> bytes:
    """BLAKE2b-128 of length-framed parts."""
    h = hashlib.blake2b(digest_size=BYTES, person=person)
    for part in parts:
        h.update(len(part).to_bytes(4, "big") + part)
    return h.digest()


def derived_id(kind: str, *columns: Column, person: bytes = PERSON) -> Column:
    """Lower-case hex of the id derived from a kind and the text of columns; SQL has no keyed BLAKE2, so batches go to Python."""

    @F.pandas_udf("string")
    def run(joined: pd.Series) -> pd.Series:
        return joined.map(lambda parts: digest(kind.encode(), *(p.encode() for p in parts), person=person).hex())

    return run(F.array(*(c.cast("string") for c in columns)))


def milli(text: Column) -> Column:
    """Milli-units of a decimal text; more than three decimals, signs and other forms are errors, never rounded."""
    valid = text.rlike(r"^[0-9]+(\.[0-9]{1,3})?$")
    return F.when(valid, (text.cast("decimal(35,3)") * 1000).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not a quantity in milli-units: "), F.coalesce(text, F.lit("null")))))


def fits(request: Column, capacity: Column) -> Column:
    """Whether a map of requested milli-units fits a map of capacities; what is missing is 0."""
    return F.forall(F.map_entries(request), lambda e: e["value"] <= F.coalesce(F.element_at(capacity, e["key"]), F.lit(0)))


def add_vectors(a: Column, b: Column) -> Column:
    return F.map_filter(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))), lambda _, v: v != 0)


def subtract_vectors(a: Column, b: Column) -> Column:
    """a - b by key; a negative amount is an error."""
    left = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    checked = F.transform_values(left, lambda k, v: F.when(v < 0, F.raise_error(F.concat(F.lit("underflow of "), k)).cast("bigint")).otherwise(v))
    return F.map_filter(checked, lambda _, v: v != 0)


def seeded_choice(rows: DataFrame, key: str, candidates: str, top_k: int, fraction: float = 0.0, cluster: str | None = None, seed: int = 42) -> DataFrame:
    """``rows`` with chosen: one of the first min(n, max(1, top_k, int(cluster * fraction))) candidates of each row.

    Each key has its own stream, seeded by the seed and the key, so that choices don't depend on how rows are dealt out.
    """

    @F.pandas_udf("bigint")
    def run(keys: pd.Series, ranked: pd.Series, sizes: pd.Series) -> pd.Series:
        def pick(k: object, nodes: Sequence[int], size: int) -> int | None:
            if nodes is None or not len(nodes):
                return None
            return int(random.Random(f"{seed}:{k}").choice(list(nodes)[: min(len(nodes), max(1, top_k, int(size * fraction)))]))

        return pd.Series([pick(*x) for x in zip(keys, ranked, sizes, strict=True)], dtype="Int64")

    return rows.withColumn("chosen", run(F.col(key), F.col(candidates), F.col(cluster) if cluster else F.lit(0)))


def seeded_rank(key: Column, eligible: int, seed: int = 42) -> Column:
    """The place, from 0, that ``seeded_choice`` draws among ``eligible`` candidates; null without any."""

    @F.pandas_udf("bigint")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series([random.Random(f"{seed}:{k}").choice(range(eligible)) if eligible else None for k in keys], dtype="Int64")

    return run(key)
