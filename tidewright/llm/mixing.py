"""Temperature mixing of sources, in DataFrame and SQL functions only.

A source's natural share of the tokens is p; its weight is p**a, normalised.  The exponent a is bisected, many parts a step,
until the weights reach a target entropy or the most repeated source reaches a repetition limit.  Weights then become rows by budgeted block
permutations: each source's documents are dealt to blocks of bounded size, every block is permuted by a keyed hash, whole
passes repeat the block, and the rest of the budget takes documents from the start of its permutation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm._common import materialize, neutral

BLOCK_ROWS = 1024
#: Exponents that one step of the bisection tries at once.
STEPS = 32


def token_count(text: Column) -> Column:
    """Words between ASCII white space; the measure of a document's size here."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_shares(rows: DataFrame) -> DataFrame:
    """(source_key, n_docs, n_tokens, share) of ``rows(source_key, tokens)``; a source without tokens has share 0."""
    sizes = materialize(rows.groupBy("source_key").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("n_tokens")), "sizes")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    return sizes.withColumn("share", F.col("n_tokens") / F.lit(float(max(1, total))))


def _largest(shares: DataFrame) -> tuple[int, float]:
    """Number of sources with tokens, and the largest share; powers are taken of shares against it, so they never vanish."""
    r = shares.filter("share > 0").agg(F.count("*").alias("n"), F.max("share").alias("top")).first()
    return r["n"], r["top"] or 1.0


def _moments(shares: DataFrame, top: float, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """Sum of (p / top)**a, entropy, and largest and smallest weight per natural share for each exponent, in one job."""
    p, a = F.col("share") / F.lit(top), F.col("exponent")
    powered = F.pow(p, a)
    each = shares.filter("share > 0").select("share", F.posexplode(F.array(*(F.lit(float(x)) for x in exponents))).alias("number", "exponent"))
    sums = each.groupBy("number").agg(F.sum(powered).alias("z"), F.sum(powered * F.log(p)).alias("zl"), F.max(powered / F.col("share")).alias("most"), F.min(powered / F.col("share")).alias("least"))
    out = [(1.0, 0.0, 0.0, 0.0)] * len(exponents)
    for r in sums.collect():  # a row for each exponent
        z = r["z"]
        out[r["number"]] = z, math.log(z) - exponents[r["number"]] * r["zl"] / z, r["most"] / z, r["least"] / z
    return out


def temperature(shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_passes: float | None = 1.0) -> float:
    """The smallest exponent, bisected, at which weights are as flat as the repetition limit and the target entropy allow.

    ``target_entropy`` is a share of the greatest possible entropy, ``max_repeats`` bounds the passes over the source that is
    repeated most.  ``budget_passes`` is the budget in passes over the whole corpus; None stands for the smallest budget that
    uses each document at least once, and limits the most repeated source against the least.  Below 1 an exponent flattens
    the natural shares; above 1 it sharpens them, which an entropy below the natural one needs.  Targets that no exponent
    meets, or that only contradict each other, are a ValueError.  With fewer than two sources there is nothing to mix: 1.
    """
    sources, top = _largest(shares)
    if sources < 2:
        return 1.0

    def too_repeated(most: float, least: float) -> bool:
        repeats = most / least if budget_passes is None and least else most if budget_passes is None else most * budget_passes
        return max_repeats is not None and repeats > max_repeats * (1 + 1e-9)

    def too_flat(exponent: float, moments: tuple) -> bool:
        _, entropy, most, least = moments
        # Beyond 1 sharper weights repeat more, so only the entropy can ask for them.
        if exponent <= 1 and too_repeated(most, least):
            return True
        return target_entropy is not None and entropy > target_entropy * math.log(sources) + 1e-9

    def first_sharp(exponents: list[float]) -> int | None:
        return next((i for i, m in enumerate(_moments(shares, top, exponents)) if not too_flat(exponents[i], m)), None)

    ladder = [0.0, 1.0, *(2.0**k for k in range(1, 11))]
    place = first_sharp(ladder)
    if place is None:
        raise ValueError(f"no exponent brings the entropy down to {target_entropy} of the greatest")
    low, high = ladder[max(0, place - 1)], ladder[place]
    while place and high - low > 1e-9 * max(1.0, high):
        grid = [low + (high - low) * k / STEPS for k in range(1, STEPS + 1)]
        at = first_sharp(grid)
        low, high = low if at == 0 else grid[at - 1], grid[at]
    _, _, most, least = _moments(shares, top, [high])[0]
    # At 1 every source has the same passes: a limit below that can't be met, nor can one that the entropy's sharpening breaks.
    if too_repeated(most, least):
        raise ValueError(f"no exponent meets max_repeats {max_repeats} with these targets")
    return high


def mix(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_passes: float | None = 1.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` with mix_tokens, mix_weight, mix_passes, mix_block, mix_position and mix_copies for each row.

    ``mix_passes`` is how often the budget goes through the row's source, ``mix_position`` the row's place in its block's
    permutation, and ``mix_copies`` how often the row is drawn: all whole passes, and once more if the remaining budget of
    its block reaches it (a document is taken when at least half of it fits).  Defined cases: a null source is a source of
    its own; null or empty texts have no tokens, follow the whole passes, and come last in the partial one only if their
    place in the permutation is reached; an empty table gives an empty result; repeated rows are drawn row by row; columns of
    ``docs`` that have the name of a result are replaced by it.
    """
    docs = docs.drop("mix_tokens", "mix_weight", "mix_passes", "mix_block", "mix_position", "mix_copies")
    id_col, text_col, source_col = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    docs, columns = neutral(docs)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("source_key")
    shares = source_shares(docs.select(key, token_count(F.col(text_col)).alias("tokens")))
    exponent = temperature(shares, target_entropy, max_repeats, budget_passes)
    top = _largest(shares)[1]
    z, _, _, least = _moments(shares, top, [exponent])[0]
    passes = 1 / least if budget_passes is None and least else budget_passes or 1.0
    weight = F.when(F.col("share") > 0, F.pow(F.col("share") / F.lit(top), F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    plan = shares.select(
        "source_key",
        "n_docs",
        weight.alias("mix_weight"),
        # Rounding keeps a source that needs exactly one pass from falling short of it.
        F.round(F.when(F.col("share") > 0, weight / F.col("share") * F.lit(passes)).otherwise(F.lit(1.0)), 9).alias("mix_passes"),
        F.ceil(F.col("n_docs") / BLOCK_ROWS).cast("bigint").alias("blocks"),
    )
    rows = docs.select("*", key, token_count(F.col(text_col)).alias("mix_tokens"))
    # One row for each source; where it outgrows a broadcast, the join on the source is split by the engine.
    rows = rows.join(plan, "source_key")
    tag = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn("mix_block", F.pmod(F.xxhash64(F.lit(seed), tag), F.col("blocks"))).withColumn("place_key", F.xxhash64(F.lit(seed + 1), tag))
    block = Window.partitionBy("source_key", "mix_block")
    ordered = block.orderBy("place_key", id_col)
    rows = rows.withColumn("mix_position", F.row_number().over(ordered) - 1)
    before = F.sum("mix_tokens").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("drawn_before", F.coalesce(before, F.lit(0))).withColumn("block_tokens", F.sum("mix_tokens").over(block))
    partial = (F.col("mix_passes") - F.floor("mix_passes")) * F.col("block_tokens")
    extra = (F.col("drawn_before") + F.col("mix_tokens") / 2 <= partial) & (partial > 0)
    rows = rows.withColumn("mix_copies", (F.floor("mix_passes") + F.when(extra, 1).otherwise(0)).cast("bigint"))
    return rows.select(*columns, "mix_tokens", "mix_weight", "mix_passes", "mix_block", "mix_position", "mix_copies")


def mixed_rows(docs: DataFrame, max_repeats: float = 1.25, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as they are drawn, in the columns of ``docs``: every row once at least.

    The budget is the smallest that drops nothing, and the exponent goes as far towards equal weights as ``max_repeats`` lets it.
    """
    places = [f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col)]
    rows, names = neutral(docs)
    drawn = mix(rows, max_repeats=max_repeats, budget_passes=None, id_col=places[0], text_col=places[1], source_col=places[2])
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_copies")))
    return drawn.filter("mix_copies > 0").withColumn("mix_copies", copies).select(*names)
