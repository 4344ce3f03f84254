"""Mixing sources to target weights.

Each source's share p of all tokens is raised to an exponent a and normalised: w = p^a / sum(p^a). The exponent is
bisected (many points a round, each round one small aggregation over the sources) to the largest one that meets a
target entropy, and raised further where that would repeat a source more often than a limit. Weights are realised as
epochs of a token budget: whole epochs take every document, and the last, partial one takes blocks of documents in a
permuted order until the budget is met, to the nearest block (a 4096th of a source, or one document of a small one).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_of, without

ENTROPY = 0.98  # target, as a share of the logarithm of the number of sources
REPEATS = 4.0
BLOCKS = 4096  # of a source, at most
POINTS, ROUNDS = 64, 4
OUT = ["n_tokens", "mix_weight", "mix_epochs", "block", "copies"]


def tokens(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bisect_exponent(shares: DataFrame, entropy: float, repeats: float, budget: float | None, total: int) -> float:
    """The exponent for rows of one share p > 0 a source. Entropy falls and the least share's repetition falls as the
    exponent rises from 0 (equal weights) to 1 (shares as they are), so both bounds are roots of falling functions."""
    low, high = 0.0, 1.0
    p = F.col("p")
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / (POINTS - 1) for k in range(POINTS)]
        sums = [F.sum(F.pow(p, F.lit(a))).alias(f"z{k}") for k, a in enumerate(grid)] + [F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"e{k}") for k, a in enumerate(grid)]
        row = shares.agg(F.max("p").alias("big"), F.min("p").alias("least"), F.count(F.lit(1)).alias("n"), *sums).first()
        if not row["n"] or row["n"] == 1:
            return 1.0
        good = len(grid) - 1
        for k, a in enumerate(grid):
            z = row[f"z{k}"]
            h = math.log(z) - a * row[f"e{k}"] / z
            scale = budget / total if budget is not None else z * row["big"] ** (1 - a)
            if h <= entropy * math.log(row["n"]) + 1e-12 and row["least"] ** (a - 1) / z * scale <= repeats:
                good = k
                break
        low, high = grid[max(good - 1, 0)], grid[good]
    return high


def mixing_plan(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: int = 17) -> DataFrame:
    """One row per source: _s, n_docs, n_tokens, mix_weight, mix_epochs, whole, blocks and the cutoff of the last epoch.

    Without a budget it is the least for which no source loses a document. Sources without tokens keep their documents
    once then, and lose them under a budget.
    """
    base = docs.select(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_s"), _hash(id_col, text, seed).alias("_h"), tokens(text).alias("n"))
    base = materialize(base, "tokens")  # texts are read once for the plan
    sources = materialize(base.groupBy("_s").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens")), "sources")
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    shares = sources.filter("n_tokens > 0").select((F.col("n_tokens") / F.lit(max(total, 1))).alias("p"))
    a = bisect_exponent(shares, entropy, repeats, budget, max(total, 1))
    z, big = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max("p")).first()
    spend = float(budget if budget is not None else total * (z or 1) * (big or 1) ** (1 - a))
    weight = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens") / max(total, 1), F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    epochs = F.when(F.col("n_tokens") > 0, F.round(weight * spend / F.greatest("n_tokens", F.lit(1)), 9)).otherwise(F.lit(1.0 if budget is None else 0.0))
    sources = sources.withColumns({"mix_weight": weight, "mix_epochs": epochs, "whole": F.floor(epochs).cast("long"), "blocks": F.least(F.col("n_docs"), F.lit(BLOCKS))})
    left = (F.col("mix_epochs") - F.col("whole")) * F.col("n_tokens")
    blocks = base.join(sources.select("_s", "blocks"), "_s").groupBy("_s", F.pmod("_h", F.col("blocks")).alias("block")).agg(F.sum("n").alias("n"))
    blocks = blocks.withColumn("o", _order("_s", "block", seed))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_s").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most BLOCKS rows a source
    taken = blocks.withColumn("before", before).join(sources.select("_s", left.alias("left")), "_s").filter(F.col("before") + F.col("n") / 2 <= F.col("left"))
    cutoff = taken.groupBy("_s").agg(F.max("o").alias("cutoff"))
    return materialize(sources.join(cutoff, "_s", "left"), "plan")


def _hash(id_col: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text_of(text))


def _order(source: str, block: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), F.col(source), F.col(block))


def mix(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", seed: int = 17, **targets) -> DataFrame:
    """docs with n_tokens, their source's mix_weight and mix_epochs, their block and how many copies the mixture takes.

    Null sources are the source ''. Null texts have no tokens. Rows that repeat id and text share a block, hence their
    number of copies. Input columns named like an output are replaced; an empty table gives an empty table.
    """
    plan = mixing_plan(docs, source, text, id_col, seed=seed, **targets).select("_s", "mix_weight", "mix_epochs", *[F.col(c).alias(f"_{c}") for c in ("whole", "blocks", "cutoff")])
    rows = without(docs, [*OUT, "_s", "_whole", "_blocks", "_cutoff"]).withColumn("_s", F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")))
    out = rows.join(plan, "_s")  # a small written table: broadcast while its size allows, else a split join
    out = out.withColumns({"n_tokens": tokens(text), "block": F.pmod(_hash(id_col, text, seed), F.col("_blocks"))})
    extra = F.coalesce(_order("_s", "block", seed) <= F.col("_cutoff"), F.lit(False)).cast("long")
    return out.withColumn("copies", F.col("_whole") + extra).drop("_s", "_whole", "_blocks", "_cutoff")


def realise(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mixture takes, without the planning columns."""
    return without(mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))), [*OUT, "_copy"])
