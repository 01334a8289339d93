"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are source token shares raised to an exponent and normalised. The exponent is found by bisection to the last bits of
its number: that whose weights have the target entropy, flatter (below 1) or steeper (above 1) than the sources come, or the nearest to
it that repeats no source more often than allowed. Each source then gets its
weight's part of the token budget: whole passes over all of its documents, and a last pass that
stops at the budget. A pass is a permutation of blocks, and of rows inside a block, by hashes of seed, document and
pass. Only block totals are summed up to find the block where the budget ends, and only that block is
cut by rows; a source of n rows has about sqrt(n) blocks of sqrt(n) rows, so nothing in order is longer than that,
however hot the source. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import row_key, small, stored

STEEPEST = 64.0  # largest exponent tried
WAYS = 256  # one pass over the sources is eight bisection steps
TOLERANCE = 1e-6  # of the entropy, in nats
BROADCAST_SOURCES = 200_000
BROADCAST_KEYS = 1_000_000
WORD_BREAK = r"[\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")).cast("bigint")


def _hash(*parts) -> F.Column:
    """60 bits of an MD5, which other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def narrow(docs: DataFrame) -> DataFrame:
    """What mixing needs of a document: its id, key, group (its source, NULL apart) and tokens."""
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return docs.select("doc_id", "source", group.alias("mix_group"), row_key("doc_id", "text").alias("mix_key"), word_count(F.col("text")).alias("n_tokens"))


@dataclass(frozen=True)
class Temperature:
    """The exponent found, the entropy of its weights as a share of the largest possible, the most passes over any source, and
    whether the target entropy is met, within ``TOLERANCE``."""

    exponent: float
    entropy: float
    repeats: float
    met: bool


def _figures(shares: DataFrame, points: list[float]) -> list[tuple[float, float]]:
    """(entropy of the weights, largest weight over share) for each exponent, in one pass over the sources."""
    power = F.pow("share", "k")
    grid = shares.select("share", F.explode(F.array(*[F.lit(float(k)) for k in points])).alias("k"))
    grid = grid.groupBy("k").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("slope"), F.max(F.pow("share", F.col("k") - 1)).alias("most"))
    found = {r["k"]: r for r in grid.collect()}
    return [(math.log(found[k]["z"]) - k * found[k]["slope"] / found[k]["z"], found[k]["most"] / found[k]["z"]) for k in points]


def _between(shares: DataFrame, bad: float, good: float, holds) -> float:
    """The exponent next to ``bad`` for which ``holds(entropy, repeats)``, which it does from there to ``good``."""
    while True:
        points = [bad + (good - bad) * i / WAYS for i in range(1, WAYS)]
        points = sorted({p for p in points if p not in (bad, good)}, reverse=good < bad)
        if not points:
            return good
        for k, figures in zip(points, _figures(shares, points)):
            if holds(*figures):
                good = k
                break
            bad = k


def temperature(shares: DataFrame, repeats: float, target_entropy: float | None, max_epochs: float | None) -> Temperature:
    """The exponent whose weights have ``target_entropy`` times the largest entropy possible, ln of the number of sources.

    ``shares`` has ``share`` per source, ``repeats`` is budget over all tokens. Entropy falls as the exponent rises, from 0 (all sources
    alike) to ``STEEPEST``; below 1 it is flatter than the sources are, above 1 steeper. The most passes over a source fall up to 1 and
    rise behind it; where the target would need more than ``max_epochs``, the exponent goes towards 1 until it does not.
    Without a target it starts from 0. Sources of equal shares, whose entropy does not depend on it, have 1.
    """
    n = shares.count()
    (flat, _), (steep, _) = _figures(shares, [0.0, STEEPEST])
    goal = flat if target_entropy is None else target_entropy * math.log(n)
    if n < 2 or flat - steep < 1e-12:
        power = 1.0
    elif flat <= goal + 1e-12:
        power = 0.0
    elif steep > goal:
        power = STEEPEST
    else:
        power = _between(shares, 0.0, STEEPEST, lambda entropy, _: entropy <= goal)

    def allowed(_, most):
        return max_epochs is None or repeats * most <= max_epochs * (1 + 1e-12)

    if power != 1.0 and not allowed(*_figures(shares, [power])[0]):
        power = _between(shares, power, 1.0, allowed)
    (entropy, most), = _figures(shares, [power])
    met = target_entropy is None or abs(entropy - goal) <= TOLERANCE
    return Temperature(power, entropy / math.log(n) if n > 1 else 1.0, repeats * most, met)


def plan(
    rows: DataFrame, budget_share: float, target_entropy: float | None, max_epochs: float | None, seed: int
) -> tuple[DataFrame, DataFrame, Temperature]:
    """(per group: passes, rest, blocks, edge, left; keys of the edge blocks that still fit; the exponent).

    Blocks below ``edge`` take part in the last pass, the edge block only with the listed keys.
    """
    totals = rows.groupBy("mix_group").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows"))
    totals = stored(totals, "sources")
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(everything, 1))))
    if max_epochs is not None:
        budget_share = min(budget_share, max_epochs)  # no weights could repeat everything more often
    found = temperature(shares, budget_share, target_entropy, max_epochs) if everything else Temperature(1.0, 1.0, 0.0, target_entropy is None)
    power = found.exponent
    norm = shares.agg(F.sum(F.pow("share", F.lit(power)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(everything, 1))), F.lit(power)) / F.lit(norm)).otherwise(0.0)
    wanted = F.floor(weight * F.lit(budget_share * everything) + 0.5)
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens"))).otherwise(0)
    plans = totals.withColumn("wanted", wanted).withColumn("passes", passes.cast("int"))
    plans = plans.withColumn("rest", F.col("wanted") - F.col("passes") * F.col("tokens")).withColumn("blocks", F.ceil(F.sqrt("n_rows")))
    plans = stored(plans.select("mix_group", "passes", "rest", "blocks", "wanted", "tokens"), "plans")

    last = rows.join(small(plans, BROADCAST_SOURCES), "mix_group").withColumn("block", _block(F.col("passes"), seed))
    sums = last.groupBy("mix_group", "rest", "block").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("mix_group").orderBy("block"))
    cut = sums.withColumn("upto", upto).filter("rest > 0 AND upto > rest").groupBy("mix_group").agg(
        F.min(F.struct("block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("e")
    )
    plans = stored(plans.join(cut, "mix_group", "left").select(*plans.columns, F.col("e.block").alias("edge"), F.col("e.left").alias("left")), "plans")

    edge = rows.join(small(plans, BROADCAST_SOURCES), "mix_group").filter(F.col("edge") == _block(F.col("passes"), seed))
    units = edge.groupBy("mix_group", "mix_key", "passes", "left").agg(F.sum("n_tokens").alias("n_tokens"))  # equal rows go together
    order = Window.partitionBy("mix_group").orderBy(_row_order(F.col("passes"), seed), "mix_key").rowsBetween(Window.unboundedPreceding, 0)
    fitting = units.withColumn("upto", F.sum("n_tokens").over(order)).filter("upto <= left").select("mix_key", F.lit(True).alias("mix_fits"))
    return plans, stored(fitting, "edge"), found


def _block(epoch, seed: int) -> F.Column:
    return F.pmod(_hash(F.lit(f"block{seed}"), epoch.cast("string"), "mix_key"), F.col("blocks"))


def _row_order(epoch, seed: int) -> F.Column:
    return _hash(F.lit(f"row{seed}"), epoch.cast("string"), "mix_key")


def repeated(rows: DataFrame, plans: DataFrame, fitting: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with mix_group and mix_key) once per pass they take part in, with epoch, block and their order."""
    out = rows.join(small(plans.drop("tokens", "wanted", "rest", "left"), BROADCAST_SOURCES), "mix_group")
    out = out.join(small(fitting, BROADCAST_KEYS), "mix_key", "left")
    block = _block(F.col("passes"), seed)
    in_last = F.coalesce((block < F.col("edge")) | ((block == F.col("edge")) & F.coalesce("mix_fits", F.lit(False))), F.lit(False))
    count = F.col("passes") + in_last.cast("int")
    out = out.withColumn("epoch", F.explode(F.slice(F.sequence(F.lit(0), F.col("passes")), F.lit(1), count)))
    out = out.withColumn("block", _block(F.col("epoch"), seed)).withColumn("row_order", _row_order(F.col("epoch"), seed))
    order = _hash(F.lit(f"order{seed}"), F.col("epoch").cast("string"), "mix_group", F.col("block").cast("string"))
    return out.withColumn("block_order", order)


def mix(docs: DataFrame, budget_share: float = 1.0, target_entropy: float | None = 0.95, max_epochs: float | None = 4.0, seed: int = 0) -> DataFrame:
    """One row per document and pass in the mixture of ``docs`` (doc_id, text, source).

    Columns: doc_id, source, n_tokens (words), epoch, block, block_order, row_order; sorted by the last two, blocks of all
    sources are interleaved at random and rows at random within them. exponent_micro, rounded millionths, and entropy_met, on every
    row, tell the exponent used and whether its weights have the target entropy (see ``temperature``). The budget is ``budget_share`` of all tokens (at most
    ``max_epochs``). A NULL source is a source of its own; NULL and empty texts have no tokens and ride along in the passes
    and blocks they fall into; a source without tokens is left out. Equal rows are taken or left together in the last
    block; rows with a NULL doc_id are kept. Extra columns are ignored; an empty table gives no rows.
    """
    rows = stored(narrow(docs), "narrow")
    plans, fitting, found = plan(rows, budget_share, target_entropy, max_epochs, seed)
    told = [F.lit(math.floor(found.exponent * 1e6 + 0.5)).cast("bigint").alias("exponent_micro"), F.lit(found.met).alias("entropy_met")]
    return repeated(rows, plans, fitting, seed).select("doc_id", "source", "n_tokens", "epoch", "block", "block_order", "row_order", *told)


def mixed_documents(docs: DataFrame, budget_share: float = 1.0, target_entropy: float | None = 0.95, max_epochs: float | None = 4.0, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` themselves, as often as ``mix`` has them, with their own columns."""
    names = docs.columns
    plans, fitting, _ = plan(stored(narrow(docs), "narrow"), budget_share, target_entropy, max_epochs, seed)
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    whole = F.struct(*[F.col(f"`{c}`") for c in names])  # so that no column can clash
    rows = docs.select(group.alias("mix_group"), row_key("doc_id", "text").alias("mix_key"), whole.alias("row"))
    return repeated(rows, plans, fitting, seed).select(*[F.col("row").getField(c).alias(c) for c in names])
