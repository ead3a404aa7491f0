r"""Mixing sources to target weights.

Temperature mixing: a source's token share q is raised to an exponent a in [0, 1] and normalised,
w = q**a / sum q**a. At a = 1 sources keep their shares; at a = 0 all weigh the same. Bisection finds
the least a, that is the flattest mix, at which the entropy of w is at most ``target_entropy`` (in
nats, where given) and no source is repeated more than ``max_repeats`` times within the budget.

Realisation: a source gets budget * w tokens: as many whole epochs as fit, then part of one more.
That part takes documents in the order of a hash of (epoch, doc_id), a permutation that differs by
epoch, in blocks of equal hash ranges: whole blocks while they fit, then documents of the next block
while they fit. So a source with a third of all rows needs only sums by block and a sort of one block;
what comes out is one hash limit for each source, and choosing documents needs no shuffle.

Tokens are words ``[^\x20\x09-\x0D]+``. Null and empty texts have none and cost nothing. Null source
is a source of its own. Rows with equal doc_id and source are taken or left together. Null doc_id is
hashed as such. With no tokens at all every row comes once. An empty table gives an empty table.
Sources are summed up on the driver: more than ``max_sources`` raise an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.llm.common import shared_dir, stored

BLOCK_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Plan:
    exponent: float
    entropy: float
    weights: dict[str | None, float]
    budgets: dict[str | None, float]


def weights_at(shares: list[float], exponent: float) -> list[float]:
    logs = [exponent * math.log(q) for q in shares]
    top = max(logs)
    powers = [math.exp(x - top) for x in logs]
    total = math.fsum(powers)
    return [x / total for x in powers]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def plan_weights(tokens: dict[str | None, int], budget: float, max_repeats: float | None = 2.0, target_entropy: float | None = None) -> Plan:
    """Weights of the sources that have tokens. If even a = 1 breaks a limit, a = 1 is used for the
    entropy; a repetition limit below budget / total tokens can't be met and raises ValueError."""
    names = sorted((s for s, n in tokens.items() if n > 0), key=lambda s: (s is None, s or ""))
    if not names:
        return Plan(1.0, 0.0, {}, {})
    total = sum(tokens[s] for s in names)
    shares = [tokens[s] / total for s in names]
    if max_repeats is not None and budget > total * max_repeats * (1 + 1e-9):
        raise ValueError(f"a budget of {budget:.0f} tokens repeats {total} tokens more than {max_repeats} times")

    def fits(a: float) -> bool:
        w = weights_at(shares, a)
        if target_entropy is not None and entropy(w) > target_entropy + 1e-12:
            return False
        return max_repeats is None or all(budget * x <= max_repeats * tokens[s] * (1 + 1e-12) for s, x in zip(names, w, strict=True))

    low, high = 0.0, 1.0
    if fits(0.0):
        high = 0.0
    else:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
    w = weights_at(shares, high)
    return Plan(high, entropy(w), dict(zip(names, w, strict=True)), {s: budget * x for s, x in zip(names, w, strict=True)})


def _key(epoch):
    return F.xxhash64(F.lit(20), epoch, F.col("doc_id"))


def _block(key):
    return F.shiftrightunsigned(key, 64 - BLOCK_BITS)


def _order(key):
    """Keys as signed numbers in the order of their blocks."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def realise(docs: DataFrame, budget_share: float = 1.0, max_repeats: float | None = 2.0, target_entropy: float | None = None, max_sources: int = 1_000_000) -> tuple[DataFrame, Plan]:
    """For each source: epochs (whole ones), last (the greatest key of the part epoch, or null),
    weight. budget_share: the budget as a multiple of all tokens."""
    spark: SparkSession = docs.sparkSession
    sized = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n")), shared_dir(spark), "sized")
    rows = sized.groupBy("source").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    tokens = {r["source"]: r["n"] for r in rows}
    plan = plan_weights(tokens, budget_share * sum(tokens.values()), max_repeats, target_entropy)
    spec = []
    for s, n in tokens.items():
        b = plan.budgets.get(s, 0.0)
        epochs = int((b + 1e-6) // n) if n else 1
        spec.append((s, epochs, int(round(b - epochs * n)) if n else 0, plan.weights.get(s, 0.0)))
    goals = F.broadcast(spark.createDataFrame(spec, "goal string, epochs long, rest long, weight double"))
    keyed = sized.join(goals, F.col("source").eqNullSafe(F.col("goal"))).where("rest > 0").select("source", "doc_id", "n", "rest", _order(_key(F.col("epochs"))).alias("key"))
    keyed = keyed.withColumn("block", F.shiftright("key", 64 - BLOCK_BITS))
    sums = keyed.groupBy("source", "rest", "block").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("block"))
    sums = sums.withColumn("before", upto - F.col("n")).withColumn("upto", upto)
    # The block in which the rest runs out; later ones are left, earlier ones taken.
    edge = sums.where((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest"))).select(F.col("source").alias("goal"), F.col("block").alias("edge"), "before")
    near = keyed.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("goal")) & (F.col("block") == F.col("edge"))).select("source", "key", "n", "rest", "before", "block")
    within = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    fits = near.withColumn("upto", F.col("before") + F.sum("n").over(within))
    first = F.min(F.col("block")).alias("block")
    cut = fits.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("last"), first)
    # None of the edge block fits: everything before the block.
    cut = cut.select("source", F.coalesce("last", F.when(F.col("block") > -(1 << (BLOCK_BITS - 1)), F.shiftleft("block", 64 - BLOCK_BITS) - 1)).alias("last"))
    limits = {r["source"]: r["last"] for r in cut.collect()}
    table = [(s, e, limits.get(s) if r > 0 else None, w) for s, e, r, w in spec]
    return spark.createDataFrame(table, "source string, epochs long, last long, weight double"), plan


def mix(docs: DataFrame, columns: list[str], with_plan: bool = False, **options) -> DataFrame:
    """The given columns of each document, as often as it was drawn; with_plan adds epoch, block
    (its place in the permutation of that epoch) and weight. Choosing is a map over docs."""
    goals, _ = realise(docs, **options)
    goals = F.broadcast(goals.select(F.col("source").alias("_goal"), F.col("epochs").alias("_epochs"), F.col("last").alias("_last"), F.col("weight").alias("_weight")))
    rows = docs.join(goals, docs["source"].eqNullSafe(goals["_goal"]))
    part = F.col("_last").isNotNull() & (_order(_key(F.col("_epochs"))) <= F.col("_last"))
    copies = F.col("_epochs") + F.when(part, 1).otherwise(0)
    rows = rows.withColumn("_copies", copies).where("_copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    if not with_plan:
        return rows.select(*columns)
    return rows.select(*columns, "epoch", _block(_key(F.col("epoch"))).alias("block"), F.col("_weight").alias("weight"))
