r"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold the same conversation again and again, each time with more turns. Every turn
gets a hash of its position, role and text; a sum over the first k turns is the prefix hash at k,
and the sum over all turns identifies the conversation. A conversation whose identity equals a
prefix hash at the same length of a longer one is a snapshot of it, and goes (anti-join). Of equal
conversations the one with the smallest conv_id stays. The rest is rendered turn by turn.

Two sums modulo 2**64 of independent 64-bit hashes are compared, with the length: 128 bits.

Prefix sums run in two steps, over blocks of turns and within a block, and identities are sums
that are combined before the shuffle, so that one conversation with very many turns is spread over
tasks. Rendering joins at most ``part_turns`` turns to one string: part 0, 1, ... of a conversation.

Turns are ordered by turn, then role, then text, nulls first; rows that agree in all four columns
are one row. A null turn comes first; null role and null text are rendered as empty, yet differ
from empty for comparing. Rows with null conv_id belong to no conversation and are dropped. Other
columns are not read. An empty table gives an empty table. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, block, at (1-based position in the conversation), role, text, a, b (turn hashes)."""
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    # Blocks by ranges of turn numbers: order within a conversation is (block, turn, role, text).
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("conv_id", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("at", F.row_number().over(within)).join(offsets, ["conv_id", "block"])
    rows = rows.withColumn("at", (F.col("at") + F.col("offset")).cast("long"))
    marked = [F.col("at"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    # 40-bit parts of two hashes: sums stay far below 2**63 for any conversation.
    return rows.select(
        "conv_id", "block", "at", "role", "text",
        F.shiftrightunsigned(F.xxhash64(F.lit(1), *marked), 16).alias("a"),
        F.shiftrightunsigned(F.xxhash64(F.lit(2), *marked), 16).alias("b"),
    )


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the maximal conversations."""
    numbered = _numbered(turns)
    blocks = numbered.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    one = whole.groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("conv_id", "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "ab"))
    running = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = numbered.select("conv_id", "block", "at", *(F.sum(c).over(running).alias(c) for c in "ab")).join(offsets, ["conv_id", "block"])
    prefixes = prefixes.join(whole.select("conv_id", F.col("n").alias("size")), "conv_id").where(F.col("at") < F.col("size"))
    proper = prefixes.select(F.col("at").alias("n"), (F.col("a") + F.col("a0")).alias("a"), (F.col("b") + F.col("b0")).alias("b")).distinct()
    return one.join(proper, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame, start: str = "<|", middle: str = "|>\n", end: str = "\n", part_turns: int = 256) -> DataFrame:
    """conv_id, n_turns, part, rendered: the turns of kept conversations, in order."""
    rows = _numbered(turns).join(kept, "conv_id")
    line = F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(end))
    rows = rows.select("conv_id", "n_turns", F.floor((F.col("at") - 1) / part_turns).alias("part"), "at", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return rows.groupBy("conv_id", "n_turns", "part").agg(F.array_join(lines, "").alias("rendered"))


def format_chats(turns: DataFrame, **options) -> DataFrame:
    return render(turns, collapse(turns), **options)


ORACLE_SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS "at" FROM d),
c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, list([role, text] ORDER BY "at") AS turns,
        string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY "at") AS rendered
      FROM p GROUP BY conv_id),
longer AS (SELECT DISTINCT list_slice(c.turns, 1, k.k) AS turns FROM c, LATERAL (SELECT unnest(range(1, c.n_turns)) AS k) k),
one AS (SELECT turns, min(conv_id) AS conv_id FROM c GROUP BY turns)
SELECT c.conv_id, c.n_turns, 0::BIGINT AS part, c.rendered
FROM c JOIN one ON one.conv_id = c.conv_id
WHERE c.turns NOT IN (SELECT turns FROM longer)
"""
