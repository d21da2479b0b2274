"""Mixing sources by temperature: shares to the power of an exponent, met exactly by block permutations.

1. Each source's tokens are summed; an exponent between 0 (all sources alike) and 1 (as they are) turns
   shares into weights. It is bracketed, each round cutting the bracket in several, until the weights
   have the entropy asked for, or until no source repeats more than allowed.
2. A source's rows are dealt by a hash into blocks. Each epoch takes the source's blocks in another
   hashed order; the last epoch stops in the block where the source's token budget ends, and takes rows of
   that one block in hashed order up to the budget.
Only that block's rows are ever ordered, and a source has a bounded number of blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Scratch


@dataclass(frozen=True)
class Mix:
    """budget: tokens wanted, as a share of all tokens if at most 1000. One of entropy (bits) and repeats is set."""

    budget: float = 1.0
    repeats: float | None = 1.25
    entropy: float | None = None
    seed: int = 0
    block_tokens: int = 1 << 17
    most_blocks: int = 4096
    rounds: int = 8
    fan: int = 32
    broadcast_bytes: int = 16 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def find_exponent(totals: DataFrame, budget: float, m: Mix) -> float:
    """The least exponent whose weights keep to the repetition limit, or the one that gives the entropy.

    totals has one row (t) of tokens per source. Both measures are monotone in the exponent: repetition of
    the smallest source falls, entropy falls. Where even exponent 1 fails, 1 is returned; where 0 passes, 0.
    Every round is one aggregate over the sources: nothing is gathered.
    """
    total = totals.agg(F.sum("t").alias("t"), F.min("t").alias("least")).first()
    if not total["t"]:
        return 1.0
    share, least = F.col("t") / float(total["t"]), total["least"] / total["t"]
    lo, hi = 0.0, 1.0

    def passes(x: list[float]) -> list[bool]:
        row = totals.agg(*[F.sum(F.pow(share, F.lit(a))).alias(f"z{i}") for i, a in enumerate(x)], *[F.sum(F.pow(share, F.lit(a)) * F.ln(share)).alias(f"l{i}") for i, a in enumerate(x)]).first()
        out = []
        for i, a in enumerate(x):
            z = row[f"z{i}"]
            if m.entropy is not None:
                out.append((math.log(z) - a * row[f"l{i}"] / z) / math.log(2) <= m.entropy)
            else:
                out.append(least ** (a - 1) / z * budget / total["t"] <= m.repeats)
        return out

    if passes([0.0])[0]:
        return 0.0
    for _ in range(m.rounds):
        x = [lo + (hi - lo) * i / m.fan for i in range(1, m.fan)]
        good = [a for a, ok in zip(x, passes(x), strict=True) if ok]
        at = min(good, default=hi)
        lo, hi = max([lo, *[a for a in x if a < at]]), at
    return hi


def mix_sources(docs: DataFrame, m: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", payload: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the mixed corpus: id, source, n_tokens, epoch, block_rank, block, and the columns in payload.

    A row's copies differ in epoch (from 0); epoch, block_rank and a hash of the id give the mixed order.
    A null source is a source of its own; null and empty texts have no tokens and go with their block;
    sources without any token are kept once. Rows that repeat an id are in the same block. No rows, no rows.
    Columns in payload that are named like one of the others are left out.
    """
    payload = tuple(c for c in payload if c not in (id_col, source_col, "n_tokens", "epoch", "block_rank", "block"))
    if (m.entropy is None) == (m.repeats is None):
        raise ValueError("set either entropy or repeats")
    scratch = Scratch(docs.sparkSession, "mixing")
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    order = F.xxhash64(F.col(id_col), F.lit(m.seed))
    extra = [F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_s"), name.alias("_k"), word_count(F.col(text_col)).alias("_n"), order.alias("_o"), *extra)
    totals = scratch.write(rows.groupBy("_k").agg(F.sum("_n").alias("t")), "totals")
    some = totals.where("t > 0")
    tokens = some.agg(F.sum("t")).first()[0] or 0
    budget = m.budget * tokens if m.budget <= 1000 else m.budget
    exponent = find_exponent(some, budget, m)
    z = some.agg(F.sum(F.pow(F.col("t") / float(tokens or 1), F.lit(exponent)))).first()[0] or 1.0
    quota = F.when(F.col("t") > 0, F.pow(F.col("t") / float(tokens or 1), F.lit(exponent)) / z * budget).otherwise(0.0)
    # Sources hold as many blocks as their size asks for.
    blocks = F.greatest(F.lit(1), F.least(F.lit(m.most_blocks), F.ceil(F.col("t") / m.block_tokens))).cast("int")
    sources = scratch.write(totals.select("_k", "t", quota.alias("quota"), blocks.alias("blocks")), "sources")
    small = lambda df, width: F.broadcast(df) if df.count() * width <= m.broadcast_bytes else df
    dealt = rows.join(small(sources.select("_k", "blocks"), 64), "_k").withColumn("block", F.pmod(F.xxhash64("_id", F.lit(m.seed + 1)), F.col("blocks")).cast("int"))
    sizes = scratch.write(dealt.groupBy("_k", "block").agg(F.sum("_n").alias("b")), "blocks")
    last = F.floor(F.col("quota") / F.col("t")).cast("int")
    plan = sizes.join(sources.where("t > 0"), "_k").withColumn("epochs", last).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("t"))
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    shuffled = Window.partitionBy("_k", "epoch").orderBy(F.xxhash64("_k", "block", "epoch", F.lit(m.seed)), "block")
    plan = plan.withColumn("block_rank", F.row_number().over(shuffled)).withColumn("before", F.sum("b").over(shuffled.rowsBetween(Window.unboundedPreceding, -1)))
    left = F.when(F.col("epoch") < F.col("epochs"), F.col("b").cast("double")).otherwise(F.least(F.col("b").cast("double"), F.col("rest") - F.coalesce("before", F.lit(0))))
    plan = plan.withColumn("take", left).where("take > 0 or b = 0").select("_k", "block", "epoch", "block_rank", "b", "take")
    # Sources without tokens cost nothing and stay.
    idle = sizes.join(sources.where("t = 0"), "_k").select("_k", "block", F.lit(0).alias("epoch"), F.lit(1).alias("block_rank"), "b", F.lit(0.0).alias("take"))
    plan = scratch.write(plan.unionByName(idle), "plan")
    out = dealt.join(small(plan, 128), ["_k", "block"])
    whole = out.where("take >= b")
    by_row = Window.partitionBy("_k", "block", "epoch").orderBy("_o", "_id")
    part = out.where("take < b").withColumn("upto", F.sum("_n").over(by_row) - F.col("_n")).where(F.col("upto") < F.col("take")).drop("upto")
    cols = [F.col("_id").alias(id_col), F.col("_s").alias(source_col), F.col("_n").alias("n_tokens"), "epoch", "block_rank", "block"]
    taken = [F.col(f"_p{i}").alias(c) for i, c in enumerate(payload)]
    return whole.unionByName(part).select(*cols, *taken)
