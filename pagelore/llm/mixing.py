"""Records of several sources mixed to target shares: subset-sum budgets over counts by exact length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore.session import cut

#: Tokens of a source's budget that the exact knapsack decides; the rest is drawn in proportion to the lengths.
KNAPSACK = 1 << 16
#: Parts into which the seeded order of one length is cut, so that no task ranks all texts of one length.
PARTS = 4096


def bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """How many of each length to take so that their sum is the greatest one that does not exceed `budget`.

    Counts are split in powers of two, sums are a bit set, and of every sum the item that first reached it is kept.
    """
    take = np.zeros(len(lengths), np.int64)
    items = []
    for i, (w, c) in enumerate(zip(lengths.tolist(), counts.tolist())):
        c, k = min(c, budget // w if w > 0 else 0), 1
        while c > 0:
            k = min(k, c)
            items.append((i, k, w * k))
            c -= k
            k *= 2
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int32)
    for j, (_, _, w) in enumerate(items):
        if w > budget:
            continue
        new = np.flatnonzero(reach[: budget + 1 - w] & ~reach[w:]) + w
        reach[new] = True
        by[new] = j
        if reach[budget]:
            break
    best = s = int(np.flatnonzero(reach)[-1])
    while s:
        i, k, w = items[by[s]]
        take[i] += k
        s -= w
    return take, best


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many texts of each length make up `budget`: all lengths in proportion, then single texts in seeded order, then
    the knapsack for what remains."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    x = counts * max(0, budget - knapsack // 2) // max(total, 1)
    left = budget - int((lengths * x).sum())
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        if left <= knapsack:
            break
        n = min(int(counts[i] - x[i]), (left - knapsack // 2) // int(lengths[i]))
        if n > 0:
            x[i] += n
            left -= n * int(lengths[i])
    take, _ = bounded_knapsack(lengths, counts - x, left)
    return x + take


def fit_uses(lengths: np.ndarray, counts: np.ndarray, budget: int, cap: int, seed: int, knapsack: int = KNAPSACK) -> np.ndarray:
    """Uses of each length in all, at most `cap` for a text: whole passes over the texts that still fit while they fit, then a
    fitted choice of texts once more."""
    x = np.zeros(len(lengths), np.int64)
    left = budget
    while left > 0:
        el = (lengths <= left) & (x < cap * counts)
        tokens = int((lengths * counts)[el].sum())
        if not tokens:
            break
        if tokens > left:
            x[el] += fit_counts(lengths[el], counts[el], left, seed, knapsack)
            break
        n = int(min(left // tokens, cap - (x[el] // counts[el]).max()))
        x[el] += n * counts[el]
        left -= n * tokens
    return x


def mix(docs: DataFrame, key: str, source: str, size: Column | str, targets: DataFrame, share: str = "target_share", repeats: str = "max_repeats", seed: int = 7, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): `key`, `source`, tokens and uses of each chosen record, and for each target what was reached.

    A source's budget is its share of `total`; by default, of the greatest total at which every source that has records
    meets its share within its cap. A source takes all records that fit as often as they fit whole into the budget, then a
    seeded choice of records once more. If the cap is reached first the source falls short, which the shares show; so does a target
    without records. Records of no target, without tokens, or with null key are not chosen. A record delivered twice counts
    once. Shares of one source given twice add up, the greater cap holds; targets with null or non-positive share take none.
    """
    d = docs.select(F.col(key).alias("k"), F.col(source).alias("src"), F.coalesce(size if isinstance(size, Column) else F.col(size), F.lit(0)).cast("long").alias("n"))
    d = cut(d.where("k is not null and src is not null and n > 0").distinct())
    t = targets.select(F.col(source).alias("src"), F.col(share).cast("double").alias("share"), F.coalesce(F.col(repeats), F.lit(1)).cast("long").alias("cap"))
    t = t.where("src is not null").groupBy("src").agg(F.sum(F.greatest("share", F.lit(0.0))).alias("share"), F.max("cap").alias("cap"))
    hist = cut(d.join(F.broadcast(t.select("src")), "src", "left_semi").groupBy("src", "n").agg(F.count("*").alias("c")))
    have = hist.groupBy("src").agg(F.sum(F.col("n") * F.col("c")).alias("tokens"))
    plan = t.join(have, "src", "left").na.fill(0, ["tokens"])
    if total is None:
        row = plan.where("share > 0 and tokens > 0 and cap > 0").agg(F.min(F.floor(F.col("cap") * F.col("tokens") / F.col("share"))).alias("total")).first()
        total = int(row.total or 0)
    plan = cut(plan.withColumn("budget", F.round(F.col("share") * F.lit(total)).cast("long")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        x = fit_uses(pdf["n"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64), int(pdf["budget"].iloc[0]), int(pdf["cap"].iloc[0]), seed)
        return pd.DataFrame({"src": pdf["src"], "n": pdf["n"], "every": x // pdf["c"], "x": x % pdf["c"]})

    # a source's histogram has a row for each length, however many records it has
    chosen = cut(hist.join(F.broadcast(plan.select("src", "budget", "cap")), "src").groupBy("src").applyInPandas(fit, "src string, n long, every long, x long").where("every > 0 or x > 0"))
    # of each length, all records `every` times and the first x in seeded order once more: parts of the order are counted,
    # and only the part in which the x-th record lies is ranked
    order = F.xxhash64(F.lit(seed), F.col("k"))
    r = d.join(chosen, ["src", "n"]).withColumns({"o": order, "part": F.pmod(F.shiftright(order, 20), F.lit(PARTS))})
    part = r.where("x > 0").groupBy("src", "n", "x", "part").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(W.partitionBy("src", "n").orderBy("part")) - F.col("c"))
    first = part.where("before < x").select("src", "n", "part", F.when(F.col("before") + F.col("c") <= F.col("x"), F.lit(None)).otherwise(F.col("x") - F.col("before")).cast("long").alias("first"), F.lit(True).alias("in_part"))
    r = r.join(first, ["src", "n", "part"], "left")
    split = F.col("first").isNotNull()
    edge = r.where(split).withColumn("no", F.row_number().over(W.partitionBy("src", "n", "part").orderBy("o", "k")))
    uses = r.where(~split).select("k", "src", "n", (F.col("every") + F.when(F.col("in_part"), 1).otherwise(0)).alias("uses"))
    uses = uses.union(edge.select("k", "src", "n", F.col("every") + F.when(F.col("no") <= F.col("first"), 1).otherwise(0)))
    uses = cut(uses.select("k", "src", F.col("n").alias("tokens"), F.col("uses").cast("long").alias("uses")).where("uses > 0"))
    got = uses.groupBy("src").agg(F.sum(F.col("tokens") * F.col("uses")).alias("got"), F.count("*").alias("records"), F.sum("uses").alias("uses"))
    got = cut(got)
    all_ = got.agg(F.sum("got").alias("all")).first()["all"] or 0
    shares = plan.join(got, "src", "left").select(
        F.col("src").alias(source), F.col("share").alias("target_share"), F.coalesce(F.col("got") / F.nullif(F.lit(all_), F.lit(0)), F.lit(0.0)).alias("reached_share"), F.col("budget").alias("budget_tokens"),
        F.coalesce("got", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("uses", F.lit(0)).alias("uses"), F.col("cap").alias("max_repeats"),
    )
    return uses.select(F.col("k").alias(key), F.col("src").alias(source), "tokens", "uses"), shares
