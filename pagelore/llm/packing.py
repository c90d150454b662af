"""Items of varying length put into windows of fixed capacity: sum-of-squares online packing over a level array."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.session import cut

#: Items that one packer takes, about; more items mean more packers, each with its own level array.
ITEMS_PER_PACKER = 50_000
#: Packers whose half-filled windows are packed once more together.
SECOND_ROUND = 16
#: Budgets are settings of a run; more than so many are refused.
MAX_BUDGETS = 1000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, numbered from 0 as opened; every size is from 1 to `capacity`.

    levels[h] counts the open windows that hold h. An item of size s goes from level h to h + s where that makes the sum of
    the squares of all counts least (level 0: a new window; a full window leaves the array); ties go to the fullest level.
    """
    levels = np.zeros(capacity + 1, np.int64)
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    n = 0
    for i, s in enumerate(sizes.tolist()):
        before, after = levels[: capacity - s + 1], levels[s:]
        cost = 2 * (after - before) + 2
        cost[-1] -= 1  # the window becomes full and is counted no more
        cost[0] = (2 * levels[s] + 1) if s < capacity else 0
        open_ = before > 0
        open_[0] = True
        cost[~open_] = np.iinfo(np.int64).max
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        if h:
            levels[h] -= 1
            w = at[h].pop()
        else:
            w, n = n, n + 1
        if h + s < capacity:
            levels[h + s] += 1
            at[h + s].append(w)
        out[i] = w
    return out


def _packed(items: DataFrame) -> DataFrame:
    """budget, packer, item and window of items (budget, capacity, packer, item, size), each packer in the order of item."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "item"], kind="stable")
        w = pack(pdf["size"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]))
        return pd.DataFrame({"budget": pdf["budget"], "packer": pdf["packer"], "item": pdf["item"], "window": w, "size": pdf["size"], "capacity": pdf["capacity"]})

    items = items.withColumn("rank", F.xxhash64("item"))
    return items.groupBy("budget", "packer").applyInPandas(one, "budget string, packer long, item string, window long, size long, capacity long")


def fill_windows(docs: DataFrame, key: str, size: Column | str, budgets: DataFrame, budget: str, capacity: str, per_packer: int = ITEMS_PER_PACKER) -> DataFrame:
    """The windows of each budget that hold all items: budget, `key`, piece_no (from 1), window (text, unique in the budget),
    tokens and capacity.

    An item is never split unless it alone exceeds the capacity; then it fills windows of its own and its rest, the last
    piece, is packed like an item. Items of size 0 or null get one row without a window; null keys are kept as they are. The
    result does not depend on the order or the partitions of the rows: the packer is drawn by a hash of the key, a packer
    works through its items in hash order. Budgets with a null or non-positive capacity, and an empty table, give no rows.
    Duplicate keys are packed as they come, one item for each row of equal size once (a row delivered twice counts once).
    """
    d = cut(docs.select(F.col(key).alias("k"), F.coalesce(size if isinstance(size, Column) else F.col(size), F.lit(0)).cast("long").alias("n")).distinct())
    b = budgets.select(F.col(budget).cast("string").alias("budget"), F.col(capacity).cast("long").alias("capacity")).where("capacity > 0").distinct()
    settings = b.orderBy("budget", "capacity").limit(MAX_BUDGETS + 1).collect()
    if len(settings) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    packers = max(1, round(d.count() / per_packer))
    # every item is packed for each budget, which is the task
    each = F.array(*[F.struct(F.lit(r.budget).alias("budget"), F.lit(r.capacity).cast("long").alias("capacity")) for r in settings]) if settings else F.array().cast("array<struct<budget:string,capacity:bigint>>")
    x = d.select("*", F.inline(each))
    whole = F.floor(F.col("n") / F.col("capacity"))
    rest = F.col("n") % F.col("capacity")
    x = x.withColumns({"full": whole, "rest": rest})
    own = x.where("full > 0").select("budget", "k", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full"))).alias("piece_no"), F.col("capacity").alias("tokens"), "capacity")
    own = own.withColumn("window", F.concat_ws("-", F.when(F.col("k").isNull(), "own-null").otherwise("own"), F.coalesce(F.col("k").cast("string"), F.lit("")), "n", "piece_no")).drop("n")
    none = x.where("n <= 0").select("budget", "k", F.lit(1).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("tokens"), "capacity", F.lit(None).cast("string").alias("window"))
    items = x.where("rest > 0 and n > 0").select(
        "budget", "capacity", "k", (F.col("full") + 1).alias("piece_no"), F.col("rest").alias("size"), F.concat_ws("-", F.when(F.col("k").isNull(), "null").otherwise("key"), F.coalesce(F.col("k").cast("string"), F.lit("")), "n").alias("item"),
        F.pmod(F.xxhash64("k", "n"), F.lit(packers)).alias("packer"),
    )
    first = cut(_packed(items.select("budget", "capacity", "packer", "item", "size")).withColumn("w1", F.concat_ws("-", "packer", "window")))
    # windows still open after the first round are items of the second one, whole, in fewer packers
    filled = first.groupBy("budget", "packer", "w1", "capacity").agg(F.sum("size").alias("size"))
    open_ = filled.where("size < capacity").select("budget", "capacity", F.floor(F.col("packer") / SECOND_ROUND).alias("packer"), F.col("w1").alias("item"), "size")
    second = _packed(open_).select(F.col("budget").alias("b2"), F.col("item").alias("i2"), F.concat_ws("-", F.lit("m"), "packer", "window").alias("w2"))
    placed = first.join(second, F.expr("budget = b2 and w1 = i2"), "left").select(F.col("budget").alias("b"), F.col("item").alias("i"), F.coalesce("w2", F.concat(F.lit("p-"), F.col("w1"))).alias("window"))
    packed = items.join(placed, F.expr("budget = b and item = i")).select("budget", "k", "piece_no", F.col("size").alias("tokens"), "capacity", "window")
    return packed.unionByName(own).unionByName(none).select("budget", F.col("k").alias(key), F.col("piece_no").cast("int").alias("piece_no"), "window", "tokens", "capacity")
