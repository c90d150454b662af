"""Blocks chosen to fit a token budget: a greedy fill in three passes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAV_KINDS, NAV_ROLES = {"link", "button", "input"}, {"primary-nav", "secondary-nav", "cta", "form-control"}


def choose(blocks: pd.DataFrame, budget: int) -> pd.Series:
    """Which rows (in page order; kind, role, zone, priority, token_cost) are kept.

    All if they fit. Else navigation up to a quarter, main text up to a third, then anything, by priority; what would exceed
    its share is skipped, unless nothing was taken yet.
    """
    cost = blocks["token_cost"].tolist()
    if sum(cost) <= budget:
        return pd.Series(True, index=blocks.index)
    rows = list(zip(blocks["kind"], blocks["role"], blocks["zone"]))
    ranked = sorted(range(len(rows)), key=lambda i: (-int(blocks["priority"].iloc[i]), i))
    nav = 0 if budget < 32 else min(max(-(-budget // 4), 24), budget // 2)
    main = 0 if budget < 48 else min(max(-(-budget // 3), 96), budget // 2)
    taken: set[int] = set()
    spent = 0

    def fill(order, share, wanted) -> None:
        nonlocal spent
        part = spent if share != main or wanted is not is_main else 0
        for i in order:
            if i in taken or not wanted(*rows[i]):
                continue
            if (part + cost[i] > share and part > 0) or (spent + cost[i] > budget and spent > 0):
                continue
            part += cost[i]
            spent += cost[i]
            taken.add(i)
            if part >= share:
                break

    is_nav = lambda k, r, z: (z != "main" and k in NAV_KINDS) or r in NAV_ROLES
    is_main = lambda k, r, z: z == "main" and k == "text" and r == "content"
    if nav:
        fill(ranked, nav, is_nav)
    if main:
        fill(range(len(rows)), main, is_main)
    fill(ranked, budget, lambda *_: True)
    return pd.Series([i in taken for i in range(len(rows))], index=blocks.index)


def within_budget(blocks: DataFrame, page: str, budget: Column) -> DataFrame:
    """`page`, ord and id (b1, b2, ...) of the blocks that a page's budget keeps. A page's blocks are one group; pages are bounded
    documents. Null zones count as outside of the main part."""
    src = blocks.select(F.col(page).alias("page"), "ord", "kind", "role", "zone", "priority", "token_cost", budget.cast("int").alias("budget"))
    kind = src.schema["page"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        kept = pdf[choose(pdf, max(1, int(pdf["budget"].iloc[0])))]
        return pd.DataFrame({"page": kept["page"], "ord": kept["ord"], "id": [f"b{i}" for i in range(1, len(kept) + 1)]})

    return src.groupBy("page").applyInPandas(one, f"page {kind}, ord int, id string").withColumnRenamed("page", page)


def recommended_tokens(html: Column, requested: int = 512) -> Column:
    """A budget for a page by its size and its tags; other requests than 512 stand."""
    if requested != 512:
        return F.lit(max(1, requested))
    n = lambda *tags: sum((F.regexp_count(html, F.lit(t)) for t in tags), F.lit(0))
    size, links = F.octet_length(html), n("<a")
    div = lambda x, k: F.floor(x / k)
    score = div(size, 12_000) + div(links, 20) + div(n("<h[1-6]"), 10) + div(n("<p"), 30) + div(n("<li"), 40) + n("<table") * 3 + div(n("<button"), 10) + div(n("<input"), 10)
    level = lambda s, a, c: (size >= s) | (links >= a) | (score >= c)
    return F.when(level(150_000, 120, 24), 4096).when(level(60_000, 45, 10), 2048).when(level(20_000, 20, 4), 1024).otherwise(512)
