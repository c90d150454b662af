import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelore.llm import mixing as X
from pagelore.llm import packing as K
from pagelore.llm.tokens import token_count


def brute_pack(sizes, capacity):
    """The same rule by trying every level with the whole sum of squares."""
    wins, out = [], []

    def total(w):
        return sum(sum(1 for v in w if v == h) ** 2 for h in set(w) if h < capacity)

    for s in sizes:
        best = None
        for h in sorted({v for v in wins if v + s <= capacity} | {0}, reverse=True):
            new = [*wins, s] if h == 0 else [v for i, v in enumerate(wins) if i != wins.index(h)] + [h + s]
            if best is None or total(new) < best[0]:
                best = (total(new), h)
        h = best[1]
        if h:
            wins[wins.index(h)] += s
        else:
            wins.append(s)
        out.append(h)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=14))
def test_levels_follow_the_sum_of_squares(sizes):
    w = K.pack(np.array(sizes, np.int64), 12)
    fill, levels = {}, []
    for s, x in zip(sizes, w.tolist()):
        levels.append(fill.get(x, 0))
        fill[x] = fill.get(x, 0) + s
    assert all(v <= 12 for v in fill.values()) and levels == brute_pack(sizes, 12)


def test_windows(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice([0, 250, *range(1, 40)]), "x", 1) for i in range(600)] + [(700, None, "x", 1), (None, 7, "x", 1), (701, 10_000, "x", 1)]
    df = spark.createDataFrame(docs + docs[:50], "doc long, tokens long, window string, budget int")
    b = spark.createDataFrame([("a", 100), ("b", 64), ("none", None)], "name string, cap int")
    out = K.fill_windows(df, "doc", "tokens", b, "name", "cap", per_packer=100).collect()
    by, win = {}, {}
    for r in out:
        by.setdefault((r.budget, r.doc), []).append(r)
        if r.window is not None:
            win.setdefault((r.budget, r.window), []).append(r.tokens)
    size = {d: n or 0 for d, n, *_ in docs}
    assert {k[1] for k in by} == set(size) and {k[0] for k in by} == {"a", "b"}
    for (name, d), rs in by.items():
        cap = {"a": 100, "b": 64}[name]
        assert sum(r.tokens for r in rs) == size[d] and sorted(r.piece_no for r in rs) == list(range(1, len(rs) + 1))
        assert len(rs) == max(1, -(-size[d] // cap)) and (size[d] > 0 or rs[0].window is None)
    assert all(sum(v) <= (100 if k[0] == "a" else 64) for k, v in win.items())
    for name, cap in (("a", 100), ("b", 64)):
        full = [sum(v) for k, v in win.items() if k[0] == name]
        assert sum(full) / (len(full) * cap) > 0.9
    again = K.fill_windows(df.repartition(7), "doc", "tokens", b, "name", "cap", per_packer=100).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert K.fill_windows(df.limit(0), "doc", "tokens", b, "name", "cap").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 15), st.integers(1, 4)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(0, 80))
def test_knapsack_is_the_best_sum(lc, budget):
    lengths, counts = (np.array(x, np.int64) for x in zip(*lc))
    take, best = X.bounded_knapsack(lengths, counts, budget)
    sums = {sum(n * w for n, (w, _) in zip(ns, lc)) for ns in itertools.product(*[range(c + 1) for _, c in lc])}
    assert best == max(s for s in sums if s <= budget) == (take * lengths).sum() and (take <= counts).all()


@pytest.mark.parametrize("budget,cap", [(0, 2), (50, 3), (1000, 1), (12_345, 8), (10**6, 4), (10**9, 3)])
def test_uses_stay_within_cap_and_budget(budget, cap):
    lengths, counts = np.array([3, 10, 47, 9000]), np.array([50, 20, 3, 1])
    x = X.fit_uses(lengths, counts, budget, cap, 1, knapsack=500)
    most = int((lengths * counts * cap).sum())
    got = int((x * lengths).sum())
    assert (x <= cap * counts).all() and got <= budget
    assert got == most if budget >= most else got > 0.9 * min(budget, 1e9) or budget == 0 or (lengths <= budget).sum() < 4


def test_mix(spark):
    rnd = random.Random(3)
    docs = [(i, s, rnd.randint(1, 60), "x", 1) for i, s in enumerate(["big"] * 3000 + ["mid"] * 300 + ["few"] * 20 + ["other"] * 50)]
    docs += [(9001, None, 5, "x", 1), (None, "big", 5, "x", 1), (9002, "big", None, "x", 1), (9003, "big", 0, "x", 1)]
    df = spark.createDataFrame(docs + docs[:99], "doc long, source string, tokens long, k string, uses int")
    t = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.2, 2), ("few", 0.1, 5), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    uses, shares = (x.collect() for x in X.mix(df, "doc", "source", "tokens", t))
    cap = {"big": 1, "mid": 2, "few": 5}
    assert len({r.doc for r in uses}) == len(uses) and all(1 <= r.uses <= cap[r.source] for r in uses)
    by = {r.source: r for r in shares}
    assert set(by) == {"big", "mid", "few", "gone"} and by["gone"].tokens == 0 == by["gone"].reached_share
    for s in cap:
        assert sum(r.tokens * r.uses for r in uses if r.source == s) == by[s].tokens == by[s].budget_tokens
        assert abs(by[s].reached_share - by[s].target_share / 0.9) < 1e-3
    again = X.mix(df.repartition(9), "doc", "source", "tokens", t)[0].collect()
    assert sorted(map(str, uses)) == sorted(map(str, again))
    _, short = X.mix(df, "doc", "source", "tokens", t, total=10**7)
    got = {r.source: r for r in short.collect()}
    assert got["big"].uses == got["big"].records == 3000 and got["few"].uses == 100
    u, s = X.mix(df.limit(0), "doc", "source", "tokens", t)
    assert u.count() == 0 and s.where("tokens > 0").count() == 0


def test_token_counts(spark):
    texts = ["", None, "The queue of Tarvok keeps every block.", "a" * 30_000, "résumé 한국어"]
    for vocabulary in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"):
        got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"), vocabulary).alias("n")).collect()]
        assert got[:2] == [0, 0] and 7 <= got[2] <= 14 and got[3] > 100 and got[4] > 2


def test_a_null_key_is_not_the_text_null(spark):
    d = spark.createDataFrame([(None, 3), ("null", 3), ("", 3), ("a", 9)], "k string, n long")
    b = spark.createDataFrame([("small", 4)], "budget_name string, capacity_tokens int")
    got = K.fill_windows(d, "k", "n", b, "budget_name", "capacity_tokens").collect()
    assert {(r.k, r.piece_no, r.tokens) for r in got} == {(None, 1, 3), ("null", 1, 3), ("", 1, 3), ("a", 1, 4), ("a", 2, 4), ("a", 3, 1)}
    assert len(got) == 6 and len({(r.k, r.piece_no) for r in got}) == 6
    assert max(w.tokens for w in spark.createDataFrame([(r.window, r.tokens) for r in got], "window string, tokens long").groupBy("window").sum("tokens").withColumnRenamed("sum(tokens)", "tokens").collect()) <= 4
