import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelore.operators import budget as B

row = st.tuples(st.sampled_from(["link", "text", "heading", "button"]), st.sampled_from(["content", "primary-nav", "cta"]), st.sampled_from(["main", "body", "nav"]), st.integers(55, 140), st.integers(1, 90))


def frame(rows):
    return pd.DataFrame(rows, columns=["kind", "role", "zone", "priority", "token_cost"])


@settings(max_examples=200, deadline=None)
@given(st.lists(row, min_size=1, max_size=30), st.integers(1, 400))
def test_budget_is_kept(rows, budget):
    f = frame(rows)
    kept = f[B.choose(f, budget)]
    assert len(kept) >= 1 and (kept["token_cost"].sum() <= budget or len(kept) == 1)
    if f["token_cost"].sum() <= budget:
        assert len(kept) == len(f)


def test_shares_of_navigation_and_main_text():
    rows = [("link", "primary-nav", "nav", 75, 20)] * 5 + [("text", "content", "main", 80, 40)] * 5 + [("heading", "content", "body", 110, 30)] * 5
    kept = frame(rows)[B.choose(frame(rows), 200)]
    assert (kept["kind"] == "link").sum() >= 2 and (kept["kind"] == "text").sum() >= 2 and kept["token_cost"].sum() <= 200


def test_pages_are_independent_of_partitions(spark):
    df = spark.createDataFrame([(p, i, k, r, z, pr, c, "x") for p in range(3) for i, (k, r, z, pr, c) in enumerate([("link", "primary-nav", "nav", 75, 20), ("text", "content", None, 80, 90), ("heading", "content", "body", 110, 30)] * 4)], "page long, ord int, kind string, role string, zone string, priority int, token_cost int, id string")
    a = sorted(map(tuple, B.within_budget(df, "page", F.lit(150)).collect()))
    assert a == sorted(map(tuple, B.within_budget(df.repartition(5), "page", F.lit(150)).collect())) and len({x[0] for x in a}) == 3
    assert B.within_budget(df.limit(0), "page", F.lit(150)).count() == 0
