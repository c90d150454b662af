from datetime import datetime, timedelta
from itertools import pairwise

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagelore.operators import snapshots as S

SCHEMA = "page_id long, snapshot_id long, taken_at timestamp, stable_ref string, ingested_at timestamp, kind string, text string, e string, s long"
HOW = dict(entity="page_id", snapshot="snapshot_id", taken="taken_at", ref="stable_ref", ingested="ingested_at", compare=["kind", "text"])
T0 = datetime(2026, 1, 1)


def brute(rows):
    taken, held = {}, {}
    for p, s, t, r, i, k, x, *_ in rows:
        taken.setdefault(p, {})[s] = t
        at = held.setdefault((p, s), {})
        if r not in at or at[r][0] < i:
            at[r] = (i, (k, x))
    out = set()
    for p, snaps in taken.items():
        order = sorted(snaps, key=lambda s: (snaps[s], s))
        for a, b in pairwise(order):
            was, now = held[p, a], held[p, b]
            out |= {(p, b, r, "added") for r in now.keys() - was.keys()} | {(p, b, r, "removed") for r in was.keys() - now.keys()}
            out |= {(p, b, r, "changed") for r in now.keys() & was.keys() if now[r][1] != was[r][1]}
    return out


row = st.tuples(st.sampled_from([1, 2, None]), st.integers(0, 5), st.sampled_from(["a", "b", "c", None]), st.integers(0, 3), st.sampled_from(["x", None]), st.sampled_from(["t", "", None]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=25, unique_by=lambda r: (r[0], r[1], r[2], r[3])), st.permutations(range(6)))
def test_changes_equal_brute_force(spark, rows, when):
    data = [(p, s, T0 + timedelta(hours=when[s]), r, T0 + timedelta(days=i), k, x, "clash", 1) for p, s, r, i, k, x in rows]
    df = spark.createDataFrame(data + data[:3], SCHEMA)
    got = [tuple(r) for r in S.snapshot_changes(df, **HOW).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


def test_counts_and_empty(spark):
    t = lambda h: T0 + timedelta(hours=h)
    data = [(1, s, t(s), r, t(9), "k", x, "", 0) for s, r, x in [(1, "a", "1"), (1, "b", "1"), (2, "a", "1"), (2, "b", "2"), (2, "c", None), (3, "c", None), (3, "a", "1")]]
    got = {tuple(r) for r in S.change_counts(spark.createDataFrame(data, SCHEMA), **HOW).collect()}
    assert got == {(1, 2, 1, 0, 1, 1), (1, 3, 0, 1, 0, 2)}
    assert S.snapshot_changes(spark.createDataFrame([], SCHEMA), **HOW).count() == 0
    assert S.change_counts(spark.createDataFrame([], SCHEMA), **HOW).count() == 0
