import random

from pagelore.operators import relational as R
from pagelore.operators import sessions as S


def test_working_sets_equal_a_plain_fold(spark):
    rnd = random.Random(3)
    rows = [(s, t, f"r{r}", rnd.choice(["heading", "text", "list", "link"]), rnd.randint(0, 30), "x") for s in range(3) for t in range(1, 9) for r in rnd.sample(range(25), rnd.randint(0, 14))]
    df = spark.createDataFrame(rows + rows[:9], "session long, turn int, ref string, kind string, o int, kept string")
    got = {(r.session, r.turn): (r.kept, r.dropped) for r in S.working_sets(df, "session", "turn", "ref", "kind", "o").collect()}
    for s in range(3):
        cur = []
        for t in sorted({x[1] for x in rows if x[0] == s}):
            mine = [x for x in rows if x[0] == s and x[1] == t]
            salient = [x[2] for x in sorted((x for x in mine if x[3] in S.SALIENT), key=lambda x: (x[4], x[2]))]
            cur, gone = S.keep(cur, salient, {x[2] for x in mine}, 6)
            assert got[s, t] == (cur, gone) and len(cur) <= 6


def test_joins_that_need_care(spark):
    l = spark.createDataFrame([(i, i % 2, i * 10) for i in range(8)], "id long, k long, at long")
    r = spark.createDataFrame([(0, 5, "a"), (0, 40, "b"), (1, 30, "c")], "k long, since long, v string")
    assert {x.id: x.v for x in R.as_of(l, r, ["k"], "at", "since", ["v"]).collect()} == {0: None, 1: None, 2: "a", 3: "c", 4: "b", 5: "c", 6: "b", 7: "c"}
    one, two = l.join(r, "k").collect(), R.salted(l, r, "k", 3).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
