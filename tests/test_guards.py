"""Guards on small supports, and their effect on verdicts."""

import pytest
from pyspark.sql import functions as F

from pagelore.operators import evidence as E
from pagelore.operators import guards as G

CASES = [
    # statement, passage, scope, status, qualifier, numeric
    ("Tarvok keeps reports for 30 days.", "Tarvok keeps reports for 30 days after upload.", "ok", "ok", "ok", "ok"),
    ("Tarvok keeps reports for 30 days.", "Tarvok keeps reports for 45 days after upload.", "ok", "ok", "ok", "contradicts"),
    ("Tarvok keeps reports for 30 days.", "Tarvok keeps reports for a while.", "ok", "ok", "ok", "fails"),
    ("Tarvok archives keep reports in every place.", "Tarvok archives keep reports in some places.", "contradicts", "ok", "fails", "ok"),
    ("Tarvok is offered in all places.", "Tarvok is offered in places.", "fails", "ok", "fails", "ok"),
    ("Tarvok search is GA in the console.", "Tarvok search is a beta feature in the console.", "ok", "contradicts", "ok", "ok"),
    ("The default timeout of Tarvok is 3 seconds.", "The maximum timeout of Tarvok is 15 minutes.", "ok", "ok", "fails", "contradicts"),
    ("The default timeout of Tarvok is 3 seconds.", "By default the timeout of Tarvok is 3 seconds.", "ok", "ok", "ok", "ok"),
    ("Tarvok v2.1 was released in May.", "Tarvok 7 was released in May.", "ok", "ok", "ok", "ok"),
]


@pytest.fixture(scope="module")
def tables(spark):
    blocks = [(i, 1, "text", "content", f"rmain:text:b{i}", p, "{}", "x") for i, (_, p, *_) in enumerate(CASES)]
    claims = [(i, i, s, "x") for i, (s, *_) in enumerate(CASES)] + [(99, 99, "A claim on a page without blocks.", "x"), (0, 98, None, "x"), (0, 97, " ", "x")]
    b = spark.createDataFrame(blocks, "page long, ord int, kind string, role string, ref string, text string, attributes string, numeric string").drop("numeric")
    return b, spark.createDataFrame(claims, "page long, claim long, statement string, scope string").drop("scope")


def test_guards(spark, tables):
    b = E.prepare_blocks(tables[0])
    c = E.matching_claims(tables[1], b)
    top = c.join(E.candidates(b), "page").select("page", "claim", "ord", F.lit(1).alias("place"), "kind", "passage_search", "text")
    got = {r.claim: (r.scope, r.status, r.qualifier, r.numeric) for r in G.guarded(c, top, b).collect()}
    assert got == {i: tuple(x[2:]) for i, x in enumerate(CASES)}
    assert G.guarded(c, top.limit(0), b).count() == 0


def test_verdicts_heed_the_guards(spark, tables):
    v = {r.claim: (r.verdict, r.reason) for r in E.verdicts(tables[1], tables[0]).collect()}
    assert v[1] == ("contradicted", "numeric-mismatch") and v[3] == ("contradicted", "scope-mismatch") and v[5] == ("contradicted", "status-mismatch")
    assert v[0][0] != "contradicted" and v[2][0] != "evidence-supported" and v[4][0] != "evidence-supported" and v[99][0] == "insufficient-evidence"
