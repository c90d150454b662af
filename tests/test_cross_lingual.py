from test_evidence import BLOCKS, CLAIMS, judge, page

from pagelore.operators import evidence as E

CLAIM = "Tarvok은 네트워크 인터페이스를 제공합니다."
ENGLISH = page(
    ("heading", "content", "main", "Tarvok at a glance"),
    ("text", "content", "main", "Tarvok provides a network interface to every one of its clients."),
    ("text", "content", "main", "Penguins build their nests from pebbles near the glaciers."),
)


def parts(spark, rows, statement):
    c = spark.createDataFrame([(1, 0, statement, "x")], CLAIMS)
    return {r.ord: r for r in E.scored(c, spark.createDataFrame(rows, BLOCKS)).collect()}


def test_cjk_claims_are_matched_by_glosses_on_latin_pages(spark):
    assert parts(spark, ENGLISH, CLAIM)[2].lexical == 1.0
    got = judge(spark, ENGLISH, CLAIM)[0]
    assert got.verdict == "evidence-supported" and got.support[0] == "rmain:text:2"


def test_other_claims_and_pages_keep_their_own_tokens(spark):
    c = spark.createDataFrame([(1, 0, CLAIM, "x"), (1, 1, "눈이 옵니다", "x"), (1, 2, "Tarvok provides an interface.", "x")], CLAIMS)
    plain = {r.claim: r.claim_tokens for r in E.prepare_claims(c).collect()}
    across = {r.claim: r for r in E.matching_claims(c, spark.createDataFrame(ENGLISH, BLOCKS)).collect()}
    assert [across[i].crosses for i in range(3)] == [True, False, False]
    assert across[0].claim_tokens == ["interface", "network", "provid", "provides", "tarvok"] and across[0].anchors == ["interface", "network", "provides", "tarvok"]
    assert all(across[i].claim_tokens == plain[i] for i in (1, 2))
    korean = page(("text", "content", "main", "Tarvok은 모든 클라이언트에게 네트워크 인터페이스를 제공합니다. " * 3))
    assert {r.claim: r.claim_tokens for r in E.matching_claims(c, spark.createDataFrame(korean, BLOCKS)).collect()} == plain


def test_lower_bar_across_languages(spark):
    """One passage between the two bars carries a claim only across languages."""
    rows = page(("button", "supporting", "nav", "Network interface"), ("text", "content", "main", "Nothing of the kind is said in this long sentence about penguins."))
    got = judge(spark, rows, "네트워크 인터페이스", "Network interface penguins glaciers pebbles")
    best = parts(spark, rows, "네트워크 인터페이스")[1].score
    assert 0.40 <= best < 0.52 and got[0].verdict == "evidence-supported" and got[1].verdict != "evidence-supported"
