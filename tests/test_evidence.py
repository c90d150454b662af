import pytest

from pagelore.functions import plaintext as X
from pagelore.operators import evidence as E

BLOCKS = "page long, ord int, kind string, role string, ref string, text string, attributes string, score double"
CLAIMS = "page long, claim long, statement string, text string"


def against(claim, passage):
    return E.contradicts(X.normalize(claim), passage, X.all_tokens, X.significant, X.normalize, X.anchors, X.tokens_match)


@pytest.mark.parametrize("claim,passage,yes", [
    ("The export is available in Tarvok.", "The export is not available in Tarvok.", True),
    ("The export is not available in Tarvok.", "The export is available in Tarvok.", True),
    ("Calls are asynchronous in Tarvok.", "Calls are synchronous in Tarvok.", True),
    ("The export is available in Tarvok.", "The export is available in Tarvok.", False),
    ("The export is available in Tarvok.", "Nothing of the kind stands here.", False),
    ("The list is mutable after loading.", "An immutable list stays as it is after loading.", False),
])
def test_polarity(claim, passage, yes):
    assert against(claim, passage) is yes


def page(*blocks):
    return [(1, i, kind, role, f"r{zone}:{kind}:{i}", text, None, 0.0) for i, (kind, role, zone, text) in enumerate(blocks, 1)]


def judge(spark, rows, *statements):
    b = spark.createDataFrame(rows, BLOCKS)
    c = spark.createDataFrame([(1, i, s, "x") for i, s in enumerate(statements)], CLAIMS)
    return {r.claim: r for r in E.verdicts(c, b).collect()}


def test_verdicts(spark):
    rows = page(
        ("heading", "content", "main", "Tarvok limits"),
        ("text", "content", "main", "Tarvok keeps every snapshot for 30 days unless a hold is placed on it."),
        ("text", "content", "main", "The export is not available in Tarvok on weekends."),
        ("link", "primary-nav", "nav", "Pricing"),
        ("text", "content", "main", None),
    )
    got = judge(spark, rows, "Tarvok keeps every snapshot for 30 days unless a hold is placed on it.", "The export is available in Tarvok on weekends.", "Penguins build their nests from pebbles near glaciers.", "   ")
    assert got[0].verdict == "evidence-supported" and got[0].support[0] == "rmain:text:2" and got[0].band in ("high", "medium")
    assert got[1].verdict == "contradicted" and got[2].verdict in ("insufficient-evidence", "needs-more-browsing") and 3 not in got
    none = judge(spark, [], "Tarvok keeps snapshots.")
    assert none[0].verdict == "insufficient-evidence" and none[0].reason == "no-supporting-block"


def test_partitions_and_repeats_do_not_matter(spark):
    rows = page(*[("text", "content", "main", f"Tarvok keeps every snapshot number {i} for {i} days.") for i in range(12)])
    b = spark.createDataFrame(rows, BLOCKS)
    c = spark.createDataFrame([(1, 7, "Tarvok keeps every snapshot for 5 days.", "x")], CLAIMS)
    one = [(r.ord, r.seg_no, round(r.score, 9), r["rank"]) for r in E.scored(c, b).orderBy("rank").collect()]
    two = [(r.ord, r.seg_no, round(r.score, 9), r["rank"]) for r in E.scored(c, b.repartition(6)).orderBy("rank").collect()]
    assert one == two and [x[3] for x in one] == list(range(1, len(one) + 1)) and all(0 < x[2] <= 1 for x in one)
    top = E.top_support(E.scored(c, b)).collect()
    assert len(top) == 3 and len({r.ord for r in top}) == 3


def test_conflicts_of_claims(spark):
    rows = [(1, 1, "The Tarvok export is available."), (1, 2, "The Tarvok export is not available."), (1, 3, "The cursor is enabled."), (2, 4, "The Tarvok export is unavailable."), (1, 5, None), (1, 6, "The Melquin cursor is not enabled.")]
    df = spark.createDataFrame(rows + rows[:2], "page long, claim long, statement string")
    got = {tuple(r) for r in E.conflicts(df.distinct()).collect()}
    assert (1, 1, 2) in got and all(p == 1 and a < b for p, a, b in got) and not any(4 in r for r in got)
