import json

from nested_brute import child_rows

from pagelore.operators import nested as N
from pagelore.operators import reports as R
from pagelore.session import table

SNAP = {"blocks": [{"id": "b1", "ref": "r1"}, {"id": "b2", "ref": "r2"}, {"id": "b1", "ref": "late"}]}
CLAIM = {"claimId": "c1", "supportSnippets": {"blockId": "b1", "stableRef": None}, "citation": {"url": "https://a.example/"}}
PAYLOADS = [
    json.dumps({"snapshot": SNAP, "evidence": {"claimOutcomes": [CLAIM]}}),
    json.dumps({"result": {"snapshot": SNAP, "evidence": {"claimOutcomes": [], "supportedClaims": CLAIM, "unsupportedClaims": [{"claimId": "c2", "citation": {"url": ""}}]}}}),
    json.dumps(json.dumps({"data": {"result": {"snapshot": {"blocks": {"id": "b1", "ref": None}}, "evidence": None}}})),
    json.dumps({"snapshot": {"blocks": None}, "evidence": {"claimOutcomes": None, "evidenceSupportedClaims": [], "contradictedClaims": [{"claimId": "c9", "supportSnippets": [{"blockId": "nope"}, {"stableRef": "own"}]}]}}),
    json.dumps({"snapshot": SNAP})[:-9],
    json.dumps({"snapshot": SNAP}) + " rest",
    json.dumps({"snapshot": SNAP}) + "," + json.dumps({"snapshot": SNAP}),
    "", "null", "[]", "7", None,
    json.dumps({"snapshot": {"blocks": [{"id": "b", "ref": "x" * 200_000}]}}),
]


def test_children_equal_brute_force(spark):
    rows = list(enumerate(PAYLOADS))
    df = spark.createDataFrame([(i, p, "v", 1) for i, p in rows + rows[:2]], "record_id long, payload string, value string, no int")
    got = sorted(map(tuple, R.children(df, "record_id", "payload").collect()), key=str)
    assert got == sorted((x for i, p in rows for x in child_rows(i, p)), key=str)


def test_children_of_test_tables(spark):
    df = table(spark, "/root/testdata/sf0.001", "report_records")
    got = sorted(map(tuple, R.children(df, "record_id", "payload").collect()), key=str)
    want = sorted((x for r in df.dropDuplicates(["record_id"]).collect() for x in child_rows(r.record_id, r.payload)), key=str)
    assert got == want and len(got) > 100


def test_flat_tables_follow_the_merged_schema(spark):
    docs = [{"a": [{"b": [1, 2]}, {"b": 3}, {}]}, {"a": {"b": [[4], 5]}, "odd key": [None]}, {"a": []}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "id long, p string")
    t = N.flat_tables(df, "id", "p")
    assert [(r.id, r.no_1) for r in t["$.a"].orderBy("id", "no_1").collect()] == [(0, 1), (0, 2), (0, 3), (1, 1)]
    got = t["$.a[*].b"].selectExpr("id", "no_1", "no_2", "to_json(value) j").orderBy("id", "no_1", "no_2").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, "1"), (0, 1, 2, "2"), (0, 2, 1, "3"), (1, 1, 1, "[4]"), (1, 1, 2, "5")]
    assert N.flat_tables(df.limit(0), "id", "p") == {}
    empty = spark.createDataFrame([], "record_id long, payload string")
    assert R.children(empty, "record_id", "payload").count() == 0


def test_schema_text_is_read_back():
    n = N.parse_schema("OBJECT<`a b`: ARRAY<OBJECT<x: DECIMAL(3,1), y: VARIANT>>, c: BIGINT, `d``e`: OBJECT<z: ARRAY<STRING>>>")
    assert N.array_paths(n) == ["$['a b']", "$['d`e'].z"] and n.fields["a b"].fields["y"].open
