from pyspark.sql import functions as F

from pagelore.sources import robots as R

BODY = """# all
User-agent: *
Disallow: /private   # not here
Disallow:

User-agent: otherbot
User-agent: OurBot
Disallow: /beta
Allow: /beta/open
"""


def test_rules_and_addresses(spark):
    files = spark.createDataFrame([("a.example", BODY, "x"), ("b.example", "User-agent: *\r\nDisallow: /", "x"), ("c.example", None, "x"), ("d.example", "", "x")], "h string, body string, path string")
    ours = {(r.host, r.path) for r in R.rules(files, "h", "body", "ourbot").collect()}
    assert ours == {("a.example", "/beta"), ("b.example", "/")}
    any_ = {(r.host, r.path) for r in R.rules(files, "h", "body", "somebot").collect()}
    assert any_ == {("a.example", "/private"), ("b.example", "/")}
    urls = ["https://a.example/beta/1", "https://a.example/", "https://a.example", "https://b.example/x", "https://c.example/beta", "https://a.example:8080/beta"]
    df = spark.createDataFrame([(u,) for u in urls], "host string")
    got = {r.host for r in R.permitted(df, "host", R.rules(files, "h", "body", "ourbot")).collect()}
    assert got == {"https://a.example/", "https://a.example", "https://c.example/beta"}
    assert R.rules(files.limit(0), "h", "body", "x").count() == 0


def test_page_types(spark):
    df = spark.createDataFrame([("text/html; charset=utf-8", True), ("Application/XHTML+xml", True), ("application/json", False), (None, False)], "t string, want boolean")
    assert df.where(R.is_page(F.col("t")) != F.col("want")).count() == 0
