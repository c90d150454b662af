from pagelore.plans import block_queries as B

PLAIN = set(b"*-._0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def form_encoded(text):
    return "".join("+" if b == 32 else chr(b) if b in PLAIN else f"%{b:02X}" for b in text.encode())


def test_statements_of_all_scripts_have_an_address(spark, tmp_path):
    said = ["Plain words, 50% & more ~ *-._", "Größe über 3 €", "¿Está listo?", "요청이 201초를 넘으면", "请求 / 資源", "раураl", "é", "\U0001f600 a+b=c?", "line\nbreak\t", "", None]
    spark.createDataFrame(list(enumerate(said)), "outcome_id long, claim_statement string").write.parquet(f"{tmp_path}/claim_outcomes.parquet")
    got = {r.outcome_id: r.url for r in B.s17_search_url(spark, str(tmp_path)).collect()}
    assert got == {i: "https://search.example/?q=" + form_encoded(s) for i, s in enumerate(said) if s is not None}
