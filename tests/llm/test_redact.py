from auditlark.llm import secrets as S

KEY = "tB9xQ2mZ7kLp0WvR4sYcD8nHq1"


def test_a_harmless_word_does_not_hide_a_secret_beside_it(spark):
    texts = [f"at /srv/samples/deploy/{KEY} end", f"b AAAAAAAA{KEY} e", f"b {KEY}AAAAAAAAAAAA/{KEY[::-1]} e", f"x EXAMPLE{KEY[:20]} y", f"sha256-{KEY} z", None, f"{KEY}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.text for r in S.redact(docs).orderBy("doc_id").collect()]
    for i in (0, 1, 2, 6):
        assert "[entropy_base64]" in found[i] and KEY[1:-1] not in found[i] and KEY[::-1][1:-1] not in found[i], found[i]
    assert found[2].count("[entropy_base64]") == 2
    assert found[3:6] == texts[3:6]
