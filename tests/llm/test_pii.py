import random

from brute import entities, sha
from cases import ODD, SAMPLE, empty_documents, odd_documents, sample_rows
from pyspark.sql import functions as F

from runledger.llm import pii, queries


def _joined(found):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)


def test_query_against_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op4_personal_data(spark, SAMPLE).collect()}
    for doc_id, text, *_ in sample_rows(spark):
        found, row = entities(text), got[doc_id]
        assert row["base_sha256"] == sha(_joined(found))
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(f[2] == k for f in found) for k in pii.KINDS]
        assert set(_joined(found).split(",")) <= set(row["spans"].split(","))


def test_patterns_on_random_texts(spark):
    random.seed(7)
    texts = ["".join(random.choice("a1.@-+ ()25%_é\n0") for _ in range(random.randint(0, 70))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f x@y.com.@z.z", "1.2.3.4.5 0256.1.1.1 000255.0.0.1", "4111 1111 1111 1111 4111-1111-1111-1111-5", "+1 (415) 555-2671..", "9" * 20000, "a" * 20000 + "@" + "b.c" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    got = dict(tuple(r) for r in rows.select("n", pii.joined(pii.base_spans(F.col("text")))).collect())
    assert [t for n, t in enumerate(texts) if got[n] != _joined(entities(t))] == []


def test_odd_and_empty(spark):
    rows = pii.personal_data(odd_documents(spark)).select("doc_id", pii.joined(F.col("base")).alias("b")).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str((i, _joined(entities(t)))) for i, t, *_ in ODD)
    assert pii.personal_data(empty_documents(spark)).count() == 0


def test_terms_that_give_an_entity_away(spark):
    """A nickname that occurs only beside an address is taken out; common words and other texts stay."""
    texts = [f"Common words here number{k} and Zorblax writes from zor@blax.org today" for k in range(5)]
    texts += [f"Common words here and there, today and always, text {k}" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    given = {s["value"] for s in rows[0]["spans"]} - {"zor@blax.org"}
    assert given == {"Zorblax", "writes", "from"}
    assert all(not rows[k]["spans"] for k in range(5, 205))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[0] == "Common words here number0 and    [email] today"
    assert clean[100] == texts[100]


def test_plan_has_no_python(spark):
    plan = pii.personal_data(odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
