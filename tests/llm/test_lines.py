from brute import dropped_lines
from cases import ODD, SAMPLE, empty_documents, odd_documents, sample_rows

from runledger.llm import lines, queries


def _ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_against_brute_force(spark):
    rows = sample_rows(spark)
    want = {r[0]: found for r, found in zip(rows, dropped_lines([r[1] for r in rows], lines.MIN_WORDS))}
    got = {r["doc_id"]: (r["n_lines"], [int(x) for x in r["dropped"].split(",") if x]) for r in queries.op5_near_lines(spark, SAMPLE).collect()}
    assert got == want


def test_one_word_apart(spark):
    base = "a b c d e f g h"
    texts = [
        base, "a b c d e f g x", "a b c d e f g h i", "x b c d e f g h", "a b c d e f h g", "b c d e f g h", "a b c d X e f g h",
        "a a b c d e f g h", "short line", "short like", "SHORT line", base.upper(), f"{base}\n\n{base} \n other", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["n_lines"], r["dropped"]) for r in lines.repeated_lines(docs).orderBy("doc_id").collect()]
    assert got == dropped_lines(texts, lines.MIN_WORDS)


def test_a_hot_template(spark):
    """Thousands of lines that differ in one word are one group; only the first stays."""
    docs = spark.createDataFrame([(k, f"value number {k} of the same long template line here") for k in range(3000)], "doc_id long, text string")
    assert [r["doc_id"] for r in lines.repeated_lines(docs).where("size(dropped) = 0").collect()] == [0]


def test_odd_and_empty(spark):
    got = lines.repeated_lines(odd_documents(spark)).collect()
    assert len(got) == len(ODD)
    assert {(r["doc_id"], r["n_lines"]) for r in got} >= {(2, 0), (3, 0), (4, 0), (7, 14)}
    assert lines.repeated_lines(empty_documents(spark)).count() == 0
    kept = lines.dedup_lines(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and kept.count() == len(ODD)


def test_plan_has_no_python(spark):
    plan = lines.repeated_lines(odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
