import time

from brute import contaminated, sha
from cases import ODD, PASSAGE, SAMPLE, empty_documents, odd_documents, sample_rows
from pyspark.sql import functions as F

from runledger.llm import decontaminate, queries

ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "four five"), (3, ""), (4, None), (None, "thirteen FOURTEEN"), (10, "two three four five six seven eight nine ten eleven zzz")]


def _items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(1))


def test_query_against_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").select("item_id", "text").collect()]
    want = set()
    for doc_id, text, *_ in sample_rows(spark):
        n_words, n_hit, ids = contaminated(text, items)
        want.add((doc_id, n_words, n_hit, len(ids), sha(",".join(ids)), n_hit > 0))
    got = [tuple(r) for r in queries.op3_decontaminate(spark, SAMPLE).collect()]
    assert set(got) == want and len(got) == len(want)


def test_odd_rows(spark):
    got = decontaminate.contamination(odd_documents(spark), _items(spark)).select("doc_id", "n_words", "n_hit", "item_ids")
    want = [(doc_id, *contaminated(text, ITEMS)) for doc_id, text, *_ in ODD]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_tables(spark):
    assert decontaminate.contamination(empty_documents(spark), _items(spark)).count() == 0
    clean = decontaminate.contamination(odd_documents(spark), _items(spark).limit(0)).collect()
    assert len(clean) == len(ODD) and not any(r["n_hit"] for r in clean)


def test_clean_documents_stay(spark):
    kept = decontaminate.keep_clean(odd_documents(spark), _items(spark))
    want = [text for _, text, *_ in ODD if contaminated(text, ITEMS)[1] == 0]
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(text or "" for text in want)
    assert kept.columns == odd_documents(spark).columns


def test_one_word_repeated_costs_its_length(spark):
    """200,000 times the word that an item repeats: every place is a candidate, none is looked up in the text."""
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, "word " * 9), (3, "so word " * 4)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "Word " * 10), (6, "so word")], "item_id long, text string")
    begin = time.monotonic()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (200_000, 200_000, ["5"]), 2: (9, 0, []), 3: (8, 8, ["6"])}
    assert time.monotonic() - begin < 120


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the red old fox ran"), (2, "red fox"), (3, "fox then red"), (4, "red a b c fox")], "doc_id long, text string")
    phrases = spark.createDataFrame([("Red fox",)], "phrase string")
    near = lambda slop: sorted(r["doc_id"] for r in decontaminate.proximity_matches(docs, phrases, slop).collect())
    assert near(0) == [2]
    assert near(1) == [1, 2]
    assert near(3) == [1, 2, 3, 4]


def test_plan_has_no_python(spark):
    plan = decontaminate.contamination(odd_documents(spark), _items(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
