import zlib

import numpy as np
from cases import ODD, SAMPLE, empty_documents, odd_documents, sample_rows
from pyspark.sql import functions as F

from runledger.llm import language, queries


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op10_language(spark, SAMPLE).collect()}
    right = []
    for doc_id, _, lang, _ in sample_rows(spark):
        held_out = zlib.crc32(str(doc_id).encode()) % 3 == 1
        assert rows[doc_id]["held_out"] == held_out
        assert 0 <= rows[doc_id]["score"] <= 1
        if held_out:
            right.append(rows[doc_id]["lang_pred"] == lang)
    assert np.mean(right) >= 0.97


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(language.remainder(F.col("doc_id")) == 1, "xx").otherwise(F.col("lang")))
    one, two = (sorted(map(tuple, language.identify(d).collect())) for d in (docs, spoilt))
    assert one == two


def test_foreign_text_is_rejected(spark):
    model = language.fit(spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text", "lang"))
    texts = spark.createDataFrame([(1, "これは日本語の文章です。" * 5), (2, "1234 !!"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language.predict(texts, model).collect()}
    assert rows[1]["rejected"] and rows[1]["lang_pred"] != "und"
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[2]["score"] == 0


def test_clusters_find_separate_groups():
    rng = np.random.default_rng(1)
    centres = np.eye(4, 16)
    vectors = language.unit(np.repeat(centres, 50, axis=0) * 9 + rng.random((200, 16)) * 0.2, np.ones(16))
    found, reach = language.clusters(vectors, 4)
    assert np.allclose(np.sort((found @ centres.T).max(0)), 1, atol=0.05) and (reach > 0.9).all()


def test_odd_and_empty(spark):
    rows = language.identify(odd_documents(spark)).collect()
    assert len(rows) == len(ODD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert language.identify(empty_documents(spark)).count() == 0
    unlabelled = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
