import duckdb
import pytest
from brute import WORD, grouped, mix_targets
from cases import SAMPLE, empty_documents, odd_documents
from compare import difference
from pyspark.sql import functions as F

from runledger.llm import mixing, queries


def test_query_against_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from read_parquet('{SAMPLE}/documents.parquet')")
    assert difference(queries.op1_mix_sources(spark, SAMPLE), connection, mixing.ORACLE_SQL) is None


def test_targets_hand_the_excess_on(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 30, None: 500}, {"a": 5}, {"a": 0, "b": 7}, {"a": 0, "b": 0}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(mixing.cyclic_weights(rows)).collect()}
        assert got == pytest.approx(mix_targets(sizes))


def test_odd_rows(spark):
    rows = mixing.mix(odd_documents(spark)).collect()
    assert len(rows) == odd_documents(spark).count()
    for row in rows:
        assert 0 <= row["copies"] <= 2
    by_source = grouped((r["source"], r) for r in rows)
    for source, own in by_source.items():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        largest = max(r["size"] for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 2 * largest
    assert {(r["doc_id"], r["size"]) for r in rows} >= {(2, 0), (3, 0), (6, 30000)}


def test_reruns_agree_and_empty(spark):
    docs = odd_documents(spark)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty_documents(spark)).count() == 0
    assert mixing.mixed_documents(empty_documents(spark)).count() == 0


def test_many_documents_come_near_their_targets(spark):
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.lit("one two three").alias("text"),
        F.when(F.col("id") < 15000, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("source"),
    )
    taken = mixing.mixed_documents(docs).groupBy("source").count()
    targets = mixing.mix(docs).groupBy("source").agg(F.max("target").alias("target"))
    for row in taken.join(targets, "source").collect():
        assert abs(3 * row["count"] - row["target"]) <= 3
    assert sum(len(WORD.findall(r["text"])) for r in docs.limit(2).collect()) == 6
