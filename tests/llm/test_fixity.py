import duckdb
from cases import SAMPLE
from compare import difference
from pyspark.sql import functions as F

from runledger.llm import fixity, queries


def _pages(spark, count=60):
    rows = [(k, f"http://x/{k}", "<p>" + "text " * (k * 50) + "</p>") for k in range(count)]
    rows += [(None, None, None), (3, "http://x/3", ""), (3, "http://x/3", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))


def test_query_against_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"create view pages as select * from read_parquet('{SAMPLE}/pages.parquet')")
    assert difference(queries.op2_fixity_audit(spark, SAMPLE), connection, fixity.ORACLE_SQL) is None


def test_records_lie_one_after_another(spark):
    rows = fixity.archive(_pages(spark)).orderBy("file", "offset").collect()
    at = {}
    for row in rows:
        assert row["offset"] == at.get(row["file"], 0)
        assert row["length"] == len(row["content"])
        at[row["file"]] = row["offset"] + row["length"]
    assert bytes(rows[0]["content"]).startswith(b"WARC/1.1\r\n")
    assert len(rows) == 63


def test_audit_finds_exactly_the_damage(spark):
    records = fixity.stored(fixity.archive(_pages(spark)), "test-records")
    whole = fixity.Tree(records)
    assert fixity.audit(whole, fixity.Tree(records)).count() == 0
    changed = records.where("page_id is null or page_id <> 7").withColumn("content", F.when(F.col("page_id") == 11, F.lit(b"x")).otherwise(F.col("content")))
    found = fixity.audit(whole, fixity.Tree(changed)).collect()
    assert sorted((r["page_id"], r["kind"]) for r in found) == [(7, "missing"), (11, "changed")]
    assert sorted(r["kind"] for r in fixity.audit(fixity.Tree(changed), whole).collect()) == ["added", "changed"]


def test_empty_replicas(spark):
    none = fixity.stored(fixity.archive(_pages(spark).limit(0)), "test-none")
    some = fixity.stored(fixity.archive(_pages(spark, 3)), "test-some")
    assert fixity.audit(fixity.Tree(none), fixity.Tree(none)).count() == 0
    assert {r["kind"] for r in fixity.audit(fixity.Tree(none), fixity.Tree(some)).collect()} == {"added"}


def test_replicas_of_more_files(spark):
    files = spark.range(40).select(F.col("id").alias("page_id"), (F.col("id") * 5).alias("file"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("length"), F.lit(b"a").alias("content"))
    files = fixity.stored(files, "test-files")
    found = fixity.audit(fixity.Tree(files), fixity.Tree(files.where("file < 50"))).collect()
    assert sorted(r["page_id"] for r in found) == list(range(10, 40))
