import tokenizers
from brute import WORD, components, contaminated, mix_targets, token_rows
from cases import SAMPLE, odd_documents
from pyspark.sql import functions as F

import __spark_entry__ as entries
import corpus_pipeline
from runledger.llm import queries
from runledger.llm.common import stored


def test_each_stage_against_brute_force(spark):
    """Every stage's rows from its own input by plain means, and the whole run as the stages in turn."""
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SAMPLE), "test-stage"))
    assert all(table.columns == columns for table in tables[:-1])
    raw, good, distinct, clean, mixed = ([r.asDict() for r in t.orderBy("doc_id").collect()] for t in tables[:-1])

    kept = {r["doc_id"] for r in queries.op8_quality_votes(spark, SAMPLE).collect() if r["kept"]}
    assert [r["doc_id"] for r in good] == sorted(kept) and len(raw) > len(good)

    roots = components([r["text"] for r in good], 5)
    assert [r["doc_id"] for r in distinct] == [r["doc_id"] for k, r in enumerate(good) if roots[k] == k]

    items = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").select("item_id", "text").collect()]
    assert [r["doc_id"] for r in clean] == [r["doc_id"] for r in distinct if contaminated(r["text"], items)[1] == 0]

    sizes = {}
    for r in clean:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"]))
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    for source, target in mix_targets(sizes).items():
        largest = max(len(WORD.findall(r["text"])) for r in clean if r["source"] == source)
        assert abs(taken[source] - target) <= largest

    tokenizer = tokenizers.Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = token_rows([(r["doc_id"], r["text"]) for r in mixed], lambda text: tokenizer.encode(text, add_special_tokens=False).ids)
    assert sorted(map(tuple, tables[-1].collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SAMPLE).collect())) == sorted(want)


def test_stages_take_odd_rows(spark):
    docs = odd_documents(spark).withColumn("n_chars", F.length("text"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            assert stage(spark, table, SAMPLE).columns == docs.columns
            stage(spark, table, SAMPLE).count()


def test_entries_hold_all_operators():
    names = entries.queries()
    assert {int(name[2:].split("_")[0]) for name in names if name.startswith("op") and name[2].isdigit()} == set(range(1, 11))
    assert "pipeline" in names
    assert set(entries.oracle_sql()) <= set(names)
