import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from brute import measures
from cases import ODD, SAMPLE, empty_documents, odd_documents, sample_rows

from runledger.llm import common, quality, queries, ragged


def test_measures_against_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op8_quality_votes(spark, SAMPLE).collect()}
    for doc_id, text, *_ in sample_rows(spark):
        want = measures(text)
        assert tuple(got[doc_id][name] for name in quality.MEASURES) == want
        assert got[doc_id]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_verdicts_against_labels(spark):
    """Nothing is learned from the labels; bad texts are rejected and good ones of enough words stay."""
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op8_quality_votes(spark, folder).collect() if r["doc_id"] in labels]
    bad = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] == 1 and not r["base_failed"]]
    assert np.mean(bad) <= 0.05 and np.mean(good) >= 0.97


def test_odd_and_empty(spark):
    rows = quality.quality(odd_documents(spark)).collect()
    assert sorted((str(r["doc_id"]), *(r[name] for name in quality.MEASURES)) for r in rows) == sorted((str(i), *measures(t)) for i, t, *_ in ODD)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality.quality(empty_documents(spark)).count() == 0
    assert quality.keep_good(empty_documents(spark)).columns == odd_documents(spark).columns


def test_the_filter_keeps_what_is_kept(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    kept = {r["doc_id"] for r in queries.op8_quality_votes(spark, SAMPLE).collect() if r["kept"]}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept
    assert quality.keep_good(docs).columns == docs.columns


def test_accuracies_are_found_again():
    """Votes drawn from known chances: the estimate tells good from bad by agreement alone."""
    rng = np.random.default_rng(5)
    rules, count = len(quality.RULES), 20000
    good = rng.random(count) < 0.8
    chance = np.where(good[:, None, None], quality.GOOD_VOTES, [0.1, 0.3, 0.6])
    votes = (rng.random((count, rules, 1)) > np.cumsum(chance, 2)).sum(2)
    patterns, where, counts = np.unique(votes @ 3 ** np.arange(rules - 1, -1, -1), return_inverse=True, return_counts=True)
    probability, found = quality.accuracies(patterns, counts.astype(float))
    assert np.mean((probability[where] > 0.5) == good) > 0.999
    assert np.abs(found[0, :, 2] - 0.6).max() < 0.1


def test_a_worker_measures_a_mebibyte_of_text_at_once():
    """What is held beside the texts is bounded by a portion, not by an Arrow batch."""
    run = quality.with_measures(SimpleNamespace(schema=[], mapInArrow=lambda run, kind: run))
    texts = pa.array([f"word{number} and some more of it, " * 60 for number in range(5000)])
    ragged._powers()
    tracemalloc.start()
    rows = sum(part.num_rows for part in run(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 5000 and texts.nbytes > 8 << 20 and peak < 120 << 20


def test_a_worker_forgets_the_words_of_another_stage(monkeypatch):
    """Tokens and words that the last stage remembered don't stand beside the sums of this one."""
    monkeypatch.delitem(sys.modules, "_remembered_by_worker", raising=False)
    words, powers = common._of_process("word encoders"), common._of_process("powers")
    words["file"], powers["up"] = "an encoder", "numbers"
    run = quality.with_measures(SimpleNamespace(schema=[], mapInArrow=lambda run, kind: run))
    assert sum(part.num_rows for part in run(iter([pa.RecordBatch.from_arrays([pa.array(["one two"])], ["text"])]))) == 1
    assert not words and powers["up"] == "numbers"


def test_sums_beside_the_texts_stay_small():
    """A worker's peak is that of 256 KiB of text, whatever the batch."""
    run = quality.with_measures(SimpleNamespace(schema=[], mapInArrow=lambda run, kind: run))
    texts = pa.array([f"word{number} and some more of it, " * 60 for number in range(3000)])
    ragged._powers()
    tracemalloc.start()
    rows = sum(part.num_rows for part in run(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and texts.nbytes > 4 << 20 and peak < 30 << 20
