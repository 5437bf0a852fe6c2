import random
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from brute import token_rows
from cases import ODD, SAMPLE, empty_documents, odd_documents, sample_rows

from runledger.llm import binary, queries, tokens

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

PIECES, WORDS = queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def words():
    return tokenizers.Tokenizer.from_file(WORDS)


def _random_texts(alphabet: str, count: int = 3000) -> list[str]:
    random.seed(13)
    return ["".join(random.choice(alphabet) for _ in range(random.randint(0, 70))) for _ in range(count)]


def test_counts_equal_the_library(spark, pieces):
    got = {r["doc_id"]: tuple(r) for r in queries.op7_count_tokens(spark, SAMPLE).collect()}
    for doc_id, text, *_ in sample_rows(spark):
        n = len(pieces.encode(text))
        assert got[doc_id] == (doc_id, len(text.encode()), n, n > 4096)


def test_merging_on_random_texts(pieces):
    counter = tokens.PieceCounter(PIECES)
    texts = _random_texts("aabbctheinr  \n▁é-=日.0") + _random_texts("ae ") + ["a" * 3000, "=-" * 2000, "  ", "<s> <0x0A>", "▁ ▁▁"]
    assert counter.counts(texts) == [len(ids) for ids in pieces.encode(texts)]


def test_word_ids_on_random_texts(words):
    encoder = binary.WordEncoder(WORDS)
    texts = _random_texts("aAbBtThHeEsS'.,!<|>\n\t \u2003\x1c\u0307\u0308\u030aWw\u0130\u0131\u03a3\u03c3\u03c2\u00df\u00e9\u00c9\u0301\u03450\u65e5\ufb01\u01c5") + ["a<|endoftext|>b <|ENDOFTEXT|>", "don't WE'LL", ""]
    want = [ids.ids + [2] for ids in words.encode_batch(texts, add_special_tokens=False)]
    assert [list(memoryview(raw).cast("I")) for raw in encoder.encode(texts)] == want


def test_files_against_brute_force(spark, words):
    rows = [(r[0], r[1]) for r in sample_rows(spark)]
    want = token_rows(rows, lambda text: words.encode(text, add_special_tokens=False).ids)
    assert sorted(map(tuple, queries.op9_token_files(spark, SAMPLE).collect())) == sorted(want)


def test_selective_reads(spark, tmp_path):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    path = binary.write_tokens(docs, str(tmp_path / "ids"), WORDS)
    positions = binary.read_positions(spark, path)
    plan = positions._jdf.queryExecution().executedPlan().toString()
    assert "start_in_part:bigint" in plan and "ids:array" not in plan
    one = binary.read_tokens(spark, path).where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()
    assert len(one.collect()[0]["ids"]) == positions.where("doc_id = 7").collect()[0]["n_tokens"]


def test_odd_and_empty(spark, pieces, words):
    got = tokens.count_tokens(odd_documents(spark), PIECES).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), len(pieces.encode(t or ""))) for i, t, *_ in ODD)
    found = sorted(map(tuple, binary.tokens_on_file(odd_documents(spark), WORDS).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted([r[0] for r in ODD], key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in found[1:]] == [sum(r[2] for r in found[: k + 1]) for k in range(len(found) - 1)]
    encode = lambda text: words.encode(text, add_special_tokens=False).ids
    assert sorted(r[3] for r in found) == sorted(r[3] for r in token_rows([(i, t) for i, t, *_ in ODD], encode))
    assert tokens.count_tokens(empty_documents(spark), PIECES).count() == 0
    assert binary.tokens_on_file(empty_documents(spark), WORDS).count() == 0


def test_ids_are_read_back_without_a_copy():
    """A batch of ids is large; its checksums are taken of its own bytes."""
    tokens = SimpleNamespace(schema={"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))})
    tokens.select = lambda *columns: SimpleNamespace(mapInArrow=lambda run, kind: run)
    count, each = 1000, 2000
    values = np.arange(count * each, dtype=np.int32)
    ids = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * each), pa.array(values))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(count))] * 2 + [ids], ["doc_id", "start", "ids"])
    tracemalloc.start()
    (found,) = binary.digests(tokens)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.column("n_tokens").to_pylist() == [each] * count
    assert found.column("ids_crc32")[3].as_py() == zlib.crc32(values[3 * each : 4 * each].astype("<u4").tobytes())
    assert peak < 4 << 20
