"""Removal of repeated strings against a count of all windows of all texts."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from collections import Counter
from hashlib import sha256

import pytest
from cases import SAMPLE, empty_documents, odd_documents, sample_rows

from runledger.llm import suffixes


def plain(rows, least) -> list[tuple]:
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    counts = Counter(text[p : p + least] for _, text in texts for p in range(len(text) - least + 1))
    out = []
    for doc_id, text in texts:
        gone = bytearray(len(text))
        for p in range(len(text) - least + 1):
            if counts[text[p : p + least]] > 1:
                gone[p : p + least] = b"\x01" * least
        spans = bytes(gone).replace(b"\x00", b" ").split()
        kept = bytes(c for c, g in zip(text, gone) if not g)
        out.append((doc_id, len(text), sum(gone), len(spans), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, least) -> list[tuple]:
    rows = suffixes.without_repeats(docs, least).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((tuple(row) for row in rows), key=str)


def test_sample_equals_a_count_of_all_windows(spark):
    rows = [(row[0], row[1]) for row in sample_rows(spark, SAMPLE)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), suffixes.LEAST) == plain(rows, suffixes.LEAST)


@pytest.mark.parametrize("least, seed", [(40, 1), (40, 2), (60, 3), (100, 4)])
def test_pieces_in_any_order(spark, least, seed):
    """Texts of pieces around the length looked for, cut at any byte, periodic ones among them."""
    r = random.Random(seed)
    letters = "abé \n"
    pieces = ["".join(r.choice(letters) for _ in range(r.randint(least // 2, 3 * least))) for _ in range(12)]
    pieces += ["a" * (2 * least), "ab" * least, "abc " * least]
    rows = []
    for k in range(40):
        parts = [p[r.randint(0, len(p) // 3) : len(p) - r.randint(0, len(p) // 3)] for p in r.choices(pieces, k=r.randint(1, 4))]
        rows.append((k, "".join(part + "".join(r.choice(letters) for _ in range(r.randint(0, 9))) for part in parts)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), least) == plain(rows, least)


def test_odd_rows(spark):
    rows = [(row.doc_id, row.text) for row in odd_documents(spark).collect() if row.doc_id != 6]
    long_text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(3000))
    more = [(9, long_text), (9, long_text), (10, "z" + long_text[100:700]), (None, long_text[:399]), (11, long_text[-400:])]
    odd = odd_documents(spark).where("doc_id is null or doc_id <> 6")
    odd = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert found(odd, 400) == plain(rows + more, 400)
    assert found(empty_documents(spark), 400) == []


def test_long_texts_are_cut_alike_in_segments(monkeypatch):
    import numpy as np

    data = np.frombuffer(random.Random(9).randbytes(20000), np.uint8)
    shape = suffixes.Shape.of(400)
    whole = suffixes.cuts(data, shape)
    monkeypatch.setattr(suffixes, "_SEGMENT", 777)
    assert suffixes.cuts(data, shape).tolist() == whole.tolist()
    assert np.diff(whole).max() <= shape.width


_STORES = """
import os, sys
from pathlib import Path
from pyspark.sql import functions as F
from runledger.llm.common import CLEANUP, stored
from runledger.session import build_session

spark = build_session("stores", "local[2]", spark__ui__enabled="false", spark__checkpoint__dir=sys.argv[1] + "/shared")
rows = stored(spark.range(5000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
left = [path for path in Path(sys.argv[1]).rglob("shuffle_*") if path.is_file()]
print("LEFT", len(left), rows.agg(F.sum("count")).first()[0], spark.conf.get(CLEANUP))
"""


def test_a_stored_table_leaves_no_shuffle_files(tmp_path):
    """They would stand beside the next step's until the driver happens to collect its garbage."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    run = subprocess.run([sys.executable, "-c", _STORES, str(tmp_path)], env=env, capture_output=True, text=True, timeout=120)
    assert run.stdout.split("LEFT")[-1].split() == ["0", "5000", "false"], run.stderr[-2000:]
