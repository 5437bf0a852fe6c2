"""The Merkle manifest against its SQL and a plain tree."""

from __future__ import annotations

from hashlib import sha256

import duckdb
import pytest
from cases import SAMPLE, empty_documents, odd_documents
from pyspark.sql import functions as F

from runledger.llm import manifest, queries


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes: list[str], arity: int) -> tuple[str, list[str]]:
    """The top, and for each node its siblings level by level, left to right."""
    paths, at, level = [""] * len(nodes), list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[k : k + arity] for k in range(0, len(level), arity)]
        for leaf, node in enumerate(at):
            run = runs[node // arity]
            paths[leaf] += "".join(run[: node % arity] + run[node % arity + 1 :])
            at[leaf] = node // arity
        level = [digest(*run) for run in runs]
    return level[0], paths


@pytest.mark.parametrize("arity, levels", [(2, 2), (3, 2)])
def test_trees_of_any_size_in_blocks(spark, arity, levels):
    sizes = {None: 1, "": 9, "b": 40, "é": 4}
    rows = [(k, lang) for lang, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string").withColumns({c: F.lit(None).cast("string") for c in ("source", "n_chars", "text")})
    got = {(r["lang"], r["doc_id"]): r for r in manifest.manifest(docs, arity=arity, levels=levels).withColumn("proof", manifest.path_text(F.col("path"))).collect()}
    piece = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {lang: plain_tree([digest(piece(k), "-", piece(lang), "--") for k in range(n)], arity) for lang, n in sizes.items()}
    root, above = plain_tree([trees[lang][0] for lang in sizes], arity)
    assert len(got) == len(rows)
    for rank, lang in enumerate(sizes):
        for k in range(sizes[lang]):
            row = got[lang, k]
            assert (row["subroot"], row["root"], row["folded_root"]) == (trees[lang][0], root, root)
            assert row["proof"] == trees[lang][1][k] + above[rank]


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumn("n_chars", F.lit(None).cast("long"))
    found = manifest.audited_documents(docs).collect()
    assert len(found) == docs.count() and {r["root"] for r in found} == {r["folded_root"] for r in found}
    assert manifest.audited_documents(empty_documents(spark).withColumn("n_chars", F.lit(1))).count() == 0


def test_query_against_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SAMPLE}/documents.parquet'")
    want = duckdb.sql(manifest.ORACLE_SQL)
    got = queries.op12_dataset_manifest(spark, SAMPLE).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
