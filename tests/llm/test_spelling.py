"""Spelling groups against counting and comparing every pair of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from cases import SAMPLE, empty_documents, odd_documents, sample_rows

from runledger.llm import spelling

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def plain_words(rows, damage=spelling.DAMAGED) -> Counter:
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_groups(rows, least_letters=6, least_count=5, factor=5, damage=spelling.DAMAGED) -> set:
    n = {w: c for w, c in plain_words(rows, damage).items() if len(w) >= least_letters and c >= least_count}
    near = {w: [o for o in n if abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: o if o is not None and n[o] >= factor * n[w] else None for w, o in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(df) -> set:
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({row.word for row in rows}) == len(rows)
    return {tuple(row) for row in rows}


@pytest.mark.parametrize("symbols", [None, 2, 40])
def test_groups_equal_comparing_all_pairs(spark, symbols):
    rows = [(row[0], row[1]) for row in sample_rows(spark, SAMPLE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.spelling_groups(docs, symbols=symbols)) == plain_groups(rows)


def test_chains_of_forms_reach_their_root(spark):
    random.seed(7)
    words = {"aaaaaa": 2000, "aaaaab": 300, "aaaabb": 50, "aaabbb": 8, "ccccccc": 9, "cccccc": 9, "cccccçc": 45, "éééééé": 60, "ééééé": 400, "éééééè": 7}
    flat = [w for w, n in words.items() for _ in range(n)]
    random.shuffle(flat)
    rows = [(k, " ".join(flat[k::9])) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows, damage=10**12)
    assert found(spelling.spelling_groups(docs, damage=10**12)) == want
    assert {row[2] for row in want if row[0] == "aaabbb"} == {"aaaaaa"}


def test_neighbourhood_is_complete_and_names_nothing_twice():
    of, count = {ord(c): k % 3 for k, c in enumerate("abcdefgh")}, 3
    for word in ("a", "ab", "aabbcc", "hgfedcba"):
        reduced = "".join("012"[of[ord(c)]] for c in word)
        edits = {reduced}
        for i in range(len(reduced) + 1):
            edits |= {reduced[:i] + c + reduced[i:] for c in "012"}
            edits |= {reduced[:i] + c + reduced[i + 1 :] for c in "012" if i < len(reduced)} | {reduced[:i] + reduced[i + 1 :]}
        keys = [int(k) for _, some in spelling.neighbourhoods([word], of, count) for k in some]
        same = {0: "a", 1: "b", 2: "c"}
        want = {int(spelling.reduced_keys(["".join(same[int(c)] for c in e)], of)[0][0]) if e else 0 for e in edits}
        assert len(keys) == len(set(keys)) and set(keys) == want


def test_odd_rows(spark):
    rows = [(row.doc_id, row.text) for row in odd_documents(spark).collect()]
    long_word = "x" * 20000
    more = [(k, f"{long_word} {long_word}y Straße×Maß÷") for k in range(5)]
    odd = odd_documents(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = found(spelling.spelling_groups(odd, damage=10**12))
    words = plain_words(rows + more, 10**12)
    assert {row[0]: row[3] for row in got} == {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    assert {(row[0], row[4]) for row in got if len(row[0]) > 10000} == {(long_word, 1), (long_word + "y", 1)}
    assert found(spelling.spelling_groups(empty_documents(spark))) == set()
