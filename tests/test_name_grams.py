"""Searches by the postings of three-letter grams against the scan."""

import random

import pytest
from helpers import dicts
from pyspark.sql import functions as F

from runledger.functions.predicates import contains_text
from runledger.sources.name_grams import NameGrams, grams_of

LETTERS = "abAB ßéÉ%_"


def names():
    some = random.Random(5)
    made = [(n, "".join(some.choice(LETTERS) for _ in range(some.randint(0, 12)))) for n in range(300)]
    return [*made, (1, "aaaa"), (900, None), (901, "ab"), (902, "Long " * 5000 + "end"), (903, "back\\slash"), (904, "aaaa")]


def index(spark, path, ignore_case):
    table = spark.createDataFrame(names(), "id long, name string")
    made = NameGrams(spark, str(path / f"grams-{ignore_case}"), "id", "name", ignore_case)
    made.write(table)
    return table, made


@pytest.mark.parametrize("ignore_case", [False, True])
def test_searches_equal_the_scan(spark, tmp_path, ignore_case):
    table, made = index(spark, tmp_path, ignore_case)
    some, texts = random.Random(7), [name for _, name in names() if name and len(name) > 5]
    values = ["", "a", "ab", "aaa", "ong Lon", "ss", "k\\\\s", "zzz", "aaaz"]
    for _ in range(12):
        text = some.choice(texts)
        at = some.randint(0, min(len(text), 12) - 4)
        values.append(text[at : at + some.randint(3, 6)])
    for value in values:
        want = table.where(contains_text(F.col("name"), value, ignore_case))
        assert sorted(map(repr, dicts(made.search(table, value)))) == sorted(map(repr, dicts(want))), value


def test_the_plan_reads_postings_of_the_rarest_grams(spark, tmp_path):
    table, made = index(spark, tmp_path, False)
    plan = made.candidates("Long Long end")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    assert [row["id"] for row in dicts(made.candidates("ng end"))] == [902]
    assert made.candidates("ab") is None
    assert made.candidates("zzzz").isEmpty()


def test_grams_of_a_value():
    assert grams_of("abcd") == ["abc", "bcd"]
    assert grams_of("abc%de_fgh") == ["abc", "fgh"]
    assert grams_of("a\\%bcd") == [] and grams_of("ab") == [] and grams_of("") == []


def test_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, name string")
    made = NameGrams(spark, str(tmp_path / "none"), "id", "name")
    made.write(empty)
    assert made.search(empty, "abc").isEmpty()
