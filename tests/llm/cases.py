"""Documents with everything that is awkward: nulls, blanks, repeats, long texts, names that clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SAMPLE = "/root/testdata/sf0.001"
_CLASHING = ("key", "place", "copies", "digest", "label", "words", "found", "quality", "part", "ids")

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ODD = [
    (1, "A short text.", "en", "a"),
    (1, "A short text.", "en", "a"),
    (2, "", "en", "a"),
    (3, None, None, None),
    (None, PASSAGE, "en", None),
    (None, PASSAGE.upper() + " fifteen", None, "b"),
    (4, "   \n\t ", "de", "b"),
    (5, "é" * 3000 + " ü", "fr", ""),
    (6, "word " * 30000, "en", "c"),
    (6, "another text under the same id", "en", "c"),
    (7, PASSAGE.replace(" ", "\n"), "es", "c"),
    (8, "\x00 ퟿ 日本語 😀 <s> <|endoftext|> a@b.co +1 (415) 555-2671 4111 1111 1111 1111 10.0.0.256 10.0.0.25", "en", "d"),
]


def odd_documents(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({name: F.lit(1) for name in _CLASHING})


def empty_documents(spark: SparkSession) -> DataFrame:
    return odd_documents(spark).limit(0)


def sample_rows(spark: SparkSession, folder: str = SAMPLE) -> list[tuple]:
    df = spark.read.parquet(f"{folder}/documents.parquet")
    return [tuple(row) for row in df.select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]
