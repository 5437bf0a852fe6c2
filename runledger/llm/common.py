"""What several operators share: tables in the shared folder, size-checked broadcasts, row keys."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runledger.session import work_path

# Rows of a side that may be sent to every task; all such rows hold a few short columns.
BROADCAST_ROWS = 200_000

WORD = r"[^\x20\x09-\x0D]+"


def travels(module: str) -> None:
    """Send a module's functions to the workers by value, so they need no path to this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


class Memo(dict):
    """What a worker process remembers under a name, from task to task; it travels empty. Speed only, never results."""

    def __init__(self, name: str):
        super().__init__()
        self.name = name

    def __reduce__(self):
        return _of_process, (self.name,)


def _of_process(name: str) -> Memo:
    # Functions travel by value, so a module's own variables begin anew with every task; a module
    # made in the process stays.
    kept = sys.modules.setdefault("_remembered_by_worker", types.ModuleType("_remembered_by_worker"))
    return kept.__dict__.setdefault(name, Memo(name))


def give_back() -> None:
    """Return to the machine what Arrow and the C library keep of freed memory; called where a task begins."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def remember_only(*names: str) -> None:
    """Drop what this worker process remembers under other names and give its memory back.

    Called where a task begins: workers go from stage to stage, and the tables and words of the
    last one would stand beside what the next one needs.
    """
    kept = sys.modules.get("_remembered_by_worker")
    others = [memo for name, memo in vars(kept).items() if name not in names and isinstance(memo, dict)] if kept else []
    if any(others):
        for memo in others:
            memo.clear()
        gc.collect()
        give_back()


travels(__name__)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


# Shuffle files go as soon as the rows they were made for are written, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and opened again: computed once, safe from lost executors."""
    spark = df.sparkSession
    path, before = work_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``rows`` rows, else as it is.

    Give a stored frame, for its rows are counted here. Without the hint the join shuffles.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_key(text: Column) -> Column:
    """A number that tells texts of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with working ones."""
    return df.select(*names)


# What lies between words of letters and digits; characters beyond ASCII belong to words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OF_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(word: Column) -> Column:
    """The word with A to Z in lower case and nothing else changed.

    Translating goes character by character; it is left to words with capitals beyond A to Z.
    """
    lower = F.lower(word)
    return F.when(F.octet_length(word) == F.length(word), lower).when(word.rlike(_OTHER_CAPITALS), F.translate(word, _CAPITALS, _SMALL)).otherwise(lower)


def known_words(words: DataFrame, vocabulary: DataFrame, column: str = "term") -> DataFrame:
    """The rows whose word is in a stored vocabulary with one row per word.

    A small vocabulary goes to every task, a large one is joined by a shuffle.
    """
    return words.join(sent_if_small(vocabulary.select(column)), column, "left_semi")
