"""Spelling variants by reduced-alphabet generation.

Letters are dealt to a few symbols. Every word's reduced form gets its full neighbourhood of one
edit, all insertions, deletions and replacements of symbols, as hashed keys; equal keys are
joined with the reduced vocabulary, and pairs are verified on the words themselves. One edit of
a word is at most one edit of its reduced form, so no pair is lost, whatever the symbols.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runledger.llm.common import stored, travels

travels(__name__)

LEAST_LETTERS, LEAST_COUNT, FACTOR, DAMAGED = 6, 5, 5, 199
# A to Z small, the letters from U+00C0 to U+00FF as they are, all else a blank, in one byte each.
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_KEPT = 200_000  # words counted in a task before their counts are passed on; memory only, never results
_CHUNK = 1 << 16  # letters whose neighbourhoods are made at once


def damaged_words(text: str, prefix: bytes, damage: int = DAMAGED) -> Iterator[tuple[bytes, int]]:
    """The distinct words of a text (Latin-1 bytes) and how often; a word loses one letter where ``damage`` divides its crc32."""
    start = zlib.crc32(prefix)
    for word, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % damage == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        yield word, n


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, damage: int = DAMAGED) -> DataFrame:
    """word, n over whole texts, counted inside the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            words = pa.array([word.decode("latin-1") for word in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                for word, n in damaged_words(text.as_py() or "", key.encode() + b":", damage):
                    if len(word) >= least_letters:
                        counts[word] += n
                if len(counts) > _KEPT:
                    yield passed_on()
                    counts.clear()
        yield passed_on()

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return keyed.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dealt_letters(vocabulary: DataFrame, symbols: int) -> dict[int, int]:
    """A symbol for each letter, frequent letters dealt first so that symbols are about equally frequent.

    There are at most 90 letters, so their counts come to the driver.
    """
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    order = sorted((-row["count"], row["letter"]) for row in letters.collect())
    load, of = [0] * symbols, {}
    for count, letter in order:
        least = min(range(symbols), key=lambda s: (load[s], s))
        load[least] -= count
        of[ord(letter)] = least
    return of


def symbols_for(words: int, least_letters: int = LEAST_LETTERS) -> int:
    """Symbols so that there are at least as many reduced forms of the shortest length as words."""
    return max(3, next(s for s in range(1, 91) if s == 90 or s**least_letters >= words))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def reduced_keys(words: list[str], of: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the reduced words; with their symbols, offsets and running sums for ``neighbourhoods``."""
    table = np.zeros(256, np.uint64)
    for letter, symbol in of.items():
        table[letter] = symbol + 1
    raw = [word.encode("latin-1") for word in words]
    offsets = np.concatenate([[0], np.cumsum([len(word) for word in raw])]).astype(np.int64)
    symbols = table[np.frombuffer(b"".join(raw), np.uint8)]
    place = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
    power = _powers(_BASE, int(np.diff(offsets).max(initial=0)) + 2)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * power[place], dtype=np.uint64)])
    return sums[offsets[1:]] - sums[offsets[:-1]], symbols, offsets, sums


def neighbourhoods(words: list[str], of: dict[int, int], symbols_count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of word, key) of every reduced word within one edit of the words' reduced forms, each once.

    A key is the sum of symbol x power of its place, modulo 2**64; what an edit does to it is
    known from the sums before and after the place.
    """
    whole, symbols, offsets, sums = reduced_keys(words, of)
    yield np.arange(len(words)), whole
    longest = int(np.diff(offsets).max(initial=0)) + 2
    power, every = _powers(_BASE, longest), np.arange(1, symbols_count + 1, dtype=np.uint64)
    for at in range(0, len(symbols), _CHUNK):
        flat = np.arange(at, min(at + _CHUNK, len(symbols)))
        owner = np.searchsorted(offsets, flat, "right") - 1
        place, own = flat - offsets[owner], symbols[flat]
        before, after = sums[flat] - sums[offsets[owner]], sums[offsets[owner + 1]] - sums[flat + 1]
        last = np.where(place > 0, symbols[flat - 1], np.uint64(0))
        differs = own != last  # of equal neighbours one deletion is enough
        yield owner[differs], (before + after * _BACK)[differs]
        other = every[None, :] != own[:, None]
        replaced = whole[owner][:, None] + (every[None, :] - own[:, None]) * power[place][:, None]
        yield np.repeat(owner, symbols_count)[other.ravel()], replaced[other]
        # A symbol put before an equal one gives what one put behind it gives.
        rest = sums[offsets[owner + 1]] - sums[flat]
        inserted = before[:, None] + every[None, :] * power[place][:, None] + (rest * _BASE)[:, None]
        yield np.repeat(owner, symbols_count)[other.ravel()], inserted[other]
    size = np.diff(offsets)
    ends = whole[:, None] + every[None, :] * power[size][:, None]
    yield np.repeat(np.arange(len(words)), symbols_count), ends.ravel()


def near_words(vocabulary: DataFrame, symbols: int | None = None) -> DataFrame:
    """word, other, other_n: all pairs of words one inserted, deleted or replaced letter apart, both ways.

    ``vocabulary`` (id, word, n; one row per word) is a stored table. The many keys of a word carry
    its id alone, so a word costs its length and not the square; a task holds one batch and the
    keys of ``_CHUNK`` letters.
    """
    symbols = symbols or symbols_for(vocabulary.count())
    of = dealt_letters(vocabulary, symbols)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = reduced_keys(batch.column("word").to_pylist(), of)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("word"), batch.column("n")], ["key", "other", "other_n"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for index, keys in neighbourhoods(batch.column("word").to_pylist(), of, symbols):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[index])], ["key", "id"])

    reduced = vocabulary.mapInArrow(own, "key long, other string, other_n long")
    edits = vocabulary.select("id", "word").mapInArrow(around, "key long, id long")
    # The vocabulary is the smaller side by far; hashed in each task, it spares a sort of the edits.
    met = edits.join(reduced.hint("shuffle_hash"), "key").join(vocabulary.select("id", "word").hint("shuffle_hash"), "id")
    one_apart = (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
    return met.where(one_apart).select("word", "other", "other_n").distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: each round doubles how far a word has followed its forms.

    Counts grow by the factor along a chain, so a chain of k words needs a count of factor ** k
    and the rounds stay few.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = stored(step, "spelling-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_groups(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, factor: int = FACTOR, damage: int = DAMAGED, symbols: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of whole texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case. A word's form is the
    near word of largest n (ties: first in code-point order) with at least ``factor`` times its n,
    its root the end of the chain of forms, the word itself where there is none. A null id counts as
    empty text in the damage rule, null and empty texts have no words, repeated rows count each;
    other columns are not read; an empty table gives no rows. A word of any length is compared as a
    whole.
    """
    counted = word_counts(docs, least_letters, damage).where(F.col("n") >= least_count)
    vocabulary = stored(counted.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = near_words(vocabulary, symbols).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    joined = vocabulary.join(near, "word", "left")
    best_n = -F.col("best.less")

    def if_form(value: Column) -> Column:
        return F.when(best_n >= factor * F.col("n"), value)

    known = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), if_form(F.col("best.other")).alias("form"), if_form(best_n).alias("form_n"))
    known = stored(known, "spelling-forms")
    return known.join(_followed(known.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
