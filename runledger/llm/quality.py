"""Quality rules as weak supervision.

Each rule votes good or bad on a text, or abstains. Which votes occur together how often is
counted over all documents; expectation-maximisation on these counts estimates how each rule
votes on good and on bad texts, and a text is kept by its posterior probability of being good.
There are at most ``3 ** len(RULES)`` vote patterns, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from runledger.llm import ragged
from runledger.llm.common import remember_only, stored, travels

travels(__name__)
travels(ragged.__name__)

# Bytes of text measured at once; a worker holds some 60 times as much in running sums. Memory only, never results.
PORTION = 256 << 10
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
THRESHOLD = 0.5


def _bytes(*values: int) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(values)] = True
    return flags


_SYMBOL = _bytes(*b"#*$%&|<>")
_UPPER = _bytes(*range(0x41, 0x5B))
_LETTER = _bytes(*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100))
_SHOUT = _bytes(*b"!?")
_STARTS_POINT = ~_bytes(*range(0x80, 0xC0))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# A rule's measure, from where on it votes bad and up to where it votes good (both by its
# value), or the other way round where the first is the smaller one; between them it abstains.
# Every kind of fault is in the view of two rules at least, so that votes can confirm each other.
RULES = {
    "mean_word_chars": (13.0, 10.0),
    "longest_word_share": (0.50, 0.25),
    "symbols_per_word": (0.10, 0.02),
    "symbol_word_share": (0.10, 0.03),
    "other_char_share": (0.20, 0.10),
    "letterless_word_share": (0.10, 0.04),
    "duplicate_line_chars": (0.30, 0.10),
    "repeated_word_share": (0.30, 0.10),
    "distinct_triple_share": (0.70, 0.85),
    "capital_share": (0.30, 0.10),
    "shout_per_word": (0.20, 0.05),
}
# What a rule's votes (none, good, bad) on good and on bad texts are taken to be before any are
# counted, and the weight of that: this part of the number of documents.
GOOD_VOTES, BAD_VOTES = (0.04, 0.95, 0.01), (0.10, 0.50, 0.40)
BELIEF = 0.05


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text, and what the rules look at."""
    texts = ragged.Texts(column)
    data, count = texts.data, len(texts)
    starts, ends, owner = texts.words()
    n_words = np.bincount(owner, minlength=count)
    points = np.concatenate([[0], np.cumsum(_STARTS_POINT[data] & ~ragged._SPACE[data])])
    word_chars = points[texts.offsets[1:]] - points[texts.offsets[:-1]]
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    letterless = np.bincount(owner[letters[starts] == letters[ends]], minlength=count)
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    marked = np.bincount(owner[marks[starts] < marks[ends]], minlength=count)
    longest = np.zeros(count, np.int64)
    np.maximum.at(longest, owner, points[ends] - points[starts])
    # Lines with a word, and those equal to an earlier one of their text.
    line_starts, line_ends, line_owner = texts.spans(data != 0x0A)
    full = points[line_starts] < points[line_ends]
    line_starts, line_ends, line_owner = line_starts[full], line_ends[full], line_owner[full]
    line_hash = ragged.span_hashes(data, line_starts, line_ends)
    n_lines = np.bincount(line_owner, minlength=count)
    line_chars = points[line_ends] - points[line_starts]
    hashes = ragged.span_hashes(data, starts, ends)
    triples, _ = ragged.windows(hashes, owner, 3)
    line_at = ragged.bounds(line_owner, count)
    triple_at = np.concatenate([[0], np.cumsum(np.maximum(n_words - 2, 0))])
    dup_lines, dup_chars, repeated, distinct = np.zeros((4, count), np.int64)
    for k in range(count):
        if n_lines[k] > 1:
            _, first = np.unique(line_hash[line_at[k] : line_at[k + 1]], return_index=True)
            dup_lines[k] = n_lines[k] - len(first)
            chars = line_chars[line_at[k] : line_at[k + 1]]
            dup_chars[k] = chars.sum() - chars[first].sum()
        if n_words[k] > 3:
            own = triples[triple_at[k] : triple_at[k + 1]]
            order = np.argsort(own)
            ordered = own[order]
            equal = ordered[1:] == ordered[:-1]
            distinct[k] = len(own) - equal.sum()
            if equal.any():
                again = np.zeros(len(own), bool)
                again[order[1:][equal]] = True
                again[order[:-1][equal]] = True
                covered = np.zeros(n_words[k], bool)
                covered[:-2] |= again
                covered[1:-1] |= again
                covered[2:] |= again
                repeated[k] = covered.sum()
    some, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    inside = texts.per_text(_LETTER[data])
    other = texts.per_text(_STARTS_POINT[data] & ~ragged._SPACE[data] & ~_LETTER[data])
    symbols = texts.per_text(_SYMBOL[data])
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated,
        "mean_word_chars": word_chars / some,
        "longest_word_share": longest / chars,
        "symbols_per_word": symbols / some,
        "symbol_word_share": marked / some,
        "other_char_share": other / chars,
        "letterless_word_share": letterless / some,
        "duplicate_line_chars": dup_chars / chars,
        "repeated_word_share": repeated / some,
        "distinct_triple_share": np.where(n_words > 3, distinct / np.maximum(n_words - 2, 1), 1.0),
        "capital_share": texts.per_text(_UPPER[data]) / np.maximum(inside, 1),
        "shout_per_word": texts.per_text(_SHOUT[data]) / some,
    }


def votes(measured: dict[str, np.ndarray]) -> np.ndarray:
    """One vote pattern per text: a number with a digit to base 3 per rule - 0 abstains, 1 is good, 2 is bad."""
    pattern = np.zeros(len(measured["n_words"]), np.int64)
    for rule, (bad, good) in RULES.items():
        value = measured[rule]
        is_bad, is_good = (value >= bad, value <= good) if bad > good else (value < bad, value >= good)
        pattern = pattern * 3 + np.where(is_bad, 2, np.where(is_good, 1, 0))
    return pattern


def with_measures(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """Every row as it is, and a struct of base counts and vote pattern under ``name``, whole texts read."""
    fields = (*MEASURES, "pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only("powers")
        for batch in batches:
            for part in ragged.portions(batch, text, PORTION, rows=5000):
                found = measures(part.column(text))
                found["pattern"] = votes(found)
                struct = pa.StructArray.from_arrays([pa.array(np.asarray(found[field], np.int64)) for field in fields], list(fields))
                yield pa.RecordBatch.from_arrays([*part.columns, struct], [*part.schema.names, name])

    kept = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema)
    return docs.mapInArrow(run, f"{kept}, `{name}` struct<{', '.join(f'{field}: bigint' for field in fields)}>")


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of good for each pattern, and each rule's votes on (bad, good) texts.

    The first guess takes each rule to vote as believed beforehand; that belief also keeps the
    two classes from changing places. Without documents there is nothing to fit.
    """
    rules = len(RULES)
    digits = patterns[:, None] // 3 ** np.arange(rules - 1, -1, -1) % 3
    onehot = (digits[:, :, None] == np.arange(3)).astype(float)
    belief = np.repeat(np.array([BAD_VOTES, GOOD_VOTES])[:, None, :], rules, axis=1)
    chance, prior, good = belief, np.array([0.2, 0.8]), np.zeros(len(patterns))
    for _ in range(rounds):
        log = np.log(prior)[:, None] + np.einsum("prv,crv->cp", onehot, np.log(chance))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
        weights = np.stack([counts * (1 - good), counts * good])
        seen = np.einsum("cp,prv->crv", weights, onehot) + belief * (1 + BELIEF * counts.sum())
        chance = seen / seen.sum(2, keepdims=True)
        prior = (weights.sum(1) + 1) / (weights.sum() + 2)
    return good, chance


def posteriors(measured: DataFrame, name: str = "quality") -> DataFrame:
    """pattern, probability for every pattern that occurs: at most ``3 ** len(RULES)`` rows."""
    counted = measured.groupBy(F.col(f"{name}.pattern").alias("pattern")).count().collect()
    rows = sorted((row["pattern"], row["count"]) for row in counted)
    patterns, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    good, _ = accuracies(patterns, counts)
    table = pd.DataFrame({"pattern": patterns, "probability": good})
    return measured.sparkSession.createDataFrame(table, "pattern long, probability double")


def judge(measured: DataFrame, table: DataFrame, threshold: float = THRESHOLD, name: str = "quality") -> DataFrame:
    """Add base_failed, probability and kept; the table of patterns is broadcast, its size is bounded.

    A text of under 50 words, or with over half its words in repeated windows, has failed
    whatever the rules say; a null or empty text is such a text.
    """
    own, table = F.col(name), F.broadcast(table.select(F.col("pattern").alias("__pattern"), F.col("probability").alias("__probability")))
    failed = (own["n_words"] < MIN_WORDS) | (100 * own["n_repeat_words"] > MAX_REPEATED_PERCENT * own["n_words"])
    joined = measured.join(table, own["pattern"] == F.col("__pattern"), "left")
    verdict = F.struct(
        *[own[field].alias(field) for field in MEASURES], failed.alias("base_failed"), F.col("__probability").alias("probability"),
        (~failed & (F.coalesce(F.col("__probability"), F.lit(1.0)) >= threshold)).alias("kept"),
    )
    return joined.withColumn(name, verdict).drop("__pattern", "__probability")


def quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id with base counts, probability and verdict of every row; repeated rows and null ids are rows like others."""
    measured = stored(with_measures(docs.select("doc_id", "text")).drop("text"), "quality-measures")
    return judge(measured, posteriors(measured), threshold).select("doc_id", "quality.*")


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text is kept, with their own columns; each text is measured once.

    Extra columns are kept, whatever their names; null and empty texts go; repeated rows stay or
    go together; an empty table gives no rows.
    """
    name = "quality"
    while name in docs.columns:
        name += "_"
    measured = stored(with_measures(docs, name=name), "quality-measured")
    judged = judge(measured, posteriors(measured, name), threshold, name)
    return judged.where(F.col(name)["kept"]).select(*docs.columns)
