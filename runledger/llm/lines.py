"""Line deduplication within an edit bound by deletion neighbourhoods.

Two lines are duplicates if they are equal or at most one word apart (one put in, left out or
exchanged). A line's variants are itself and itself without one word; lines one word apart have
a variant in common. Variants are hashed keys, equal keys are brought together by aggregation,
and each line is compared with the earliest line of its keys alone, so a group of any size
gives no pairs. Lines that share no half with another line have no such neighbour and get no
variants. Texts of lines are stored once and read again where a line gets variants; only
16-byte digests are shuffled.
DataFrame work alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runledger.llm.common import ascii_lower, sent_if_small, stored, text_key

MIN_WORDS = 8  # shorter lines are duplicates only if equal, for a word is too much of them

_ORDER = ("doc_id", "digest", "line_no")


def normal(line: Column) -> Column:
    """The line's words in lower case (A to Z), with single blanks between them."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | line.rlike(r"[\x09-\x0D]")
    clean = F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)
    return ascii_lower(clean)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, digest, line_no, line, id, words of every line that has a word; line_no counts all lines from 0."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("digest"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    # Tested on the raw line: a filter on the normal one would work that out a second time.
    rows = rows.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "digest", "line_no", normal(F.col("raw")).alias("line"))
    rows = rows.withColumn("id", F.unhex(F.md5("line")))
    return rows.withColumn("words", F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1)


def _halves(line: Column, words: Column) -> Column:
    """Keys of the halves that a neighbour of as many words, one more or one less would share."""
    keys = []
    for length in (words, words - 1):
        half = F.floor(length / 2).cast("int")
        pair = F.array(
            F.xxhash64(F.lit("first"), length, F.call_function("substring_index", line, F.lit(" "), half)),
            F.xxhash64(F.lit("last"), length, F.call_function("substring_index", line, F.lit(" "), half - length)),
        )
        keys.append(F.when(length >= MIN_WORDS, pair).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*keys)


def _variants(line: Column) -> Column:
    """(key, place) of the line itself, place -1, and of the line without its word at each place."""
    words = F.split(line, " ")

    def running(shift: int) -> Column:
        hashes = F.transform(words, lambda word, i: F.xxhash64(word, i - shift))
        return F.aggregate(hashes, F.array(F.lit(0).cast("bigint")), lambda sums, h: F.array_append(sums, F.element_at(sums, -1).bitwiseXOR(h)))

    both = F.struct(running(0).alias("a"), running(1).alias("b"), F.size(words).alias("n"))

    def keys(of: Column) -> Column:
        whole = F.struct(F.xxhash64(F.element_at(of["a"], -1), of["n"]).alias("key"), F.lit(-1).alias("place"))

        def without(i: Column) -> Column:
            rest = F.element_at(of["b"], -1).bitwiseXOR(F.get(of["b"], i + 1))
            return F.struct(F.xxhash64(F.get(of["a"], i).bitwiseXOR(rest), of["n"] - 1).alias("key"), i.alias("place"))

        return F.concat(F.array(whole), F.transform(F.sequence(F.lit(0), of["n"] - 1), without))

    return F.get(F.transform(F.array(both), keys), F.lit(0))


def _one_word_apart(line: Column, other: Column) -> Column:
    """Whether two different lines are one word apart. The word lists are bound by a lambda, so each line is split once."""
    split = F.struct(F.split(line, " ").alias("a"), F.split(other, " ").alias("b"))
    return F.get(F.transform(F.array(split), lambda of: _lists_apart(of["a"], of["b"])), F.lit(0))


def _lists_apart(a: Column, b: Column) -> Column:
    """Whether two different word lists are equal before and after the first difference."""
    size_a, size_b = F.size(a), F.size(b)
    unequal = F.filter(F.sequence(F.lit(1), F.least(size_a, size_b)), lambda i: F.get(a, i - 1) != F.get(b, i - 1))
    at = F.coalesce(F.get(unequal, F.lit(0)), F.least(size_a, size_b) + 1)
    most = 1 << 30
    rest = lambda words, start: F.array_join(F.slice(words, start, most), " ")
    longer = F.when(size_a == size_b, rest(a, at + 1) == rest(b, at + 1)).when(size_a == size_b + 1, rest(a, at + 1) == rest(b, at)).when(size_b == size_a + 1, rest(a, at) == rest(b, at + 1))
    return F.coalesce(longer, F.lit(False))


def neighbours(listed: DataFrame) -> DataFrame:
    """id: lines with an earlier line one word apart. listed: order, id, line, short, halves of every line."""
    keys = listed.select("short", F.explode("halves").alias("key"))
    shared = keys.groupBy("key").agg(F.min("short").alias("low"), F.max("short").alias("high")).where("low < high").select("key")
    partnered = stored(keys.join(sent_if_small(stored(shared, "shared-halves")), "key").select("short").distinct(), "partnered-lines")
    texts = listed.select(*_ORDER, "id", "line", "short").join(sent_if_small(partnered), "short", "left_semi")
    texts = stored(texts.groupBy("id").agg(F.min(F.struct(*_ORDER)).alias("first"), F.min("line").alias("line")), "partnered-texts")
    near = texts.select("id", "first", F.explode(_variants(F.col("line"))).alias("v"))
    near = stored(near.select("id", "first", "v.key", "v.place"), "line-variants")
    who = F.struct("first", "id")
    # Keys are counted first, a reduction by hash; minima of structs are sorted for, so only few rows reach them.
    met_keys = stored(near.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "shared-variants")
    met = stored(near.join(sent_if_small(met_keys), "key"), "lines-of-variants")
    whole, part = F.min(F.when(F.col("place") < 0, who)), F.min(F.when(F.col("place") >= 0, who))
    by_key = met.groupBy("key").agg(whole.alias("whole"), part.alias("part"))
    same = met.groupBy("key", "place").agg(F.min(who).alias("same"))
    best = F.when(F.col("place") < 0, F.col("part")).otherwise(F.least("same", "whole"))
    earlier = met.join(by_key, "key").join(same, ["key", "place"]).select("id", "first", best.alias("best")).where(F.col("best.first") < F.col("first"))
    found = earlier.groupBy("id").agg(F.min("best").alias("best")).select("id", F.col("best.id").alias("other"))
    pairs = found.join(texts.select("id", "line"), "id").join(texts.select(F.col("id").alias("other"), F.col("line").alias("witness")), "other")
    return pairs.where(_one_word_apart(F.col("line"), F.col("witness"))).select("id")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_lines, dropped of every row: the numbers of the lines that an earlier line makes superfluous.

    Earlier is by doc_id, text digest and line number, and need not be kept itself. Blank lines
    are neither counted nor dropped. A null or empty text has no lines, repeated rows keep each
    line once among them, null ids come first, an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    halves = _halves(F.col("line"), F.col("words"))
    listed = stored(lines(docs).select(*_ORDER, "id", "line", F.xxhash64("line").alias("short"), halves.alias("halves")), "lines")
    near = stored(neighbours(listed), "near-lines").withColumn("all", F.lit(True))
    again = listed.groupBy("id").agg(F.min(F.struct(*_ORDER)).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    again = again.join(near, "id", "full_outer").select("id", "first", F.coalesce("all", F.lit(False)).alias("all"))
    again = sent_if_small(stored(again, "superfluous-lines"))
    met = listed.select(*_ORDER, "id").join(again, "id")
    gone = met.where(F.col("all") | (F.struct(*_ORDER) > F.col("first"))).groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    counts = docs.select("doc_id", text_key(F.col("text")).alias("digest"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"))
    gone = gone.select(F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest"), "dropped")
    joined = counts.join(gone, (F.col("digest") == F.col("its_digest")) & F.col("doc_id").eqNullSafe(F.col("its_id")), "left")
    return joined.select("doc_id", "digest", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without superfluous lines."""
    found = repeated_lines(docs).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "dropped").where(F.size("dropped") > 0).distinct()
    keyed = docs.withColumn("__own", text_key(F.col("text")))
    joined = keyed.join(found, (F.col("__own") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("dropped", i))
    return joined.withColumn("text", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
