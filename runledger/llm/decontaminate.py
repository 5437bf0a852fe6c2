"""Benchmark decontamination by a distributed positional inverted index.

Training documents are indexed by (term, document, position) for the terms that test texts
have. A phrase is looked up from its rarest term on: that term's list, shifted by its place in
the phrase, is intersected with the shifted list of the next rarest, and what is left with the
lists of all other terms. Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runledger.llm.common import BETWEEN_WORDS, OF_WORDS, ascii_lower, known_words, sent_if_small, stored

WINDOW = 10


def doc_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def cut(text: Column) -> Column:
    """A text's words as they are; the first and the last may be empty."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS, -1)


def word_list(text: Column) -> Column:
    return F.filter(F.transform(cut(text), ascii_lower), lambda word: word != "")


def phrase_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window: each run of ``size`` words as text with single blanks, once per item.

    An item of fewer words is one window, one without words has none.
    """
    listed = items.select("item_id", word_list(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    return listed.select("item_id", F.explode(F.transform(starts, lambda at: F.array_join(F.slice("words", at, size), " "))).alias("window")).distinct()


# Stands for a whole document in its index; no word, for it lies between words.
_DOCUMENT = "\n"


def indexed(docs: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc, n_words) of every row, and its postings (term, doc, position) of words in the vocabulary (term, one row each).

    Texts are cut once: the index is a stored table in which a document is a posting of its own.
    """
    listed = docs.select("doc_id", doc_key(F.col("doc_id"), F.col("text")).alias("doc"), cut(F.col("text")).alias("list"))
    # Only the first and the last word may be empty.
    empty = (F.col("list")[0] == "").cast("int") + F.when(F.size("list") > 1, (F.element_at("list", -1) == "").cast("int")).otherwise(0)
    words = listed.select("doc_id", "doc", (F.size("list") - empty).alias("n_words"), F.posexplode(F.array_insert("list", 1, F.lit(_DOCUMENT))).alias("position", "word"))
    whole = F.col("word") == _DOCUMENT
    rows = words.select(
        ascii_lower(F.col("word")).alias("term"), "doc", "position",
        F.when(whole, F.col("doc_id")).alias("doc_id"), F.when(whole, F.col("n_words")).cast("long").alias("n_words"),
    )
    marker = docs.sparkSession.range(1).select(F.lit(_DOCUMENT).alias("term"))
    index = stored(known_words(rows, stored(vocabulary.select("term").union(marker), "index-terms")), "postings")
    own = F.col("term") == _DOCUMENT
    return index.where(own).select("doc_id", "doc", "n_words"), index.where(~own).select("term", "doc", "position")


def ranked_terms(windows: DataFrame, index: DataFrame) -> DataFrame:
    """window, n, ranked: the phrase's (rows, place, term) from the rarest on; phrases with a term that never occurs are gone."""
    terms = windows.select("window", F.posexplode(F.split("window", " ")).alias("place", "term"))
    counts = stored(index.groupBy("term").agg(F.count("*").alias("rows")), "term-counts")
    ranked = terms.join(sent_if_small(counts), "term", "left").groupBy("window").agg(
        F.count("*").cast("int").alias("n"), F.count("rows").alias("found"), F.sort_array(F.collect_list(F.struct("rows", "place", "term"))).alias("ranked")
    )
    return ranked.where("n = found").select("window", "n", "ranked")


def candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """doc, start, n, window where a phrase's two rarest terms stand at its distance."""
    one, two = F.col("ranked")[0], F.get("ranked", F.lit(1))
    seeds = ranked_terms(windows, index).select(
        "window", "n", one["term"].alias("term"), one["place"].alias("place"),
        two["term"].alias("second"), (two["place"] - one["place"]).alias("gap"),
    )
    seeds = stored(seeds, "phrase-seeds")
    patterns = stored(seeds.select("term", "second", "gap").distinct(), "phrase-patterns")
    first = index.join(sent_if_small(patterns), "term")
    seconds = known_words(index, stored(patterns.where("second is not null").select(F.col("second").alias("term")).distinct(), "second-terms"))
    seconds = seconds.select(F.col("doc"), F.col("term").alias("second"), F.col("position").alias("next"))
    both = first.where("second is not null").withColumn("next", F.col("position") + F.col("gap"))
    met = both.join(seconds, ["doc", "next", "second"]).select("doc", "position", "term", "second", "gap")
    lone = first.where("second is null").select("doc", "position", "term", "second", "gap")
    same = [F.col(f"m.{name}").eqNullSafe(F.col(f"s.{name}")) for name in ("term", "second", "gap")]
    named = met.union(lone).distinct().alias("m").join(sent_if_small(seeds).alias("s"), same)
    return named.select("m.doc", (F.col("m.position") - F.col("s.place")).alias("start"), "s.n", "s.window").where("start >= 0")


def phrase_matches(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc, n_words) of every row, and doc, start, n, window of each place where a phrase stands.

    What the two rarest lists leave is intersected with the lists of all other terms, of the
    documents concerned; a phrase stands where each of its places has its term. Texts are not
    looked at again, so a text that repeats one word costs its length.
    """
    vocabulary = windows.select(F.explode(F.split("window", " ")).alias("term")).distinct()
    rows, index = indexed(docs.select("doc_id", "text"), vocabulary)
    phrases = stored(windows.select("window").distinct(), "phrases")
    seeds = stored(candidates(index, phrases), "phrase-candidates")
    asked = seeds.select("doc", "start", "n", "window", F.posexplode(F.split("window", " ")).alias("place", "term"))
    asked = asked.withColumn("position", F.col("start") + F.col("place"))
    concerned = sent_if_small(stored(seeds.select("doc").distinct(), "phrase-documents"))
    lists = index.join(concerned, "doc", "left_semi").distinct()
    met = asked.join(lists, ["doc", "position", "term"]).groupBy("doc", "start", "n", "window").agg(F.count("*").alias("terms"))
    return rows, met.where("terms = n").select("doc", "start", "n", "window")


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """phrase, doc_id, position: where every term stands within ``slop`` words of its place in the phrase.

    Places are counted from the rarest term's occurrence, which is ``position``. Each occurrence
    asks for ``2 * slop + 1`` positions per term, so the join is by equality and a frequent term
    costs no more than its list.
    """
    wanted = phrases.select("phrase", F.array_join(word_list(F.col("phrase")), " ").alias("window")).where("window <> ''").distinct()
    windows = stored(wanted, "near-phrases")
    vocabulary = windows.select(F.explode(F.split("window", " ")).alias("term")).distinct()
    rows, index = indexed(docs.select("doc_id", "text"), vocabulary)
    ranked = stored(ranked_terms(windows.select("window").distinct(), index), "near-ranks")
    anchor = ranked.select("window", "n", F.col("ranked")[0]["term"].alias("term"), F.col("ranked")[0]["place"].alias("anchor"), "ranked")
    seen = index.join(sent_if_small(stored(anchor, "near-anchors")), "term").select("doc", "position", "window", "n", "anchor", F.explode("ranked").alias("other"))
    asked = seen.select(
        "doc", "position", "window", "n", F.col("other.place").alias("place"), F.col("other.term").alias("term"),
        F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("shift"), "anchor",
    ).where((F.col("place") != F.col("anchor")) | (F.col("shift") == 0))
    asked = asked.withColumn("at", F.col("position") + F.col("place") - F.col("anchor") + F.col("shift"))
    lists = index.select("doc", "term", F.col("position").alias("at")).distinct()
    met = asked.join(lists, ["doc", "term", "at"]).groupBy("doc", "position", "window", "n").agg(F.count_distinct("place").alias("places"))
    names = rows.select("doc_id", "doc").distinct()
    return met.where("places = n").join(windows, "window").join(names, "doc").select("phrase", "doc_id", "position")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, doc, n_words, n_hit, item_ids of every document row.

    A word inside any match is hit; ``item_ids`` are the items with matches, as sorted strings.
    Null, empty and wordless texts have no words and no hits. Items that repeat count once by
    their id; an item with a null id hits words but isn't listed. Repeated document rows give
    repeated results, empty tables give empty or clean results, extra columns are ignored.
    """
    windows = stored(phrase_windows(items, size), "windows")
    rows, found = phrase_matches(docs, windows)
    found = stored(found, "phrase-matches")
    owners = sent_if_small(windows.where("item_id is not null"))
    listed = found.select("doc", "window").distinct().join(owners, "window").select("doc", F.col("item_id").cast("string").alias("item")).distinct()
    listed = listed.groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    covered = found.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("position")).distinct()
    hits = covered.groupBy("doc").agg(F.count("*").alias("n_hit")).join(listed, "doc", "left")
    joined = rows.join(hits, "doc", "left")
    none = F.array().cast("array<string>")
    return joined.select("doc_id", "doc", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in which no window of a test text occurs, with their own columns."""
    hit = contamination(docs, items, size).where("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("doc").alias("__doc")).distinct()
    keyed = docs.withColumn("__own", doc_key(F.col("doc_id"), F.col("text")))
    same = (F.col("__own") == F.col("__doc")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return keyed.join(sent_if_small(stored(hit, "contaminated")), same, "left_anti").select(*docs.columns)
