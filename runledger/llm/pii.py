"""Personal data, and terms that give it away.

Base entities are found by pattern. Beyond them a term can reveal an entity: if nearly every
text with the term also has the entity, the term carries the entity's information. Both are
measured over all texts: a term discloses an entity if their pointwise mutual information is at
least ``GENERALISE`` of the entity's own information, and is removed instead of generalised
from ``REMOVE`` on. Only texts that hold the entity lose such terms. DataFrame work alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runledger.llm.common import BETWEEN_WORDS, OF_WORDS, known_words, sent_if_small, stored, text_key

# Possessive forms of the base patterns: the same matches without going back over long runs.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this has no match of the kind.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
ORDER = {kind: number for number, kind in enumerate([*KINDS, "removed", "generalised"])}

MIN_SUPPORT = 3  # texts that an entity, and an entity with a term, must have
MIN_CHARS = 3  # of a term
GENERALISE, REMOVE = 0.90, 0.97

_SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,value:string>"


def _placed(text: Column, pattern: str, wanted: object = None) -> Column:
    """(start, end, value) of all matches, or those whose value is wanted, from the lengths of the matches and of what lies between them."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out"), both.alias("of"))

    def step(state: Column, i: Column) -> Column:
        value = F.get(state["of"]["m"], i)
        begin = state["at"] + F.length(F.get(state["of"]["p"], i))
        end = begin + F.length(value)
        found = F.struct(begin.alias("start"), end.alias("end"), value.alias("value"))
        out = F.array_append(state["out"], found)
        return F.struct(end.alias("at"), (F.when(wanted(value), out).otherwise(state["out"]) if wanted else out).alias("out"), state["of"].alias("of"))

    size = F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.aggregate(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), start, step, lambda state: state["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when((F.length(digits) - i) % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


_VALID = {
    "email": lambda value: F.lit(True),
    "ip": lambda value: value.rlike(_OCTETS),
    "card": lambda value: F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False),
    "phone": lambda value: F.length(_digits(value)).between(10, 15),
}


def _spans_of(text: Column, kind: str) -> Column:
    def named(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), F.lit(ORDER[kind]).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))

    valid = F.filter(_placed(text, KINDS[kind]), lambda m: _VALID[kind](m["value"]))
    there = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_NEEDS[kind])
    return F.when(there, F.transform(valid, named)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    """All base entities of a text in order of start, then kind; code points, end exclusive."""
    return F.array_sort(F.concat(*[_spans_of(text, kind) for kind in KINDS]))


def joined(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _rebuilt(text: Column, spans: Column, new: object) -> Column:
    """The text with each span replaced; where spans overlap, the first goes on to the last end."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        begin = F.greatest(state["at"], s["start"])
        kept = F.substring(text, (state["at"] + 1).cast("int"), (begin - state["at"]).cast("int"))
        piece = F.when(s["start"] >= state["at"], new(s)).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], kept, piece).alias("out"))

    return F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text))))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """digest, term, kind: what each text with a repeated entity gives away.

    Equal texts count once. Only entities with MIN_SUPPORT texts can have terms with as many,
    so only their texts are paired with terms; the terms that remain are then counted in all
    texts of the corpus.
    """
    mentions = found.where(F.size("base") > 0).select("digest", F.explode("base").alias("span")).select("digest", _entity(F.col("span")).alias("entity")).distinct()
    mentions = stored(mentions, "mentions")
    entities = mentions.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= MIN_SUPPORT)
    mentions = stored(mentions.join(sent_if_small(stored(entities, "entities")), "entity"), "repeated-mentions")
    texts = docs.select(text_key(F.col("text")).alias("digest"), F.col("text"))
    held = texts.join(sent_if_small(stored(mentions.select("digest").distinct(), "holders")), "digest", "left_semi").dropDuplicates(["digest"])
    masked = held.select("digest", _rebuilt(F.col("text"), base_spans(F.col("text")), lambda s: F.lit(" ")).alias("text"))
    terms = masked.select("digest", F.explode(F.array_distinct(F.split(F.lower("text"), BETWEEN_WORDS, -1))).alias("term")).where(F.length("term") >= MIN_CHARS)
    terms = stored(terms, "terms-of-holders")
    pairs = terms.join(mentions, "digest").groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= MIN_SUPPORT)
    # A term in more texts than this can't reach the threshold, whatever the corpus holds beyond the holders.
    total = texts.select("digest").distinct().agg(F.count("*").alias("n")).scalar()
    information = F.log(total / F.col("n_entity"))
    share = lambda level: F.exp((level - 1) * information)  # noqa: E731  least n_both / n_term for that part of the information
    inside = terms.groupBy("term").agg(F.count("*").alias("n_inside"))
    pairs = pairs.join(inside, "term").where(F.col("n_both") >= share(GENERALISE) * F.col("n_inside")).select("entity", "n_entity", "term", "n_both")
    pairs = stored(pairs, "likely-pairs")
    vocabulary = stored(pairs.select("term").distinct(), "likely-terms")
    # Each of n equal texts counts 1 / n, so that counts need no list of texts and terms.
    copies = sent_if_small(stored(texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "copies"))
    words = texts.join(copies, "digest", "left").select(
        (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("weight"), F.explode(F.array_distinct(F.split(F.lower("text"), BETWEEN_WORDS, -1))).alias("term")
    )
    everywhere = known_words(words, vocabulary).groupBy("term").agg(F.round(F.sum("weight")).alias("n_term"))
    reached = F.col("n_both") / F.greatest("n_term", "n_both")
    strong = pairs.join(everywhere, "term").withColumn("removed", reached >= share(REMOVE)).where(reached >= share(GENERALISE))
    given = terms.join(mentions.select("digest", "entity"), "digest").join(strong.select("entity", "term", "removed"), ["entity", "term"])
    return given.groupBy("digest", "term").agg(F.max("removed").alias("removed"))


def term_spans(docs: DataFrame, given: DataFrame) -> DataFrame:
    """digest, extra: where each text's disclosing terms stand outside its base entities."""
    lists = given.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("terms"))
    texts = docs.select(text_key(F.col("text")).alias("digest"), F.col("text"))
    held = texts.join(sent_if_small(stored(lists, "given-terms")), "digest")
    words = _placed(F.col("text"), OF_WORDS, lambda value: F.map_contains_key("terms", F.lower(value)))
    marked = held.select("digest", words.alias("words"), base_spans(F.col("text")).alias("base"), "terms")
    free = F.filter("words", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))

    def span(w: Column) -> Column:
        kind = F.when(F.element_at("terms", F.lower(w["value"])), "removed").otherwise("generalised")
        rank = F.when(kind == "removed", ORDER["removed"]).otherwise(ORDER["generalised"])
        return F.struct(w["start"].alias("start"), rank.alias("rank"), kind.alias("kind"), w["end"].alias("end"), w["value"].alias("value"))

    return marked.withColumn("free", free).select("digest", F.transform("free", span).alias("extra")).dropDuplicates(["digest"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, digest, base, spans of every row; both are arrays in order of start, then kind.

    A null text is empty. Repeated rows have equal results and count once as evidence, null ids
    are kept, an empty table gives no rows, extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    found = stored(docs.select("doc_id", text_key(F.col("text")).alias("digest"), base_spans(F.col("text")).alias("base")), "base-spans")
    extra = sent_if_small(stored(term_spans(docs, disclosing_terms(docs, found)), "term-spans"))
    both = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(f"array<{_SPAN}>"))))
    return found.join(extra, "digest", "left").select("doc_id", "digest", "base", both.alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with entities masked by kind, removed terms left out and generalised terms replaced by their class."""
    found = personal_data(docs).select("digest", "spans").where(F.size("spans") > 0).dropDuplicates(["digest"])
    rows = docs.withColumn("__digest", text_key(F.col("text"))).join(found.withColumnRenamed("digest", "__digest"), "__digest", "left")

    def new(s: Column) -> Column:
        word = F.when(s["value"].rlike("^[0-9]+$"), "[number]").when(s["value"].rlike("^[A-Z]"), "[name]").otherwise("[word]")
        return F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", word).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(_rebuilt(F.col("text"), F.col("spans"), new))
    return rows.withColumn("text", clean).select(*docs.columns)
