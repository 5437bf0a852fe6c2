"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source is a hash. Words are summed by source and hash bucket, the
bucket in which a source's budget ends is found by a running sum over at most ``2**bits``
buckets, and only that bucket is summed again by the next bits. A document is taken if its
hash lies under the threshold: no sort, and no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runledger.llm.common import WORD, pick, sent_if_small, stored

LEVEL_BITS = (10, 10, 10)
HASH_BITS = sum(LEVEL_BITS)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """A document's place in its source: 30 bits of a digest of its id and text."""
    digest = F.md5(F.concat_ws("|", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").bitwiseAND(F.lit(2**HASH_BITS - 1))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and place, without the text."""
    text = F.col("text")
    return docs.select("doc_id", "source", word_count(text).alias("size"), place(F.col("doc_id"), text).alias("place"))


def source_sizes(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source").agg(F.sum("size").alias("source_size"))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """A repeating list of weights for the sources by code point, null last; one row per source."""
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(weight) for weight in cycle])
    return sources.withColumn("weight", weights[(number % len(cycle)).cast("int")])


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size, weight).

    The targets add up to ``share`` of all words by weight; none is above ``most`` times its
    source, and what is cut off goes to the others by weight. Sources are full in the order of
    their limit per weight, so the level is the first at which the next source isn't full.
    """
    limit = F.lit(most) * F.col("source_size")
    by_limit = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    levels = sources.withColumn("ratio", limit / F.col("weight")).select(
        "*", ((budget - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)).alias("level")
    )
    reached = levels.agg(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level")))["level"].alias("level"))
    target = F.least(limit, F.coalesce(reached.scalar(), F.lit(0.0)) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def thresholds(sizes: DataFrame, goals: DataFrame, level_bits: tuple[int, ...] = LEVEL_BITS) -> DataFrame:
    """key, source_size, target, copies of every document, and the place under which one more is taken."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.select(
        _key(F.col("source")).alias("key"), "source_size", "target", whole.cast("int").alias("copies"),
        (F.col("target") - whole * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"),
    )
    rows, left = sizes.select(_key(F.col("source")).alias("key"), "size", "place"), sum(level_bits)
    for level, bits in enumerate(level_bits):
        state = stored(state, f"mix-level-{level}")
        inside = rows.join(sent_if_small(state.where("rest > 0").select("key", "low")), "key")
        inside = inside.where(F.shiftright("place", left) == F.col("low"))
        left -= bits
        buckets = inside.groupBy("key", F.shiftright("place", left).alias("bucket")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
        reached = buckets.withColumn("upto", running).join(state.select("key", "rest", "before"), "key")
        reached = reached.where(F.col("before") + F.col("upto") >= F.col("rest")).groupBy("key")
        found = reached.agg(F.min(F.struct("bucket", "words", "upto")).alias("found"))
        upto = F.col("before") + F.col("found.upto")
        state = state.join(found, "key", "left").select(
            "key", "source_size", "target", "copies", "rest",
            F.coalesce(F.col("found.bucket"), F.lit(0)).cast("long").alias("low"),
            F.coalesce(upto - F.col("found.words"), F.lit(0)).cast("long").alias("before"),
            F.coalesce(upto, F.lit(0)).cast("long").alias("upto"),
        )
        if left:
            state = state.drop("upto")
    nearer = F.col("upto") - F.col("rest") <= F.col("rest") - F.col("before")
    last = F.when(F.col("rest") > 0, F.col("low") + F.when(nearer, 1).otherwise(0)).otherwise(0)
    return state.select("key", "source_size", "target", "copies", last.alias("threshold"))


def copies(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """doc_id, source, size, place, source_size, target, and how often the mix takes each document.

    Rows that agree in id, source and text share one place and are taken or left together. A
    source without words has target 0, and its documents are taken as often as that gives: not
    at all. An empty table gives an empty mix. Nulls in ``text`` count as no words; a null source
    is a source. Extra columns are ignored.
    """
    found = sent_if_small(stored(thresholds(sizes, goals), "mix-thresholds"))
    rows = sizes.withColumn("key", _key(F.col("source"))).join(found, "key", "left")
    return rows.withColumn("copies", _copies(F.col("place"))).drop("key", "threshold")


def _copies(own_place: Column) -> Column:
    return F.col("copies") + F.when(own_place < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, share: float = 1.5, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """The mix's decision for every document, with sources weighted by the cycle."""
    sizes = stored(sized(pick(docs, "doc_id", "source", "text")), "mix-sizes")
    return copies(sizes, targets(cyclic_weights(source_sizes(sizes)), share))


def mixed_documents(docs: DataFrame, share: float = 1.5, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    sizes = stored(sized(pick(docs, "doc_id", "source", "text")), "mix-sizes")
    found = thresholds(sizes, targets(cyclic_weights(source_sizes(sizes)), share)).select("key", "copies", "threshold")
    found = sent_if_small(stored(found, "mix-thresholds"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), _key(F.col("source")).alias("key"), place(F.col("doc_id"), F.col("text")).alias("place"))
    taken = rows.join(found, "key").select("doc", _copies(F.col("place")).alias("copies"))
    return taken.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")


ORACLE_SQL = """
with sizes as (
    select doc_id, source, case when source is null then '' else '=' || source end as key,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
        ('0x' || substr(md5(concat_ws('|', doc_id::varchar, md5(coalesce(text, '')))), 1, 15))::bigint % 1073741824 as place
    from documents),
sources as (
    select *, 2.0 * source_size / weight as ratio from (
        select key, source_size, ([3, 1, 2])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
        from (select key, source, sum(size)::bigint as source_size from sizes group by key, source))),
levels as (
    select ratio, (1.5 * (select sum(source_size) from sources)
        - 2.0 * coalesce(sum(source_size) over (order by ratio, key rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by ratio, key rows between current row and unbounded following) as level from sources),
goals as (
    select key, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end::int as copies
    from (select *, least(2.0 * source_size, coalesce((select level from levels where ratio >= level order by ratio limit 1), 0) * weight)::double as target
        from sources)),
running as (
    select key, place, words, sum(words) over (partition by key order by place)::bigint as upto
    from (select key, place, sum(size) as words from sizes group by key, place)),
ends as (
    select r.key, min(case when r.upto >= g.target - g.copies * g.source_size then r.place end) as place
    from running r join goals g using (key) where g.target - g.copies * g.source_size > 0 group by r.key),
found as (
    select e.key, e.place + case when r.upto - (g.target - g.copies * g.source_size) <= (g.target - g.copies * g.source_size) - (r.upto - r.words)
        then 1 else 0 end as threshold
    from ends e join running r on r.key = e.key and r.place = e.place join goals g on g.key = e.key)
select s.doc_id, s.size, g.source_size, g.target,
    (s.size * (g.copies + case when s.place < coalesce(f.threshold, 0) then 1 else 0 end))::bigint as taken
from sizes s join goals g using (key) left join found f on f.key = s.key
"""
