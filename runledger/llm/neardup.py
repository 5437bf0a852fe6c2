"""Near-duplicates by MinHash with tensored banding.

A table's key joins one key of each of two small collections, so ``m`` keys a collection give
``m * m`` tables: 400 tables of eight minhashes from 160 minhashes instead of 3,200. A pair of
texts at the threshold shares no table with probability 5e-5, and less above it. Candidates are
verified on their full shingle sets.

Equal sets are one class from the start. Within a table only a class and its leader (the least
class that shares a table with it) are compared first; most members of a group of copies are
linked by that. What stays apart although tables bring it together is compared in blocks of
``BLOCK`` classes, whose links alone leave the task, so no pairs are ever emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runledger.llm import ragged
from runledger.llm.common import remember_only, stored, text_key, travels

travels(__name__)
travels(ragged.__name__)

SHINGLE_WORDS = 5
PERCENT = 80
PER_KEY = 4  # minhashes of a collection's key
KEYS = 20  # keys of a collection
BLOCK = 512
PORTION = 1 << 20


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, and how many there are.

    A text with fewer words has its whole sequence as its one shingle, one without words none.
    """
    texts = ragged.Texts(column, lower=True)
    starts, ends, owner = texts.words()
    hashes = ragged.span_hashes(texts.data, starts, ends)
    n_words = np.bincount(owner, minlength=len(texts))
    shingles, _ = ragged.windows(hashes, owner, size)
    word_at = np.concatenate([[0], np.cumsum(n_words)])
    shingle_at = np.concatenate([[0], np.cumsum(np.maximum(n_words - size + 1, 0))])
    out, counts = [], np.zeros(len(texts), np.int64)
    for k in np.flatnonzero(n_words):
        if n_words[k] >= size:
            own = np.unique(shingles[shingle_at[k] : shingle_at[k + 1]])
        else:
            words = hashes[word_at[k] : word_at[k + 1]]
            own = ragged.mixed(np.sum(words * ragged.numbers(len(words), 500), keepdims=True, dtype=np.uint64))
        out.append(own)
        counts[k] = len(own)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def collection_keys(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """2 * KEYS keys of each non-empty set: those of the first collection, then those of the second."""
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
    keys = np.zeros((2 * KEYS, len(counts)), np.uint64)
    if len(counts):
        factors, offsets = ragged.numbers(2 * KEYS * PER_KEY, 9000) | np.uint64(1), ragged.numbers(2 * KEYS * PER_KEY, 19000)
        for number in range(2 * KEYS * PER_KEY):
            least = np.minimum.reduceat(sets * factors[number] + offsets[number], firsts)
            keys[number // PER_KEY] = ragged.mixed(keys[number // PER_KEY] ^ least)
    return (keys ^ np.arange(2 * KEYS, dtype=np.uint64)[:, None]).T


def _set_ids(sets: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """128 bits that stand for each non-empty set."""
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
    sums = [np.add.reduceat(ragged.mixed(sets ^ salt), firsts) if len(counts) else np.empty(0, np.uint64) for salt in ragged.numbers(2, 31)]
    both = np.stack([ragged.mixed(sums[0] + counts.astype(np.uint64)), sums[1]], axis=1)
    return [row.tobytes() for row in both]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, digest, n_shingles, set_id, keys of every row; a text without words has no set_id and no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only("powers")
        for batch in batches:
            for part in ragged.portions(batch, "text", PORTION):
                sets, counts = shingle_sets(part.column("text"), size)
                some = counts > 0
                ids = np.full(len(counts), None, object)
                ids[some] = _set_ids(sets, counts[some])
                keys = collection_keys(sets, counts[some]).astype(np.int64)
                at = pa.array(np.concatenate([[0], np.cumsum(np.where(some, 2 * KEYS, 0))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array(counts), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))],
                    ["doc_id", "digest", "n_shingles", "set_id", "keys"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key(F.col("text")).alias("digest"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, digest long, n_shingles long, set_id binary, keys array<long>")


def tables(classes: DataFrame) -> DataFrame:
    """key, set_id for every table entry that two classes or more share.

    A class is in a shared entry only if one of its keys in each collection is shared, so keys
    that one class alone has are left out before any are joined to pairs.
    """
    keys = classes.select("set_id", F.posexplode("keys").alias("place", "key"))
    shared = keys.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high")
    keys = keys.join(shared.select("key"), "key")
    side = lambda first: F.collect_list(F.when((F.col("place") < KEYS) == F.lit(first), F.col("key")))
    both = keys.groupBy("set_id").agg(side(True).alias("a"), side(False).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    pairs = both.select("set_id", "b", F.explode("a").alias("a")).select("set_id", "a", F.explode("b").alias("b"))
    return pairs.select(F.xxhash64("a", "b").alias("key"), "set_id")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """set_id, shingles of the wanted classes, from one document of each: wanted has set_id, rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only("powers")
        for batch in batches:
            for part in ragged.portions(batch, "text", PORTION):
                sets, counts = shingle_sets(part.column("text"), size)
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("set_id"), pa.ListArray.from_arrays(at, pa.array(sets.astype(np.int64)))], ["set_id", "shingles"])

    rows = docs.select("doc_id", text_key(F.col("text")).alias("digest"), "text")
    chosen = wanted.select("set_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest"))
    same = (F.col("digest") == F.col("rep_digest")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    found = rows.join(chosen, same).select("set_id", "text")
    return found.mapInArrow(run, "set_id binary, shingles array<long>").dropDuplicates(["set_id"])


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b of those pairs whose sets' Jaccard similarity is ``percent`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            x, y, i, j = left.values.to_numpy(), right.values.to_numpy(), left.offsets.to_numpy(), right.offsets.to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                own, other = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep[k] = 100 * common >= percent * (len(own) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


def block_links(ids: list[bytes], groups: list[bytes], side: np.ndarray, sets: np.ndarray, at: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between classes of different groups, enough to join all groups that have any.

    ``side`` is 0 for classes of the first block and 1 for those of the second; only pairs
    across are compared, or all pairs if there is one block. Every class is looked up in an
    index of the shingles of one block, so memory is that of the block's sets.
    """
    sizes = np.diff(at)
    number = {group: k for k, group in enumerate(dict.fromkeys(groups))}
    group = np.array([number[g] for g in groups])
    two = side.any()
    second = np.flatnonzero(side == 1) if two else np.arange(len(ids))
    first = np.flatnonzero(side == 0) if two else second
    member = np.repeat(second, sizes[second])
    entries = np.concatenate([sets[at[k] : at[k + 1]] for k in second]) if len(second) else sets[:0]
    order = np.argsort(entries, kind="stable")
    entries, member = entries[order], member[order]
    joined, links = {}, []

    def root(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    for k in first:
        own = sets[at[k] : at[k + 1]]
        low, high = np.searchsorted(entries, own, "left"), np.searchsorted(entries, own, "right")
        many = high - low
        if not many.any():
            continue
        begin = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        common = np.bincount(member[begin + np.arange(many.sum())], minlength=len(ids))
        near = np.flatnonzero((100 * common >= percent * (sizes[k] + sizes - common)) & (group != group[k]) & (common > 0))
        for other in near:
            a, b = root(group[k]), root(group[other])
            if a != b:
                joined[a] = b
                links.append((ids[k], ids[other]))
    return links


def residual_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """a, b: links between classes that tables bring together and that are not of one leader yet.

    members: area, set_id, leader. Areas are cut into blocks by a hash of the class, each two
    blocks of an area are one group of at most about ``2 * block`` sets.
    """
    sizes = members.groupBy("area").agg(F.count("*").alias("rows"), F.min("leader").alias("low"), F.max("leader").alias("high"))
    open_areas = sizes.where("low < high").select("area", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    rows = members.join(open_areas, "area").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("area", "set_id", "leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    rows = rows.join(sets, "set_id")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own = table.column("own").to_numpy()
        arrays = table.column("shingles").chunk(0)
        found = block_links(
            table.column("set_id").to_pylist(), table.column("leader").to_pylist(), (own == j).astype(int) if i != j else np.zeros(len(own), int),
            arrays.values.to_numpy(), arrays.offsets.to_numpy(), percent,
        )
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return rows.groupBy("area", "i", "j").applyInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of a link: the least node reachable.

    Each round takes the least label of the neighbours, then the label of one's label; the
    rounds grow with the logarithm of the longest path. Every round is a table on disk.
    """
    both = links.union(links.select("b", "a")).toDF("node", "near").distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        seen = both.join(labels.toDF("near", "seen"), "near").groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        step = stored(step, "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stored(step.join(jump, "label").select("node", "old", F.col("far").alias("label")), "labels")
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, digest, n_shingles, component_id, rep of every row.

    ``component_id`` is the least doc_id of all documents reachable by links, ``rep`` the least
    (doc_id, digest) among them, which names one text of the component. Null, empty and blank
    texts have no shingles and are linked with nothing. Repeated rows are of one component, null
    ids are passed over by the least id unless there is no other, an empty table gives no rows,
    and extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(signatures(docs, size), "signatures")
    own = F.struct("doc_id", "digest")
    full = rows.where("set_id is not null")
    heads = full.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.min(own).alias("rep"))
    classes = stored(heads.join(full.select("set_id", "keys").dropDuplicates(["set_id"]), "set_id"), "classes")

    entries = stored(tables(classes), "table-entries")
    led = entries.groupBy("key").agg(F.min("set_id").alias("lead"), F.max("set_id").alias("last")).where("lead < last").select("key", "lead")
    entries = stored(entries.join(led, "key"), "shared-entries")
    leaders = stored(entries.groupBy("set_id").agg(F.min("lead").alias("lead")), "leaders")
    wanted = classes.join(leaders.select("set_id"), "set_id").select("set_id", "rep")
    sets = stored(full_sets(docs, wanted, size), "full-sets")

    star = stored(linked_pairs(leaders.where("lead <> set_id").select(F.col("lead").alias("a"), F.col("set_id").alias("b")), sets, percent), "star-links")
    # The leader a class is linked to, and the leader's leader as the area in which a table's classes meet.
    linked = star.select(F.col("b").alias("set_id"), F.col("a").alias("leader"))
    area = leaders.select(F.col("set_id").alias("lead"), F.col("lead").alias("area"))
    met = entries.select("set_id", "lead").distinct().join(area, "lead").select("area", "set_id").distinct()
    members = stored(met.join(linked, "set_id", "left").select("area", "set_id", F.coalesce("leader", "set_id").alias("leader")), "areas")
    links = stored(star.union(residual_links(members, sets, percent)), "all-links")

    labels = components(links)
    named = classes.select("set_id", "first_id", "rep").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = stored(named.withColumn("label", F.coalesce("label", "set_id")), "class-labels")
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min("rep").alias("rep"))
    by_class = named.select("set_id", "label").join(least, "label").select("set_id", "component_id", "rep")
    joined = rows.select("doc_id", "digest", "n_shingles", "set_id").join(by_class, "set_id", "left")
    alone = F.col("set_id").isNull()
    return joined.select(
        "doc_id", "digest", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, own).otherwise(F.col("rep")).alias("rep"),
    )


def keep_one(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the least id and digest.

    Rows that agree in id and text are one document and are kept once; texts without words stay.
    """
    found = near_duplicates(docs, size, percent).where(F.col("n_shingles") > 0)
    chosen = found.select(F.col("rep.doc_id").alias("__id"), F.col("rep.digest").alias("__digest")).distinct()
    rows = docs.withColumn("__own", text_key(F.col("text")))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = (F.col("__own") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    kept = rows.where(~wordless).join(chosen, same, "left_semi").dropDuplicates(["doc_id", "__own"])
    return kept.unionByName(rows.where(wordless)).select(*docs.columns)
