"""Removal of repeated byte strings by a suffix array built with a difference cover.

Texts are cut into phrases at places that depend on the bytes around them alone, so equal strings
are cut alike, and become strings of phrase names. Their suffix array is built with the
difference cover {1, 2} modulo 3: triples of names at the sampled places are sorted and numbered,
and the numbers named again by triples until they reach over the string length asked for; the
other suffixes are merged by their first name and the rank of the sampled suffix behind it. In
the sorted lists adjacent prefixes are compared, which tells how many phrases from a place on
also stand elsewhere. Where a window of ``least`` bytes has all its inner phrases elsewhere,
its bytes are compared by digest, so the result is that of all windows of all texts.

Phrases that occur once start no repeated suffix and never enter the array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from runledger.llm.common import sent_if_small, stored, travels
from runledger.llm.ranks import numbered

travels(__name__)

LEAST = 400
_SEGMENT = 1 << 20  # bytes cut at once; memory only
_ROWS = 20_000  # rows of an output batch; memory only
_NEVER = 1 << 30
# Names are named again until they reach so many phrases. Where as many agree, the bytes decide.
REACH = 9
# Repeated names, one long each, that may be sent to every task: 16 MB.
_SENT_NAMES = 2_000_000
# Windows are compared in runs, then in blocks of so many, then one by one.
_STEPS = (16, 4, 1)


class Shape(NamedTuple):
    """Lengths that follow from the string length: a window holds at least one whole phrase that it alone determines."""

    least: int
    gram: int
    width: int

    @classmethod
    def of(cls, least: int) -> Shape:
        gram = 1 << max(1, (least // 25).bit_length() - 1)
        return cls(least, gram, (least - gram + 3) // 4)

    @property
    def low(self) -> int:
        return self.width - 1

    @property
    def high(self) -> int:
        return self.least - self.gram - self.width + 1


def _sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values, done = best(values[:-done], values[done:]), 2 * done
    rest = width - done
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def _chosen(data: np.ndarray, shape: Shape) -> np.ndarray:
    """Which grams have the least hash of some ``width`` grams in a row that they lie in."""
    h, width = data.astype(np.uint64), 1
    while width < shape.gram:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        width *= 2
    if len(h) < shape.width:
        return np.zeros(len(h), bool)
    beside = np.zeros(shape.width - 1, np.uint64)
    lowest = np.concatenate([beside, _sliding(h, shape.width, np.minimum), beside])
    return _sliding(lowest, shape.width, np.maximum) == h


def cuts(data: np.ndarray, shape: Shape) -> np.ndarray:
    """Where the phrases of a text begin, the last one being left open; long texts go by segments."""
    if len(data) < shape.least:
        return np.empty(0, np.int64)
    grams, found = len(data) - shape.gram + 1, []
    for at in range(0, grams, _SEGMENT):
        begin, end = max(0, at - shape.low), min(grams, at + _SEGMENT + shape.low)
        chosen = _chosen(data[begin : end + shape.gram - 1], shape)
        found.append(np.flatnonzero(chosen[at - begin : at - begin + _SEGMENT]) + at)
    return np.concatenate(found)


def _texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[np.ndarray]:
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield data[a:b]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc (a digest of the text), text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.md5(text).alias("doc"), text.alias("text"))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *values]), kind))


def parsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """row, doc, doc_id, n_bytes, sha, cuts, names, reach, needed of every text; a stored table without texts.

    Of each phrase: ``reach``, the phrases from it on that a window can determine, and ``needed``,
    how many of them any window has that it is the first of.
    """
    shape = Shape.of(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("n_bytes", "sha", "cuts", "names", "reach", "needed")}
            for data in _texts(batch):
                at, view = cuts(data, shape), memoryview(data)
                bounds = at.tolist()
                names = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], np.uint64)
                first, place = at[:-1], np.arange(len(names))
                earliest = np.maximum(np.concatenate([[0], at[:-2] - shape.low + 1])[: len(names)], 0)
                needed = np.searchsorted(at, earliest + shape.high, "right") - 1 - place
                needed[(first < shape.low) | (earliest > len(data) - least)] = _NEVER
                out["n_bytes"].append(len(data))
                out["sha"].append(sha256(data).hexdigest())
                out["cuts"].append(at)
                out["names"].append(names.view(np.int64))
                out["reach"].append(np.searchsorted(at, first + (shape.high - shape.low), "right") - 1 - place)
                out["needed"].append(needed)
            arrays = [pa.array(out["n_bytes"], pa.int64()), pa.array(out["sha"], pa.string()), _lists(out["cuts"], pa.int32()), _lists(out["names"], pa.int64())]
            arrays += [_lists(out["reach"], pa.int32()), _lists(out["needed"], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), *arrays], ["doc_id", "doc", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, doc string, n_bytes long, sha string, cuts array<int>, names array<long>, reach array<int>, needed array<int>"
    return stored(_keyed(docs).mapInArrow(run, columns).withColumn("row", F.monotonically_increasing_id()), "suffix-phrases")


def _one_each(phrases: DataFrame) -> DataFrame:
    """doc, row, doc_id, copies: of equal texts the row that stands for all."""
    first = phrases.groupBy("doc").agg(F.min(F.struct("row", "doc_id")).alias("first"), F.count("*").alias("copies"))
    return first.select("doc", "first.*", "copies")


def symbols(phrases: DataFrame) -> DataFrame:
    """row, i, x, y, z (names of phrase i and the next two), needed, copies, head (names in reach, ``REACH`` at most); a stored table.

    Only phrases of stretches are in it that occur again phrase by phrase and are long enough for a
    window. Of equal texts one stands for all, with their number in ``copies``. Heads hold 32 bits
    of the names; where these agree by chance, the bytes decide.
    """
    repeated = stored(phrases.select(F.explode("names").alias("x")).groupBy("x").count().where("count > 1").select("x"), "suffix-repeated")
    one_each = _one_each(phrases).select("row", "copies")
    places = phrases.select("row", F.posexplode("names").alias("i", "x")).join(sent_if_small(repeated.hint("shuffle_hash"), _SENT_NAMES), "x", "left_semi")
    # At most as many places as one text has phrases.
    places = places.groupBy("row").agg(F.collect_list("i").alias("places"))
    joined = phrases.select("row", "names", "reach", "needed").join(places, "row").join(one_each, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row, copies = batch.column("row")[k].as_py(), batch.column("copies")[k].as_py()
                names, reach, needed, places = (batch.column(c)[k].values.to_numpy() for c in ("names", "reach", "needed", "places"))
                again = np.zeros(len(names) + 1, bool)
                again[places] = True
                place = np.arange(len(names))
                stop = np.flatnonzero(~again)
                stop = stop[np.searchsorted(stop, place)]  # the next phrase that occurs once
                # Windows from phrase i on can occur again if all they need does; the phrases in their reach come along.
                use = np.flatnonzero(stop - place >= needed)
                needed = np.where(stop - place >= needed, needed, _NEVER)
                change = np.bincount(use, minlength=len(names) + 1) - np.bincount(np.minimum(use + reach[use], len(names)), minlength=len(names) + 1)
                at = np.flatnonzero((np.cumsum(change)[:-1] > 0) & again[:-1])
                size = np.minimum(np.minimum(reach, stop - place), REACH)
                ahead = np.concatenate([names, np.zeros(REACH, np.int64)])
                for begin in range(0, len(at), _ROWS):
                    some = at[begin : begin + _ROWS]
                    table, own = ahead[some[:, None] + np.arange(REACH)], size[some]
                    offsets = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
                    heads = pa.ListArray.from_arrays(pa.array(offsets), pa.array(table[np.arange(REACH) < own[:, None]].astype(np.int32)))
                    columns = [pa.array(np.full(len(some), row)), pa.array(some.astype(np.int32)), *(pa.array(np.ascontiguousarray(table[:, d])) for d in range(3))]
                    columns += [pa.array(needed[some]), pa.array(np.full(len(some), copies)), heads]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "i", "x", "y", "z", "needed", "copies", "head"])

    return stored(joined.mapInArrow(run, "row long, i int, x long, y long, z long, needed int, copies long, head array<int>"), "suffix-symbols")


def _named(triples: DataFrame) -> DataFrame:
    """row, i, name: the number of each row's triple among all different triples in order."""
    order = ["x", "y", "z"]
    names = numbered(triples.select(*order).distinct(), order, "suffix-names").withColumn("name", F.col("place") + 1).drop("place")
    return stored(triples.join(names, order).select("row", "i", "name"), "suffix-named")


def sampled_ranks(suffixes: DataFrame) -> DataFrame:
    """row, i, rank of the suffixes at places 1 and 2 modulo 3, ordered by their first ``REACH`` names.

    Each round names triples of the last round's names, three places apart, and so reaches three
    times as far; places of phrases that are not in the table have the name 0.
    """
    named = _named(suffixes.where("i % 3 <> 0").select("row", "i", "x", "y", "z"))
    reach = 3
    while reach < REACH:
        row = Window.partitionBy("row", F.col("i") % 3).orderBy("i")

        def ahead(places: int) -> Column:
            near = [F.when(F.lead("i", k).over(row) == F.col("i") + places, F.lead("name", k).over(row)) for k in (1, 2)]
            return F.coalesce(*near, F.lit(0))

        named = _named(named.select("row", "i", F.col("name").alias("x"), ahead(3).alias("y"), ahead(6).alias("z")))
        reach *= 3
    return named.withColumnRenamed("name", "rank")


def merged(suffixes: DataFrame, ranks: DataFrame) -> DataFrame:
    """list, a, b, c, row, i, needed, copies, head: every suffix in two of three lists, each ordered by (a, b, c).

    Two suffixes whose places are 0 and 1 modulo 3 compare by their first name and the rank behind
    it, 0 and 2 by two names and the rank behind them, 1 and 2 by their ranks. A list for each of
    these pairs merges the classes two by two with plain keys: every two suffixes share a list.
    """
    row = Window.partitionBy("row").orderBy("i")
    known = suffixes.join(ranks, ["row", "i"], "left")

    def rank(places: int) -> Column:
        near = [F.when(F.lead("i", k).over(row) == F.col("i") + places, F.lead("rank", k).over(row)) for k in range(1, places + 1)]
        return F.coalesce(*near, F.lit(0))

    known = known.withColumns({"next": rank(1), "second": rank(2)})
    zero, keys = F.lit(0).cast("long"), F.col("i") % 3
    one = F.struct(F.lit(1).alias("list"), F.col("x").alias("a"), F.col("next").alias("b"), zero.alias("c"))
    two = F.struct(F.lit(2).alias("list"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("second").alias("c"))
    three = F.struct(F.lit(3).alias("list"), F.col("rank").alias("a"), zero.alias("b"), zero.alias("c"))
    entries = F.when(keys == 0, F.array(one, two)).when(keys == 1, F.array(one, three)).otherwise(F.array(two, three))
    own = ["row", "i", "needed", "copies", "head"]
    # Where a window can't occur again, the suffix was of use for the ranks alone.
    return known.where(F.col("needed") < _NEVER).select(*own, F.explode(entries).alias("key")).select("key.*", *own)


def _agreeing(lists: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many names each row's head has in common with the row before it; 0 for the first."""
    same = (heads[1:] == heads[:-1]) & (np.arange(REACH) < np.minimum(sizes[1:], sizes[:-1])[:, None])
    return np.concatenate([[0], np.where(lists[1:] == lists[:-1], np.cumprod(same, axis=1).sum(axis=1), 0)])


_COMMON = "row long, i int, needed int, common int, border int, range int, list int, head array<int>"


def common_prefixes(suffixes: DataFrame) -> DataFrame:
    """row, i, common: how many phrases from phrase i on also stand elsewhere, where windows may need no more.

    The lists are dealt to sorted ranges; a range's task compares adjacent rows as they pass, and
    its first and last row are compared with those of the ranges beside. A place is given by each
    list that tells so; where ``REACH`` phrases agree, all count as agreeing.
    """
    order = ["list", "a", "b", "c", "row", "i"]
    ordered = merged(suffixes, sampled_ranks(suffixes)).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, of_range, last = ("row", "i", "needed", "copies", "list"), TaskContext.get().partitionId(), None

        def rows(part: dict, common: np.ndarray, border: int) -> pa.RecordBatch:
            n = len(common)
            heads = [part["head"][k, : part["size"][k]] if border else part["head"][k, :0] for k in range(n)]
            arrays = [pa.array(part["row"]), pa.array(part["i"], pa.int32()), pa.array(part["needed"], pa.int32()), pa.array(common.astype(np.int32))]
            arrays += [pa.array(np.full(n, v, np.int32)) for v in (border, of_range)] + [pa.array(part["list"], pa.int32()), _lists(heads, pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, ["row", "i", "needed", "common", "border", "range", "list", "head"])

        def taken(part: dict, which: np.ndarray | slice) -> dict:
            return {name: values[which] for name, values in part.items()}

        for batch in batches:
            if not len(batch):
                continue
            heads = batch.column("head")
            part = {name: batch.column(name).to_numpy() for name in names} | {"size": np.diff(heads.offsets.to_numpy())}
            part["head"] = np.zeros((len(batch), REACH), np.int32)
            part["head"][np.arange(REACH) < part["size"][:, None]] = heads.flatten().to_numpy()
            part["before"] = np.zeros(len(batch), np.int64)
            if last is None:
                yield rows(taken(part, slice(0, 1)), np.zeros(1), 1)
            else:
                part = {name: np.concatenate([last[name], values]) for name, values in part.items()}
            found = _agreeing(part["list"], part["head"], part["size"])
            part["before"] = np.maximum(part["before"], found)
            # The last row waits for the one behind it.
            best = np.maximum(part["before"][:-1], found[1:])
            best = np.where(part["copies"][:-1] > 1, part["size"][:-1], best)
            best = np.where(best >= REACH, _NEVER - 1, best)
            hit = np.flatnonzero(best >= part["needed"][:-1])
            yield rows(taken(part, hit), best[hit], 0)
            last = taken(part, slice(-1, None))
        if last is not None:
            best = np.where(last["copies"] > 1, last["size"], last["before"])
            best = np.where(best >= REACH, _NEVER - 1, best)
            if best[0] >= last["needed"][0]:
                yield rows(last, best, 0)
            yield rows(last, np.zeros(1), 2)

    found = stored(ordered.mapInArrow(run, _COMMON), "suffix-common")
    # Two rows a range: the last one of a range and the first one of the next.
    ends = Window.orderBy("range", "border")
    shown, border = F.struct("list", "head"), F.col("border")
    borders = found.where("border > 0").withColumn("near", F.when(border == 1, F.lag(shown).over(ends)).otherwise(F.lead(shown).over(ends)))
    same = F.zip_with("head", F.col("near.head"), lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, False)
    agree = F.when(F.col("near.list") == F.col("list"), F.when(differs == 0, F.size("head")).otherwise(differs - 1)).otherwise(0).cast("int")
    borders = borders.withColumn("common", F.when(agree >= REACH, _NEVER - 1).otherwise(agree))
    return found.where("border = 0").unionByName(borders.drop("near")).where("common >= needed").select("row", "i", "common")


_PIECES = "core long, one long, two long, n long, row long, first int, last int"


def _pieces(view: memoryview, row: int, cores: tuple, first: np.ndarray, last: np.ndarray, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Rows of runs of windows: a digest of their core bytes, and one of 128 bits of all their bytes as two numbers."""
    for at in range(0, len(first), _ROWS):
        some = slice(at, at + _ROWS)
        core = b"".join([xxhash.xxh3_64_digest(view[p:q]) for p, q in zip(cores[0][some].tolist(), cores[1][some].tolist())])
        whole = b"".join([xxhash.xxh3_128_digest(view[p : q + least]) for p, q in zip(first[some].tolist(), last[some].tolist())])
        pairs = np.frombuffer(whole, np.int64).reshape(-1, 2)
        columns = [np.frombuffer(core, np.int64), *pairs.T.copy(), n[some], np.full(len(pairs), row), *(places[some].astype(np.int32) for places in (first, last))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["core", "one", "two", "n", "row", "first", "last"])


def _suspects(texts: DataFrame, shape: Shape) -> DataFrame:
    """Runs of windows with the same first phrase, where the phrases they all have, their core, stand elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(_texts(batch)):
                at, places, commons = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in ("cuts", "places", "commons"))
                known = np.zeros(len(at) + 1, np.int64)
                np.maximum.at(known, places, commons)
                end = len(data) - shape.least
                starts = np.unique(np.concatenate([[0], at - shape.low + 1]))
                starts = starts[(starts >= 0) & (starts <= end)]
                lasts = np.concatenate([starts[1:] - 1, [end]])
                a, b = np.searchsorted(at, starts + shape.low), np.searchsorted(at, starts + shape.high, "right") - 1
                hit = np.flatnonzero(known[a] >= b - a)
                # Up to the last cut that every window has of which this cut can be the first.
                ends = np.searchsorted(at, at[a[hit]] + (shape.high - shape.low - shape.width + 1), "right") - 1
                cores = (at[a[hit]], at[ends])
                row, copies = batch.column("row")[k].as_py(), batch.column("copies")[k].as_py()
                yield from _pieces(memoryview(data), row, cores, starts[hit], lasts[hit], np.full(len(hit), copies), shape.least)

    return texts.select("row", "copies", "text", "cuts", "places", "commons").mapInArrow(run, _PIECES)


def _finer(texts: DataFrame, runs: DataFrame, shape: Shape, step: int) -> DataFrame:
    """The runs (row, first, last, n) in blocks of ``step`` windows; a block's core is what all its windows share.

    Blocks are counted from the first cut a run's windows determine, so equal windows fall into like blocks.
    """
    # At most as many runs as one text has phrases.
    listed = runs.groupBy("row").agg(F.collect_list(F.struct("first", "last", "n")).alias("runs"))
    joined = texts.select("row", "text", "cuts").join(listed, "row").select("row", "text", "cuts", "runs.first", "runs.last", "runs.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(_texts(batch)):
                at, first, last, n = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in ("cuts", "first", "last", "n"))
                cut = at[np.searchsorted(at, first + shape.low)]
                high, low = (cut - first) // step, (cut - last) // step
                count = high - low + 1
                own = np.repeat(np.arange(len(first)), count)
                grid = high[own] - (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))
                begin = cut[own] - step * grid - step + 1  # of the block before the run's ends cut it
                cores = (begin + step - 1, begin + shape.least)
                yield from _pieces(memoryview(data), batch.column("row")[k].as_py(), cores, np.maximum(begin, first[own]), np.minimum(begin + step - 1, last[own]), n[own], shape.least)

    return joined.mapInArrow(run, _PIECES)


def repeated_windows(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """row, first, last: ranges of window starts whose bytes stand elsewhere too, not joined; stored tables.

    Runs of windows with all bytes equal are settled at once, one standing for all from then on.
    Where runs with an equal core differ and one of them stands alone, they are looked at in
    blocks, and those blocks in which the same happens again window by window.
    """
    shape, pieces, settled = Shape.of(least), stored(_suspects(texts, Shape.of(least)), "suffix-runs"), None
    for step in (*_STEPS, None):
        # Equal runs agree in their core. Any of them stands for all; its columns are taken of one row.
        one_of = [F.first(name).alias(name) for name in ("core", "row", "first", "last")]
        runs = stored(pieces.groupBy("one", "two").agg(F.sum("n").alias("n"), *one_of), "suffix-different")
        equal = pieces.where("n = 1").join(runs.where("n > 1").select("one", "two"), ["one", "two"], "left_semi").select("row", "first", "last")
        equal = stored(equal, "suffix-settled")
        settled = equal if settled is None else settled.unionByName(equal)
        if step is None:
            return settled
        mixed = runs.groupBy("core").agg(F.count("*").alias("different"), F.min("n").alias("fewest")).where("different > 1 and fewest = 1")
        pieces = stored(_finer(texts, runs.join(mixed.select("core"), "core", "left_semi"), shape, step), "suffix-blocks")


def _removed(texts: DataFrame, windows: DataFrame, least: int) -> DataFrame:
    """doc, n_removed, n_spans, kept_sha256, spans of texts with repeated windows."""
    listed = windows.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    joined = texts.select("doc", "row", "text").join(listed, "row").select("doc", "text", "found.first", "found.last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, data in enumerate(_texts(batch)):
                first, last = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in ("first", "last"))
                change = np.zeros(len(data) + 2, np.int64)
                np.add.at(change, first + 1, 1)
                np.add.at(change, last + least + 1, -1)
                covered = np.cumsum(change) > 0
                edges = np.flatnonzero(covered[1:] != covered[:-1])
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])]
                kept = data[~covered[1 : len(data) + 1]]
                out.append((batch.column("doc")[k].as_py(), len(data) - len(kept), len(spans), sha256(kept.tobytes()).hexdigest(), spans))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            columns = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(run, "doc string, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>")


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges, end exclusive) of every text.

    A byte goes where a string of ``least`` bytes that covers it also starts anywhere else, in this
    text or another; strings overlap and are judged on the texts as given. Null counts as empty;
    texts under ``least`` bytes stay whole; repeated rows are texts of their own, so their long
    strings go; ids may repeat or be null; other columns are not read; an empty table gives no rows.
    """
    phrases = parsed(docs, least)
    suffixes = symbols(phrases)
    found = common_prefixes(suffixes).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "common"))).alias("found"))
    found = stored(found.select("row", F.col("found.i").alias("places"), F.col("found.common").alias("commons")), "suffix-found")
    copies = _one_each(phrases)
    wanted = phrases.select("row", "cuts").join(found, "row").join(copies, "row")
    keys = stored(wanted.select("doc", F.col("doc_id").alias("first_id")), "suffix-docs")
    # The text itself is read of the row that stands for all equal ones.
    mine = F.col("doc_id").eqNullSafe(F.col("first_id"))
    texts = _keyed(docs).join(sent_if_small(keys), "doc").where(mine).select("doc", "text").join(wanted.drop("doc_id"), "doc")
    texts = stored(texts, "suffix-texts")
    # Long texts that stand there several times go as a whole, the others without their repeated windows.
    removed = _removed(texts.where("copies = 1"), repeated_windows(texts, least), least)
    whole = phrases.select("doc", "doc_id", "n_bytes", "sha").join(copies.where("copies > 1").select("doc", "copies"), "doc", "left").join(removed, "doc", "left")
    goes = F.col("copies").isNotNull() & (F.col("n_bytes") >= least)
    span = F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))
    nothing = F.array().cast("array<struct<start: long, stop: long>>")
    return whole.select(
        "doc_id", "n_bytes", F.when(goes, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(goes, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(goes, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(goes, F.array(span)).otherwise(F.coalesce("spans", nothing)).alias("spans"),
    )
