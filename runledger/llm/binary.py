"""Token ids as Parquet list columns, laid out for selective reads.

Documents are put in ascending order of id by ranges, tokenized in their task and written with
small pages, a page index and row groups of a set size. Ids are dictionary-coded, the counters
beside them delta-coded. A reader of positions opens no ids; a reader of some documents skips
row groups and pages by the statistics of ``doc_id``.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from runledger.llm import ragged
from runledger.llm.common import Memo, give_back, remember_only, sent_if_small, stored, text_key, travels
from runledger.session import work_path

travels(__name__)
travels(ragged.__name__)

# Words met lately that a worker process remembers, and as many met before; speed only, never results.
REMEMBERED = 200_000
END_ID = 2

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",  # counters: delta coding
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


class WordEncoder:
    """Ids of whole texts from ids of words, each word encoded once.

    The tokenizer drops white space, looks at no character across it and reads no capitals, so
    a text's ids are its words' ids in a row, and those of a word in lower case.
    """

    # With one of these after a letter, capital and small letters compose differently.
    _MARKS = tuple(mark.encode() for mark in ("\u0308", "\u030a", "\u030c", "\u0331"))
    _BLANKS = bytes.maketrans(b"\n\t\r\v\f", b"     ")
    _LOWER = bytes.maketrans(b"\n\t\r\v\f" + ascii_uppercase.encode(), b"     " + ascii_lowercase.encode())

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The whole way, and shorter ways for words of letters that the normalizer would leave as
        # they are. One tokenizer goes all three ways, for its vocabulary is large.
        blanks = pre_tokenizers.WhitespaceSplit()
        self.whole = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.plain = (None, blanks)
        self.accented = (None, pre_tokenizers.Sequence([blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        # Words met lately, and those met before them; one that is met again becomes young again.
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _prepared(self, texts: pa.Array) -> pa.Array:
        """The texts with blanks for white space and A to Z in lower case, where that changes no id."""
        texts = pa.concat_arrays([texts.cast(pa.large_string())])  # offsets from 0
        _, offsets, data = texts.buffers()
        raw = data.to_pybytes() if data else b""
        small = raw.translate(self._LOWER)
        signs = [sign for sign in (b"<|", *self._MARKS) if sign in raw]
        if signs:
            ends = np.frombuffer(offsets, np.int64)[: len(texts) + 1].tolist()
            cut = [(raw[i:j], small[i:j]) for i, j in zip(ends[:-1], ends[1:])]
            small = b"".join(own.translate(self._BLANKS) if any(sign in own for sign in signs) else other for own, other in cut)
        return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(small))

    def _go(self, way: tuple) -> None:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = way

    def _learn(self, new: set[str]) -> None:
        """Encode words not met before; those of small letters alone many at a time, cut where a token ends a word."""
        ending = {word for word in new if word[-1] in ".," and word[:-1].lower().isalpha()}
        stems = new - ending | {word[:-1] for word in ending} | {word[-1] for word in ending}
        stems = stems.difference(self.known)
        plain, accented, others = [], [], []
        for word in stems:
            if word.isascii():
                (plain if word.isalpha() and word.islower() else others).append(word)
            elif word.isalpha() and word.lower() == word and unicodedata.is_normalized("NFC", word):
                accented.append(word)
            else:
                others.append(word)
        for way, words in ((self.plain, plain), (self.accented, accented)):
            self._go(way)
            for at in range(0, len(words), 5000):
                chunks = [words[k : k + 100] for k in range(at, min(at + 5000, len(words)), 100)]
                for some, found in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(chunk) for chunk in chunks], add_special_tokens=False)):
                    ids = np.array(found.ids, "<u4")
                    stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)  # each word's last token ends a word
                    raw, bounds = ids.tobytes(), [0, *stops.tolist()]
                    if len(stops) == len(some):
                        self.known.update(zip(some, map(raw.__getitem__, map(slice, bounds[:-1], bounds[1:]))))
                    else:
                        others += some
        self._go(self.whole)
        for at in range(0, len(others), 5000):
            some = others[at : at + 5000]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[word] = np.array(found.ids, "<u4").tobytes()
        for word in ending:
            self.known[word] = self.known[word[:-1]] + self.known[word[-1]]

    def _found(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words."""
        if len(self.known) + len(words) > REMEMBERED:
            self.older, self.known = self.known, {"": b""}
        found = list(map(self.known.get, words))
        missing = [place for place, ids in enumerate(found) if ids is None]
        unmet = [words[place] for place in missing]
        old = list(map(self.older.get, unmet))
        self.known.update([(word, ids) for word, ids in zip(unmet, old) if ids is not None])
        new = {word for word, ids in zip(unmet, old) if ids is None}
        if new:
            self._learn(new)
        for place, word, ids in zip(missing, unmet, old):
            found[place] = self.known[word] if ids is None else ids
        return found

    def encode_column(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by the end id, and where each text's begin and end.

        Words are told apart by Arrow; Python sees each distinct one once.
        """
        words = pa.compute.split_pattern(self._prepared(texts), " ")
        coded = words.values.dictionary_encode()
        found = self._found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())  # faster than to_pylist
        # The end id stands in the pool as one more word, after the last word of each text.
        found.append(np.array([end_id], "<u4").tobytes())
        last = words.offsets.to_numpy()[1:]
        index = np.insert(coded.indices.to_numpy(zero_copy_only=False), last, len(found) - 1)
        # Arrow lays the ids of the words side by side.
        taken = pa.array(found, pa.large_binary()).take(pa.array(index))
        _, offsets, data = taken.buffers()
        stops = np.frombuffer(offsets, np.int64)[: len(index) + 1]
        ids = np.frombuffer(data, "<u4", stops[-1] // 4) if len(index) else np.empty(0, "<u4")
        return ids, np.concatenate([[0], stops[last + np.arange(1, len(last) + 1)] // 4])

    def encode(self, texts: list[str], end_id: int = END_ID) -> list[bytes]:
        """Each text's ids and the end id, as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()), end_id)
        return [ids[i:j].astype("<u4").tobytes() for i, j in zip(ends[:-1], ends[1:])]


_ENCODERS: dict[str, WordEncoder] = Memo("word encoders")


def _encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, key, start_in_part, n_tokens, ids in ascending order of key, null keys first.

    Documents with one key go by a digest of their text; equal rows may stand in any order,
    for they are the same. A null text is empty and has the end id alone.
    """
    ordered = docs.select(key, text, text_key(F.col(text)).alias("digest"))
    ordered = ordered.repartitionByRange(key, "digest").sortWithinPartitions(key, "digest").select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only("word encoders")
        encoder, part_id, done = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in ragged.portions(batch, text, 4 << 20):
                found, offsets = encoder.encode_column(part.column(text).fill_null(""))
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.view(np.int32)))
                columns = [
                    pa.array(np.full(part.num_rows, part_id, np.int32)), part.column(key),
                    pa.array(done + offsets[:-1]), pa.array(np.diff(offsets)), ids,
                ]
                done += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(columns, ["part", key, "start_in_part", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return ordered.mapInArrow(run, f"part int, {key} {kind}, start_in_part long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, vocabulary: str) -> str:
    """Write the documents' ids to a new folder."""
    encoded(docs, vocabulary).write.options(**WRITER).parquet(path)
    return path


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with their place among all ids, from one row per part."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begin")), "token-parts")
    return rows.join(sent_if_small(begins), "part").withColumn("start", F.col("begin") + F.col("start_in_part"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start, n_tokens of every document; the id column isn't read."""
    rows = _placed(spark, path)
    return rows.select("doc_id", "part", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document; filters on doc_id skip row groups and pages."""
    return _placed(spark, path).select("doc_id", "start", "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (counted) and ids_crc32 of what stands in the files.

    Null and empty texts have n_tokens 1; repeated rows are documents of their own; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # an encoder that worked here before has left some
        for batch in batches:
            ids = batch.column("ids")
            # The bytes as they are, without a copy of a batch's ids.
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).view("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            counted = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), counted, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokens_on_file(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the documents' ids below the shared folder and give the digests read back."""
    spark = docs.sparkSession
    path = write_tokens(docs, work_path(spark, "token-ids"), vocabulary)
    return digests(read_tokens(spark, path))
