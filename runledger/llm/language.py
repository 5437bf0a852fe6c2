"""Language identification by nearest centroids.

A text is a unit vector of hashed letter bigrams and trigrams, weighted by TF-IDF. Each
language has several centroids, found by spherical k-means in the vectors of a bounded sample
of its labelled texts. A text gets the language of the centroid with the largest cosine, and is
marked as rejected if it is farther from it than the sample's texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from runledger.llm import ragged
from runledger.llm.common import stored, travels

travels(__name__)
travels(ragged.__name__)

WIDTH = 4096
SAMPLE_PER_LANGUAGE = 1000  # the bound of the sample that a language is learned from
CENTROIDS = 4
MOST_LANGUAGES = 500  # languages that may be learned; more is an error, for all centroids go to every task
LETTERLESS = "und"

# Letters keep their byte in lower case; everything else is one separator.
_CODE = ragged._LOWER.copy()
_CODE[[b for b in range(0x80) if not (0x61 <= ragged._LOWER[b] <= 0x7A)]] = 0


def counts(column: pa.Array) -> np.ndarray:
    """How often each hashed bigram and trigram occurs in each text."""
    texts = ragged.Texts(column)
    data, size = _CODE[texts.data].astype(np.uint32), len(texts)
    out = np.zeros(size * WIDTH, np.int64)
    owner = np.repeat(np.arange(size, dtype=np.int64) * WIDTH, np.diff(texts.offsets))
    for length in (2, 3):
        many = len(data) - length + 1
        if many > 0:
            gram = data[:many].copy()
            for k in range(1, length):
                gram = (gram << np.uint32(8)) | data[k : k + many]
            slot = ((gram + np.uint32(length)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
            whole = (owner[:many] == owner[length - 1 :]) & (gram != 0)
            out += np.bincount(owner[:many][whole] + slot[whole], minlength=len(out))
    return out.reshape(size, WIDTH)


def unit(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = (np.log1p(found) * idf).astype(np.float32)
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(norm > 0, norm, 1)


def clusters(vectors: np.ndarray, most: int = CENTROIDS, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by spherical k-means, each with the cosine that nearly all its vectors reach.

    The first centroid is the mean, each further one starts at the vector farthest from those before.
    """
    start = [vectors.mean(0)]
    for _ in range(min(most, len(vectors)) - 1):
        nearest = np.max(vectors @ np.stack(start).T, axis=1)
        start.append(vectors[int(np.argmin(nearest))])
    centres = np.stack(start)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        sums = np.stack([vectors[nearest == k].sum(0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    cosine = vectors @ centres.T
    nearest = np.argmax(cosine, axis=1)
    reach = [float(np.quantile(cosine[nearest == k, k], 0.001)) if (nearest == k).any() else 1.0 for k in range(len(centres))]
    return centres, np.array(reach)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


class Model:
    """Inverse document frequencies and all languages' centroids; its size is bounded by MOST_LANGUAGES."""

    def __init__(self, idf: np.ndarray, languages: list[str], centres: np.ndarray, reach: np.ndarray):
        self.idf, self.languages, self.centres, self.reach = idf, languages, centres, reach

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        cosine = unit(counts(column), self.idf) @ self.centres.T
        best = np.argmax(cosine, axis=1)
        value = cosine[np.arange(len(best)), best]
        return [self.languages[k] for k in best], np.clip(value, 0, 1).astype(float), value < self.reach[best]


def sample(docs: DataFrame, most: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """lang, text of up to ``most`` labelled rows per language: those with the smallest hashes.

    Rows are thinned out by hash before any are ranked, so that no task ranks a whole language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id")) != 1))
    labelled = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size")).limit(MOST_LANGUAGES + 1)
    sizes = stored(sizes, "language-sizes")
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.least(F.lit(1.0), (1.5 * most + 50) / F.col("size"))
    thin = labelled.join(F.broadcast(sizes), "lang").where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    return thin.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text")


def fit(docs: DataFrame, most: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model | None:
    """The languages' centroids; nothing if there is no labelled text with a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.portions(batch, "text", rows=500):
                found = counts(part.column("text")).astype(np.int32)
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * WIDTH)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["lang", "counts"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            found = batch.column("counts").flatten().to_numpy().reshape(-1, WIDTH)
            total, rows = total + (found > 0).sum(0), rows + len(found)
        yield pa.RecordBatch.from_pydict({"rows": [rows], "total": [total.tolist()]})

    vectors = stored(sample(docs, most).mapInArrow(count, "lang string, counts array<int>"), "language-sample")
    found = vectors.mapInArrow(frequencies, "rows long, total array<long>").collect()
    rows = sum(row["rows"] for row in found)
    if not rows:
        return None
    idf = np.log((1 + rows) / (1 + np.sum([row["total"] for row in found], axis=0))) + 1

    def centre(key: tuple, table: pa.Table) -> pa.Table:
        raw = np.concatenate([chunk.flatten().to_numpy() for chunk in table.column("counts").chunks]).reshape(-1, WIDTH)
        order = np.lexsort(raw.T[:8][::-1])  # rows come in any order; sums should not depend on it
        centres, reach = clusters(unit(raw[order], idf), centroids)
        return pa.table({"lang": [key[0].as_py()] * len(centres), "centre": [c.tolist() for c in centres.astype(float)], "reach": reach})

    centres = vectors.groupBy("lang").applyInArrow(centre, "lang string, centre array<double>, reach double").collect()
    centres.sort(key=lambda row: (row["lang"], row["centre"]))
    return Model(
        idf, [row["lang"] for row in centres],
        np.array([row["centre"] for row in centres], np.float32), np.array([row["reach"] for row in centres]),
    )


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, rejected for every row, from the text alone; one pass, no shuffle.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if
    nothing could be learned. Every other text gets its nearest language; ``rejected`` says that
    it lies farther away than that language's sample.
    """
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.lit(model is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.portions(batch, text, rows=500):
                has = part.column("lettered").to_numpy(zero_copy_only=False)
                names, score, far = np.full(len(has), LETTERLESS, object), np.zeros(len(has)), np.ones(len(has), bool)
                if has.any():
                    names[has], score[has], far[has] = model.predict(part.column(text).filter(pa.array(has)))
                columns = [part.column(key), pa.array(names, pa.string()), pa.array(score), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, [key, "lang_pred", "score", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text, lettered.alias("lettered"))
    return rows.mapInArrow(run, f"{key} {kind}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, predict all; a null id is neither held out nor learned from."""
    found = predict(docs, fit(docs.select("doc_id", "text", "lang")))
    return found.withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)))
