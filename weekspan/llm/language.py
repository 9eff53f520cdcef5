"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors.

A text is lower-cased, everything that is not a letter byte becomes a single separator, and its 2- and 3-byte grams are
hashed into ``DIMENSIONS`` counts. A vector is (1 + log tf) * idf, scaled to length one. Each language has several
centroids (spherical k-means on a bounded sample of labelled texts); a text gets the language of the centroid with the
largest cosine, which is also its score.

Rejection by distance: over all training rows, the cosine to the own language's nearest centroid is counted by language
and by text length (powers of two). A text is rejected if its cosine is below ``SLACK`` times the ``REJECTED_SHARE`` quantile
of its predicted language and length class, so texts like those of the training rows stay; ``identify`` still names the
nearest language of such a text and marks it in a further column, ``keep_known`` drops it.

Document frequencies and rejection thresholds are taken from all training rows; only the centroids are fitted on a
sample of ``SAMPLE_ROWS`` rows at most in expectation, split evenly over the languages and drawn by a hash of the key.

Defined cases: null, empty and letterless texts get ``und`` and score 0 and are rejected; so is every text where there are
no labelled rows; ties between centroids go to the alphabetically first language; equal texts get equal results; an empty table gives no
rows. Extra columns are kept by ``identify`` unless they have the name of a result column, which then replaces them.
Rows with a null key are learned from like any others by the registered query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekspan.llm.textbatch import LOWER, Texts, fresh, give_back, slices, tidy

DIMENSIONS = 4_096
CENTROIDS = 3
SAMPLE_ROWS = 3_000
ROUNDS = 12
REJECTED_SHARE = 0.001
SLACK = 0.5
BINS = 200
LENGTHS = 24
ROWS_AT_ONCE = 256
UNKNOWN = "und"

#: Letters: a-z and every byte of a multi-byte character; the rest separates words.
LETTER_BYTE = np.zeros(256, bool)
LETTER_BYTE[ord("a") : ord("z") + 1] = True
LETTER_BYTE[128:] = True


def letters_only(texts: Texts) -> Texts:
    """Lower case (also of the accented Latin-1 letters), runs of other bytes as one space."""
    data = LOWER[texts.data]
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    data[accented] += 32
    letter = LETTER_BYTE[data]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    firsts = texts.bounds[:-1][texts.bounds[:-1] < texts.bounds[1:]]
    kept[firsts] = True
    data[~letter] = 32
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    return Texts(data[kept], before[texts.bounds])


def gram_counts(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Counts (documents x DIMENSIONS) and the number of bytes of each normalised text."""
    plain = letters_only(texts)
    sizes = np.diff(plain.bounds)
    owner = np.repeat(np.arange(len(plain), dtype=np.int64) * DIMENSIONS, sizes)
    data = plain.data.astype(np.uint32)
    counts = np.zeros(len(plain) * DIMENSIONS, np.int64)
    for n in (2, 3):
        if len(data) < n:
            continue
        code = data[: len(data) - n + 1].copy()
        for i in range(1, n):
            code = code * np.uint32(256) + data[i : len(data) - n + 1 + i]
        gram = ((code * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int64)
        same = owner[: len(gram)] == owner[n - 1 :]
        counts += np.bincount((owner[: len(gram)] + gram)[same], minlength=len(counts))
    return counts.reshape(len(plain), DIMENSIONS), sizes


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1), dtype=np.float32), np.float32(0)) * idf
    length = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(length, 1e-12)[:, None]


def length_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(sizes, 1)).astype(np.int64), LENGTHS - 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows by language
    owner: np.ndarray  # language of each centroid
    floors: np.ndarray  # language x length class

    def nearest(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its cosine, length class; every text of the slice."""
        counts, sizes = gram_counts(texts)
        near = unit_vectors(counts, self.idf) @ self.centroids.T
        best = near.argmax(1)
        return self.owner[best], np.clip(near[np.arange(len(best)), best], 0, 1), length_class(sizes)


def _document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for _, _, texts in slices(batch.column(0), rows=ROWS_AT_ONCE):
                counts, _ = gram_counts(texts)
                seen += (counts > 0).sum(0)
                total += len(texts)
        if total:
            where = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(where, -1), pa.int32()), pa.array(np.append(seen[where], total), pa.int64())], ["gram", "n"])

    found = rows.mapInArrow(tidy(count), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most DIMENSIONS + 1 rows
    seen, total = np.zeros(DIMENSIONS), 0
    for r in found:
        if r.gram < 0:
            total = r.n
        else:
            seen[r.gram] = r.n
    return total, seen


def _centroids(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from rows that are far from each other."""
    chosen = [vectors.mean(0)]
    chosen[0] /= max(np.linalg.norm(chosen[0]), 1e-12)
    while len(chosen) < min(k, len(vectors)):
        chosen.append(vectors[np.max(vectors @ np.array(chosen).T, axis=1).argmin()])
    centres = np.array(chosen)
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def learn(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on every row of ``rows`` with a text and a label; the caller leaves held-out rows out."""
    rows = rows.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("lang"), F.col(key).alias("key"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), np.zeros((0, LENGTHS)))
    total, seen = _document_frequencies(rows.select("text"))
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, sample_rows / len(languages) / sizes[lang])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "key", "text"), F.lit(1 << 30)) / float(1 << 30)

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in slices(batch.column(0), rows=ROWS_AT_ONCE):
                v = unit_vectors(gram_counts(texts)[0], idf)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, last - first), pa.array([x.tobytes() for x in v], pa.binary())], ["lang", "vector"])

    sampled = rows.filter(draw < share).select("text", "lang").mapInArrow(tidy(vectors_of), "lang string, vector binary").collect()  # about sample_rows rows
    by_language: dict[str, list[bytes]] = {}
    for r in sampled:
        by_language.setdefault(r.lang, []).append(bytes(r.vector))
    centres, owner = [], []
    for i, lang in enumerate(languages):
        drawn = sorted(by_language.get(lang, []))
        if drawn:
            found = _centroids(np.array([np.frombuffer(v, np.float32) for v in drawn]), CENTROIDS)
            centres.append(found)
            owner += [i] * len(found)
    centroids = np.concatenate(centres) if centres else np.zeros((0, DIMENSIONS), np.float32)
    model = Model(languages, idf, centroids.astype(np.float32), np.array(owner, np.int64), np.zeros((len(languages), LENGTHS)))
    if len(centroids):
        model.floors = _floors(rows, model)
    return model


def _floors(rows: DataFrame, model: Model) -> np.ndarray:
    """Rejection thresholds from the histogram of all training rows' cosines to their own language."""
    place = {lang: i for i, lang in enumerate(model.languages)}

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(place) * LENGTHS * BINS, np.int64)
        for batch in batches:
            labels = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, last, texts in slices(batch.column(0), rows=ROWS_AT_ONCE):
                counts, sizes = gram_counts(texts)
                near = unit_vectors(counts, model.idf) @ model.centroids.T
                own = labels[first:last]
                cosine = np.where(model.owner[None, :] == own[:, None], near, -1).max(1)
                where = (own * LENGTHS + length_class(sizes)) * BINS + np.clip((cosine * BINS).astype(np.int64), 0, BINS - 1)
                seen += np.bincount(where, minlength=len(seen))
        where = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(seen[where], pa.int64())], ["cell", "n"])

    found = rows.select("text", "lang").mapInArrow(tidy(histogram), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(len(place) * LENGTHS * BINS)
    for r in found:
        seen[r.cell] = r.n
    seen = seen.reshape(len(place), LENGTHS, BINS).cumsum(2)
    known = seen[:, :, -1:] > 0
    below = (seen < np.maximum(seen[:, :, -1:] * REJECTED_SHARE, 1)).sum(2) / BINS
    return np.where(known[:, :, 0], below, 0) * SLACK


VERDICT = T.StructType([T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def verdicts(model: Model, text: Column) -> Column:
    """Struct (language, score, rejected) of a text column. Only texts go to Python, and only verdicts come back."""
    names = np.array([*model.languages, UNKNOWN], object)

    @F.arrow_udf(VERDICT)
    def predict(texts_in: pa.Array, has_letter: pa.Array) -> pa.Array:
        n = len(texts_in)
        best, cosine, refused = np.full(n, len(names) - 1), np.zeros(n), np.ones(n, bool)
        lettered = np.array(has_letter.to_pylist(), bool)
        if len(model.centroids):
            for first, last, texts in slices(texts_in, rows=ROWS_AT_ONCE):
                lang, near, length = model.nearest(texts)
                known = lettered[first:last]
                best[first:last] = np.where(known, lang, len(names) - 1)
                cosine[first:last] = np.where(known, np.clip(near, 0, 1), 0)
                refused[first:last] = ~known | (near < model.floors[lang, length]) | (near <= 0)
        give_back()
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(cosine, pa.float64()), pa.array(refused)], ["language", "score", "rejected"])

    return predict.asNondeterministic()(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))  # so that it is evaluated once


def identify(df: DataFrame, model: Model, text: str = "text", kept: list[str] | None = None, language: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``df`` (or its ``kept`` columns) with the nearest language, the cosine to it, and whether its distance rejects it."""
    kept = [c for c in (df.columns if kept is None else kept) if c not in (language, score, rejected)]
    (verdict,) = fresh(df, "verdict")
    found = df.withColumn(verdict, verdicts(model, F.col(text)))
    of = lambda field, name: F.col(verdict)[field].alias(name)
    return found.select(*[F.col(f"`{c}`") for c in kept], of("language", language), of("score", score), of("rejected", rejected))


def keep_known(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a letter and is not rejected, columns unchanged."""
    (verdict,) = fresh(df, "verdict")
    found = df.withColumn(verdict, verdicts(model, F.col(text)))
    return found.filter(~F.col(verdict)["rejected"]).select(*[F.col(f"`{c}`") for c in df.columns])
