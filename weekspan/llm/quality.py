"""Document quality from a linear-chain conditional random field over lines.

Every line gets a hidden label, good or bad. Its features describe its characters, its words, repetitions within the
document, and the same for the lines before and after; a transition matrix ties neighbouring labels. Forward-backward
gives each line's probability of being good; a document's score is their mean weighted by line length in bytes.

The field is fitted in numpy by gradient steps on the likelihood of line labels, which for a labelled document are all
its label, on a sample of at most ``SAMPLE_ROWS`` labelled documents in expectation (drawn by a hash of the key; those
of more than ``SAMPLE_LINES`` lines are not drawn). Scoring is one narrow pass over whole texts; the recursion runs over
all documents of a slice at once, so a document of many lines takes steps, not memory.

Defined cases: texts without a line (null, empty, only line breaks) get the share of good documents in the sample; keys
labelled both ways are not learned from, repeated labels count once; without usable labels every score is 0.5; equal
texts get equal scores; an empty table gives no rows; extra columns are kept by ``score_documents`` unless they have the
name of the score column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekspan.llm.textbatch import NOT_SPACE, Texts, Words, batch_column, member, mix, slices, tidy, with_columns

SAMPLE_ROWS = 4_000
SAMPLE_LINES = 256
STEPS = 150
RATE = 0.1
PENALTY = 1e-3
REPEAT_WORDS = 3

IN_LINE = ~member("\n")
LETTERS = member("AZ", "az") | (np.arange(256) >= 128)
UPPER = member("AZ")
DIGITS = member("09")
STOPS = member(".", ",", ";", ":", "?")
SYMBOLS = member("!", "#&", "*+", "/", "<>", "@", "[`", "{~")
OWN = 9
NEIGHBOURS = (0, 1, 2, 5, 6)
FEATURES = OWN + 2 * len(NEIGHBOURS) + 2


def _shares(data: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of a kind each range holds."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind[data], out=sums[1:])
    return (sums[ends] - sums[starts]).astype(np.float64)


def _repeated(hashes: np.ndarray, owner: np.ndarray, all_but_first: bool) -> np.ndarray:
    """Which values occur before (or, if not ``all_but_first``, anywhere else) in the same document."""
    joint = mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(joint, kind="stable")
    same = joint[order][1:] == joint[order][:-1]
    out = np.zeros(len(hashes), bool)
    out[order[1:]] = same
    if not all_but_first:
        out[order[:-1]] |= same
    return out


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x FEATURES), line lengths in bytes, and the first line of each document."""
    lines: Words = texts.words(IN_LINE)
    n = len(lines)
    out = np.zeros((n, FEATURES))
    if not n:
        return out, np.zeros(0), lines.first
    size = (lines.ends - lines.starts).astype(np.float64)
    letters = np.maximum(_shares(texts.data, LETTERS, lines.starts, lines.ends), 1)
    words = texts.words(NOT_SPACE)
    hashes = words.hashes()
    line_of = np.searchsorted(lines.starts, words.starts, "right") - 1
    n_words = np.maximum(np.bincount(line_of, minlength=n), 1)
    where, grams = words.windows(REPEAT_WORDS, hashes)
    again = _repeated(grams, words.documents()[where], True)
    in_line = np.bincount(line_of[where], minlength=n)
    within = _repeated(hashes, line_of, True)
    out[:, 0] = _shares(texts.data, UPPER, lines.starts, lines.ends) / letters
    out[:, 1] = _shares(texts.data, SYMBOLS, lines.starts, lines.ends) / n_words
    out[:, 2] = np.bincount(line_of[where], weights=again, minlength=n) / np.maximum(in_line, 1)
    out[:, 3] = _shares(texts.data, DIGITS, lines.starts, lines.ends) / size
    out[:, 4] = _shares(texts.data, STOPS, lines.starts, lines.ends) / n_words
    out[:, 5] = _repeated(lines.hashes(), lines.documents(), False)
    out[:, 6] = np.bincount(line_of, weights=within, minlength=n) / n_words
    out[:, 7] = np.log1p(size)
    out[:, 8] = size / n_words / 10
    owner = lines.documents()
    joined = owner[1:] == owner[:-1]
    near = out[:, NEIGHBOURS]
    k = len(NEIGHBOURS)
    out[1:, OWN : OWN + k] = near[:-1] * joined[:, None]
    out[:-1, OWN + k : OWN + 2 * k] = near[1:] * joined[:, None]
    out[1:, -2] = joined
    out[:-1, -1] = joined
    return out, size, lines.first


def _logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of a good line; the last is its bias, a bad line's score is 0
    moves: np.ndarray  # 2 x 2 scores of neighbouring labels
    without_lines: float

    def good(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def forward_backward(good: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward scores (lines x 2) and each document's log normaliser; all documents step together."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[:-1][order], sizes[order]
    unary = np.stack([np.zeros(len(good)), good], 1)
    ahead, behind = unary.copy(), np.zeros_like(unary)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # documents with more than t lines
    for t in range(1, longest):
        at = starts[: active[t]] + t
        before = ahead[at - 1]
        ahead[at, 0] += _logsum(before[:, 0] + moves[0, 0], before[:, 1] + moves[1, 0])
        ahead[at, 1] += _logsum(before[:, 0] + moves[0, 1], before[:, 1] + moves[1, 1])
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        after = behind[at + 1] + unary[at + 1]
        behind[at, 0] = _logsum(moves[0, 0] + after[:, 0], moves[0, 1] + after[:, 1])
        behind[at, 1] = _logsum(moves[1, 0] + after[:, 0], moves[1, 1] + after[:, 1])
    total = np.zeros(len(first) - 1)
    filled = np.diff(first) > 0
    ends = first[1:][filled] - 1
    total[filled] = _logsum(ahead[ends, 0], ahead[ends, 1])
    return ahead, behind, total


def marginals(good: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability that each line is good."""
    ahead, behind, _ = forward_backward(good, moves, first)
    joint = ahead + behind
    return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -700, 700)))


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum likelihood with a small penalty; every document weighs the same, whatever its number of lines."""
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = np.concatenate([(features - mean) / scale, np.ones((len(features), 1))], 1)
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weight = (1 / np.maximum(sizes, 1))[owner] / len(sizes)
    y = labels[owner]
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    theta = np.zeros(FEATURES + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        good = x @ weights
        ahead, behind, total = forward_backward(good, moves, first)
        p = 1 / (1 + np.exp(np.clip((ahead + behind)[:, 0] - (ahead + behind)[:, 1], -700, 700)))
        gradient = np.zeros_like(theta)
        gradient[:-4] = x.T @ ((y - p) * weight) - PENALTY * weights
        for a in (0, 1):
            for b in (0, 1):
                after = behind[pair + 1, b] + (good[pair + 1] if b else 0)
                expected = np.exp(np.minimum(ahead[pair, a] + moves[a, b] + after - total[owner[pair]], 0))
                seen = (y[pair] == a) & (y[pair + 1] == b)
                gradient[-4 + 2 * a + b] = ((seen - expected) * weight[pair]).sum() - PENALTY * moves[a, b]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), float(labels.mean()))


def learn(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Fit on a sample of the documents that ``labels`` marks 0 or 1; the caller leaves held-out rows out of ``labels``."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    total = usable.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = usable.filter(F.pmod(F.xxhash64(F.lit("fit"), "key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    texts_in = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(drawn), "key")  # at most about sample_rows rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch_column(batch, "text")):
                x, _, first = line_features(texts)
                n = np.diff(first)
                chosen = np.flatnonzero((n > 0) & (n <= SAMPLE_LINES))
                raw = [x[first[d] : first[d + 1]].astype(np.float32).tobytes() for d in chosen]
                yield pa.RecordBatch.from_arrays([batch_column(batch, "label").slice(a, b - a).take(pa.array(chosen)), pa.array(raw, pa.binary())], ["label", "features"])

    rows = sorted((bytes(r.features), r.label) for r in texts_in.select("text", "label").mapInArrow(tidy(features), "label int, features binary").collect())
    if not rows:
        return Field(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), np.zeros((2, 2)), 0.5)
    parts = [np.frombuffer(r, np.float32).reshape(-1, FEATURES) for r, _ in rows]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return fit(np.concatenate(parts).astype(np.float64), first, np.array([y for _, y in rows], np.float64))


def score_documents(df: DataFrame, field: Field, text: str = "text", kept: list[str] | None = None, score: str = "score") -> DataFrame:
    """``df`` (or its ``kept`` columns) with the quality of every whole text."""
    kept = [c for c in (df.columns if kept is None else kept) if c != score]
    read = df.select(*[F.col(f"`{c}`") for c in kept], *([] if text in kept else [F.col(text)]))
    schema = T.StructType([*[read.schema[c] for c in kept], T.StructField(score, T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, field.without_lines)
            for a, b, texts in slices(batch_column(batch, text)):
                x, size, first = line_features(texts)
                if not len(x):
                    continue
                p = marginals(field.good(x), field.moves, first)
                owner = np.repeat(np.arange(len(texts)), np.diff(first))
                weight = np.bincount(owner, weights=size, minlength=len(texts))
                found = np.flatnonzero(weight)
                scores[a + found] = np.clip(np.bincount(owner, weights=size * p, minlength=len(texts))[found] / weight[found], 0, 1)
            yield with_columns(batch, kept, {score: pa.array(scores)})

    return read.mapInArrow(tidy(apply), schema)
