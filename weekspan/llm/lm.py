"""Language-model scores from causal self-attention over subword ids, next to a unigram word model.

A text is a run of words (lower-case A-Z, cut at white space), each written as the subword ids of a public vocabulary,
and an end id. The model factors the probability of an id into its class and the id within the class. The class comes from an attention
layer over the ids before it (query from the last id, keys and values from the window, a bias by distance, a causal mask,
then a rectified layer), added to the logarithm of how often the class follows the last id in the corpus; the id within the
class comes from counts after the last id, shrunk towards counts after the last id's class. Every id is scored once:
windows of ``2 * STRIDE`` ids overlap by half and only the ids of the second half are scored, so each sees between
``STRIDE`` and ``2 * STRIDE - 1`` ids before it. Windows are scored in batches, in numpy.

Every text is written as ids once, into a stored table that all later passes read. Counts of ids, of classes and of pairs
of neighbours cover all training documents and are summed in Spark; ids become classes by what stands next to them
(k-means on counts of hashed neighbours), all ids of the vocabulary included. Of the pairs the ``PAIRS`` most frequent are
kept one by one, the proven bound of that table; the others count in their class. The attention layer is trained on every
window of the training documents: in each of ``TURNS`` turns, every task that reads ids improves the shared weights by
steps of its own over the turn's windows, and the mean of all, by their numbers of windows, is the next turn's start. Tables
of ``FEW_WINDOWS`` or fewer pass in every turn; the more windows there are, the fewer turns each takes part in, at least one.

The unigram model needs every document's words to meet their counts. Words are dealt by hash in packed blocks, once per
document and slice with their number; sums return to the documents the same way. More buckets do not split a word, so
words of very many documents (``common``) are counted apart, exactly and with map-side sums, and their counts, a list
of bounded length, are broadcast to where the documents are scored. So a bucket's memory does not grow with the table.

Defined cases: null and empty texts are an end alone; words unseen in training have count 0, ids unseen have a smoothed
share of their class; without training documents the model is uniform over the vocabulary and N and V are 0; repeated
rows get equal results; a null key is never held out; an empty table gives no rows; other columns are not read. Documents
meet their sums by a 64-bit hash of key and text: two different documents share one with a probability of 3e-20 a pair.
"""

from __future__ import annotations

import base64
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekspan.llm import common
from weekspan.llm.textbatch import MULTIPLIER, NOT_SPACE, Texts, Words, batch_column, buckets_for, by_bucket, mix, packed, roll, slices, text_volume, tidy
from weekspan.session import durable

TOKENIZER = "byte_bpe_50k"
VOCABULARY = 50_257
END = 50_256
CLASSES = 64
FREQUENT = 4_096
LEAST_TALLY = 100
NEIGHBOURS = 64
PAIRS = 500_000
STRIDE = 16
WIDTH = 16
FEW_WINDOWS = 80_000
TURNS = 4
BATCH = 192
PAIR_CODES = 4_000_000
RATE = 0.02
LEAST_RATE = 0.02  # of the rate, where a task holds more windows than most
PIECE = 4_096
PRIOR = 12.0
CLASS_PRIOR = 12.0
LARGEST = 60.0  # exponents are cut here, far above what training reaches
LEAST = 0.05
ENTRIES = 1_500_000
WORD_BYTES = 6
DOCUMENT_ROWS = 20_000
LEAST_BUCKETS = 48
IDS_AT_ONCE = 300_000
CELLS_A_ROW = 100_000
COUNTS_SEEN = 1 << 16
KEY, ROW, HELD = "_key", "_row", "_held"


@lru_cache(maxsize=2)
def _coder(name: str):
    """The vocabulary with one chunk per word, and which ids begin with a space."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    begins = np.zeros(VOCABULARY, bool)
    begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    return tiktoken.Encoding(f"{name}-words", pat_str=r" ?[^ ]+| ", mergeable_ranks=ranks, special_tokens={}), begins


def subwords(words: Words, name: str = TOKENIZER, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and the number of ids of each word; each distinct word is encoded once."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = words.hashes() if hashes is None else hashes
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    chosen = np.zeros(n, bool)
    chosen[first] = True
    whole = Words(Texts(words.texts.data, np.array([0, len(words.texts.data)])), words.starts, words.ends, np.array([0, n]))
    body = _spaced(whole, chosen)
    coder, begins = _coder(name)
    ids = np.array(coder.encode_ordinary(body), np.int64)
    starts = np.flatnonzero(begins[ids])
    sizes = np.diff(np.append(starts, len(ids)))
    place = np.cumsum(chosen)[first] - 1  # distinct words in text order
    sizes, starts = sizes[place][which], starts[place][which]
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])], sizes


def _spaced(words: Words, chosen: np.ndarray) -> str:
    """The chosen words, each after a space."""
    at = np.flatnonzero(chosen)
    sizes = words.ends[at] - words.starts[at]
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]), 32, np.uint8)
    source = np.repeat(words.starts[at] - (ends - sizes), sizes) + (np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(at) + 1), sizes))
    target = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(at) + 1), sizes)
    out[target] = words.texts.data[source]
    return out.tobytes().decode("utf-8", "replace")


def streams(texts: Texts, name: str = TOKENIZER, words: Words | None = None, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks x STRIDE) ids, -1 before a text's start and after its end; which blocks hold ids to score; their document.

    Each document is one block of starts, then its ids and the end.
    """
    words = texts.lower().words(NOT_SPACE) if words is None else words
    ids, sizes = subwords(words, name, hashes)
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = before[words.first]
    n = np.diff(first) + 1
    blocks = 1 + -(-n // STRIDE)
    origin = (np.cumsum(blocks) - blocks) * STRIDE + STRIDE
    out = np.full(int(blocks.sum()) * STRIDE, -1, np.int64)
    out[np.repeat(origin - first[:-1], n - 1) + np.arange(len(ids))] = ids
    out[origin + n - 1] = END
    scored = np.ones(len(out) // STRIDE, bool)
    scored[origin // STRIDE - 1] = False
    return out.reshape(-1, STRIDE), scored, np.repeat(np.arange(len(texts)), blocks)


def keep_freed() -> None:
    """Let this process keep up to 64 MB that it freed, until ``tidy`` gives them back.

    Arrays of the same sizes are made for every batch; if each is given back to the system, as happens above 128 KB, getting
    their pages again takes as long as the work on them.
    """
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        library.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def in_batch(context: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The input rows that ``context`` names, sorted, and ``context`` in numbers of these."""
    there = np.zeros(rows, bool)
    there[context] = True
    found = np.flatnonzero(there)
    number = np.empty(rows, np.int64)
    number[found] = np.arange(len(found))
    return found, number.take(context)


class PairTable:
    """Values of (id before, id) pairs in an open hash table; pairs that are not held have none."""

    NONE = np.uint32(0xFFFFFFFF)  # above all codes

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(3 * len(codes) + 1))))
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.codes, self.values, self.steps = np.full(1 << bits, self.NONE), np.zeros(1 << bits, np.float32), 0
        codes = codes.astype(np.uint32)
        left = np.arange(len(codes))
        while len(left):
            at = self._place(codes[left], self.steps)
            free = self.codes[at] == self.NONE
            _, first = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.codes[at[taken]], self.values[at[taken]] = codes[left[taken]], values[left[taken]]
            left = np.delete(left, taken)
            self.steps += 1

    def _place(self, codes: np.ndarray, step: int) -> np.ndarray:
        at = ((codes * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)
        return (at + step) & self.mask if step else at

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of every code, and whether it is held; those that are not have any value."""
        codes = codes.astype(np.uint32)
        at = self._place(codes, 0)
        seen, values = self.codes.take(at), self.values.take(at)
        held = seen == codes
        left = np.flatnonzero(~held)
        left = left[seen[left] != self.NONE]
        for step in range(1, self.steps):
            if not len(left):
                break
            at = self._place(codes[left], step)
            seen = self.codes[at]
            hit = seen == codes[left]
            held[left[hit]], values[left[hit]] = True, self.values[at[hit]]
            left = left[~hit & (seen != self.NONE)]
        return values, held

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the codes that are held, and their values."""
        values, held = self.look_up(codes)
        return np.flatnonzero(held), values[held]


@dataclass
class Model:
    compact: np.ndarray  # id -> input row; the last entry is the start of a text
    classes: np.ndarray  # id -> class
    parameters: dict[str, np.ndarray]
    prior: np.ndarray  # log P(class | id before): (VOCABULARY + 1) x CLASSES, the last row is the start
    within: np.ndarray  # log10 P(id | its class, class before): (CLASSES + 1) x VOCABULARY
    share: np.ndarray  # log10 of the weight that ids without a pair keep: (VOCABULARY + 1) x CLASSES
    pairs: PairTable  # log10 P(id | its class, id before)

    def conditional(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 P(target | its class, id before); -1 is the start of a text."""
        out, held = self.pairs.look_up((before + 1) * VOCABULARY + target)
        rest = np.flatnonzero(~held)
        before, target = before[rest], target[rest]
        previous = np.where(before >= 0, self.classes[before], CLASSES)
        out[rest] = self.within[previous, target] + self.share[before, self.classes[target]]
        return out


MASK = np.where(np.arange(2 * STRIDE - 1)[None, :] > STRIDE - 1 + np.arange(STRIDE)[:, None], np.float32(-1e9), np.float32(0))
DISTANCE = np.clip(STRIDE - 1 + np.arange(STRIDE)[:, None] - np.arange(2 * STRIDE - 1)[None, :], 0, 2 * STRIDE - 2)


def start_parameters(rows: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"e": (rows, WIDTH), "wq": (WIDTH, WIDTH), "wk": (WIDTH, WIDTH), "wv": (WIDTH, WIDTH), "r1": (WIDTH, WIDTH), "r2": (WIDTH, WIDTH), "wc": (WIDTH, CLASSES)}
    out = {n: (rng.normal(size=s) * (0.3 if n == "e" else 1 / np.sqrt(WIDTH))).astype(np.float32) for n, s in shapes.items()}
    out["wc"] *= np.float32(0.1)
    return out | {"b": np.zeros(WIDTH, np.float32), "rb": np.zeros(2 * STRIDE - 1, np.float32)}


def projections(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Every input row as query and own part of the hidden layer, as key and value, and as the row before the last.

    Ones beside keys and values sum the attention weights.
    """
    scale = p["e"].dtype.type(1 / np.sqrt(WIDTH))
    last = p["e"] @ np.concatenate([p["wq"] * scale, p["r1"]], 1)
    last[:, WIDTH:] += p["b"]
    seen = np.ones((len(p["e"]), 2 * WIDTH + 1), p["e"].dtype)
    np.matmul(p["e"], np.concatenate([p["wk"], p["wv"]], 1), out=seen[:, :-1])
    earlier = p["e"] @ p["r2"]
    # what no exponent exceeds: by the longest query and key, and by the largest values of each hidden unit
    longest = [np.einsum("rw,rw->r", x, x).max() for x in (last[:, :WIDTH], seen[:, :WIDTH])]
    largest = np.maximum(last[:, WIDTH:].max(0) + seen[:, WIDTH:-1].max(0) + earlier.max(0), 0)
    most = {"most_weight": np.sqrt(longest[0] * longest[1]) + p["rb"].max(), "most_class": (largest @ np.maximum(p["wc"], 0)).max()}
    return {"last": last, "seen": seen, "earlier": earlier} | {n: float(x) * 1.001 for n, x in most.items()}


def exponentials(x: np.ndarray, most: float) -> np.ndarray:
    """exp of ``x``, in its place and cut at ``LARGEST``; nothing in it exceeds ``most`` (logarithms of chances added to it
    are not above 0)."""
    if not most <= LARGEST:
        np.minimum(x, LARGEST, out=x)
    return np.exp(x, out=x)


def hidden_layer(p: dict[str, np.ndarray], context: np.ndarray, tables: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The hidden layer ``z`` at the second half of each window, and what it is made of; ``weights`` and ``mixed`` are
    still to be divided by the sums of the weights, the last column of ``mixed``."""
    last = tables["last"].take(context[:, STRIDE - 1 : -1], 0)
    seen = tables["seen"].take(context[:, :-1], 0)
    weights = last[:, :, :WIDTH] @ seen[:, :, :WIDTH].transpose(0, 2, 1)
    weights += p["rb"][DISTANCE] + MASK
    exponentials(weights, tables["most_weight"])
    mixed = weights @ seen[:, :, WIDTH:]
    z = mixed[:, :, :WIDTH] / mixed[:, :, WIDTH:]
    z += last[:, :, WIDTH:]
    z += tables["earlier"].take(context[:, STRIDE - 2 : -2], 0)
    np.maximum(z, 0, out=z)
    return {"z": z, "weights": weights, "mixed": mixed, "seen": seen, "last": last}


def forward(p: dict[str, np.ndarray], context: np.ndarray, tables: dict[str, np.ndarray], prior: np.ndarray) -> dict[str, np.ndarray]:
    """Class scores for the second half of each window; ``tables`` are the projections of every input row, ``prior`` the
    log probabilities of the classes after each window's last ids."""
    f = hidden_layer(p, context, tables)
    f["classes"] = f["z"].reshape(-1, WIDTH) @ p["wc"]
    f["classes"] += prior
    return f


scoring_tables = projections


def class_scores(p: dict[str, np.ndarray], context: np.ndarray, tables: dict[str, np.ndarray], prior: np.ndarray) -> np.ndarray:
    """The class scores of ``forward``, with products taken window by window: a window's scores then do not depend on its
    place in the batch."""
    scores = (hidden_layer(p, context, tables)["z"] @ p["wc"]).reshape(-1, CLASSES)
    scores += prior
    return scores


def gradients(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, weight: np.ndarray, prior: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss and its gradient for windows ``context`` whose second halves have classes ``target``."""
    rows, context = in_batch(context, len(p["e"]))
    chance, g = batch_gradients(p | {"e": p["e"][rows]}, context, target, weight, prior)
    w = weight.reshape(-1) / max(weight.sum(), 1.0)
    of_e = np.zeros_like(p["e"])
    of_e[rows] = g["e"]
    return float(-(np.log(np.maximum(chance, 1e-12)) * w).sum()), {n: g[n] for n in p} | {"e": of_e}


def batch_gradients(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, weight: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The chances of the targets and the gradient of the mean loss.

    Neither weights of attention nor chances of classes are divided by their sums as wholes: the sums meet what is narrower
    or multiplied anyway.
    """
    tables = projections(p)
    f = forward(p, context, tables, prior)
    kind = f["z"].dtype.type
    seen, last, weights, mixed = f["seen"], f["last"], f["weights"], f["mixed"]
    flat, w = target.reshape(-1), (weight.reshape(-1) / max(weight.sum(), 1.0)).astype(kind)
    at = np.arange(len(flat))
    d = exponentials(f["classes"], tables["most_class"])
    sums = d @ np.ones(CLASSES, kind)
    chance = d[at, flat] / sums
    d *= (w / sums)[:, None]
    d[at, flat] -= w
    z = f["z"].reshape(-1, WIDTH)
    g = {"wc": (d.T @ z).T}
    hidden = d @ p["wc"].T
    hidden *= z > 0
    out = hidden.reshape(f["z"].shape)
    # beside what reaches a window's mean: what the division by the sum of its weights takes off
    reached = np.empty((*out.shape[:2], WIDTH + 1), kind)
    np.divide(out, mixed[:, :, WIDTH:], out=reached[:, :, :WIDTH])
    reached[:, :, WIDTH] = -np.einsum("bqw,bqw->bq", reached[:, :, :WIDTH], mixed[:, :, :WIDTH]) / mixed[:, :, WIDTH]
    d_scores = reached @ seen[:, :, WIDTH:].transpose(0, 2, 1)
    d_scores *= weights
    g["rb"] = np.bincount(DISTANCE.reshape(-1), weights=d_scores.sum(0).reshape(-1), minlength=len(p["rb"])).astype(kind)
    # beside each other: what reaches queries and the hidden layer, and what reaches keys and values
    above = np.empty((*out.shape[:2], 2 * WIDTH), kind)
    np.matmul(d_scores, seen[:, :, :WIDTH], out=above[:, :, :WIDTH])
    above[:, :, WIDTH:] = out
    below = np.empty((*seen.shape[:2], 2 * WIDTH), kind)
    np.matmul(d_scores.transpose(0, 2, 1), last[:, :, :WIDTH], out=below[:, :, :WIDTH])
    np.matmul(weights.transpose(0, 2, 1), reached[:, :, :WIDTH], out=below[:, :, WIDTH:])
    above, below = above.reshape(-1, 2 * WIDTH), below.reshape(-1, 2 * WIDTH)
    e = p["e"].take(context[:, :-1], 0)
    e_seen, e_last, e_earlier = (x.reshape(-1, WIDTH) for x in (e, e[:, STRIDE - 1 :], e[:, STRIDE - 2 : -1]))
    scale = kind(1 / np.sqrt(WIDTH))
    from_last, from_seen = e_last.T @ above, (below.T @ e_seen).T
    g["wq"], g["r1"], g["wk"], g["wv"] = from_last[:, :WIDTH] * scale, from_last[:, WIDTH:], from_seen[:, :WIDTH], from_seen[:, WIDTH:]
    g["r2"], g["b"] = e_earlier.T @ hidden, np.ones(len(hidden), kind) @ hidden
    # the last ids and those before them are among the ids seen: one sum by input row
    d_e = (below @ np.concatenate([p["wk"], p["wv"]], 1).T).reshape(e.shape)
    d_e[:, STRIDE - 1 :] += (above @ np.concatenate([p["wq"] * scale, p["r1"]], 1).T).reshape(out.shape)
    d_e[:, STRIDE - 2 : -1] += (hidden @ p["r2"].T).reshape(out.shape)
    cells = np.arange(p["e"].size).reshape(p["e"].shape).take(context[:, :-1], 0)
    g["e"] = np.bincount(cells.reshape(-1), d_e.reshape(-1), p["e"].size).astype(kind).reshape(p["e"].shape)
    return chance, g


def classes_of(tally: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Classes of all ids by what stands before and after them: weighted k-means on shares of hashed neighbours.

    Ids that were never seen share the classes evenly, by id.
    """
    out = np.arange(VOCABULARY) % CLASSES
    seen = np.flatnonzero(tally)
    if len(seen) <= CLASSES:
        out[seen] = np.arange(len(seen))
        return out
    points = np.sqrt(beside[seen] / np.maximum(beside[seen].sum(1, keepdims=True), 1))
    weight = np.sqrt(tally[seen].astype(float))
    rng = np.random.default_rng(3)
    centres = points[rng.choice(len(points), CLASSES, replace=False, p=weight / weight.sum())]
    for _ in range(20):
        own = ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)
        n = np.bincount(own, weight, CLASSES)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points * weight[:, None])
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-12)[:, None], centres)
    out[seen] = own
    return out


def encoded(rows: DataFrame, name: str, apart) -> DataFrame:
    """KEY, HELD, ROW and the ids of every text, in blocks of ``STRIDE`` ids as 16-bit numbers (0 is no id), stored once.

    With them the number of words and the sums over the words of the broadcast ``apart``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        words, often = apart.value
        logs = np.log10(often + 0.1)
        for batch in batches:
            for a, b, texts in slices(batch_column(batch, "text"), rows=30_000):
                found = texts.lower().words(NOT_SPACE)
                hashes = found.hashes() if len(found) else np.zeros(0, np.uint64)
                blocks, _, owner = streams(texts, name, found, hashes)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1)) * STRIDE
                raw = packed((blocks.reshape(-1) + 1).astype("<u2"), cuts)
                document = found.documents()
                at, here = common.places(words, hashes)
                at, apart_of = at[here], document[here]
                sums = [np.bincount(document, minlength=b - a), np.bincount(apart_of, minlength=b - a), np.bincount(apart_of[often[at] > 0], minlength=b - a), np.bincount(apart_of, logs[at], b - a).astype(np.float64)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch_column(batch, c).slice(a, b - a) for c in (KEY, HELD, ROW)], *map(pa.array, sums), pa.array(raw, pa.binary())], [KEY, HELD, ROW, "n_words", "n_apart", "known_apart", "logs_apart", "ids"]
                )

    kind = rows.schema[KEY].dataType.simpleString()
    spec = f"{KEY} {kind}, {HELD} boolean, {ROW} long, n_words long, n_apart long, known_apart long, logs_apart double, ids binary"
    return durable(rows.select(KEY, HELD, ROW, "text").mapInArrow(tidy(write), spec), "ids")


def decoded(column: pa.Array, limit: int = IDS_AT_ONCE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, blocks, document of each block) of runs of rows with about ``limit`` ids, -1 is no id."""
    sizes = np.array(pc.binary_length(column), np.int64) // (2 * STRIDE)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        start = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, start + limit // STRIDE, "right")))
        raw = b"".join(column.slice(first, last - first).to_pylist())
        yield first, last, np.frombuffer(raw, "<u2").astype(np.int64).reshape(-1, STRIDE) - 1, np.repeat(np.arange(last - first), sizes[first:last])
        first = last


def neighbours_of(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id with the one before it, -1 for the first of a text."""
    flat = blocks.reshape(-1)
    at = np.flatnonzero(flat >= 0)
    return flat[at - 1], flat[at]


def _summed(ids: DataFrame, size: int, cells: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Counts of ``cells`` (numbers below ``size``, a fixed bound) over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, blocks, _ in decoded(batch.column(0)):
                np.add.at(total, cells(blocks), 1)  # the cells of one run are few beside ``size``
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // CELLS_A_ROW).astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(total[at])], ["part", "cell", "n"])

    def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in count(batches):
            part, cell, n = (c.to_numpy() for c in batch.columns)
            cuts = _cuts(part)
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(packed(cell, cuts), pa.binary()), pa.array(packed(n, cuts), pa.binary())], ["part", "cells", "counts"])

    found = ids.select("ids").mapInArrow(tidy(packed_rows), "part int, cells binary, counts binary").groupBy("part").applyInArrow(tidy(_added), "part int, cells binary, counts binary")
    out = np.zeros(size, np.int64)
    for r in found.select("cells", "counts").collect():  # at most ``size`` cells
        out[np.frombuffer(r.cells, np.int64)] = np.frombuffer(r.counts, np.int64)
    return out


def _added(table: pa.Table) -> pa.Table:
    """The counts of one part's cells, added up."""
    cells = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("cells").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
    order = np.argsort(cells, kind="stable")
    cuts = _cuts(cells[order])
    cells, counts = cells[order][cuts[:-1]], np.add.reduceat(counts[order], cuts[:-1])
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _pair_sums(ids: DataFrame, amount: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the pairs (id before, id) that occur more often than the ``most``-th, at most ``most`` of them.

    Pairs are counted in tasks and added up by bucket; a histogram of the sums gives the least count that is kept.
    """
    buckets = buckets_for(amount, PAIR_CODES, LEAST_BUCKETS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        waiting = 0

        def settled() -> None:
            nonlocal codes, counts, waiting
            found, n = np.unique(np.concatenate(fresh), return_counts=True)
            both = np.concatenate([codes, found])
            order = np.argsort(both, kind="stable")
            cuts = _cuts(both[order])
            codes, counts = both[order][cuts[:-1]], np.add.reduceat(np.concatenate([counts, n])[order], cuts[:-1])
            fresh.clear()
            waiting = 0

        def sent() -> pa.RecordBatch:
            nonlocal codes, counts
            bucket = ((mix(codes.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            cuts = _cuts(bucket[order])
            out = pa.RecordBatch.from_arrays(
                [pa.array(bucket[order][cuts[:-1]].astype(np.int32)), pa.array(packed(codes[order], cuts), pa.binary()), pa.array(packed(counts[order], cuts), pa.binary())], ["part", "cells", "counts"]
            )
            codes, counts = codes[:0], counts[:0]
            return out

        for batch in batches:
            for _, _, blocks, _ in decoded(batch.column(0)):
                before, target = neighbours_of(blocks)
                fresh.append((before + 1) * VOCABULARY + target)
                waiting += len(target)
                if waiting > PAIR_CODES // 2:
                    settled()
                    if len(codes) > PAIR_CODES:
                        yield sent()
        if fresh:
            settled()
        if len(codes):
            yield sent()

    spec = "part int, cells binary, counts binary"
    summed = durable(by_bucket(ids.select("ids").mapInArrow(tidy(count), spec), "part", buckets).groupBy("part").applyInArrow(tidy(_added), spec), "pairs")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS_SEEN, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(np.minimum(np.frombuffer(x, np.int64), COUNTS_SEEN - 1), minlength=COUNTS_SEEN)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["count", "n"])

    seen = np.zeros(COUNTS_SEEN, np.int64)
    for r in summed.select("counts").mapInArrow(tidy(histogram), "count long, n long").groupBy("count").agg(F.sum("n").alias("n")).collect():
        seen[r["count"]] = r.n
    above = np.cumsum(seen[::-1])[::-1]
    least = int(np.argmax(above <= most)) if (above <= most).any() else COUNTS_SEEN

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.frombuffer(counts, np.int64)
                kept = n >= max(least, 2)
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(cells, np.int64)[kept].tobytes()], pa.binary()), pa.array([n[kept].tobytes()], pa.binary())], ["cells", "counts"])

    rows = summed.select("cells", "counts").mapInArrow(tidy(frequent), "cells binary, counts binary").collect()  # at most ``most`` pairs
    codes = np.concatenate([np.frombuffer(r.cells, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    order = np.argsort(codes)
    return codes[order], np.concatenate([np.frombuffer(r.counts, np.int64) for r in rows] or [np.zeros(0, np.int64)])[order]


def within_class(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 P(id | its class, class before), shrunk towards P(id | its class), itself shrunk towards equal shares."""
    total = counts.sum(0)
    in_class = np.bincount(classes, weights=total, minlength=CLASSES)
    members = np.bincount(classes, minlength=CLASSES)
    plain = (total + LEAST) / (in_class + LEAST * members)[classes]
    out = np.empty(counts.shape, np.float32)
    for c in range(len(counts)):
        of = np.bincount(classes, weights=counts[c], minlength=CLASSES)
        out[c] = np.log10((counts[c] + PRIOR * plain) / (of + PRIOR)[classes])
    return out


def class_prior(after: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log P(class | id before) from counts of (id before, class), shrunk towards P(class | class before), and that to P(class)."""
    plain = (after.sum(0) + 1.0) / (after.sum() + CLASSES)
    previous = np.append(classes, CLASSES)
    by_class = np.zeros((CLASSES + 1, CLASSES))
    np.add.at(by_class, previous, after)
    middle = (by_class + CLASS_PRIOR * plain) / (by_class.sum(1, keepdims=True) + CLASS_PRIOR)
    return np.log((after + CLASS_PRIOR * middle[previous]) / (after.sum(1, keepdims=True) + CLASS_PRIOR)).astype(np.float32)


def pair_table(codes: np.ndarray, counts: np.ndarray, within: np.ndarray, classes: np.ndarray) -> tuple[PairTable, np.ndarray]:
    """log10 P(id | its class, id before) of the kept pairs, and what the other ids of each class keep after each id."""
    before, target = codes // VOCABULARY - 1, codes % VOCABULARY
    own, previous = classes[target], np.where(before >= 0, classes[before], CLASSES)
    total = np.bincount(np.where(before >= 0, before, VOCABULARY) * CLASSES + own, counts, (VOCABULARY + 1) * CLASSES) + PRIOR
    values = np.log10((counts + PRIOR * 10.0 ** within[previous, target].astype(np.float64)) / total[np.where(before >= 0, before, VOCABULARY) * CLASSES + own])
    return PairTable(codes, values.astype(np.float32)), np.log10(PRIOR / total).astype(np.float32).reshape(VOCABULARY + 1, CLASSES)


def score_blocks(model: Model, blocks: np.ndarray, owner: np.ndarray, texts: int, tables: dict[str, np.ndarray], batch: int = 256) -> np.ndarray:
    """log10 probability of every text from its blocks; the first block of a text holds no ids."""
    out = np.zeros(texts)
    at = np.flatnonzero(np.append(False, owner[1:] == owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    rows, of_class, ones = model.compact.take(blocks), model.classes.take(blocks), np.ones(CLASSES, np.float32)
    for i in range(0, len(at), batch):
        chosen = at[i : i + batch]
        target = blocks.take(chosen, 0)
        before = np.concatenate([blocks[chosen - 1, -1:], target[:, :-1]], 1).reshape(-1)
        scores = class_scores(model.parameters, np.concatenate([rows.take(chosen - 1, 0), rows.take(chosen, 0)], 1), tables, model.prior.take(before, 0))
        chance = scores.take(np.arange(0, scores.size, CLASSES) + of_class.take(chosen, 0).reshape(-1))
        chance = np.minimum(chance, LARGEST)
        exponentials(scores, tables["most_class"])
        chance -= np.log(scores.reshape(-1, STRIDE, CLASSES) @ ones).reshape(-1)
        chance *= np.float32(0.4342944819)
        chance += model.conditional(before, target.reshape(-1))
        value = np.where(target >= 0, chance.reshape(target.shape), 0).sum(1, dtype=np.float64)
        np.add.at(out, owner[chosen], value)  # in order, wherever a batch ends
    return out


def _cuts(codes: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes)) if len(codes) else np.zeros(1, np.int64)


def _group(rows: np.ndarray, groups: int) -> np.ndarray:
    return (mix(rows.view(np.uint64)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)


def _word_values(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    words = texts.lower().words(NOT_SPACE)
    return words.hashes() if len(words) else np.zeros(0, np.uint64), words.documents()


def _common_words(rows: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of very many documents, sorted, and how often each stands in all training documents."""
    words = common.candidates(rows, "text", ROW, count, _word_values)
    if not len(words):
        return words, np.zeros(0, np.int64)
    known = rows.sparkSession.sparkContext.broadcast(words)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for batch in batches:
            for _, _, texts in slices(batch_column(batch, "text"), rows=30_000):
                at, found = common.places(known.value, _word_values(texts)[0])
                total += np.bincount(at[found], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["word", "n"])

    counts = rows.filter(~F.col(HELD)).select("text").mapInArrow(tidy(tally), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words), np.int64)
    out[counts.column("word").to_numpy()] = counts.column("n").to_numpy()
    return words, out


def _entries(rows: DataFrame, buckets: int, apart) -> DataFrame:
    """Blocks of (word hash, document, times) by bucket of the hash, without the words of the broadcast ``apart``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for batch in batches:
            keys, held = batch_column(batch, ROW).to_numpy(), np.array(batch_column(batch, HELD).to_pylist(), bool)
            for first, last, texts in slices(batch_column(batch, "text"), rows=30_000):
                hashes, owner = _word_values(texts)
                left = ~common.places(apart.value[0], hashes)[1]
                hashes, owner = hashes[left], owner[left]
                if not len(hashes):
                    continue
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], owner[order]
                once = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
                times = np.minimum(np.diff(np.append(once, len(hashes))), (1 << 32) - 1)
                hashes, owner = hashes[once], owner[once]
                bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = _cuts(bucket)
                listed = [np.unique(owner[a:b], return_inverse=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                large = times >= 255
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cuts[:-1]].astype(np.int64)), pa.array(packed(hashes, cuts), pa.binary()), pa.array([c.astype("<u2").tobytes() for _, c in listed], pa.binary()),
                        pa.array(packed(np.minimum(times, 255).astype(np.uint8), cuts), pa.binary()), pa.array([times[a:b][large[a:b]].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                        pa.array([keys[first:last][u].astype("<i8").tobytes() for u, _ in listed], pa.binary()), pa.array([held[first:last][u].tobytes() for u, _ in listed], pa.binary()),
                    ],
                    ["bucket", "hashes", "documents", "times", "large", "rows", "held"],
                )

    spec = "bucket long, hashes binary, documents binary, times binary, large binary, rows binary, held binary"
    return rows.select(ROW, HELD, "text").mapInArrow(tidy(emit), spec)


SUMS = "_group long, rows binary, logs binary, known binary, counted binary, trained long, distinct long"


def _word_sums(entries: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Each bucket counts its words in training documents and returns, by document, sums over its words there."""

    def count(table: pa.Table) -> pa.Table:
        hashes, rows, times, held = [], [], [], []
        for h, d, t, big, r, out in zip(*[table.column(n).to_pylist() for n in ("hashes", "documents", "times", "large", "rows", "held")], strict=True):
            number = np.frombuffer(d, "<u2")
            n = np.frombuffer(t, np.uint8).astype(np.int64)
            n[n == 255] = np.frombuffer(big, "<u4") if big else 255
            hashes.append(np.frombuffer(h, "<u8"))
            rows.append(np.frombuffer(r, "<i8")[number])
            times.append(n)
            held.append(np.frombuffer(out, bool)[number])
        word, row, n, out = map(np.concatenate, (hashes, rows, times, held))
        del hashes, rows, times, held
        order = np.argsort(word, kind="stable")
        word, row, n, out = word[order], row[order], n[order], out[order]
        cuts = _cuts(word)
        count = np.add.reduceat(np.where(out, 0, n), cuts[:-1])
        each = np.repeat(count, np.diff(cuts))
        order = np.lexsort((row, _group(row, groups)))
        row, n, each = row[order], n[order], each[order]
        ends = _cuts(row)[:-1]
        logs, known, counted = np.add.reduceat(n * np.log10(each + 0.1), ends), np.add.reduceat(n * (each > 0), ends), np.add.reduceat(n, ends)
        row = row[ends]
        group = _group(row, groups)
        cuts = _cuts(group)
        blocks = len(cuts) - 1
        return pa.table(
            {
                "_group": pa.array(group[cuts[:-1]].astype(np.int64)), "rows": pa.array(packed(row, cuts), pa.binary()), "logs": pa.array(packed(logs.astype("<f8"), cuts), pa.binary()),
                "known": pa.array(packed(known.astype("<u4"), cuts), pa.binary()), "counted": pa.array(packed(counted.astype("<u4"), cuts), pa.binary()),
                "trained": pa.array([int(count.sum())] + [0] * (blocks - 1), pa.int64()), "distinct": pa.array([int((count > 0).sum())] + [0] * (blocks - 1), pa.int64()),
            }
        )

    return by_bucket(entries, "bucket", buckets).groupBy("bucket").applyInArrow(tidy(count), SUMS)


def _document_sums(sums: DataFrame, groups: int) -> DataFrame:
    """(row key, sum of logs, known, words) of every document with words."""

    def add(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("rows").to_pylist()])
        found, which = np.unique(rows, return_inverse=True)
        total = lambda name, kind: np.bincount(which, weights=np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]).astype(np.float64), minlength=len(found))
        return pa.table({ROW: pa.array(found), "logs": pa.array(total("logs", "<f8")), "known": pa.array(total("known", "<u4")), "counted": pa.array(total("counted", "<u4"))})

    return by_bucket(sums, "_group", groups).groupBy("_group").applyInArrow(tidy(add), f"{ROW} long, logs double, known double, counted double")


class Steps:
    """Weights that take a step (Adam) for every batch of windows; all of them lie in one vector.

    Moments are kept without their factors 0.1 and 0.01, which go into the rate.
    """

    def __init__(self, start: dict[str, np.ndarray]):
        self.vector = np.concatenate([x.ravel() for x in start.values()]).astype(np.float32)
        self.p = views(self.vector, start)
        self.m, self.v, self.g, self.hold = (np.zeros_like(self.vector) for _ in range(4))
        self.found = views(self.g, start)
        self.steps = self.windows = 0

    def take(self, model: Model, windows: np.ndarray, rate: float) -> None:
        """One step over the windows (rows of 2 * STRIDE ids)."""
        target = windows[:, STRIDE:]
        before = windows[:, STRIDE - 1 : -1].reshape(-1)
        rows, context = in_batch(model.compact.take(windows), len(self.p["e"]))
        _, found = batch_gradients(self.p | {"e": self.p["e"].take(rows, 0)}, context, model.classes.take(target), target >= 0, model.prior.take(before, 0))
        for n, x in self.found.items():
            x[rows if n == "e" else ...] = found[n]
        g, hold = self.g, self.hold
        self.steps += 1
        self.windows += len(windows)
        self.m *= np.float32(0.9)
        self.m += g
        self.v *= np.float32(0.99)
        self.v += np.multiply(g, g, out=hold)
        self.found["e"][rows] = 0
        unit = np.sqrt(0.01 / (1 - 0.99**self.steps))
        np.sqrt(self.v, out=hold)
        hold += np.float32(1e-8 / unit)
        np.divide(self.m, hold, out=hold)
        hold *= np.float32(0.1 * rate / (1 - 0.9**self.steps) / unit)
        self.vector -= hold


def views(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parts of ``vector`` in the shapes of ``like``."""
    cuts = np.cumsum([0, *[x.size for x in like.values()]])
    return {n: vector[a:b].reshape(x.shape) for (n, x), a, b in zip(like.items(), cuts[:-1], cuts[1:], strict=True)}


def in_turn(count: int, turn: int, turns: int, times: int) -> np.ndarray:
    """Which of ``count`` windows take part in a turn: ``times`` * 2**turn of every 2**turns - 1, all of them at most.

    Every window takes part in one turn at least, whatever ``times``; early turns are short, as their mean is of little use.
    """
    cycle = (1 << turns) - 1
    return np.flatnonzero((np.arange(count) - ((1 << turn) - 1)) % cycle < min(cycle, times << turn))


def train(ids: DataFrame, model: Model, windows: int, turns: int = TURNS) -> dict[str, np.ndarray]:
    """Weights of the attention layer from all windows of ``ids``, each at least once; of ``FEW_WINDOWS`` or fewer in every turn."""
    p = model.parameters
    if not windows:
        return p
    cycle = (1 << turns) - 1
    times = min(cycle, max(1, -(-cycle * FEW_WINDOWS // windows)))
    context = ids.sparkSession.sparkContext
    tables = context.broadcast((model.compact, model.classes, model.prior))
    in_task = windows / max(1, ids.rdd.getNumPartitions()) / cycle

    for turn in range(turns):
        shared = context.broadcast(p)
        expected = in_task * min(cycle, times << turn)

        def improve(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared, expected: float = expected) -> Iterator[pa.RecordBatch]:
            keep_freed()
            compact, classes, prior = tables.value
            known = Model(compact, classes, shared.value, prior, None, None, None)
            steps, draw = Steps(shared.value), np.random.default_rng(11 + turn)
            for batch in batches:
                for _, _, blocks, owner in decoded(batch.column(0)):
                    at = np.flatnonzero(np.append(False, owner[1:] == owner[:-1]))
                    at = draw.permutation(at[in_turn(len(at), turn, turns, times)])
                    for part in np.array_split(at, -(-len(at) // BATCH)) if len(at) else []:
                        done = (turn + min(1.0, steps.windows / expected)) / turns
                        steps.take(known, np.concatenate([blocks[part - 1], blocks[part]], 1), RATE * min(1.0, max(2 * (1 - done), LEAST_RATE)))
            if steps.windows:
                cuts = np.arange(0, len(steps.vector), PIECE)
                weights = steps.vector.astype(np.float64) * steps.windows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array([steps.windows] * len(cuts), pa.int64()), pa.array([weights[a : a + PIECE] for a in cuts], pa.list_(pa.float64()))], ["piece", "n", "weights"]
                )

        pieces = ids.select("ids").mapInArrow(tidy(improve), "piece int, n long, weights array<double>")
        means = pieces.groupBy("piece").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("weights")).alias("weights")).orderBy("piece").collect()  # one set of weights
        if not means:
            break
        p = views(np.concatenate([r["weights"].toArray() / r["n"] for r in means]).astype(np.float32), p)
    return p


def learn(ids: DataFrame) -> Model:
    """The attention model of the ``encoded`` training documents ``ids``."""
    ids = ids.select("ids")
    def beside(blocks: np.ndarray) -> np.ndarray:
        before, target = neighbours_of(blocks)
        hashed = lambda x: (mix((x + 2).astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % NEIGHBOURS
        inside = before >= 0
        return np.concatenate([target * (2 * NEIGHBOURS) + hashed(before), before[inside] * (2 * NEIGHBOURS) + NEIGHBOURS + hashed(target[inside])])

    near = _summed(ids, VOCABULARY * 2 * NEIGHBOURS, beside).reshape(VOCABULARY, -1)
    tally = near[:, :NEIGHBOURS].sum(1)  # every id has one place before it
    amount = int(tally.sum())
    classes = classes_of(tally, near.astype(np.float32))

    def by_class(blocks: np.ndarray) -> np.ndarray:
        before, target = neighbours_of(blocks)
        previous, place = np.where(before >= 0, classes[before], CLASSES), np.where(before >= 0, before, VOCABULARY)
        return np.concatenate([previous * VOCABULARY + target, (CLASSES + 1) * VOCABULARY + place * CLASSES + classes[target]])

    plain = (CLASSES + 1) * VOCABULARY
    counts = _summed(ids, plain + (VOCABULARY + 1) * CLASSES, by_class)
    within = within_class(counts[:plain].reshape(CLASSES + 1, VOCABULARY), classes)
    prior = class_prior(counts[plain:].reshape(VOCABULARY + 1, CLASSES).astype(np.float64), classes)
    pairs, share = pair_table(*_pair_sums(ids, amount, PAIRS), within, classes)
    order = np.argsort(-tally, kind="stable")[:FREQUENT]
    frequent = order[tally[order] >= LEAST_TALLY]
    compact = np.append(len(frequent) + classes, len(frequent) + CLASSES)  # ids that are not frequent share their class's row
    compact[frequent] = np.arange(len(frequent))
    model = Model(compact, classes, start_parameters(len(frequent) + CLASSES + 1), prior, within, share, pairs)
    model.parameters = train(ids, model, amount // STRIDE)
    return model


def score(df: DataFrame, held_out, key: str = "doc_id", text: str = "text", name: str = TOKENIZER) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; ``held_out`` is a condition on it."""
    spark = df.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias(KEY), F.coalesce(held_out, F.lit(False)).alias(HELD), F.xxhash64(F.col(key), content).alias(ROW), content.alias("text"))
    count, volume = text_volume(rows)
    buckets, groups = buckets_for(volume // WORD_BYTES, ENTRIES, LEAST_BUCKETS), buckets_for(count, DOCUMENT_ROWS, LEAST_BUCKETS)
    apart = spark.sparkContext.broadcast(_common_words(rows, count))
    sums = durable(_word_sums(_entries(rows, buckets, apart), buckets, groups))
    sizes = sums.agg(F.sum("trained").alias("trained"), F.sum("distinct").alias("distinct")).first()
    ends = rows.filter(~F.col(HELD)).count()
    often = apart.value[1]
    n_train, distinct = (sizes.trained or 0) + int(often.sum()) + ends, (sizes.distinct or 0) + int((often > 0).sum()) + (ends > 0)
    ids = encoded(rows, name, apart)
    model = spark.sparkContext.broadcast(learn(ids.filter(~F.col(HELD))))

    carried = [KEY, HELD, ROW, "n_words", "n_apart", "known_apart", "logs_apart"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        m = model.value
        tables = scoring_tables(m.parameters)
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for first, last, blocks, owner in decoded(batch_column(batch, "ids")):
                found[first:last] = score_blocks(m, blocks, owner, last - first, tables)
            yield pa.RecordBatch.from_arrays([*[batch_column(batch, c) for c in carried], pa.array(found)], [*carried, "score"])

    scored = ids.mapInArrow(tidy(apply), T.StructType([*[ids.schema[c] for c in carried], T.StructField("score", T.DoubleType())]))
    joined = scored.join(_document_sums(sums, groups), ROW, "left")
    # rows equal in key and text share their sums, which then hold each of them once
    part = F.coalesce((F.col("n_words") - F.col("n_apart")) / F.col("counted"), F.lit(0.0))
    n_tokens = F.col("n_words") + 1
    logs = F.coalesce(F.col("logs") * part, F.lit(0.0)) + F.col("logs_apart") + F.log10(F.lit(ends + 0.1))
    base = logs - n_tokens * F.log10(F.lit(n_train + 0.1 * (distinct + 1)))
    return joined.select(
        F.col(KEY).alias(key), F.col(HELD).alias("held_out"), n_tokens.alias("n_tokens"), (F.round(F.coalesce(F.col("known") * part, F.lit(0.0))).cast("long") + F.col("known_apart") + int(ends > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
