"""Personal data in whole texts: base patterns, and spans added by a semi-Markov conditional random field.

Base spans (e-mail addresses, IPv4 addresses, payment cards, telephone numbers) come from fixed patterns and are never
taken back. Around every ``@``, every spelled-out "at ... dot" and every run of seven digits or four digit groups, a
region is cut into atoms (runs of digits, letters, blanks; single symbols). The field scores whole candidate spans of at
most ``SPAN_ATOMS`` atoms by features of the span as such: how many digits, groups, dots and at-signs, how it begins and
ends, what touches it, whether its four numbers fit a byte, whether its digits pass the card checksum. Atoms outside spans
are spans of their own without a type. Dynamic programming over span ends then chooses boundaries and types together, with
scores for neighbouring types; segments it finds that touch no base span are added.

The field is fitted in numpy by gradient steps on the likelihood of whole segmentations (forward-backward over segments).
Its labels are the base spans of a sample of at most ``SAMPLE_ROWS`` documents in expectation, with at most
``SAMPLE_REGIONS`` regions of them, and disguised copies of these: other separators, a missing plus, "(at)" and "dot",
and broken copies (a wrong check digit, a part above 255) as examples of what is no personal data. Every text is searched
whole; the patterns take time in proportion to its length. A stretch of more than ``PIECE`` atoms is decoded piece by piece.

Defined cases: a null or empty text has no spans; positions are code points, ends exclusive; base spans of different
kinds may overlap; without base spans in the sample nothing is added; equal texts get equal spans; an empty table gives
no rows; extra columns are kept unless they have the name of the result column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekspan.llm.textbatch import Texts, batch_column, member, slices, tidy, with_columns

# The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_END = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = member("AZ", "az", "09", ".", "_", "%", "+", "-")
IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")

SAMPLE_ROWS = 20_000
SAMPLE_REGIONS = 1_000
REGIONS_A_DOCUMENT = 16
SPAN_ATOMS = 24
PIECE = 16_384
CHUNK = 32_768
STEPS = 80
RATE = 0.1
PENALTY = 1e-4
AROUND_NUMBER, AROUND_MAIL = 8, 72
NUMBER = re.compile(rb"[+(]{0,2}[0-9](?:[ ().\-/\[\]]{0,4}[0-9])+")
MAIL = re.compile(rb"@|[(\[{] ?[aA][tT] ?[)\]}]| [aA][tT] [A-Za-z0-9-]{1,40} ?[(\[{]?[dD][oO][tT]\b")
ATOM = re.compile(rb"[0-9]+|[A-Za-z]+|[\x80-\xff]+|[ \t]+|[^\n]")
DIGITS, LETTER, BLANK, AT, DOT, DASH, PLUS, OPEN, CLOSE, AT_WORD, DOT_WORD, OTHER = range(12)
SYMBOL = {b"@": AT, b".": DOT, b"-": DASH, b"+": PLUS, b"(": OPEN, b"[": OPEN, b"{": OPEN, b")": CLOSE, b"]": CLOSE, b"}": CLOSE}
TYPES = len(KINDS) + 1


def digits_of(raw: bytes) -> bytes:
    return bytes(c for c in raw if 48 <= c <= 57)


def luhn(digits: bytes) -> bool:
    values = [c - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _in_byte(part: bytes) -> bool:
    short = part.lstrip(b"0")
    return len(short) <= 3 and int(short or b"0") <= 255


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, ordered by kind and start."""
    found = []
    data = np.frombuffer(raw, np.uint8)
    ends = [m.span() for m in EMAIL_END.finditer(raw)]
    if ends:
        outside = np.flatnonzero(~LOCAL[data])
        before = np.searchsorted(outside, [a for a, _ in ends])
        done = 0
        for (at, end), k in zip(ends, before, strict=True):
            start = max(int(outside[k - 1]) + 1 if k else 0, done)
            if start < at:
                found.append((0, start, end))
                done = end
    found += [(1, *m.span()) for m in IP.finditer(raw) if all(map(_in_byte, m[0].split(b".")))]
    found += [(2, *m.span()) for m in CARD.finditer(raw) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    found += [(3, *m.span()) for m in PHONE.finditer(raw) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def regions(raw: bytes) -> list[tuple[int, int]]:
    """Stretches of one line that may hold personal data, with some bytes on either side."""
    near = []
    for m in NUMBER.finditer(raw):
        if len(m[0]) >= 7 and (len(digits_of(m[0])) >= 7 or len(re.findall(rb"[0-9]+", m[0])) >= 4):
            near.append((*m.span(), AROUND_NUMBER))
    for m in MAIL.finditer(raw):
        near.append((*m.span(), AROUND_MAIL))
    clipped = []
    for start, end, around in near:
        low, line = max(start - around, 0), raw.find(b"\n", end, end + around)
        clipped.append((max(low, raw.rfind(b"\n", low, start) + 1), line if line >= 0 else min(end + around, len(raw))))
    out: list[tuple[int, int]] = []
    for a, b in sorted(clipped):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Atoms:
    """The atoms of some regions, at most ``PIECE`` of a region in a row."""

    def __init__(self, raw: bytes, stretches: list[tuple[int, int]]):
        self.raw = raw
        starts, ends, kinds, first = [], [], [], [0]
        for a, b in stretches:
            for n, m in enumerate(ATOM.finditer(raw, a, b)):
                if n and n % PIECE == 0:
                    first.append(len(starts))
                text = m[0]
                c = text[0]
                if 48 <= c <= 57:
                    kind = DIGITS
                elif c >= 128 or text.isalpha():
                    kind = {b"at": AT_WORD, b"dot": DOT_WORD}.get(text.lower(), LETTER)
                elif c in b" \t":
                    kind = BLANK
                else:
                    kind = SYMBOL.get(text, OTHER)
                starts.append(m.start())
                ends.append(m.end())
                kinds.append(kind)
            if len(starts) > first[-1]:
                first.append(len(starts))
        self.starts, self.ends, self.kinds = (np.array(x, np.int64) for x in (starts, ends, kinds))
        self.first = np.array(first)
        n = len(starts)
        self.sums = np.zeros((12, n + 1), np.int64)
        for k in range(12):
            np.cumsum(self.kinds == k, out=self.sums[k, 1:])
        sizes = self.ends - self.starts
        self.digits = np.concatenate([[0], np.cumsum(np.where(self.kinds == DIGITS, sizes, 0))])
        self.fours = np.concatenate([[0], np.cumsum((self.kinds == DIGITS) & (sizes == 4))])
        self.sizes = sizes

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last atom of all spans that could be of a type: bounded, and numbers of four digits or more, or one
        at-sign or "at" after a name without blanks and before something that ends with a dot or "dot" and letters; an
        "at" that stands free needs a "dot"."""
        kinds = np.concatenate([[BLANK, BLANK, BLANK], self.kinds])  # kinds[x + 3 - n] is n atoms before x
        at_mark = np.isin(self.kinds, (AT, AT_WORD))
        marks, before = np.append(np.flatnonzero(at_mark), len(self.kinds)), np.concatenate([[0], np.cumsum(at_mark)])
        free_word = np.concatenate([[0], np.cumsum((self.kinds == AT_WORD) & (kinds[2:-1] != OPEN) & (kinds[1:-2] != OPEN))])
        here = np.arange(len(self.kinds))
        one, two = kinds[here + 2], kinds[here + 1]
        site_end = (self.kinds == LETTER) & ((one == DOT) | (np.isin(one, (BLANK, CLOSE)) & ((two == DOT_WORD) | ((two == BLANK) & (kinds[here] == DOT_WORD)))))
        site_end |= (self.kinds == LETTER) & (one == CLOSE) & (two == DOT)
        region = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        n = len(self.starts)
        first, last = [], []
        for length in range(1, SPAN_ATOMS + 1):
            i = np.arange(n - length + 1)
            j = i + length - 1
            count = lambda k, i=i, j=j: self.sums[k, j + 1] - self.sums[k, i]
            ok = (region[i] == region[j]) & np.isin(self.kinds[i], (DIGITS, LETTER, PLUS, OPEN))
            digits = self.digits[j + 1] - self.digits[i]
            number = (digits >= 4) & (count(LETTER) + count(AT_WORD) + count(DOT_WORD) + count(AT) + count(OTHER) == 0) & (self.kinds[j] == DIGITS)
            mark = marks[before[i]]
            blanks = self.sums[BLANK, np.minimum(mark, j + 1)] - self.sums[BLANK, i]
            near = (blanks == 0) | ((blanks == 1) & ((kinds[mark + 2] == BLANK) | ((kinds[mark + 2] == OPEN) & (kinds[mark + 1] == BLANK))))
            mail = (before[j + 1] - before[i] == 1) & (mark > i) & near & site_end[j] & np.isin(self.kinds[i], (DIGITS, LETTER))
            mail &= (free_word[j + 1] == free_word[i]) | (count(DOT_WORD) > 0)
            ok &= number | mail
            first.append(i[ok])
            last.append(j[ok])
        i, j = np.concatenate(first), np.concatenate(last)
        order = np.lexsort((i, j))
        return i[order], j[order]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """One row of 0/1 features for each span from atom i to atom j."""
        count = lambda k: self.sums[k, j + 1] - self.sums[k, i]
        digits, groups = self.digits[j + 1] - self.digits[i], count(DIGITS)
        kinds = np.concatenate([self.kinds, [BLANK]])
        region = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        left = np.where((i > 0) & (region[i - 1] == region[i]), kinds[i - 1], BLANK)
        after = np.minimum(j + 1, len(region) - 1)
        right = np.where((j + 1 < len(region)) & (region[after] == region[j]), kinds[j + 1], BLANK)
        beyond = np.minimum(j + 2, len(region) - 1)
        follows = np.where((j + 2 < len(region)) & (region[beyond] == region[j]), kinds[beyond], BLANK)
        word = (LETTER, DIGITS, AT_WORD, DOT_WORD)
        last_size = np.where(self.kinds[j] == DIGITS, self.sizes[j], 0)
        quad, quad_bad, checked, unchecked = (np.zeros(len(i), bool) for _ in range(4))
        plain = (count(LETTER) + count(AT_WORD) + count(DOT_WORD) + count(AT)) == 0
        for x in np.flatnonzero(plain & (groups == 4) & (count(DOT) == 3)):
            parts = re.findall(rb"[0-9]+", self.raw[self.starts[i[x]] : self.ends[j[x]]])
            quad[x] = all(map(_in_byte, parts))
            quad_bad[x] = not quad[x]
        for x in np.flatnonzero(plain & (digits >= 13) & (digits <= 19)):
            checked[x] = luhn(digits_of(self.raw[self.starts[i[x]] : self.ends[j[x]]]))
            unchecked[x] = not checked[x]
        between = lambda x, edges: [(x >= a) & (x < b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        huge = 1 << 60
        dots, opens, closes, ats = count(DOT), count(OPEN), count(CLOSE), count(AT)
        columns = [
            np.ones(len(i), bool), *between(digits, (0, 1, 4, 7, 9, 13, 16, 17, 20, huge)), *between(groups, (0, 1, 2, 3, 4, 5, huge)), *between(dots, (0, 1, 2, 3, 4, huge)),
            ats == 1, count(AT_WORD) == 1, (ats + count(AT_WORD)) > 1, count(DOT_WORD) > 0, count(LETTER) > 0, count(BLANK) > 0, count(BLANK) > 3, count(DASH) > 0,
            opens > 0, opens != closes, (count(PLUS) > 0) & (self.kinds[i] != PLUS), count(OTHER) > 0, quad, quad_bad, checked, unchecked,
            self.kinds[i] == PLUS, self.kinds[i] == OPEN, self.kinds[i] == DIGITS, self.kinds[i] == LETTER, self.kinds[j] == DIGITS, np.isin(self.kinds[j], (LETTER, AT_WORD, DOT_WORD)),
            (last_size == 4) & plain, (last_size < 4) & plain, (self.fours[j + 1] - self.fours[i] == groups) & (groups > 1),
            np.isin(left, word), np.isin(right, word), np.isin(left, (DOT, DASH, PLUS, AT, OPEN)), np.isin(right, (DOT, DASH, AT)) & np.isin(follows, word),
            (right == BLANK) & (follows == DIGITS) & plain, (left == BLANK) & (np.where(i > 1, kinds[i - 2], BLANK) == DIGITS) & plain, (self.kinds[j] == LETTER) & (self.sizes[j] >= 2),
            np.isin(right, (AT, DOT, AT_WORD, DOT_WORD)), np.isin(right, (BLANK, OPEN)) & np.isin(follows, (AT, DOT, AT_WORD, DOT_WORD, OPEN)), (left == BLANK) & (np.where(i > 1, kinds[i - 2], BLANK) == LETTER) & (count(BLANK) > 0),
        ]
        return np.stack(columns, 1).astype(np.float32)


@dataclass
class Field:
    weights: np.ndarray  # types x features
    moves: np.ndarray  # scores of neighbouring labels; 0 is no type

    def scores(self, atoms: Atoms, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), len(KINDS)), np.float32)
        for a in range(0, len(i), CHUNK):
            out[a : a + CHUNK] = atoms.features(i[a : a + CHUNK], j[a : a + CHUNK]) @ self.weights.T.astype(np.float32)
        return out


class Lattice:
    """Segments of all regions, dealt by the place of their last atom within the region, so that regions step together."""

    def __init__(self, first: np.ndarray, i: np.ndarray, j: np.ndarray):
        self.first = first
        self.lengths = np.diff(first)
        region = np.searchsorted(first, j, "right") - 1
        place = j - first[region]
        self.order = np.lexsort((i, place))
        self.cuts = np.searchsorted(place[self.order], np.arange(int(self.lengths.max(initial=0)) + 1))
        self.node = i + region, j + 1 + region  # places between atoms: one more than atoms in each region
        self.starts = first[:-1] + np.arange(len(first) - 1)
        self.by_length = np.argsort(-self.lengths, kind="stable")
        self.longest = len(self.cuts) - 1

    def at(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Regions that have an atom t, by their first place; the candidate segments that end there."""
        n = int(np.searchsorted(-self.lengths[self.by_length], -t, "left"))
        return self.starts[self.by_length[:n]] + t, self.order[self.cuts[t] : self.cuts[t + 1]]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _log_add_at(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """out[at] = log(exp(out[at]) + sum of exp(values) per place)."""
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    at, values = at[order], values[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    places = at[first]
    top = np.maximum(out[places], np.maximum.reduceat(values, first, 0))
    safe = np.where(np.isfinite(top), top, 0)
    rest = np.add.reduceat(np.exp(values - np.repeat(safe, np.diff(np.append(first, len(at))), 0)), first, 0)
    out[places] = np.log(np.exp(out[places] - safe) + rest) + safe


def segment_sums(lattice: Lattice, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward sums at the places between atoms, by label of the segment that ends (starts) there, and each region's total."""
    places = int(lattice.first[-1]) + len(lattice.lengths)
    ahead, behind = np.full((places, TYPES), -np.inf), np.full((places, TYPES), -np.inf)
    ahead[lattice.starts, 0] = 0.0
    into, out_of = lattice.node
    with np.errstate(divide="ignore", invalid="ignore"):
        for t in range(lattice.longest):
            free, segments = lattice.at(t)
            ahead[free + 1, 0] = _log_sum(ahead[free] + moves[:, 0], 1)
            before = _log_sum(ahead[into[segments]][:, :, None] + moves[None, :, 1:], 1)
            wide = np.full((len(segments), TYPES), -np.inf)
            wide[:, 1:] = before + scores[segments]
            _log_add_at(ahead, out_of[segments], wide)
        ends = lattice.starts + lattice.lengths
        behind[ends] = 0.0
        for t in range(lattice.longest - 1, -1, -1):
            free, segments = lattice.at(t)
            _log_add_at(behind, free, moves[None, :, 0] + behind[free + 1, 0][:, None])
            after = scores[segments] + behind[out_of[segments]][:, 1:]
            _log_add_at(behind, into[segments], _log_sum(moves[None, :, 1:] + after[:, None, :], 2))
        total = _log_sum(ahead[ends], 1)
    return ahead, behind, total


def best_segments(lattice: Lattice, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments on the best path of every region, and their types from 0 on; ties go to no segment, then to earlier ones."""
    places = int(lattice.first[-1]) + len(lattice.lengths)
    best = np.full((places, TYPES), -np.inf)
    best[lattice.starts, 0] = 0.0
    before = np.zeros((places, TYPES), np.int8)
    segment = np.full((places, TYPES), -1, np.int64)
    into, out_of = lattice.node
    for t in range(lattice.longest):
        free, segments = lattice.at(t)
        ways = best[free] + moves[:, 0]
        before[free + 1, 0] = ways.argmax(1)
        best[free + 1, 0] = ways.max(1)
        if not len(segments):
            continue
        ways = best[into[segments]][:, :, None] + moves[None, :, 1:]
        values = ways.max(1) + scores[segments]
        for y in range(1, TYPES):
            order = np.lexsort((into[segments], -values[:, y - 1], out_of[segments]))
            at = out_of[segments][order]
            chosen = order[np.append(True, at[1:] != at[:-1])]
            place = out_of[segments][chosen]
            best[place, y], before[place, y], segment[place, y] = values[chosen, y - 1], ways[chosen, :, y - 1].argmax(1), segments[chosen]
    found, kinds = [], []
    for start, end in zip(lattice.starts, lattice.starts + lattice.lengths, strict=True):
        label = int(best[end].argmax())
        while end > start:
            x, earlier = int(segment[end, label]), int(before[end, label])
            if label:
                found.append(x)
                kinds.append(label - 1)
                end = into[x]
            else:
                end -= 1
            label = earlier
    return np.array(found[::-1], np.int64), np.array(kinds[::-1], np.int64)


def fit(examples: list[tuple[bytes, list[tuple[int, int, int]]]], steps: int = STEPS) -> Field | None:
    """Maximum likelihood of segmentations; an example is the text of a region and its spans (kind, start, end)."""
    raw = b"\n".join(x for x, _ in examples)
    stretches, wanted, offset = [], {}, 0
    for text, spans in examples:
        stretches.append((offset, offset + len(text)))
        wanted |= {(offset + a, offset + b): k for k, a, b in spans}
        offset += len(text) + 1
    atoms = Atoms(raw, [s for s in stretches if s[0] < s[1]])
    i, j = atoms.candidates()
    gold = np.array([wanted.get(x, -1) for x in zip(atoms.starts[i].tolist(), atoms.ends[j].tolist(), strict=True)])
    if not (gold >= 0).any():
        return None
    lattice = Lattice(atoms.first, i, j)
    x = np.concatenate([atoms.features(i[a : a + CHUNK], j[a : a + CHUNK]) for a in range(0, len(i), CHUNK)])
    region = np.searchsorted(atoms.first, j, "right") - 1
    into, out_of = lattice.node
    seen_moves = _gold_moves(lattice, gold)
    chosen = np.zeros((len(i), len(KINDS)))
    chosen[np.flatnonzero(gold >= 0), gold[gold >= 0]] = 1
    free = np.setdiff1d(np.arange(int(atoms.first[-1]) + len(lattice.lengths)), lattice.starts + lattice.lengths)
    free_region = np.searchsorted(lattice.starts, free, "right") - 1
    theta = np.zeros(len(KINDS) * x.shape[1] + TYPES * TYPES)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, moves = theta[: -TYPES * TYPES].reshape(len(KINDS), -1), theta[-TYPES * TYPES :].reshape(TYPES, TYPES)
        scores = x @ weights.T
        ahead, behind, total = segment_sums(lattice, scores, moves)
        joint = np.exp(ahead[into][:, :, None] + moves[None, :, 1:] + (scores + behind[out_of][:, 1:])[:, None, :] - total[region][:, None, None])
        expected = np.zeros((TYPES, TYPES))
        expected[:, 1:] = joint.sum(0)
        expected[:, 0] = np.exp(ahead[free] + moves[None, :, 0] + behind[free + 1, 0][:, None] - total[free_region][:, None]).sum(0)
        gradient = np.concatenate([((chosen - joint.sum(1)).T @ x).ravel(), (seen_moves - expected).ravel()]) / len(lattice.lengths) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[: -TYPES * TYPES].reshape(len(KINDS), -1), theta[-TYPES * TYPES :].reshape(TYPES, TYPES))


def _gold_moves(lattice: Lattice, gold: np.ndarray) -> np.ndarray:
    """How often one label follows another on the given paths."""
    out = np.zeros((TYPES, TYPES))
    into, out_of = lattice.node
    ends = {int(into[s]): (int(out_of[s]), int(gold[s]) + 1) for s in np.flatnonzero(gold >= 0)}
    for start, end in zip(lattice.starts, lattice.starts + lattice.lengths, strict=True):
        place, label = int(start), 0
        while place < end:
            place, following = ends.get(place, (place + 1, 0))
            out[label, following] += 1
            label = following
    return out


def disguises(text: bytes, span: tuple[int, int, int]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Copies of a region whose only span is written otherwise, and copies in which it no longer is personal data."""
    kind, a, b = span
    body = text[a:b]
    digits, groups = digits_of(body), re.findall(rb"[0-9]+", body)
    fours = lambda d, sep: sep.join(d[x : x + 4] for x in range(0, len(d), 4))
    if kind == 0:
        local, _, domain = body.partition(b"@")
        same = [local + b" at " + domain.replace(b".", b" dot "), local + b"(at)" + domain.replace(b".", b"(dot)"), local + b" [at] " + domain, local + b" @ " + domain]
        name, site = re.sub(rb"[^A-Za-z].*", b"", local) or local, domain.split(b".")[-2:]
        same += [name + b" at " + b" dot ".join(site), name + b" [at] " + b".".join(site)]
        broken = [body.replace(b"@", b" "), domain]
    elif kind == 1:
        same = [b" . ".join(groups), b"[.]".join(groups), b"(.)".join(groups)]
        broken = [b".".join([*groups[:3], b"%d" % (256 + int(groups[3]))]), b".".join(groups[:3])]
    elif kind == 2:
        wrong = digits[:-1] + b"%d" % ((digits[-1] - 47) % 10)
        same = [fours(digits, b"-"), fours(digits, b"."), fours(digits, b"  ")]
        broken = [wrong, fours(wrong, b"."), fours(wrong, b" "), digits[:9]]
    else:
        same = [body[1:], b".".join(groups), b"-".join(groups)]
        if len(groups) == 4:
            same.append(b"(" + groups[1] + b") " + b"-".join(groups[2:]))
        broken = [b"".join(groups[1:]), b" ".join(groups[-2:])]
    return [(text[:a] + s + text[b:], [(kind, a, a + len(s))]) for s in same] + [(text[:a] + s + text[b:], []) for s in broken]


def learn(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, sample_regions: int = SAMPLE_REGIONS) -> Field | None:
    """The field of a corpus, or None where its sample holds no base span."""
    rows = df.count()
    share = min(1.0, sample_rows / max(rows, 1))
    drawn = df.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64(F.lit("pii"), "text"), F.lit(1 << 30)) < int(share * (1 << 30))).filter("text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, list[int]]] = []
            for _, _, texts in slices(batch_column(batch, "text")):
                for d in range(len(texts)):
                    raw = texts.document(d)
                    spans = base_spans(raw)
                    for a, b in regions(raw)[:REGIONS_A_DOCUMENT]:
                        inside = sorted((s, e, k) for k, s, e in spans if s < b and e > a)
                        if all(s >= a and e <= b for s, e, _ in inside) and all(x[1] <= y[0] for x, y in zip(inside, inside[1:], strict=False)):
                            out.append((raw[a:b], [v for s, e, k in inside for v in (k, s - a, e - a)]))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.binary()), pa.array([s for _, s in out], pa.list_(pa.int32()))], ["region", "spans"])

    found = drawn.mapInArrow(tidy(cut), "region binary, spans array<int>").distinct()
    with_spans, without = found.filter(F.size("spans") > 0), found.filter(F.size("spans") == 0)
    order = F.xxhash64(F.lit("region"), "region")
    kept = [r for part in (with_spans, without) for r in part.orderBy(order, "region").limit(sample_regions // 2).collect()]
    examples = []
    for r in sorted(kept, key=lambda r: (bytes(r.region), r.spans)):
        spans = [tuple(r.spans[x : x + 3]) for x in range(0, len(r.spans), 3)]
        examples.append((bytes(r.region), spans))
        if len(spans) == 1:
            examples += disguises(bytes(r.region), spans[0])
    return fit(examples) if examples else None


def added_spans(raw: bytes, field: Field | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the best segmentations that touch no base span."""
    stretches = regions(raw) if field is not None else []
    atoms = Atoms(raw, stretches)
    if not len(atoms.starts):
        return []
    i, j = atoms.candidates()
    if not len(i):
        return []
    lattice = Lattice(atoms.first, i, j)
    chosen, kinds = best_segments(lattice, field.scores(atoms, i, j), field.moves)
    starts, ends = atoms.starts[i[chosen]], atoms.ends[j[chosen]]
    taken = np.zeros(len(raw) + 1, np.int32)
    np.add.at(taken, [a for _, a, _ in base], 1)
    np.add.at(taken, [b for _, _, b in base], -1)
    before = np.concatenate([[0], np.cumsum(np.cumsum(taken[:-1]) > 0)])
    free = before[ends] == before[starts]
    return sorted(zip(kinds[free].tolist(), starts[free].tolist(), ends[free].tolist(), strict=True))


def find(df: DataFrame, field: Field | None, text: str = "text", kept: list[str] | None = None, result: str = "pii") -> DataFrame:
    """``df`` (or its ``kept`` columns) with all spans of every whole text: kind, start, end, and whether a base pattern gave it."""
    kept = [c for c in (df.columns if kept is None else kept) if c != result]
    read = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(result))
    spec = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
    schema = T.StructType([*[read.schema[c] for c in kept], T.StructField(result, spec)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def of(texts: Texts) -> list[list[dict]]:
        """All documents at once: no pattern matches a line feed, which stands between them."""
        raw = b"\n".join(texts.document(d) for d in range(len(texts)))
        base = base_spans(raw)
        spans = sorted([(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in added_spans(raw, field, base)])
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if not spans:
            return out
        first = texts.bounds[:-1] + np.arange(len(texts))
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        for k, a, b, given in spans:
            d = int(np.searchsorted(first, a, "right")) - 1
            out[d].append({"kind": KINDS[k], "start": int(points[a] - points[first[d]]), "end": int(points[b] - points[first[d]]), "base": given})
        return out

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, _, texts in slices(batch_column(batch, result)) for x in of(texts)]
            yield with_columns(batch, kept, {result: pa.array(found, kind)})

    return read.mapInArrow(tidy(apply), schema)


def redact(df: DataFrame, text: str = "text", result: str = "pii") -> DataFrame:
    """``df`` with every span of ``result`` replaced by its kind in angle brackets; of spans that overlap, the first stands for both."""
    spans = F.array_sort(F.transform(result, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    body = F.col(text)

    def step(state: F.Column, s: F.Column) -> F.Column:
        fresh = s["start"] >= state["at"]
        piece = F.concat(state["out"], F.substr(body, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.when(fresh, piece).otherwise(state["out"]).alias("out"), F.greatest(state["at"], -s["end"]).alias("at"))

    whole = F.aggregate(spans, start, step, lambda state: F.concat(state["out"], F.substr(body, state["at"] + 1, F.greatest(F.char_length(body) - state["at"], F.lit(0)))))
    return df.withColumn(text, F.when(F.size(result) > 0, whole).otherwise(body))
