"""Hard negatives, filter interactions and personal data: odd inputs, brute force, and the parts of each method."""

import hashlib
import itertools
import os
import re

import numpy as np
import pytest

from weekspan.llm import filters, negatives, pii, queries

FOLDER = os.environ.get("WEEKSPAN_TEST_DATA", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


# Hard negatives


def mined(rows, positives=5, most=10):
    """All answers from all scores, by plain loops."""
    ok = [(k, y, [int(np.floor(256 * x)) for x in v]) for k, y, v, *_ in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = 1 << 63
    out = []
    for n, (key, label, vector) in enumerate(ok):
        if key is None or key % 100:
            continue
        others = [(-sum(a * b for a, b in zip(vector, v)), last if k is None else k, y, k) for m, (k, y, v) in enumerate(ok) if m != n and len(v) == len(vector)]
        for score, _, _, positive in sorted(x[:2] + (0, x[3]) for x in others if x[2] == label)[:positives]:
            found = sorted((s, o, k) for s, o, y, k in others if y != label and 30 * -score <= 100 * -s <= 90 * -score)
            out += [(key, positive, r + 1, k, -score, -s) for r, (s, _, k) in enumerate(found[:most])]
    return sorted(out, key=repr)


VECTORS = "vec_id long, label int, embedding array<float>, size int, i int, copies string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, y, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "c") for k, y, v in rows], VECTORS)


def test_negatives_against_all_scores(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "CELL_ROWS", 4)
    monkeypatch.setattr(negatives, "BATCH", 2)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 8))
    rows = [(int(k), int(k) % 4, (centres[k % 6] + 0.3 * draw.normal(size=8)).astype(np.float32).tolist()) for k in range(0, 1500, 5)]
    rows += [(k, 1, rows[0][2]) for k in range(2001, 2090)]  # one vector in a fifth of the rows
    rows += [rows[20], rows[20], rows[0], (None, 2, rows[3][2]), (700, None, rows[1][2]), (800, 1, None), (900, 2, [1.0] * 7 + [None]), (100, 3, [float("nan")] * 8)]
    rows += [(3000, 0, [1.0, 2.0]), (3001, 0, [1.0, 1.0]), (3002, 1, [0.7, 0.5]), (3100, 0, []), (3101, 0, []), (3102, 1, []), (3200, 0, [0.0] * 8)]
    got = negatives.mine(vectors(spark, rows), "vec_id % 100 = 0").collect()
    assert sorted((tuple(r) for r in got), key=repr) == mined(rows)


def test_no_anchors(spark):
    assert negatives.mine(vectors(spark, []), "vec_id % 100 = 0").collect() == []
    assert negatives.mine(vectors(spark, [(1, 1, [1.0]), (2, 2, [1.0])]), "vec_id % 100 = 0").collect() == []
    assert negatives.mine(vectors(spark, [(100, 1, [1.0]), (2, 2, [1.0])]), "vec_id % 100 = 0").collect() == []


def test_bounds_spare_cells():
    """Far clusters are never visited."""
    draw = np.random.default_rng(2)
    codes = np.array([[1000.0, 0], [-1000, 0], [0, 1000], [0, -1000]])
    blocks = []
    for i, j in itertools.product(range(4), range(4)):
        points = np.rint(np.concatenate([np.repeat(codes[None, i], 40, 0), np.repeat(codes[None, j], 40, 0)], 1) + draw.normal(size=(40, 4)) * 20)
        away = [float(np.sqrt(((points[:, s] - codes[c]) ** 2).sum(1)).max()) for s, c in ((slice(0, 2), i), (slice(2, 4), j))]
        keys = np.arange(40) + 100 * (4 * i + j)
        blocks.append({"size": 4, "i": i, "j": j, "far_i": away[0], "far_j": away[1], "n": 40, "keys": keys.tobytes(), "labels": np.zeros(40, np.int64).tobytes(), "copies": np.ones(40, np.int64).tobytes(), "vectors": points.astype(np.int32).tobytes()})
    shard = negatives.Shard(blocks, (codes, codes))
    seen = []
    shard.visit = lambda anchor, block, *rest: (seen.append(block["i"] * 4 + block["j"]), negatives.Shard.visit(shard, anchor, block, *rest))
    anchor = negatives.Anchor(0, 10**6, 0, np.array([1000.0, 0, 0, 1000.0]), [negatives.Best(negatives.LOWEST, negatives.NO_KEY, 5, True)])
    shard.search(anchor)
    assert len(anchor.windows[0].scores) == 5 and set(seen) == {2}


# Filter interactions

DOCUMENTS = "doc_id long, text string, source string, mask int, part string, good string"
LONG = " ".join(f"w{i}" for i in range(200))


def audited(rows, marks):
    """Every order replayed document by document."""
    first = {}
    for k, t, *_ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    documents = []
    for k, t, s in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t or "")) > 2 * len(t or ""),
            "D": bool(re.search("[#$%&*|]", t or "")), "E": k is not None and k > first.get(t or "", k),
        }
        documents.append((s or "", {f for f, x in fails.items() if x}, k))
    good, toxic = ({k for k, *m in marks if k is not None and m[x]} for x in (0, 1))
    out = {}
    for part in {d[0] for d in documents}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in documents if d[0] == part]
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in documents if d[0] == part and f in d[1]]
                out[part, order, step + 1] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in failing), sum(d[2] in good for d in gone), sum(d[2] in toxic for d in gone)]
    for part, order, step in list(out):
        out[part, order, step].append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == order[step - 1] and len(v) >= 6))
    return out


def test_audit_against_replay(spark, monkeypatch):
    monkeypatch.setattr(filters, "STRIDE", 3)
    texts = [None, "", "  \n", LONG, LONG + " #", LONG.upper(), "a " * 300, "short", "Ünïcode ÄÖ", LONG + " x", LONG, "A|B", LONG + "\x0bÄ" * 50]
    rows = [(n if n % 11 else None, texts[(n * n + n // 7) % len(texts)], [None, "", "s", "t"][n % 4]) for n in range(120)]
    rows += [rows[5], rows[5], (7, LONG, "s"), (7, "short", "s"), (8, LONG, "only")]
    marks = [(n, n % 2 == 0, None if n % 5 else True) for n in range(0, 60, 2)] + [(4, False, False), (None, True, True)]
    masks = filters.fail_masks(spark.createDataFrame([(*r, 9, "p", "g") for r in rows], DOCUMENTS))
    got = filters.audit(masks, spark.createDataFrame(marks, "key long, good boolean, toxic boolean"), ["good", "toxic"]).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == audited(rows, marks)
    assert len(got) == 600 * 4


def test_audit_of_nothing(spark):
    masks = filters.fail_masks(spark.createDataFrame([], DOCUMENTS))
    marks = spark.createDataFrame([], "key long, good boolean")
    assert filters.audit(masks, marks, ["good"]).collect() == []
    clean = filters.fail_masks(spark.createDataFrame([(1, LONG, "s", 0, "", "")], DOCUMENTS))
    rows = filters.audit(clean, marks, ["good"]).collect()
    assert len(rows) == 600 and all(r.kept == 1 and r.removed == 0 for r in rows)


def test_galloping_lists():
    draw = np.random.default_rng(1)
    lists = [np.flatnonzero(draw.random(5000) < p) for p in (0.5, 0.01, 0.0, 0.3)]
    for stride in (1, 7, 1024):
        stretches = list(filters.id_ranges(lists, stride))
        assert all((np.concatenate([s[k] for s in stretches]) == x).all() for k, x in enumerate(lists))
        assert all(len(x) <= stride for s in stretches for x in s)
    a, b = lists[0], lists[3]
    assert filters.merged(a, b).tolist() == sorted({*a, *b}) and filters.without(a, b).tolist() == sorted({*a} - {*b})


# Personal data


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_base(t):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return found


def test_base_patterns():
    draw = np.random.default_rng(3)
    pieces = ["a.b", "@", "x-1", ".", "..", "1", "255", "256", "0.0.0.0", "4845168114407329", "-", " ", "+", "+1 (132) 555-1352", "(", ")", "é", "c.com", "00012", "12345678", "_%"]
    for _ in range(3000):
        t = "".join(draw.choice(pieces, draw.integers(1, 14)))
        raw = t.encode()
        got = [(pii.KINDS[k], len(raw[:a].decode()), len(raw[:b].decode())) for k, a, b in pii.base_spans(raw)]
        assert got == plain_base(t), t


def test_long_runs_take_linear_time():
    for unit in (b"1", b"a@", b"a.", b"+1", b"1.", b"1 ", b"@a-", b"(at)", b" at a"):
        raw = unit * 40_000
        pii.base_spans(raw)
        assert all(a < b for a, b in pii.regions(raw))


def paths(lattice, n, scores, moves, i, j):
    """Score of every segmentation of one region of n atoms: {segments with types: score}."""

    def go(place, label):
        if place == n:
            yield (), 0.0
            return
        for rest, s in go(place + 1, 0):
            yield rest, s + moves[label, 0]
        for x in np.flatnonzero(i == place):
            for y in range(1, pii.TYPES):
                for rest, s in go(j[x] + 1, y):
                    yield ((int(x), y - 1), *rest), s + moves[label, y] + scores[x, y - 1]

    return dict(go(0, 0))


def test_sums_and_best_path_against_enumeration():
    draw = np.random.default_rng(4)
    for n in (1, 2, 5):
        i, j = (np.array(x) for x in zip(*[(a, b) for a in range(n) for b in range(a, n) if b - a < 3 and draw.random() < 0.7] or [(0, 0)]))
        order = np.lexsort((i, j))
        i, j = i[order], j[order]
        scores, moves = draw.normal(size=(len(i), 4)), draw.normal(size=(5, 5))
        lattice = pii.Lattice(np.array([0, n]), i, j)
        every = paths(lattice, n, scores, moves, i, j)
        ahead, behind, total = pii.segment_sums(lattice, scores, moves)
        assert np.isclose(total[0], np.log(sum(np.exp(s) for s in every.values()))) and np.isclose(behind[0, 0], total[0])
        best = max(every, key=every.get)
        assert [tuple(map(int, x)) for x in zip(*pii.best_segments(lattice, scores, moves))] == list(best)


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(7)
    number = lambda a, b: str(rng.integers(a, b))
    rows = []
    for n in range(120):
        stem = "".join(chr(c) for c in rng.integers(0, 10**9, 15) % 10 + 48)
        card = next(stem + d for d in "0123456789" if luhn(stem + d))
        rows += [f"words of.{n}@mail{n % 9}.example.com then", f"seen {number(0, 255)}.{number(0, 255)}.{number(0, 255)}.{number(0, 255)} there", f"paid {card} once", f"call +1 ({number(100, 999)}) 555-{number(1000, 9999)} now", f"item {stem}{(int(card[-1]) + 3) % 10} stays", "version 3.0. of 2024-10-12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    return pii.learn(df)


def test_added_spans(spark, field):
    cases = {
        "call (132) 555-1352 now": ["phone:5:19"], "mail bob at example dot com please": ["email:5:27"], "é x.y [at] mail.example.org!": ["email:2:27"], "host 10 . 1 . 2 . 3 up": ["ip:5:19"],
        "look at me. dot": [], "version 3.11.2 of 2024-10-12": [], "order 12345678901234 came": [], "+1 (132) 555-1352": ["phone:0:17"], "": [], None: [],
    }
    df = spark.createDataFrame([(n, t, "k", 1) for n, t in enumerate(cases)], "doc_id long, text string, kind string, base int")
    rows = sorted(pii.find(df, field).collect(), key=lambda r: r.doc_id)
    assert [r.kind for r in rows] == ["k"] * len(cases)
    for r, (text, want) in zip(rows, cases.items(), strict=True):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.pii] == want, text
    hidden = {r.doc_id: r.text for r in pii.redact(pii.find(df, field)).collect()}
    assert hidden[0] == "call <phone> now" and hidden[2] == "é <email>!" and hidden[9] is None and hidden[4] == "look at me. dot"


def test_no_personal_data_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.learn(empty) is None and pii.find(empty, None).collect() == []
    plain = spark.createDataFrame([(1, "1234567 x"), (2, None)], "doc_id long, text string")
    assert pii.learn(plain) is None and [r.pii for r in pii.find(plain, None).collect()] == [[], []]


@tables
def test_personal_data_of_the_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_pii"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        spans = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert not set(spans) - set(r.spans.split(","))
