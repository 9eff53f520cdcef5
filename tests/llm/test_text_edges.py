"""Defined results on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weekspan.llm import common, components, decontaminate, embeddings, jaccard, language, lm, packing, quality, sharding, substrings, warc
from weekspan.llm.textbatch import Texts
from weekspan.session import scratch_path

LONG = " ".join(f"word{i}" for i in range(30_000))
SPEC = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, `n_words` string, node string"


def _rows():
    prose = "the quick brown fox jumps over the lazy dog and runs through the wide green forest until night"
    texts = [None, "", "   \n\t ", "...!!!", "a", "one two three", prose, prose, prose + " again", LONG, "über straße naïve " * 8, "é" * 300, "x" * 5_000]
    return [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 1, 0.5, 3, "clash", "n") for i, t in enumerate(texts)] + [(6, prose, "en", "s", 1, 0.5, 3, "clash", "n"), (None, prose, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_rows(), SPEC).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SPEC)


def test_language(odd, none):
    model = language.learn(odd)
    found = language.identify(odd, model, kept=["doc_id", "text"]).collect()
    assert len(found) == len(_rows())
    assert all(r.lang_pred == language.UNKNOWN and r.score == 0 for r in found if r.text is None or not any(c.isalpha() for c in r.text))
    assert all(r.lang_pred == "en" for r in found if r.text and r.text.startswith("the quick"))
    assert language.identify(odd, model).columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score", "rejected"]
    assert all(r.rejected for r in found if r.lang_pred == language.UNKNOWN)
    kept = language.keep_known(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(not r.rejected for r in found)
    assert language.identify(none, model).count() == 0
    nothing = language.learn(none)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {language.UNKNOWN}


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(6, 1), (6, 1), (9, 0), (9, 1), (10, 0), (None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    field = quality.learn(odd, labels)
    found = quality.score_documents(odd, field).collect()
    assert len(found) == len(_rows()) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if not (r.text or "").strip("\n")} == {field.without_lines}
    assert quality.score_documents(none, field).count() == 0
    plain = quality.learn(none, labels)
    assert {r.score for r in quality.score_documents(odd, plain).collect()} == {0.5}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    good, moves = rng.normal(size=4), rng.normal(size=(2, 2))
    weights = {}
    for labels in np.ndindex(2, 2, 2, 2):
        weights[labels] = np.exp(sum(g * y for g, y in zip(good, labels, strict=True)) + sum(moves[a, b] for a, b in zip(labels, labels[1:], strict=False)))
    total = sum(weights.values())
    want = [sum(w for y, w in weights.items() if y[i]) / total for i in range(4)]
    assert np.allclose(quality.marginals(good, moves, np.array([0, 4, 4])), want)


def _jaccard_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(keys) if keys else None, len(links[i])))
    return sorted(out, key=repr)


def test_jaccard(spark, odd, none, monkeypatch):
    rows = [(r[0], r[1]) for r in _rows()]
    assert sorted([tuple(r) for r in jaccard.link(odd).collect()], key=repr) == _jaccard_classes(rows)
    assert jaccard.link(none).count() == 0 and jaccard.deduplicate(none).count() == 0
    kept = jaccard.deduplicate(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert len([t for t in texts if t and t.startswith("the quick")]) == 1 and len([t for t in texts if t is None]) == 2


def test_deduplicate_judges_rows_of_one_key_by_their_texts(spark):
    base = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    text = [" ".join(w) for w in base]
    near = [" ".join([*w[:-1], "other"]) for w in base]
    rows = [(5, text[0]), (5, text[1]), (5, None), (5, " "), (5, None)]  # link with nothing
    rows += [(None, text[2]), (None, near[2]), (None, text[2])]  # a class without a key
    rows += [(7, text[3]), (7, near[3]), (8, near[3]), (7, text[3]), (None, near[3])]  # a class whose smallest key repeats
    kept = [tuple(r) for r in jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(r for r in kept if r[0] == 5 and r[1] and r[1].strip()) == [(5, text[0]), (5, text[1])]
    assert sorted((r[1] for r in kept if r[0] == 5 and not (r[1] or "").strip()), key=repr) == [" ", None, None]
    assert len([r for r in kept if r[0] is None]) == 1 and len([r for r in kept if r[0] == 7]) == 1 and len(kept) == 7


def test_jaccard_group_of_near_copies(spark, monkeypatch):
    random.seed(5)
    base = [f"w{random.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(random.randrange(3)):
            words[random.randrange(120)] = f"x{random.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(1_000 + i, rows[i % 5][1]) for i in range(40)]
    for chunk in (512, 32):
        monkeypatch.setattr(jaccard, "FAMILY_CHUNK", chunk)
        monkeypatch.setattr(jaccard, "BUCKET_CHUNK", chunk)
        found = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted([tuple(r) for r in found], key=repr) == _jaccard_classes(rows)


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.9), (0.95, 0.999)):
        bands, rows = jaccard.bands_for(threshold, recall)
        assert bands * rows <= jaccard.HASHES and 1 - (1 - threshold**rows) ** bands >= recall


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(300, 300 + i) for i in range(1, 90)] + [(500, 500), (None, 3), (601, 600), (600, 601)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(1, 201)), list(range(300, 390)), [500], [600, 601]]
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "http://c", "<p>é</p>"), (4, "http://c", "<p>é</p>"), (None, "http://d", "<p>é</p>"), (None, None, "only"), (9, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")
    path = scratch_path(spark, "archives")
    warc.write_archives(pages, path)
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(rows)
    kinds = sorted((r.record_key, r.record_type, r.refers_to or "", r.payload_bytes) for r in found)
    assert kinds == sorted([("1", "revisit", "4", 9), ("2", "revisit", "3", 0), ("3", "response", "", 0), ("4", "response", "", 9), ("4", "response", "", 9), ("null", "revisit", "4", 9), ("null", "response", "", 4), ("9", "response", "", 300_000)])
    assert {bytes(r.payload).decode() for r in found if r.payload is not None} == {"<p>é</p>", "", "only", "y" * 300_000}
    path = scratch_path(spark, "archives")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_archive_leads_with_its_dictionary(spark):
    path = scratch_path(spark, "archives")
    random.seed(2)
    rows = [(i, "http://x", f"<html><body>{' '.join(random.choice(['alpha', 'beta', 'gamma', 'delta']) for _ in range(200))}</body></html>") for i in range(400)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    contents = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).filter("length > 0").collect()]
    assert all(c[:4] == (0x184D2A5D).to_bytes(4, "little") for c in contents)
    assert sum(len(list(warc.records_of(c))) for c in contents) == 400


def test_decontamination(spark, odd, none, monkeypatch):
    prose = _rows()[6][1]
    benchmark = spark.createDataFrame([(1, prose), (1, prose), (2, "One, two; THREE"), (3, None), (4, ""), (None, "naïve über")], "item_id long, text string")
    found = {(r.doc_id, r.text): r for r in decontaminate.scan(odd, benchmark).collect()}
    assert found[(5, "one two three")]["items"] == ["2"] and found[(5, "one two three")].hit_words == [0, 1, 2]
    assert found[(6, prose)]["items"] == ["1"] and len(found[(6, prose)].hit_words) == len(prose.split())
    assert found[(0, None)].n_words == 0 and found[(0, None)]["items"] == []
    assert [r["items"] for (i, _), r in found.items() if i == 10] == [["null"]]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    again = {(r.doc_id, r.text): r for r in decontaminate.scan(odd, benchmark).collect()}
    assert {k: (r.hit_words, r["items"]) for k, r in again.items()} == {k: (r.hit_words, r["items"]) for k, r in found.items()}
    cut = {(r.doc_id): r.text for r in decontaminate.decontaminate(odd, benchmark, remove="spans").collect()}
    assert cut[5] == "" and cut[8] == " again"
    left = decontaminate.decontaminate(odd, benchmark)
    assert left.columns == odd.columns and left.filter("text like '%quick%'").count() == 0 and left.filter("text is null").count() == 2
    assert decontaminate.scan(odd, benchmark.limit(0)).filter(F.size("items") > 0).count() == 0
    assert decontaminate.scan(none, benchmark).count() == 0


def test_packing(odd, none):
    found = packing.pack(odd, with_ids=True).collect()
    assert sum(r.piece == 0 for r in found) == len(_rows())
    assert [(r.start, r.length) for r in found if r.doc_id == 0] == [(0, 1)]
    assert all(len(r.ids) == r.length for r in found) and packing.pack(none).count() == 0


def test_packing_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for capacity, groups in ((64, 5), (1024, 12), (1, 1), (7, 3)):
        counts = {int(s): int(n) for s, n in zip(range(1, capacity + 1), rng.integers(0, 40, capacity), strict=True) if n}
        plan = packing.Plan(counts, capacity, groups)
        fill = np.zeros(plan.sequences, int)
        placed = dict.fromkeys(counts, 0)
        for length, rank, n, first, each, at in sorted(plan.runs, key=lambda r: r[5]):
            size = np.full(-(-n // each), each)
            if n % each:
                size[-1] = n % each
            assert (fill[first : first + len(size)] == at).all()
            fill[first : first + len(size)] += size * length
            placed[length] += n
        assert placed == counts and fill.max(initial=0) <= capacity and (fill > 0).all()


def test_special_token_is_one_id():
    text = f"a {packing.SPECIAL} b"
    assert list(packing.token_ids(text)) == [*packing._full(packing.TOKENIZER).encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_attention_gradient():
    rng = np.random.default_rng(0)
    p = {n: x.astype(np.float64) for n, x in lm.start_parameters(12).items()}
    context, target, weight = rng.integers(0, 12, (2, 2 * lm.STRIDE)), rng.integers(0, lm.CLASSES, (2, lm.STRIDE)), np.ones((2, lm.STRIDE))
    prior = np.log(rng.dirichlet(np.ones(lm.CLASSES), 2 * lm.STRIDE))
    _, g = lm.gradients(p, context, target, weight, prior)
    for n in p:
        at = tuple(rng.integers(0, s) for s in p[n].shape)
        held, step = p[n][at], 1e-5
        p[n][at] = held + step
        above = lm.gradients(p, context, target, weight, prior)[0]
        p[n][at] = held - step
        below = lm.gradients(p, context, target, weight, prior)[0]
        p[n][at] = held
        assert (above - below) / (2 * step) == pytest.approx(g[n][at], abs=1e-6)
    small = {n: x.astype(np.float32) for n, x in p.items()}
    prior = prior.astype(np.float32)
    assert np.allclose(lm.forward(small, context, lm.projections(small), prior)["classes"], lm.class_scores(small, context, lm.scoring_tables(small), prior), atol=1e-4)
    # the future does not reach a prediction
    changed = context.copy()
    changed[:, -1] = (changed[:, -1] + 1) % 12
    a, b = (lm.class_scores(small, c, lm.scoring_tables(small), prior).reshape(2, lm.STRIDE, -1) for c in (context, changed))
    assert np.array_equal(a, b)


def _model_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias(lm.KEY), F.lit(False).alias(lm.HELD), F.xxhash64("doc_id", "text").alias(lm.ROW), F.coalesce("text", F.lit("")).alias("text"))
    nothing = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return lm.learn(lm.encoded(df, lm.TOKENIZER, nothing))


def _chances(model, context):
    """log10 of the probability of every id after the ids of ``context`` (-1 is no id), by plain loops over the window."""
    p, e = model.parameters, model.parameters["e"].astype(float)
    row = [e[model.compact[i]] for i in context]
    last, earlier = row[-1], row[-2]
    query = last @ p["wq"] / np.sqrt(lm.WIDTH)
    scores = [query @ (row[k] @ p["wk"]) + p["rb"][len(row) - 1 - k] for k in range(len(row))]
    weights = np.exp(np.array(scores) - max(scores))
    mixed = sum(w * (r @ p["wv"]) for w, r in zip(weights / weights.sum(), row))
    z = np.maximum(last @ p["r1"] + p["b"] + earlier @ p["r2"] + mixed, 0)
    logits = z @ p["wc"] + model.prior[context[-1]]
    classes = logits - np.log(np.exp(logits).sum())
    ids = np.arange(lm.VOCABULARY)
    return classes[model.classes] / np.log(10) + model.conditional(np.full(lm.VOCABULARY, context[-1]), ids)


@pytest.mark.parametrize("rows", [[(i, f"the cat {i} sat on mat {i * 7 % 11} and the dog ran " * (1 + i % 4)) for i in range(80)], [(1, "a b a"), (2, None)], []])
def test_probabilities_sum_to_one_and_scores_follow_them(spark, rows):
    model = _model_of(spark, rows)
    for context in ([-1] * 16, [-1] * 10 + [5, 9, 700, 262, 3797, 319], list(range(20, 36)), [50256] * 16):
        assert (10.0 ** _chances(model, context)).sum() == pytest.approx(1, abs=1e-4)
    tables = lm.scoring_tables(model.parameters)
    for text in ("the cat sat", "", "zzz qq the dog ran over the mat and 11 cats sat on 3 mats in the far and unseen house"):
        blocks, _, owner = lm.streams(Texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])))
        ids = blocks[blocks >= 0]
        want = 0.0
        for k, i in enumerate(ids):
            start = k // lm.STRIDE * lm.STRIDE - lm.STRIDE  # a window begins a stride before the block of the id
            context = [ids[x] if x >= 0 else -1 for x in range(start, k)]
            want += _chances(model, [-1] * max(0, 2 - len(context)) + context)[i]
        assert lm.score_blocks(model, blocks, owner, 1, tables)[0] == pytest.approx(want, abs=1e-3)


def test_training_takes_every_window(spark, monkeypatch):
    for turns in (1, 4):
        for times in range(1, 1 << turns):
            taken = np.concatenate([lm.in_turn(100, t, turns, times) for t in range(turns)])
            assert set(taken) == set(range(100)) and (times > 1 or len(taken) == 100)
    assert all(len(lm.in_turn(100, t, 4, 15)) == 100 for t in range(4))
    for name, value in (("FEW_WINDOWS", 1), ("LEAST_WINDOWS", 1), ("LEAST_TALLY", 1)):  # a table far above the few
        monkeypatch.setattr(lm, name, value, raising=False)
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + k % 26)}{k * i % 90}" for k in range(60))) for i in range(60)]
    model = _model_of(spark, rows)
    moved = (model.parameters["e"] != lm.start_parameters(len(model.parameters["e"]))["e"]).any(1)
    known = np.flatnonzero(model.compact[:-1] < len(moved) - lm.CLASSES - 1)
    assert len(known) > 200 and set(known[~moved[model.compact[known]]]) <= {lm.END}


def test_training_steps_reuse_memory():
    """A step neither asks the system for the pages of its arrays again nor works on input rows its windows do not name."""
    import resource

    rng = np.random.default_rng(2)
    rows = lm.FREQUENT + lm.CLASSES + 1
    compact, classes = np.arange(lm.VOCABULARY + 1) % rows, np.arange(lm.VOCABULARY) % lm.CLASSES
    prior = np.log(np.full((lm.VOCABULARY + 1, lm.CLASSES), 1 / lm.CLASSES, np.float32))
    steps = lm.Steps(lm.start_parameters(rows))
    model = lm.Model(compact, classes, steps.p, prior, None, None, None)
    windows = rng.integers(0, 900, (25, lm.BATCH, 2 * lm.STRIDE))
    lm.keep_freed()
    for x in windows[:5]:
        steps.take(model, x, 0.01)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for x in windows[5:]:
        steps.take(model, x, 0.01)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 200 * 20  # about 2,000 a step where every array is new
    assert steps.windows == 25 * lm.BATCH and np.isfinite(steps.vector).all()
    assert np.array_equal(steps.p["e"][900:], lm.start_parameters(rows)["e"][900:])


def test_no_exponent_exceeds_its_bound():
    rng = np.random.default_rng(5)
    for size in (0.1, 1.0, 6.0):
        p = {n: (x + rng.normal(size=x.shape) * size).astype(np.float32) for n, x in lm.start_parameters(30).items()}
        context = rng.integers(0, 30, (40, 2 * lm.STRIDE))
        tables, prior = lm.projections(p), np.log(rng.dirichlet(np.ones(lm.CLASSES), 40 * lm.STRIDE)).astype(np.float32)
        scores = tables["last"][context[:, lm.STRIDE - 1 : -1]][:, :, : lm.WIDTH] @ tables["seen"][context[:, :-1]][:, :, : lm.WIDTH].transpose(0, 2, 1) + p["rb"][lm.DISTANCE]
        assert scores.max() <= tables["most_weight"] and lm.class_scores(p, context, tables, prior).max() <= tables["most_class"]


def test_pair_table():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 10**9, 5000))
    table = lm.PairTable(codes, np.arange(len(codes), dtype=np.float32))
    asked = np.concatenate([codes[::3], rng.integers(0, 10**9, 500)])
    at, values = table.find(asked)
    known = {int(c): i for i, c in enumerate(codes)}
    assert {int(a): float(v) for a, v in zip(at, values)} == {k: float(known[int(c)]) for k, c in enumerate(asked) if int(c) in known}
    assert len(lm.PairTable(codes[:0], np.zeros(0, np.float32)).find(asked)[0]) == 0


def test_pairs_kept_are_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(lm, "PAIR_CODES", 50)
    rows = [(i, " ".join(f"w{(i * k) % 9} x{k % 5}" for k in range(60))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias(lm.KEY), F.lit(False).alias(lm.HELD), F.col("doc_id").alias(lm.ROW), "text")
    ids = lm.encoded(df, lm.TOKENIZER, spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64))))
    counts = {}
    for r in ids.collect():
        for _, _, blocks, _ in lm.decoded(pa.array([bytes(r.ids)], pa.binary())):
            for a, b in zip(*lm.neighbours_of(blocks)):
                counts[(a + 1) * lm.VOCABULARY + b] = counts.get((a + 1) * lm.VOCABULARY + b, 0) + 1
    codes, n = lm._pair_sums(ids, 5000, 20)
    order = sorted(counts.values(), reverse=True)
    assert len(codes) <= 20 and all(counts[c] == x for c, x in zip(codes, n)) and min(n) > order[20]
    assert len(lm._pair_sums(ids, 5000, 10**6)[0]) == sum(x > 1 for x in counts.values())


def test_language_model(odd, none):
    found = lm.score(odd, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect()
    assert len(found) == len(_rows()) and all(r.score < 0 and r.base_score < 0 for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (0, 1, 2)} == {1}
    same = [r for r in found if r.doc_id == 6]
    assert len(same) == 2 and len({(r.score, r.base_score, r.n_known) for r in same}) == 1
    assert lm.score(none, F.lit(False)).count() == 0
    untrained = lm.score(odd, F.lit(True)).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(r.score < 0 for r in untrained)


def _without_repeats(rows):
    words = [(t or "").split() for _, t in rows]
    keys = [10**18 if k is None else k for k, _ in rows]
    first = {}
    for k, w in zip(keys, words, strict=True):
        for p in range(len(w) - 12):
            gram = tuple(w[p : p + 13])
            first[gram] = min(first.get(gram, 10**19), k)
    out = []
    for (key, _), k, w in zip(rows, keys, words, strict=True):
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < k for q in range(p, p + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [40, 6])
def test_substrings(spark, odd, bits):
    """With 6 bits nearly all edges collide, so every removal rests on the verified source coordinates."""
    random.seed(1)
    base = [[f"{random.choice('abcdefgh')}{random.randrange(40)}" for _ in range(60)] for _ in range(10)]
    rows = [(r[0], r[1]) for r in _rows()]
    for i in range(120):
        words = []
        for _ in range(random.randrange(4)):
            b, a = random.choice(base), random.randrange(50)
            words += b[a : a + random.randrange(40)] + [str(random.random())] * random.randrange(2)
        rows.append((random.choice([i, i // 2, None]), random.choice([" ", "\n", "  "]).join(words)))
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True, edge_bits=bits).collect()
    assert sorted([tuple(r) for r in found], key=repr) == _without_repeats(rows)


def test_substrings_keep_columns(odd, none):
    found = substrings.remove_repeats(odd)
    assert found.columns == [c for c in odd.columns if c != "n_words"] + ["n_words", "n_removed"]
    texts = {r.doc_id: r.text for r in found.collect()}
    assert texts[7] == "" and texts[2] == "   \n\t " and texts[0] is None and texts[9] == LONG
    assert substrings.remove_repeats(none).count() == 0


def test_sharding(odd, none):
    found = sharding.interleave(odd).collect()
    sizes = np.bincount([r.shard for r in found], minlength=8)
    assert len(found) == len(_rows()) and sizes.max() - sizes.min() <= 1
    for s in range(8):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sizes[s]))
    assert {r["size"] for r in found if r.doc_id == 0} == {1} and sharding.interleave(none).count() == 0


def test_shards_match_the_mixture(spark):
    df = spark.range(4_000).selectExpr("id as doc_id", "'x' as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source")
    found = sharding.interleave(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source", "shard").count().collect()
    by_source = {}
    for r in found:
        by_source.setdefault(r.source, []).append(r["count"])
    assert all(len(c) == 8 and max(c) - min(c) <= 2 for c in by_source.values())


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * rng.choice([0, 0.02, 0.15, 0.2])).astype(np.float32).tolist() for _ in range(rng.integers(1, 40))]
    rows += [rows[0]] * 25
    rows = [(int(i), v, int(rng.integers(0, 2)), "clash") for i, v in enumerate(rows)] + [(rows_id, v, 0, None) for rows_id, v in ((5_000, None), (5_001, []), (5_002, [0.0] * 16), (5_003, [float("nan")] * 16), (5_004, [None] * 16), (5_005, [1.0, 2.0]))]
    rows += [(None, rows[0][1], 0, None), (6_000, rows[0][1], None, None), (3, rows[3][1], rows[3][2], None)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")).collect()

    def sound(r):
        return r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])

    links = []
    for i, a in enumerate(rows):
        near = []
        for j, b in enumerate(rows):
            if i != j and sound(a) and sound(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    near.append(j)
        links.append(near)
    want = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(keys) if keys else None
        want.append((r[0], len(links[i]), least, r[0] is not None and r[0] == least))
    assert sorted([tuple(r) for r in found], key=repr) == sorted(want, key=repr)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_word_counts_around_one_byte(spark):
    """Numbers of a word in a document on both sides of what one byte holds."""
    rows = [(i, " ".join(["same"] * n + [f"w{i}"])) for i, n in enumerate((254, 255, 256, 300, 70_000, 1))]
    found = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    total = sum(n for n in (254, 255, 256, 300, 70_000, 1))
    size, distinct = total + 2 * len(rows), 1 + len(rows) + 1
    for i, n in enumerate((254, 255, 256, 300, 70_000, 1)):
        terms = n * np.log10(total + 0.1) + np.log10(1.1) + np.log10(len(rows) + 0.1) - (n + 2) * np.log10(size + 0.1 * (distinct + 1))
        assert found[i].base_score == pytest.approx(terms, rel=1e-12) and found[i].n_tokens == found[i].n_known == n + 2


def test_common_words_are_counted_apart(spark, monkeypatch):
    """A word of most documents goes into no bucket, and the base scores stay those of the definition."""
    rows = [(i, f"hot {'hot ' * (i % 3)}w{i % 40} v{i}") for i in range(120)] + [(3, "hot w3 v3"), (3, "hot w3 v3"), (500, None), (None, "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 10 == 0
    monkeypatch.setattr(common, "COMMON", 60)
    monkeypatch.setattr(common, "HITS", 60)
    found = sorted([tuple(r)[:6] for r in lm.score(df, held).collect()], key=repr)
    marked = df.select(F.col("doc_id").alias(lm.KEY), F.coalesce(held, F.lit(False)).alias(lm.HELD), F.xxhash64("doc_id", "text").alias(lm.ROW), F.coalesce("text", F.lit("")).alias("text"))
    words, often = lm._common_words(marked, len(rows))
    entries = lm._entries(marked, 4, spark.sparkContext.broadcast((words, often))).collect()
    times = {}
    for k, t in rows:
        for w in [*(t or "").lower().split(), 0] if k is None or k % 10 else []:
            times[w] = times.get(w, 0) + 1
    assert list(often) == [times["hot"]]
    assert not any(words[0] in np.frombuffer(bytes(r.hashes), "<u8") for r in entries)
    total, n = sum(times.values()), len(times)
    want = []
    for k, t in rows:
        every = [*(t or "").lower().split(), 0]
        score = sum(np.log10(times.get(w, 0) + 0.1) - np.log10(total + 0.1 * (n + 1)) for w in every)
        want.append((k, k is not None and k % 10 == 0, len(every), sum(w in times for w in every), total, score))
    for a, b in zip(found, sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


@pytest.mark.parametrize("bits", [40, 6])
def test_common_passages_are_marked_apart(spark, monkeypatch, bits):
    """Windows of most documents go into no bucket, and the words removed stay those of the definition."""
    monkeypatch.setattr(common, "COMMON", 40)
    monkeypatch.setattr(common, "HITS", 40)
    random.seed(4)
    base = [f"p{i}" for i in range(40)]
    rows = [(random.choice([i, i // 2, None]), " ".join([f"a{i}", *base[: random.choice([40, 40, 30, 5])], f"b{i % 9}", *base[3:20]])) for i in range(100)] + [(7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.remove_repeats(df, digest=True, edge_bits=bits).collect()
    assert sorted([tuple(r) for r in found], key=repr) == _without_repeats(rows)
    names = substrings.Edges(4, bits)
    keyed = df.select(F.coalesce("doc_id", F.lit(substrings.LAST_KEY)).alias(substrings.KEY), F.xxhash64("doc_id", "text").alias(substrings.ROW), "text")
    apart = substrings._common_edges(keyed, "text", names, len(rows))
    blocks = substrings._edges(keyed, "text", names, spark.sparkContext.broadcast(apart)).collect()
    assert len(apart[0]) and not any(np.isin(substrings.Edges.whole(r.bucket, substrings.from_bytes(bytes(r.edges))), apart[0]).any() for r in blocks)


def test_packing_goes_through_configurations():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(5.8, 1.0, 30_000).astype(int) + 1, 1024)
    counts = {int(s): int(n) for s, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.Plan(counts, 1024, 256)
    least = -(-int(lengths.sum()) // 1024)
    assert plan.configured >= 0.9 * plan.large and plan.sequences <= 1.005 * least


def test_most_valuable_configuration():
    rng = np.random.default_rng(5)
    for _ in range(200):
        capacity = int(rng.integers(8, 200))
        sizes = np.unique(rng.integers(capacity // 4 + 1, capacity + 1, rng.integers(1, 12)))
        worth = np.round(rng.random(len(sizes)) * rng.integers(0, 2, len(sizes)), 3)
        best, counts = packing._best_configuration(sizes, worth, capacity)
        every = [c for r in range(4) for c in itertools.combinations_with_replacement(range(len(sizes)), r) if sizes[list(c)].sum() <= capacity]
        assert best == pytest.approx(max(worth[list(c)].sum() for c in every))
        assert counts @ sizes <= capacity and counts @ worth == pytest.approx(best)


INNER = "doc_id long, text string, lang string, source string, n_chars long, _row string, row string, own int, named int, times int, _items string, _hit_words int, items string, hit_words int, `n_words` string, n_removed int, _row_key string, _order_key int, _bucket string, _paths int, verdict string, rejected int, language int, score string"


def test_working_names_are_no_columns(spark):
    prose = "the quick brown fox jumps over the lazy dog and runs through the wide green forest until night"
    texts = [prose, prose + " x", "one two three four five six seven eight nine ten " + prose, "quite another text of its own", None, ""]
    rows = [(i, t, "en", "s", 1, *[str(i) if c.endswith("string") else i for c in INNER.split(", ")[5:]]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, INNER)
    before = {r.doc_id: tuple(r) for r in df.collect()}
    benchmark = spark.createDataFrame([(1, "quite another text of its own")], "item_id long, text string")
    for kept in (jaccard.deduplicate(df), decontaminate.decontaminate(df, benchmark), language.keep_known(df, language.learn(df))):
        assert kept.columns == df.columns
        found = kept.collect()
        assert found and all(tuple(r) == before[r.doc_id] for r in found)
    cut = decontaminate.decontaminate(df, benchmark, decontaminate.SPANS)
    assert all(tuple(r)[2:] == before[r.doc_id][2:] for r in cut.collect()) and cut.columns == df.columns
    repeats = substrings.remove_repeats(df)
    assert repeats.columns == [c for c in df.columns if c not in ("n_words", "n_removed")] + ["n_words", "n_removed"]
    place = {c: i for i, c in enumerate(df.columns)}
    for r in repeats.collect():
        assert all(r[c] == before[r.doc_id][place[c]] for c in df.columns if c not in ("text", "n_words", "n_removed"))
