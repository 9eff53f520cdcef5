"""The pipeline's stages against what each operator's rule says of its own input."""

import os

import pytest

import corpus_pipeline
from weekspan.session import scratch_path

FOLDER = os.environ.get("WEEKSPAN_TEST_DATA", "/root/testdata/sf0.001")


def words(text):
    return (text or "").split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    start, known, single, cut, clean = seen
    assert len(known) >= 0.99 * len(start) and all(start[i] == t for i, t in known.items())

    grams = {i: {tuple(words(t.lower())[p : p + 5]) for p in range(max(1, len(words(t)) - 4))} for i, t in known.items()}
    near = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    kept = sorted(single)
    assert not any(near(a, b) for x, a in enumerate(kept) for b in kept[x + 1 :])
    assert all(any(near(i, j) for j in known if j != i) for i in known.keys() - single.keys())

    first = {}
    for i in kept:
        for p in range(len(words(single[i])) - 12):
            first.setdefault(tuple(words(single[i])[p : p + 13]), i)
    for i in kept:
        w = words(single[i])
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        assert cut[i] == (" ".join(x for q, x in enumerate(w) if q not in gone) if gone else single[i])
    assert clean.keys() <= cut.keys() and all(cut[i] == t for i, t in clean.items())

    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in rows} == clean.keys()


INNER = "verdict string, row int, own int, named int, times int, items string, hit_words int, n_words string, n_removed int, _row_key string, _order_key int, _bucket string, _paths int, score string, language int"


def chain(spark, docs):
    """Rows after every stage; all but the last keep the columns."""
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = after
        seen.append(docs.collect())
    return seen


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_odd_rows_pass_through_the_chain(spark):
    words = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(600)]
    prose = [" ".join(words[a : a + 60]) for a in range(0, 600, 60)]
    texts = [None, "", "  \n", "123 !!", prose[0], prose[0] + " end", prose[1], prose[2], "x" * 3000, " ".join(words) + " tail", prose[3]]
    columns = [c.split()[0] for c in INNER.split(", ")]
    clash = [str(n) if INNER.split(", ")[n].endswith("string") else n for n in range(len(columns))]
    rows = [(i, t, "en", None if i % 2 else "s", len(t or ""), *clash) for i, t in enumerate(texts)]
    rows += [rows[4], rows[6], (None, prose[2], None, None, None, *clash), (None, None, None, None, None, *clash), (7, prose[4], "en", "s", 1, *clash)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + INNER)
    known, single, cut, clean, packed = chain(spark, docs)
    values = lambda r: tuple(r)[5:]
    assert all(list(values(r)) == clash for stage in (known, single, cut, clean) for r in stage)
    assert {r.doc_id for r in known} == {4, 5, 6, 7, 8, 9, 10, None} and len(known) == 11  # texts without a letter go
    near = [r for r in single if (r.text or "").startswith(words[0] + " ") and len(r.text.split()) < 100]
    assert [r.doc_id for r in near] == [4] and sum(r.text == prose[1] for r in single) == 1
    assert [r.doc_id for r in single if r.text == prose[2]] == [7] and any(r.text == prose[4] for r in single)
    long = next(r for r in cut if r.doc_id == 9)
    gone = {w for k in (0, 1, 2) for w in prose[k].split()}  # also in documents 4, 6 and 7
    assert gone.isdisjoint(long.text.split()) and long.text.endswith("tail") and long.n_chars == len(long.text)
    assert {r.doc_id for r in clean} == {r.doc_id for r in cut} and {r.doc_id for r in packed} == {r.doc_id for r in clean}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_empty_table_passes_through_the_chain(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert [len(s) for s in chain(spark, docs)] == [0] * 5
