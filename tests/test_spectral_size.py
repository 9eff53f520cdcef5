"""The edges of a graph are stored once and never shuffled again; tables of earlier steps go."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekspan.operators import spectral
from weekspan.session import durable, forget


def graph(spark, gap):
    pairs = [(a, b, 1.0 + (a + b) % 3) for a in range(12) for b in range(12) if a != b and (a * b) % 5 < 2]
    rows = [(a * gap, b * gap, w) for a, b, w in pairs] + [(0, 0, 9.0), (0, gap, 0.5), (None, gap, 1.0), (777, gap, 4.0)]
    nodes = spark.createDataFrame([(a * gap,) for a in range(13)] + [(None,)], "row long")  # the last node has no edges
    return spark.createDataFrame(rows, "row long, neighbour long, weight double"), nodes


@pytest.mark.parametrize("gap, slice_bytes", [(1, 1 << 20), (10**12, 1 << 20), (7, 200)])
def test_product_of_slices_is_the_matrix_product(spark, gap, slice_bytes):
    edges, nodes = graph(spark, gap)
    plain, scales = spectral.plain_edges(edges, nodes)
    known = scales.filter("row is not null").orderBy("row").collect()
    ids = [r["row"] for r in known]
    matrix = np.zeros((len(ids), len(ids)))
    for r in plain.collect():
        if r["row"] in ids and r["neighbour"] in ids:
            matrix[ids.index(r["row"]), ids.index(r["neighbour"])] = r["weight"]
    scale = np.array([r["scale"] for r in known])
    block = np.array([[np.sin(i + 1.0), i % 3 - 1.0] for i in range(len(ids))])
    table = scales.join(spark.createDataFrame([(i, [float(v) for v in b]) for i, b in zip(ids, block)], "row long, block array<double>"), "row", "left")
    product = spectral._product(plain, table, 2, len(ids), slice_bytes)
    text = product._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange") == 1  # that of the sums
    got = {r["row"]: r["w"] for r in product.collect()}
    expected = matrix @ (block * scale[:, None])
    for i, row in enumerate(ids):
        assert np.allclose(got.get(row, [0.0, 0.0]), expected[i])


def test_forgotten_tables_are_deleted(spark):
    df = durable(spark.range(5))
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    kept = durable(df)
    forget(df)
    assert not os.path.exists(folder) and kept.count() == 5


def test_earlier_steps_leave_no_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(spectral, "durable", lambda df, name="table": written.append(durable(df, name)) or written[-1])
    edges, nodes = graph(spark, 1)
    plain, scales = spectral.plain_edges(edges, nodes)
    del written[:]
    spectral.leading_pairs(plain, scales, 3)
    left = [t for t in written if os.path.exists(os.path.dirname(t.inputFiles()[0].removeprefix("file://")))]
    assert len(written) > 3 and len(left) == 1
