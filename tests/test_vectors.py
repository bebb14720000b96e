"""Vector search against plain arithmetic: exact blocks, cells, graphs of neighbours and filters."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.operators import vectors as v
from docloom.plans import catalog

SIZES = ("/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1")


def plain(rows, queries, k, metric="cosine", passes=lambda i: True):
    """{query: [(id, distance)]} by one product."""
    held = [(i, x) for i, x in rows if x is not None and len(x) == 8 and (metric == "l2" or any(x)) and passes(i)]
    out = {}
    for q, y in queries:
        if y is None or len(y) != 8 or (metric == "cosine" and not any(y)):
            continue
        if metric == "cosine":
            d = [(round(1 - float(np.dot(x, y)) / float(np.linalg.norm(x) * np.linalg.norm(y)), 9), i) for i, x in held]
        else:
            d = [(round(float(np.linalg.norm(np.subtract(x, y))), 9), i) for i, x in held]
        out[q] = [i for _, i in sorted(d)[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
        assert r.rank == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    held = [(i, [round(rng.gauss(0, 1), 3) for _ in range(8)]) for i in range(600)]
    held += [(1000 + i, held[7][1]) for i in range(300)]  # equal vectors, a third of the table
    return [*held, (2000, None), (2001, [0.0] * 8), (2002, [1.0] * 5), (2003, [])]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>").withColumn("label", F.col("id") % 10).withColumn("block", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def asked(spark, rows):
    return spark.createDataFrame([(i, x) for i, x in rows if i % 25 == 0] + [(7, rows[7][1]), (2000, None), (2001, [0.0] * 8), (2002, [1.0] * 5)], "query_id long, vector array<float>")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_blocks(df, asked, rows, metric, monkeypatch):
    monkeypatch.setattr(v, "QUERIES", 5)
    monkeypatch.setattr(v, "BLOCK_BYTES", 3000)
    single = [(i, [float(np.float32(a)) for a in x] if x is not None else None) for i, x in rows]
    queries = [(i, x) for i, x in single if i % 25 == 0 or i in (7, 2001, 2002)]
    assert got(v.nearest(df, asked, 12, metric)) == plain(single, queries, 12, metric)
    assert v.nearest(df.where("1 = 0"), asked, 3).collect() == [] and v.nearest(df, asked.where("1 = 0"), 3).collect() == []


def recall(found, exact):
    """Share of the rows that are as near as the exact ones; of equally near rows, any will do."""
    held = {}
    for r in exact.collect():
        held.setdefault(r.query_id, []).append(r.distance)
    hits = sum(r.distance <= max(held[r.query_id]) for r in found.collect())
    return hits / sum(map(len, held.values()))


def test_probe_all_cells_is_exact_and_cells_split(df, asked, monkeypatch):
    monkeypatch.setattr(v, "QUERIES", 9)
    index, centres = retrieval.cells(df.where(F.size("vector") == 8).select("id", "vector"), 6)
    exact = v.nearest(df, asked, 10)
    assert got(v.probe(index, centres, asked, 10, probes=6, cell_rows=50)) == got(exact)
    assert recall(v.probe(index, centres, asked, 10, probes=4), exact) > 0.6


def test_graph_stored_filtered_and_wide(spark, df, asked, tmp_path):
    v.store_graph(v.graph_index(df, keep=["label"], shard_rows=200, m=6, candidates=20), str(tmp_path / "graph"))
    index = v.open_graph(spark, str(tmp_path / "graph"))
    assert index.select("shard").distinct().count() > 3
    exact = v.nearest(df, asked, 10)
    assert recall(v.graph_nearest(index, asked, 10), exact) > 0.95
    assert got(v.graph_nearest(index, asked, 10, width=10**6)) == got(exact)
    rare = F.col("label") == 3
    some = got(v.nearest(df.where(rare), asked, 10))
    found = got(v.graph_nearest(index, asked, 10, width=4, passes=rare, spare=1))
    assert {q: len(i) for q, i in found.items()} == {q: 10 for q in some}  # ten pass, so ten come
    assert got(v.graph_nearest(index, asked, 10, passes=rare, spare=10**6)) == some
    assert v.graph_nearest(index, asked, 10, passes=F.col("label") == 77).collect() == []
    assert sum(map(len, got(v.graph_nearest(index, asked, 10, passes=F.col("id") == 5)).values())) == len(some)


def test_graph_rows_link_to_diverse_neighbours():
    rng = np.random.default_rng(1)
    x = v._unit(np.concatenate([rng.normal(size=(1, 8)).repeat(50, axis=0), rng.normal(size=(150, 8))]))
    table = v._neighbours(x, 5, 30)
    assert table.shape == (200, 12) and all(i not in row for i, row in enumerate(table.tolist()))
    like = x @ x.T
    for i in range(60, 200):  # own choices: the nearest first; each closer to the row than to a chosen one before it, or a filler
        own = [j for j in table[i, :5] if j >= 0]
        assert own[0] == np.argsort(-np.where(np.arange(200) == i, -9, like[i]), kind="stable")[0] or np.isclose(like[i, own[0]], np.delete(like[i], i).max())
    reached, frontier = {0}, [0]
    while frontier:
        frontier = [j for i in frontier for j in table[i].tolist() if j >= 0 and j not in reached and not reached.add(j)]
    assert len(reached) == 200


@pytest.mark.parametrize("path", SIZES)
def test_recall_of_every_fiftieth(spark, path):
    exact = catalog.QUERIES["knn_cosine"](spark, path).where("rank <= 10").cache()
    assert recall(catalog.QUERIES["knn_hnsw"](spark, path), exact) >= 0.9
    assert recall(catalog.QUERIES["knn_ivf"](spark, path), exact) >= 0.9
    filtered = catalog.QUERIES["knn_filtered"](spark, path)
    assert recall(catalog.QUERIES["knn_hnsw_filtered"](spark, path), filtered) >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_a_block_holds_bounded_distances(monkeypatch, metric):
    """However many queries meet a block, only some of their distances are held at once; the answers are those of all at once."""
    rng = np.random.default_rng(5)
    x, q, held = rng.normal(size=(700, 8)), rng.normal(size=(900, 8)), []
    table = lambda name, rows: pa.table([pa.array(range(len(rows))), pa.array(rows.tolist())], names=[name, "vector"])
    distances = v.distances

    def counted(some, queries, metric):
        held.append(8 * len(some) * len(queries))
        return distances(some, queries, metric)

    monkeypatch.setattr(v, "distances", counted)
    monkeypatch.setattr(v, "HELD_BYTES", 1 << 19)
    found = v._block_product(3, 8, metric)(table("id", x), table("query_id", q))
    assert max(held) <= 1 << 19 and sum(held) == 8 * 700 * 900
    order = np.argsort(distances(x, q, metric), axis=0)[:3].T
    assert found["query_id"].to_pylist() == np.repeat(np.arange(900), 3).tolist() and found["id"].to_pylist() == order.ravel().tolist()
