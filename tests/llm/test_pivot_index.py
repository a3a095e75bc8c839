"""Nearest vectors against brute force: recall, order, ties, copies and rows that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import pivot_index
from martwright.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, score int, rank string, block int"


def brute(rows, asks, top):
    fit = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
           if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = {}
    for _, v in fit:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    size = max(sizes, key=lambda s: (sizes[s], s))
    fit = [(i, v) for i, v in fit if len(v) == size]
    out = []
    for place, (query, v) in enumerate(fit):
        if query is None or not asks(query):
            continue
        scores = [((v * w).sum(), i) for k, (i, w) in enumerate(fit) if k != place]
        best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:top]
        out += [(query, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(map(repr, out))


def found(spark, rows, asks, top, **options):
    frame = spark.createDataFrame([(i, v, 1, "r", 2) for i, v in rows], SCHEMA).repartition(3)
    got = pivot_index.nearest_vectors(frame, asks, top, **options).collect()
    return sorted(repr((r.query_id, r["rank"], r.vec_id, np.float64(r.score))) for r in got)


def test_all_rows_that_take_part_are_ranked(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(120)]
    hot = rows[7][1]
    rows += [(200 + i, hot) for i in range(60)] + [(200, hot), (200, hot), (None, hot), (None, rows[3][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (305, [1.0] * 5),
             (310, [float("nan")] + [1.0] * 5), (315, [float("inf")] + [1.0] * 5), (320, [9.0] * 6)]
    want = brute(rows, lambda i: i % 5 == 0, 4)
    for block_bytes, query_bytes in ((1 << 22, 1 << 20), (6 * 8 * 40, 6 * 8 * 5)):
        monkeypatch.setattr(pivot_index, "_BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(pivot_index, "_QUERY_BYTES", query_bytes)
        monkeypatch.setattr(pivot_index, "_QUERY_BLOCKS", 3)
        # with all vectors ranked again the search is exact
        assert found(spark, rows, F.col("vec_id") % 5 == 0, 4, pivots=16, nearest=8) == want


def test_few_rows(spark):
    query = F.col("vec_id") % 20 == 0
    assert found(spark, [], query, 20) == []
    assert found(spark, [(0, None)], query, 20) == []
    assert found(spark, [(0, [1.0, 2.0])], query, 20) == []
    assert found(spark, [(0, [1.0, 2.0]), (3, [2.0, 1.0])], query, 20) == [repr((0, 1, 3, np.float64(4.0)))]


def test_footrule_is_that_of_the_orders():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(50, 8))
    order = pivot_index.PivotOrder.build(vectors[:12], float((vectors**2).sum(axis=1).max()), 5)
    index = pivot_index.IndexBlock.build(
        order, np.arange(50), np.arange(50), np.ones(50, bool), vectors
    )
    near, query = order.of(vectors), order.of(vectors[:1], queries=True)[0]

    def place(order_, pivot):
        return order_.tolist().index(pivot) if pivot in order_ else 5

    plain = [sum(abs(place(query, p) - place(own, p)) for p in range(12)) for own in near]
    assert index.footrule(query).tolist() == plain


def test_greater_products_are_nearer_for_vectors_of_any_length():
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(40, 5)) * rng.uniform(0.1, 9, (40, 1))
    order = pivot_index.PivotOrder.build(vectors, float((vectors**2).sum(axis=1).max()), 40)
    query = rng.normal(size=(1, 5))
    assert order.of(query, queries=True)[0].tolist() == np.argsort(-(vectors @ query[0])).tolist()


def test_near_copies_give_one_pivot():
    rng = np.random.default_rng(3)
    near = rng.normal(size=8) + rng.normal(size=(500, 8)) / 1000
    apart = rng.normal(size=(20, 8))
    chosen = pivot_index.far_apart(np.concatenate([near, apart]), 21)
    assert sum((np.abs(near - p).max(axis=1) == 0).any() for p in chosen) == 1
    assert len(pivot_index.far_apart(np.ones((5, 3)), 4)) == 1


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    got = queries()["op12_nearest_vectors"](spark, folder).collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    of_query = {}
    for r in got:
        of_query.setdefault(r.query_id, []).append(r)
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(of_query) == set(ids[asked].tolist())
    hits = 0
    for q in asked:
        scores = (vectors * vectors[q]).sum(axis=1)
        scores[q] = -np.inf
        own = sorted(of_query[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        at = np.searchsorted(ids, [r.vec_id for r in own])
        assert scores[at].tolist() == [r.score for r in own]
        assert np.lexsort([ids[at], -scores[at]]).tolist() == list(range(20))
        hits += len(set(np.lexsort([ids, -scores])[:20].tolist()) & set(at.tolist()))
    assert hits / (20 * len(asked)) >= 0.95
