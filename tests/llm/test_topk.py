import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemill.llm import topk
from tidemill.llm.queries import op5_topk


def brute(rows, k, every):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in reversed(good)}.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "few"), [(8192, 2048, 64), (100, 3, 6)])
def test_whole_table(spark, sf, monkeypatch, block, chunk, few):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", chunk)
    monkeypatch.setattr(topk, "FEW", few)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op5_topk(spark, sf).collect())) == brute(rows, 5, 50)


def test_block_equals_brute_force():
    rng = np.random.default_rng(1)
    for shape, scale in (((900, 8), 40), ((700, 64), 3), ((400, 3), 1), ((300, 5), 0)):
        v = np.floor(rng.standard_normal(shape) * scale).astype(np.int64)
        v[::7] = v[0]  # ties and equal vectors
        ids = rng.permutation(len(v))
        block = topk.Block(ids, v)
        for i in range(0, len(v), 29):
            got = list(zip(*map(np.ndarray.tolist, block.search(int(ids[i]), v[i], 5)), strict=True))
            scores = v @ v[i]
            want = sorted((-int(s), int(j)) for s, j in zip(scores, ids, strict=True) if j != ids[i])[:5]
            assert got == [(j, -s) for s, j in want]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], "x"), (50, [1.0], "x"), (1, None, "x"), (2, [1.0, None], "x"), (3, [float("nan"), 1.0], "x"), (4, [float("inf"), 1.0], "x"), (5, [], "x"), (6, [0.5, -2.0], "x"), (6, [0.5, -2.0], "x"), (100, [0.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == brute([(r[0], r[1]) for r in rows], 5, 50)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_search_stops_on_proof(sf):
    """Random directions are the worst case; still every query leaves postings unread and most rows unscored."""
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    v = np.floor(256 * np.array(rows["embedding"], np.float64)).astype(np.int64)
    ids = np.array(rows["vec_id"])
    block = topk.Block(ids, v)
    for i in np.flatnonzero(ids % 50 == 0).tolist():
        read, rescored = block.read, block.rescored
        got, score = block.search(int(ids[i]), v[i], 5)
        want = [j for j in np.lexsort((ids, -(v @ v[i]))) if ids[j] != ids[i]][:5]
        assert got.tolist() == ids[want].tolist() and score.tolist() == (v @ v[i])[want].tolist()
        assert block.read - read < 0.75 * v.size and block.rescored - rescored < 0.4 * len(v)


def test_far_clusters_are_not_searched():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 32)) * 300
    v = np.floor(np.repeat(centres, 50, axis=0) + rng.standard_normal((400, 32)) * 10).astype(np.int64)
    pivots = topk.Pivots([v[50 * i].tolist() for i in range(8)])
    at, far = pivots.nearest(v)
    assert at.tolist() == [i // 50 for i in range(400)]
    pivots.radius = np.array([far[at == i].max() for i in range(8)])
    scores = v @ v.T
    floor = np.sort(np.where(at[:, None] == at, scores, -(10**15)), axis=1)[:, -6].astype(float)
    reached = pivots.reached(v, floor)
    assert reached.mean() < 0.3
    assert all(reached[i, at[j]] for i, j in zip(*np.nonzero(scores >= floor[:, None]), strict=True))


def test_repeated_query_ids_and_large_components(spark):
    rows = [(0, [3.0, 1.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0**20, 2.0**20]), (50, [2.0**21, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == brute([(0, [1.0, 2.0])] + rows[2:], 5, 50)[:4] + brute(rows, 5, 50)[4:]


def test_more_than_64_bits_is_an_error():
    big = np.array([[2**40, 2**40], [2**39, 5], [1, 1]], np.int64)
    assert topk.products(big, big[0]).tolist() == [2**81, 2**79 + 5 * 2**40, 2**41]
