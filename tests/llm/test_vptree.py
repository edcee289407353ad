import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.llm import vptree


def brute(rows, k, query=lambda i: i is not None and i % 20 == 0):
    """The k nearest ids of every query row of (id, vector) rows, among all rows
    but itself, ties to the smaller id, as sorted (id, nearest) pairs."""
    rows = list(rows.items()) if isinstance(rows, dict) else rows
    x = np.array([v for _, v in rows], float)
    last = [(i is None, i or 0) for i, _ in rows]
    out = []
    for n, (i, _) in enumerate(rows):
        if query(i):
            s = np.zeros(len(rows))
            for c in range(x.shape[1]):
                s += x[:, c] * x[n, c]
            best = sorted((-s[m], last[m], m) for m in range(len(rows)) if m != n)[:k]
            out.append((i, [rows[m][0] for *_, m in best]))
    return sorted(out, key=str)


def answers(spark, rows, k=20, **how):
    """What ``search`` finds, parted into the answers of single query rows."""
    out = []
    for q, found in search(spark, [(i, v, 0) for i, v in rows], k, **how).items():
        by_rank = {}
        for r, v, s in found:
            by_rank.setdefault(r, []).append((v, s))
        for one in zip(*by_rank.values()):
            out.append((q, [v for v, _ in one]))
    return sorted(out, key=str)


def search(spark, rows, k=20, factor=1.0, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in sorted(vptree.nearest(df, F.col("vec_id") % 20 == 0, k, factor, **how).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def vectors(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[: n // 2] *= rng.uniform(0.1, 5, (n // 2, 1)).astype(np.float32)
    if copies:
        x[-copies:] = x[0]
    return {i: x[i].tolist() for i in range(n)}


@pytest.mark.parametrize("n, d, copies, shard_rows", [(400, 3, 0, 100), (700, 8, 0, 8192), (500, 4, 200, 64), (15, 2, 0, 4)])
def test_factor_one_is_exact(spark, n, d, copies, shard_rows):
    rows = vectors(n, d, n, copies)
    got = search(spark, [(i, v, 0) for i, v in rows.items()], shard_rows=shard_rows)
    want = dict(brute(rows, 20))
    assert {q: [v for _, v, _ in r] for q, r in got.items()} == want
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        for _, v, s in found:
            assert s == pytest.approx(float(np.dot(np.array(rows[q], float), np.array(rows[v], float))), abs=1e-12)


def test_pruning_spares_work_and_a_factor_spares_more():
    x = np.random.default_rng(1).normal(size=(4000, 3))
    tree = vptree.Tree(x)
    exact = tree.search(x[:50], 5, 1.0)
    wide = tree.search(x[:50], 5, 3.0)
    assert wide[-1] < exact[-1] < 50 * 4000 / 4
    far = np.linalg.norm(x[:50, None] - x, axis=2)
    assert (np.sort(exact[1][np.argsort(exact[0], kind="stable")].reshape(50, 5), axis=1) == np.sort(np.argsort(far, axis=1)[:, :5], axis=1)).all()


def test_recall_of_the_query(spark, sf):
    from pagegrain.llm.queries import op9_vantage_point_trees

    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = dict(brute(rows, 20))
    got = {}
    for r in op9_vantage_point_trees(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[q] & set(w)) for q, w in want.items())
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (6, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1), (7, [2.0, 1.0], 1), (7, [2.0, 1.0], 1), (9, [1.0, 2.0, 3.0], 1), (20, [0.0, 1.0], 1)]
    assert {q: [v for _, v, _ in r] for q, r in search(spark, rows).items()} == {0: [7, 7, None, 20], 20: [7, 7, None, 0]}
    assert search(spark, []) == {} and search(spark, [(0, [1.0], 1)]) == {}
    with pytest.raises(ValueError):
        search(spark, rows, factor=0.5)


def test_a_huge_vector_does_not_blur_the_others(spark):
    x = np.random.default_rng(5).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[299] = 0
    x[299, 0] = 1e9
    rows = {i: v.tolist() for i, v in enumerate(x)}
    got = search(spark, [(i, v, 0) for i, v in rows.items()])
    assert {q: [v for _, v, _ in r] for q, r in got.items()} == dict(brute(rows, 20))


def test_the_most_frequent_dimension_stays(spark):
    rows = [(0, [1.0, 2.0, 3.0], 1), (20, [1.0, 0.0], 1), (40, [2.0, 1.0], 1), (41, [0.0, 1.0], 1)]
    assert {q: [v for _, v, _ in r] for q, r in search(spark, rows).items()} == {20: [40, 41], 40: [20, 41]}


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_ties_go_to_the_smaller_id(spark, shard_rows):
    rng = np.random.default_rng(3)
    small = [(i, [float(c) for c in rng.integers(-2, 3, 3)]) for i in range(400)]
    small = [(i, v) for i, v in small if any(v)]
    assert answers(spark, small, shard_rows=shard_rows) == brute(small, 20)


def test_all_scores_equal(spark):
    rng = np.random.default_rng(9)
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, *map(float, rng.normal(size=2).astype(np.float32))]) for i in range(1, 400)]
    assert [v for _, v, _ in search(spark, [(i, v, 0) for i, v in rows])[0]] == list(range(1, 21))


@pytest.mark.parametrize("shard_rows", [5, 8192])
def test_rows_that_repeat_an_id_or_all_of_it(spark, shard_rows):
    rows = [(20, [1.0, 2.0])] * 3 + [(20, [2.0, 1.0])] * 2 + [(7, [3.0, 0.0]), (7, [0.0, 3.0])] + [(None, [1.0, 1.0])] * 2 + [(1, [2.0, 1.0])] * 30 + [(3, [-0.0, 1.0]), (4, [0.0, 1.0])]
    got = search(spark, [(i, v, 0) for i, v in rows], k=6, shard_rows=shard_rows)
    want = brute(rows, 6)
    assert len(want) == 5 and set(got) == {20} and len(got[20]) == 30
    assert sorted(v or -1 for _, v, _ in got[20]) == sorted(v or -1 for _, r in want for v in r)
    only = [(i, v) for i, v in rows if i != 20] + [(20, [1.0, 2.0])]
    assert answers(spark, only, k=40, shard_rows=shard_rows) == brute(only, 40)


def test_large_groups_of_copies_and_hot_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [1.0, 1.0]) for i in range(1, 300)] + [(5, list(map(float, v))) for v in rng.integers(1, 4, (200, 2))] + [(300, [1.0, 1.0])]
    assert answers(spark, rows, shard_rows=64) == brute(rows, 20)
