"""The operators on embeddings against numpy, on clusters, copies, odd rows and no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import opsdiff.llm.collisions as collisions
import opsdiff.llm.hard_negatives as negatives
from opsdiff.llm import vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def made(n=400, dims=16, seed=3):
    """Clusters of near copies of many sizes, exact copies, and single vectors."""
    random = np.random.default_rng(seed)
    centres = random.standard_normal((30, dims))
    rows = []
    for i in range(n):
        base = centres[i * i % 30] + random.standard_normal(dims) * random.choice([0.05, 0.2, 0.6])
        rows.append([i, base.astype(np.float32).tolist(), int(i * i % 30 % 4)])
    for i in range(40):
        rows.append([n + i, rows[3][1], rows[3][2]])       # one vector very often
        rows.append([n + 100 + i, [2 * x for x in rows[3][1]], rows[3][2]])  # and twice as long
    return rows


ODD = [
    [None, [0.5] * 16, 1], [2001, None, 1], [2002, [0.5] * 16, None], [2003, [0.0] * 16, 1], [2004, [NAN] + [0.5] * 15, 1],
    [2005, [INF] + [0.5] * 15, 1], [2006, [None] + [0.5] * 15, 1], [2007, [], 1], [2008, [0.5] * 3, 1], [2100, [1.0] + [0.0] * 15, 3], [2100, [1.0] + [0.0] * 15, 3],
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made() + ODD, SCHEMA).withColumns({c: F.lit("mine") for c in ("class", "label2", "block", "rank", "weight")}).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def usable(rows, label=True):
    return [r for r in rows if r[1] is not None and len(r[1]) == 16 and all(x is not None and np.isfinite(x) for x in r[1]) and (r[2] is not None or not label)]


# Helpers

def test_hilbert_neighbours_differ_in_one_step():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    place = vectors.hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("dims", [1, 2, 5, 40, 90])
def test_spectral_split_gives_the_greatest_eigenvalues(dims):
    random = np.random.default_rng(dims)
    a = random.standard_normal((dims, 3 * dims)) * np.geomspace(1, 1e4, dims)[:, None]
    a = a @ a.T
    values, found = whitening.leading(a, 8)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:8], rtol=1e-9, atol=1e-12 * np.linalg.norm(a))
    assert np.abs(found.T @ found - np.eye(found.shape[1])).max() < 1e-13
    assert np.linalg.norm(a @ found - found * values) < 1e-12 * np.linalg.norm(a)


def test_tied_and_empty_spectra():
    for a in (np.eye(9), np.zeros((4, 4)), np.diag([1.0, 0, -1]), np.diag([5.0] * 6 + [1.0] * 6), np.ones((7, 7))):
        values, found = whitening.leading(a, 8)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:8], atol=1e-12)
        assert np.allclose(a @ found, found * values, atol=1e-12)


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar(a)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-12 and np.linalg.eigvalsh(u @ a).min() > -1e-10


# Whitening

def test_whitening_equals_numpy(spark, table):
    got = whitening.whiten(table).toPandas()
    rows = usable(made() + ODD, label=False)
    x = np.floor(1024 * np.array([r[1] for r in rows], float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, own = np.linalg.eigh(centred.T @ centred / n)
    values, own = values[::-1][:8], own[:, ::-1][:, :8]
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.max() < 1e-9
    want = {}
    for r, w, d in zip(rows, centred @ own / np.sqrt(values), ((n * x - total) ** 2).sum(axis=1), strict=True):
        want.setdefault(r[0] if r[0] is not None else -1, []).append((int(d), np.abs(w)))
    for vec_id, group in got.groupby(got.vec_id.fillna(-1).astype(int)):
        own_rows = want[vec_id]
        for k, part in group.groupby("component"):
            assert set(part.deviation) == {d for d, _ in own_rows}
            assert np.allclose(np.sort(np.abs(part.whitened)), np.sort([w[k - 1] for _, w in own_rows]), atol=1e-8)
    share = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, values / np.trace(centred.T @ centred / n), rtol=1e-9)


def test_whitening_of_few_equal_and_no_rows(spark, none):
    assert whitening.whiten(none).count() == 0
    same = spark.createDataFrame([[i, [0.25, 0.5], 1] for i in range(9)], SCHEMA)
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([[i, [0.1 * i, 0.2 * i, 0.0], 1] for i in range(9)], SCHEMA)
    got = whitening.whiten(line).toPandas()
    assert got.component.max() <= 2 and got.identity_error.max() < 1e-4
    large = spark.createDataFrame([[1, [3e38, 1.0], 1], [2, [-3e38, 2.0], 1], [3, [0.0, 3.0], 1]], SCHEMA)
    got = whitening.whiten(large).toPandas()
    assert set(got.n) == {3} and got.deviation.isna().any()


# Near-dedup

def brute_links(rows):
    rows = [r for r in usable(rows) if any(r[1])]
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (v @ v.T >= collisions.SIMILARITY) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    ids = np.array([r[0] if r[0] is not None else 1 << 60 for r in rows])
    least = ids.copy()
    while True:
        near = np.minimum(least, np.where(linked, least[None, :], 1 << 61).min(axis=1))
        if (near == least).all():
            return rows, linked.sum(axis=1), least
        least = near


def test_near_duplicates_equal_brute_force(table):
    rows, number, least = brute_links(made() + ODD)
    want = {}
    for r, n, c in zip(rows, number, least, strict=True):
        want.setdefault(r[0], []).append((int(n), int(c)))
    got = collisions.near_duplicates(table).collect()
    assert len(got) == len(made()) + len(ODD)
    found = sum(r["n_links"] for r in got)
    assert found <= number.sum() and found >= 0.98 * number.sum()
    same = 0
    for r in got:
        expected = want.get(r["vec_id"], [(0, r["vec_id"])])
        assert all(r["n_links"] <= n for n, _ in expected)
        same += (r["n_links"], r["component_id"]) in [(n, c if c < 1 << 60 else None) for n, c in expected]
        assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])
    assert same >= 0.95 * len(got)


def test_many_blocks_count_no_pair_twice(table, monkeypatch):
    whole = sorted(map(tuple, collisions.near_duplicates(table).collect()), key=repr)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 32)
    monkeypatch.setattr(collisions, "PACK", 3)
    again = sorted(map(tuple, collisions.near_duplicates(table).collect()), key=repr)
    assert sum(r[1] for r in again) == sum(r[1] for r in whole)
    assert again == whole


def test_recall_of_pairs_that_are_just_similar():
    """Half a window and the count are made for pairs at the threshold itself."""
    random = np.random.default_rng(5)
    for dims in (2, 8, 64, 200):
        a = random.standard_normal((3000, dims))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        side = random.standard_normal(a.shape)
        side -= (side * a).sum(axis=1, keepdims=True) * a
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * side
        rays = collisions.directions(dims)
        counts = (np.abs((a - b) @ rays) <= collisions.half_window(dims, 0.93)).sum(axis=1)
        assert (counts >= collisions.enough(dims, 0.93)).mean() > 0.985


def test_far_pairs_seldom_reach_the_count():
    random = np.random.default_rng(6).standard_normal((600, 64))
    lines = collisions.unit(random) @ collisions.directions(64)
    maybe = collisions.colliding(lines, lines, collisions.half_window(64, 0.93), collisions.enough(64, 0.93))
    assert maybe.diagonal().all() and maybe.mean() < 0.02


def test_near_duplicates_of_nothing(none, spark):
    assert collisions.near_duplicates(none).count() == 0
    lone = spark.createDataFrame([[7, None, 1], [8, [], 2], [None, None, None]], SCHEMA)
    assert sorted(map(tuple, collisions.near_duplicates(lone).collect()), key=repr) == sorted([(7, 0, 7, True), (8, 0, 8, True), (None, 0, None, False)], key=repr)


# Hard negatives

def brute_negatives(rows, every=100):
    rows = list({(r[0], tuple(r[1]), r[2]): r for r in usable(rows) if r[0] is not None}.values())
    y = np.floor(256 * np.array([r[1] for r in rows], float)).astype(np.int64)
    ids, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    out = []
    for a in np.flatnonzero(ids % every == 0):
        score = y @ y[a]
        first = lambda of, k: of[np.lexsort((ids[of], -score[of]))[:k]]
        for p in first(np.flatnonzero((label == label[a]) & (np.arange(len(ids)) != a)), 5):
            other = np.flatnonzero((label != label[a]) & (30 * score[p] <= 100 * score) & (100 * score <= 90 * score[p]))
            out += [(int(ids[a]), int(ids[p]), k, int(ids[n]), int(score[p]), int(score[n])) for k, n in enumerate(first(other, 10), 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block", [2048, 32])
def test_hard_negatives_equal_brute_force(table, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "PACK", 2 if block == 32 else 512)
    monkeypatch.setattr(negatives, "GROUP", 3 if block == 32 else 256)
    got = sorted(map(tuple, negatives.mine(table, every=10).select(*COLUMNS).collect()))
    assert got == brute_negatives(made() + ODD, every=10) and got


def test_shifted_labels_and_large_scores(spark):
    table = spark.createDataFrame([[7, [1.0], 9], [8, [1.0], 9], [14, [1.0], None], [None, [1.0], 4], [0, [1.0], 2147483647]], SCHEMA)
    assert [r["label"] for r in negatives.shifted_labels(table).collect()] == [0, 9, None, 4, 8]
    a = np.array([[1 << 23, -(1 << 23)]])
    assert negatives.products(a, a).tolist() == [[1 << 47]] and negatives.products(a * 64, a * 64).tolist() == [[1 << 59]]


def test_hard_negatives_of_nothing(none, spark):
    assert negatives.mine(none).count() == 0
    lone = spark.createDataFrame([[100, [1.0, 2.0], 1], [5, [1e30, 1.0], 2], [200, None, 1]], SCHEMA)
    assert negatives.mine(lone).count() == 0


def test_bounds_hold_all_scores():
    random = np.random.default_rng(2)
    block, anchors = random.integers(-200, 200, (50, 12)), random.integers(-200, 200, (20, 12))
    least, most = negatives.bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
    score = anchors @ block.T
    assert (least <= score).all() and (score <= most).all()
