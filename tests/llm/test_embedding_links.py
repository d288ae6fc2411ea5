"""Embedding near-duplicates against comparing every pair."""

import math

import numpy as np
import pytest

from salesflow.llm import embedding_links

SCHEMA = "vec_id long, embedding array<{}>, label int, id int, node int, a int, kept string"


def table(spark, rows, kind="float", parts=5):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, "x") for i, v in rows], SCHEMA.format(kind)).repartition(parts)


def plain(rows, limit=0.9, kind=np.float32):
    big = 1 << 62
    ids = [big if i is None else i for i, _ in rows]
    vs = []
    for _, v in rows:
        ok = v is not None and all(x is not None and math.isfinite(kind(x)) for x in v) and any(kind(x) for x in v)
        vs.append([float(kind(x)) for x in v] if ok else None)
    cos = lambda a, b: math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(
        math.fsum(x * x for x in a) * math.fsum(y * y for y in b))
    n = len(rows)
    near = {i: [j for j in range(n) if i != j and vs[i] and vs[j] and len(vs[i]) == len(vs[j])
                and cos(vs[i], vs[j]) >= limit] for i in range(n)}
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(ids[j] for j in seen)
        out.append((rows[i][0], len(near[i]), None if least == big else least, ids[i] == least))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clustered(n, seed, dims=12, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6 + 1, dims))
    rows = [(i, (centres[rng.integers(len(centres))] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]
    rng.shuffle(rows)
    return [(int(i), v) for i, v in rows]


@pytest.mark.parametrize("seed,cells,limit", [(1, 1 << 19, 0.9), (2, 100, 0.9), (3, 24, 0.95), (4, 60, 0.6)])
def test_links_match_plain(spark, seed, cells, limit):
    rows = clustered(220, seed)
    want = plain(rows, limit)
    assert sum(r[1] > 1 for r in want) > 20 and sum(not r[3] for r in want) > 10
    assert got(embedding_links.near_embeddings(table(spark, rows), limit, interval_cells=cells, leaf=4)) == want


def test_awkward_vectors(spark):
    one = [0.5, -0.25, 0.0, 1.0]
    rows = [(1, one), (1, one), (7, [-0.0 if x == 0 else x for x in one]), (8, [x * 1e30 for x in one]),
            (9, [x * 1e-30 for x in one]), (None, [x * 3 for x in one]), (None, [5.0, 5.0, -5.0, 0.0]), (2, None),
            (3, []), (4, [0.0] * 4), (5, [0.5, None, 0.0, 1.0]), (6, [0.5, float("nan"), 0.0, 1.0]),
            (10, [float("inf"), 0.0, 0.0, 0.0]), (11, one + [0.0]), (12, [1.0]), (13, [2.0]), (14, [-2.0]),
            (15, [1.0] + [0.0] * 999), (16, [1.0] + [0.0] * 998 + [0.1])]
    want = plain(rows)
    for cells in (1 << 19, 1):
        assert got(embedding_links.near_embeddings(table(spark, rows), interval_cells=cells)) == want
    assert got(embedding_links.near_embeddings(table(spark, rows, "double"))) == plain(rows, kind=float)


def test_limit_is_exact(spark):
    # cosine 0.6 exactly, and the next double below and above in one component
    rows = [(0, [1.0, 0.0]), (1, [3.0, 4.0]), (2, [3.0, math.nextafter(4.0, 5)]), (3, [math.nextafter(3.0, 4), 4.0])]
    assert got(embedding_links.near_embeddings(table(spark, rows, "double"), 0.6)) == plain(rows, 0.6, float)


def test_nothing(spark):
    assert got(embedding_links.near_embeddings(table(spark, []))) == []
    assert got(embedding_links.near_embeddings(table(spark, [(3, None)]))) == [(3, 0, 3, True)]


def test_large_group_stays_small(spark):
    """A third of all vectors near to one another: links are counted, not listed."""
    rng = np.random.default_rng(5)
    near = np.r_[np.ones(1), np.zeros(15)] + rng.normal(0, 0.02, (1500, 16))
    far = rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[near, far])]
    out = {r.vec_id: r for r in embedding_links.near_embeddings(table(spark, rows), interval_cells=1 << 13).collect()}
    u = np.array([v for _, v in rows], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert [out[i].n_links for i in range(len(rows))] == want.tolist()
    assert {out[i].component_id for i in range(1500)} == {0}


def test_forest_connects_the_same():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(2, 60))
        u, v = rng.integers(0, n, (2, int(rng.integers(1, 60))))
        x, y = embedding_links.forest(u, v)
        assert len(x) <= n
        label = lambda p, q: [min(_reach(i, p, q)) for i in range(n)]
        assert label(u, v) == label(x, y)


def _reach(i, u, v):
    seen = {i}
    while True:
        more = {b for a, b in [*zip(u.tolist(), v.tolist()), *zip(v.tolist(), u.tolist())] if a in seen} - seen
        if not more:
            return seen
        seen |= more
