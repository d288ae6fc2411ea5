"""Centroid clustering and spelling variants against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from salesflow.llm import centroid_clusters, spelling

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, own int, q int"


def plain_clusters(rows, k=40, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(place(v)[1], []).append(v)
        for j, mine in members.items():
            centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    placed = [(i, *place(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in placed:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in placed), key=str)


def random_vectors(n, seed, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (6, dims))
    return [(i, (centres[i % 6] + rng.normal(0, 0.08, dims)).astype(np.float32).tolist()) for i in range(n)]


def awkward_vectors():
    rows = random_vectors(90, 3)
    one = rows[0][1]
    return rows + [(500, one), (500, one), (3, one), (None, one), (501, None), (502, []), (503, one[:-1]),
                   (504, one[:-1] + [None]), (505, one[:-1] + [float("nan")]), (506, one[:-1] + [float("inf")]),
                   (507, [0.0] * 64), (508, [-300.5] * 64)]


@pytest.mark.parametrize("k,batch_rows", [(40, 7), (5, 4096), (200, 64)])
def test_clusters_match_plain(spark, k, batch_rows):
    rows = awkward_vectors()
    table = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTORS).repartition(5)
    got = centroid_clusters.clusters(table, k=k, batch_rows=batch_rows)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, k)


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None, 1, 2, 3, 4)]):
        assert centroid_clusters.clusters(spark.createDataFrame(rows, VECTORS)).collect() == []


def test_wide_values_are_tabulated_too():
    rng = np.random.default_rng(1)
    q = rng.integers(-10**8, 10**8, (50, 64))
    c = rng.integers(-10**8, 10**8, (9, 64))
    cluster, distance = centroid_clusters.nearest(q, c)
    want = np.square(q[:, None] - c[None]).sum(-1)
    assert (cluster == want.argmin(1)).all() and (distance == want.min(1)).all()


def test_components_out_of_range_raise(spark):
    table = spark.createDataFrame([(1, [1e9] * 64, 1, 2, 3, 4)], VECTORS)
    with pytest.raises(Exception, match="out of range"):
        centroid_clusters.clusters(table).collect()


# ---------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, word string, n int, form string, key int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    mates = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, some in mates.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, words[w], len(mates[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def edited(rng, word):
    letters = "abcdefghéñ÷"
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:i] + ("" if kind == 0 else rng.choice(letters)) + word[i + (kind < 2):]


def variant_docs(seed, stems=25):
    rng = random.Random(seed)
    words = []
    for _ in range(stems):
        stem = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 12)))
        words += [stem] * rng.choice([5, 40, 400])
        for _ in range(8):
            first = edited(rng, stem)
            words += [first] * rng.choice([4, 5, 9, 60]) + [edited(rng, first)] * rng.choice([5, 6])
    rng.shuffle(words)
    return [(i, " ".join(words[i::40]).title() if i % 3 else "-".join(words[i::40])) for i in range(40)]


@pytest.mark.parametrize("seed,bucket_rows", [(1, 2000), (2, 12), (3, 3), (4, 1)])
def test_variants_match_plain(spark, seed, bucket_rows):
    docs = variant_docs(seed)
    table = spark.createDataFrame([(i, t, None, "x", 1, "y", 2) for i, t in docs], DOCS).repartition(4)
    got = spelling.variants(table, bucket_rows=bucket_rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want)


def test_variants_of_awkward_rows(spark):
    docs = [(1, "Receive " * 30), (1, "Receive " * 30), (2, None), (None, "recieve receive\nreceive, recveive " * 6),
            (3, ""), (4, "你好 \U0001F600 12345"), (5, "recei×ve " * 5 + "q" * 300_000),
            (6, ("q" * 300_000 + " ") * 6), (7, "ÉÉÉÉÉÉ " * 5)]
    table = spark.createDataFrame([(i, t, None, "x", 1, "y", 2) for i, t in docs], DOCS)
    assert sorted((tuple(r) for r in spelling.variants(table).collect()), key=str) == plain_variants(docs)
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []


def test_deleted_letters(spark):
    docs = [(i, "similar letters") for i in range(1200)]
    table = spark.createDataFrame([(i, t, None, "x", 1, "y", 2) for i, t in docs], DOCS)
    assert sorted((tuple(r) for r in spelling.variants(table, min_count=1).collect()), key=str) == sorted(
        plain_all(docs), key=str)


def plain_all(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in text.split():
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6}
    top = lambda w: max((v for v in words if near(w, v)), key=words.get, default=None)
    out = []
    for w, n in words.items():
        form = top(w) if top(w) and words[top(w)] >= 5 * n else None
        out.append((w, form, form or w, n, sum(near(w, v) for v in words), words[form] if form else None))
    return out
