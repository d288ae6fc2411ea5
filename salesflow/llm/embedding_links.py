"""Embedding near-duplicates by an epsilon grid order join.

Two vectors link if their cosine is ``min_cosine`` or more, that is if their
unit vectors are at most epsilon = sqrt(2 - 2 min_cosine) apart. Equal vectors
are first reduced to one row with its number of copies.

Order: unit vectors are projected on the ``leading`` principal dimensions of
the table (the covariance is summed over all vectors in Spark; it has at most
``MOMENT_DIMS`` squared entries). A grid of side epsilon on these dimensions
gives each vector a cell, and vectors are range-partitioned and sorted by the
number of components, cell coordinates and hash: the epsilon grid order.
Places in this order cut it into intervals of about ``interval_cells`` vector
components, whatever the number of partitions.

Join: pairs of intervals are joined recursively. From the whole sequence down,
each pair is replaced by the pairs of its ``FAN`` parts, one Spark join a
level, and pairs whose bounding boxes are further apart than epsilon go; boxes
cover the leading dimensions and the length of the rest of the vector, so
whatever the projection, no linked pair is skipped. The rows of a pair of
intervals that is left meet in one task, of bounded size, which halves both
further in the same way down to blocks of ``leaf`` vectors, then multiplies
the blocks. Cosines within rounding of the limit are computed again with exact
sums. A task returns numbers of links, and a spanning forest of the links for
the components, never all pairs. Where vectors lie in all directions alike, few blocks are
provably distant and the join compares most pairs, in blocks.

Defined cases: a vector that is null, zero or empty, or holds a null or
non-finite component links with nothing, copies included, and is its own component; vectors with
different numbers of components do not link; zeros of either sign are equal. A
null vec_id counts as the largest id and comes out as null; rows that repeat an
id are vectors of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow.llm._common import NULL_ID, materialize, scratch
from salesflow.llm.components import components

# Vector components in an interval, about (8,192 vectors of 64).
INTERVAL_CELLS = 1 << 19
# Parts that an interval of one level has on the next.
FAN = 16
# Vectors of a block that is compared at once.
LEAF = 512
# Components that principal dimensions are taken from; any beyond count to the rest.
MOMENT_DIMS = 256
# Cosines this close to the limit are computed again.
_DOUBT = 1e-12
# Rounding of the projections, added to epsilon squared.
_SLACK = 1e-6


# ---------------------------------------------------------------------------
# Vectors
# ---------------------------------------------------------------------------

def _plain(vectors: DataFrame) -> tuple[Column, Column, str]:
    """The vector with zeros of one sign, whether it can link, and its component type."""
    inner = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if inner == "float" else "double"
    v = F.expr(f"transform(embedding, x -> CAST(x AS {kind}) + CAST(0 AS {kind}))")
    able = F.expr("coalesce(forall(embedding, x -> x IS NOT NULL AND abs(CAST(x AS DOUBLE)) < double('Infinity')) "
                  "AND exists(embedding, x -> x <> 0), false)")
    return v, able, kind


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors (doubles) for every number of components in ``batch``."""
    column = batch.column("v")
    flat = column.flatten().to_numpy().astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        yield rows, flat[starts[rows][:, None] + np.arange(dims)]


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _moments(width: int):
    """Sums of the products and of the components of a task's unit vectors, by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            for _, v in _by_length(batch):
                u = units(v)[:, :width]
                products[:u.shape[1], :u.shape[1]] += u.T @ u
                sums[:u.shape[1]] += u.sum(axis=0)
        values = np.r_[products.ravel(), sums]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])
    return run


def principal_dimensions(classes: DataFrame, leading: int) -> np.ndarray:
    """Orthonormal columns: the directions of largest variance (a bounded matrix reaches the driver)."""
    n, longest = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return np.zeros((1, 1))
    width = min(longest, MOMENT_DIMS)
    got = (classes.select("v").mapInArrow(_moments(width), "place long, value double")
           .groupBy("place").agg(F.sum("value").alias("value")).collect())
    values = np.zeros(width * width + width)
    for r in got:
        values[r.place] = r.value
    mean = values[width * width:] / n
    covariance = values[:width * width].reshape(width, width) / n - np.outer(mean, mean)
    return np.linalg.eigh(covariance)[1][:, ::-1][:, :leading]


def projected(u: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Leading coordinates of unit vectors, and the length of the rest."""
    width = min(u.shape[1], len(basis))
    p = u[:, :width] @ basis[:width]
    return np.c_[p, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", p, p)))]


# ---------------------------------------------------------------------------
# Order
# ---------------------------------------------------------------------------

def _cells(basis: np.ndarray, side: float):
    """Adds ``place`` (bytes that sort like the number of components and the grid cells) and ``box`` coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, box = [None] * batch.num_rows, [None] * batch.num_rows
            for rows, v in _by_length(batch):
                p = projected(units(v), basis)
                cells = np.floor(p[:, :-1] / side) + (1 << 15)
                tails = np.clip(cells, 0, (1 << 16) - 1).astype(">u2")
                head = int(v.shape[1]).to_bytes(4, "big")
                for i, tail, at in zip(rows.tolist(), tails, p.tolist()):
                    place[i], box[i] = head + tail.tobytes(), at
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.binary()), pa.array(box, pa.list_(pa.float64()))],
                [*batch.schema.names, "place", "box"])
    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task, the row's place in it, and the vector components before it."""
    task, rows, cells = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = np.diff(batch.column("v").offsets.to_numpy()).astype(np.int64)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, task, np.int64)), pa.array(np.arange(rows, rows + n)),
             pa.array(cells + np.cumsum(sizes) - sizes)], [*batch.schema.names, "task", "nth", "before"])
        rows, cells = rows + n, cells + int(sizes.sum())


def ordered(classes: DataFrame, basis: np.ndarray, side: float, kind: str, interval_cells: int, folder: str) -> DataFrame:
    """The classes with ``node``, their place in the epsilon grid order, and ``interval``."""
    fields = f"id long, n long, h1 long, h2 long, v array<{kind}>, place binary, box array<double>"
    order = ["place", "h1", "h2"]
    rows = materialize(
        classes.mapInArrow(_cells(basis, side), fields).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_number, fields + ", task long, nth long, before long"), folder + "/ordered")
    # One row a task: where its rows start in the whole order.
    starts = rows.sparkSession.sql("""
        SELECT task AS of, coalesce(sum(n) OVER w, 0) AS first_row, coalesce(sum(cells) OVER w, 0) AS first_cell
        FROM (SELECT task, count(*) AS n, sum(CAST(size(v) AS LONG)) AS cells FROM {rows} GROUP BY task)
        WINDOW w AS (ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", rows=rows)
    return (rows.join(F.broadcast(starts), F.col("task") == F.col("of"))
            .select("id", "n", "h1", "h2", "v", "box", (F.col("first_row") + F.col("nth")).alias("node"),
                    F.expr(f"(first_cell + before) DIV {interval_cells}").alias("interval")))


# ---------------------------------------------------------------------------
# Pairs of intervals
# ---------------------------------------------------------------------------

def interval_pairs(rows: DataFrame, coordinates: int, reach: float, folder: str) -> DataFrame:
    """a, b (a <= b): the pairs of intervals that may hold a link, found from the whole sequence down."""
    bounds = [F.array(*[f(F.col("box")[i]) for i in range(coordinates)]).alias(name)
              for name, f in (("lo", F.min), ("hi", F.max))]
    leaves = materialize(
        rows.groupBy("interval").agg(*bounds, F.min(F.size("v")).alias("short"), F.max(F.size("v")).alias("long")),
        folder + "/boxes")
    last = leaves.agg(F.max("interval")).first()[0] or 0
    levels = 0
    while FAN ** levels <= last:
        levels += 1

    def boxes(level: int, name: str) -> DataFrame:
        part = F.expr(f"interval DIV {FAN ** level}").alias(name)
        whole = [F.array(*[f(F.col(c)[i]) for i in range(coordinates)]).alias(f"{name}_{c}")
                 for c, f in (("lo", F.min), ("hi", F.max))]
        return leaves.groupBy(part).agg(*whole, F.min("short").alias(f"{name}_short"), F.max("long").alias(f"{name}_long"))

    gap = "greatest(0D, a_lo[i] - b_hi[i], b_lo[i] - a_hi[i])"
    close = (f"a_short <= b_long AND b_short <= a_long AND aggregate(sequence(0, {coordinates - 1}), 0D, "
             f"(s, i) -> s + {gap} * {gap}) <= {reach}D")
    pairs = rows.sparkSession.range(1).selectExpr("id AS a", "id AS b")
    for level in range(levels - 1, -1, -1):
        parts = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1))
        finer = pairs.select("b", parts("a").alias("a")).select("a", parts("b").alias("b")).filter("a <= b")
        pairs = materialize(finer.join(boxes(level, "a"), "a").join(boxes(level, "b"), "b").filter(close).select("a", "b"),
                            f"{folder}/pairs-{level}")
    return pairs


# ---------------------------------------------------------------------------
# Inside a task
# ---------------------------------------------------------------------------

def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges u, v connect: from each node to the smallest of its part."""
    names, at = np.unique(np.r_[u, v], return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y):
            np.minimum.at(new, root[side], least)
            np.minimum.at(new, side, least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    move = root != np.arange(len(names))
    return names[move], names[root[move]]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine with exactly rounded sums."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


class Sequence:
    """Consecutive vectors of one length in epsilon grid order."""

    def __init__(self, node: np.ndarray, weight: np.ndarray, v: np.ndarray, basis: np.ndarray):
        self.node, self.weight, self.v, self.u = node, weight, v, units(v)
        self.box, self.links, self._bounds = projected(self.u, basis), np.zeros(len(node), np.int64), {}

    def bounds(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        if (start, stop) not in self._bounds:
            part = self.box[start:stop]
            self._bounds[start, stop] = part.min(axis=0), part.max(axis=0)
        return self._bounds[start, stop]


def _halves(start: int, stop: int, leaf: int) -> list[tuple[int, int]]:
    if stop - start <= leaf:
        return [(start, stop)]
    mid = (start + stop) // 2
    return [(start, mid), (mid, stop)]


def join_sequences(a: Sequence, b: Sequence, min_cosine: float, reach: float,
                   leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between ``a`` and ``b`` (or inside one) as connecting edges; counts them in both."""
    todo = [(0, len(a.node), 0, len(b.node))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if a is b and j1 <= i0:
            continue
        (alo, ahi), (blo, bhi) = a.bounds(i0, i1), b.bounds(j0, j1)
        gap = np.maximum(0.0, np.maximum(alo - bhi, blo - ahi))
        if gap @ gap > reach:
            continue
        if max(i1 - i0, j1 - j0) > leaf:
            todo += [(*x, *y) for x in _halves(i0, i1, leaf) for y in _halves(j0, j1, leaf)]
            continue
        cosine = a.u[i0:i1] @ b.u[j0:j1].T
        x, y = np.nonzero(cosine >= min_cosine - _DOUBT)
        if a is b and i0 == j0:
            x, y = x[x < y], y[x < y]
        if not len(x):
            continue
        doubt = np.flatnonzero(cosine[x, y] < min_cosine + _DOUBT)
        if len(doubt):
            wrong = [k for k in doubt.tolist() if exact_cosine(a.v[i0 + x[k]], b.v[j0 + y[k]]) < min_cosine]
            x, y = np.delete(x, wrong), np.delete(y, wrong)
        x, y = x + i0, y + j0
        np.add.at(a.links, x, b.weight[y])
        np.add.at(b.links, y, a.weight[x])
        yield forest(a.node[x], b.node[y])


def _join(basis: np.ndarray, min_cosine: float, reach: float, leaf: int):
    """kind 0: node, number of links; kind 1: two connected nodes; from rows sorted by tile, interval and node."""
    def sequences(rows: pa.RecordBatch) -> dict[int, Sequence]:
        node, weight = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        return {v.shape[1]: Sequence(node[at], weight[at], v, basis) for at, v in _by_length(rows)}

    def tile(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        interval = rows.column("interval").to_numpy()
        cut = int(np.searchsorted(interval, interval[0], "right"))
        own = rows.column("a")[0].as_py() == rows.column("b")[0].as_py()
        first = sequences(rows.slice(0, cut))
        second = first if own else sequences(rows.slice(cut))
        found = []
        for dims in first.keys() & second.keys():
            found += join_sequences(first[dims], second[dims], min_cosine, reach, leaf)
        if not found:
            return
        u, v = forest(*map(np.concatenate, zip(*found)))
        sides = list(first.values()) + ([] if own else list(second.values()))
        node, links = (np.concatenate([getattr(s, c) for s in sides]) for c in ("node", "links"))
        linked = links > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.zeros(int(linked.sum()), np.int32), np.ones(len(u), np.int32)]),
             pa.array(np.r_[node[linked], u]), pa.array(np.r_[links[linked], v])], ["kind", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # rows of the tile being read
        for batch in batches:
            while batch.num_rows:
                pair = [batch.column(c).to_numpy() for c in ("a", "b")]
                same = (pair[0] == pair[0][0]) & (pair[1] == pair[1][0])
                stop = batch.num_rows if same.all() else int(np.argmin(same))
                if held and [held[0].column(c)[0].as_py() for c in ("a", "b")] != [int(p[0]) for p in pair]:
                    yield from tile(pa.concat_batches(held))
                    held = []
                held.append(batch.slice(0, stop))
                batch = batch.slice(stop)
        if held:
            yield from tile(pa.concat_batches(held))
    return run


# ---------------------------------------------------------------------------
# Operator
# ---------------------------------------------------------------------------

def near_embeddings(vectors: DataFrame, min_cosine: float = 0.9, leading: int = 8,
                    interval_cells: int = INTERVAL_CELLS, leaf: int = LEAF, folder: str | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    if not 0.0 < min_cosine <= 1.0:
        raise ValueError("min_cosine must be above 0 and at most 1")
    folder = folder or scratch(vectors.sparkSession, "embeddings")
    v, able, kind = _plain(vectors)
    every = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), able.alias("able"),
                           v.alias("v"))
    keyed = every.filter("able").select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = materialize(keyed.groupBy("h1", "h2", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
                          .select("id", "n", "h1", "h2", "v"), folder + "/classes")
    basis = principal_dimensions(classes, leading)
    reach = 2.0 - 2.0 * min_cosine + _SLACK
    rows = ordered(classes, basis, math.sqrt(reach), kind, interval_cells, folder)

    pairs = interval_pairs(rows, basis.shape[1] + 1, reach, folder)
    wanted = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("interval"))
    met = wanted.join(rows.select("interval", "node", "n", "v"), "interval")
    found = materialize(met.repartition("a", "b").sortWithinPartitions("a", "b", "interval", "node")
                        .mapInArrow(_join(basis, min_cosine, reach, leaf), "kind int, u long, v long"), folder + "/links")

    links = found.filter("kind = 0").groupBy(F.col("u").alias("linked")).agg(F.sum("v").alias("links"))
    of = components(found.filter("kind = 1").select("u", "v"), folder + "/components")
    named = (rows.select("node", "id", "n", "h1", "h2").join(of, F.col("node") == F.col("u"), "left")
             .join(links, F.col("node") == F.col("linked"), "left")
             .select("id", "h1", "h2", F.coalesce("root", "node").alias("root"),
                     (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    named = materialize(named, folder + "/named")
    # Written, as the facts of the classes are, so that either side of the joins has a shuffle and Spark can
    # split a component or a vector that many rows share.
    least = materialize(named.groupBy("root").agg(F.min("id").alias("component")), folder + "/least")
    facts = materialize(named.join(least, "root").select("h1", "h2", "n_links", "component"), folder + "/facts")
    out = keyed.drop("v").join(facts, ["h1", "h2"]).select("id", "n_links", "component").unionByName(
        every.filter("NOT able").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(shown("id").alias("vec_id"), "n_links", shown("component").alias("component_id"),
                      (F.col("id") == F.col("component")).alias("kept"))
