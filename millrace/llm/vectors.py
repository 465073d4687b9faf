"""Near duplicates among embeddings by counting collisions in many sorted one-dimensional projections."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .store import dropped, stored

PROJECTIONS = 40
WINDOW = 1.5  # half a window, in standard deviations of the projected difference of a pair at the threshold
MISSED = 0.001  # share of pairs at the threshold that each of the two tests may miss
STRIP_ROWS = 2048  # a strip has three times as many at most
CELL = 0.02  # width of the cells of the first projection that strips are made of
_CHUNK = 256  # rows of a strip whose counts are held at once


@lru_cache
def directions(dim: int) -> np.ndarray:
    """One direction a column, with normal components: a difference of length d is projected to a normal value of deviation d."""
    return np.random.default_rng([20240811, dim]).standard_normal((dim, PROJECTIONS))


def calibrated(threshold: float) -> tuple[float, float, int]:
    """(reach, half, count): pairs at the threshold differ by no more than `reach` in the first projection, and collide in
    windows of `half` to both sides in `count` of all projections at least, but for the share MISSED each."""
    length = math.sqrt(2 - 2 * threshold)
    one = math.erf(WINDOW / math.sqrt(2))
    chances = [math.comb(PROJECTIONS, i) * one**i * (1 - one) ** (PROJECTIONS - i) for i in range(PROJECTIONS + 1)]
    count = next(c for c in range(PROJECTIONS, -1, -1) if sum(chances[c:]) >= 1 - MISSED)
    low, high = 0.0, 40.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < 1 - MISSED else (low, mid)
    return high * length, WINDOW * length, count


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, length, first projection's cell and bytes of each vector that can have a link, nulls for the others."""
    for batch in batches:
        lists = batch.column("vector")
        sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = lists.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null is NaN, -0.0 is 0.0
        kind = np.float32 if flat.type == pa.float32() else np.float64
        ends = np.cumsum(sizes)
        n = batch.num_rows
        key, cell, vec = [None] * n, [None] * n, [None] * n
        labelled = batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[labelled & (sizes > 0)]):
            at = np.flatnonzero((sizes == dim) & labelled)
            rows = values[(ends[at] - dim)[:, None] + np.arange(dim)]
            fine = np.isfinite(rows).all(1) & (rows != 0).any(1)
            at, rows = at[fine], rows[fine]
            first = np.floor(_unit(rows) @ directions(int(dim))[:, 0] / CELL).astype(int) if len(at) else []
            for i, c, row in zip(at, first, rows.astype(kind)):
                vec[i], cell[i] = row.tobytes(), int(c)
                key[i] = hashlib.blake2b(vec[i], digest_size=16).digest()
        columns = [pa.array(key, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(cell, pa.int32()), pa.array(vec, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], ["vec_id", "label", "key", "dim", "cell", "vec"])


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit vectors x link with which unit vectors y: enough collisions, then the cosine.

    Each projection of y is sorted, and a window around the projection of a row of x is a range of positions in that order.
    """
    _, half, least = calibrated(threshold)
    px, py = x @ directions(x.shape[1]), y @ directions(x.shape[1])
    order = np.argsort(py, axis=0, kind="stable")
    ranked = np.take_along_axis(py, order, 0)
    place = np.empty(py.shape, np.uint16)
    np.put_along_axis(place, order, np.arange(len(y), dtype=np.uint16)[:, None], 0)
    begin = np.stack([np.searchsorted(r, v - half, "left") for r, v in zip(ranked.T, px.T)]).astype(np.uint16)
    width = np.stack([np.searchsorted(r, v + half, "right") for r, v in zip(ranked.T, px.T)]).astype(np.uint16) - begin
    place = np.ascontiguousarray(place.T)
    out = np.zeros((len(x), len(y)), bool)
    for lo in range(0, len(x), _CHUNK):
        hits = np.zeros((len(x[lo : lo + _CHUNK]), len(y)), np.uint8)
        for j in range(PROJECTIONS):
            hits += (place[j] - begin[j, lo : lo + _CHUNK, None]) < width[j, lo : lo + _CHUNK, None]  # before `begin` the difference wraps
        enough = hits >= least
        rows, columns = np.flatnonzero(enough.any(1)), np.flatnonzero(enough.any(0))
        if len(rows):
            out[np.ix_(lo + rows, columns)] = enough[np.ix_(rows, columns)] & (x[lo + rows] @ y[columns].T >= threshold)
    return out


def _forest(links: np.ndarray) -> Iterator[tuple[list[int], list[int]]]:
    """Rows and columns of each connected part of a link matrix."""
    rows, columns = links.any(1), links.any(0)
    while rows.any():
        front = np.array([int(np.argmax(rows))])
        in_rows, in_columns = [front], []
        rows[front] = False
        while len(front):
            across = np.flatnonzero(links[front].any(0) & columns)
            columns[across] = False
            front = np.flatnonzero(links[:, across].any(1) & rows)
            rows[front] = False
            in_columns.append(across)
            in_rows.append(front)
        yield np.concatenate(in_rows).tolist(), np.concatenate(in_columns).tolist()


def _met(group: pa.Table, threshold: float) -> pa.Table:
    """Links between two strips, or within one: per vector its number of links, weighted by copies, and one edge to its part's first."""
    nodes, mult = (group.column(c).to_numpy() for c in ("node", "copies"))
    kind = np.dtype(f"f{len(group.column('vec')[0].as_py()) // group.column('dim')[0].as_py()}")
    vectors = _unit(np.frombuffer(b"".join(group.column("vec").to_pylist()), kind).reshape(len(nodes), -1).astype(np.float64))
    right = group.column("side").to_numpy() == 1
    a, b = np.flatnonzero(~right), np.flatnonzero(right)
    within = not len(b) and group.column("a")[0] == group.column("b")[0]
    if within:
        b = a
    links = linked(vectors[a], vectors[b], threshold)
    if within:
        links |= links.T
        np.fill_diagonal(links, False)
    degree = np.zeros(len(nodes), np.int64)
    degree[a] += links @ mult[b]
    if not within:
        degree[b] += links.T @ mult[a]
    to = nodes.copy()
    for rows, columns in _forest(links.copy()):
        members = np.unique(np.concatenate((a[rows], b[columns])))
        to[members] = nodes[members].min()
    some = degree > 0
    return pa.table({"node": nodes[some], "degree": degree[some], "other": to[some]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept (the row has that id).

    Rows of the same label, not null, link if the cosine of their vectors, in double precision, is the threshold or more.  Vectors
    that are null, empty, zero, or hold a null or non-finite component link with nothing; nor do vectors of different lengths.

    Equal vectors of a label become one with a number of copies.  These are laid in strips along the first of
    PROJECTIONS random directions.  A task takes two strips of a label whose ranges are near enough (or one), sorts each
    projection, counts for every vector of one the windows around it that hold a vector of the other, and verifies the pairs whose
    count is one that all but MISSED of the pairs at the threshold reach; closer pairs reach it more often still.  It returns a
    number of links a vector and a forest of links, never pairs, so a dense group costs rows, not their square; no strip is cut
    short.  The pairs that tasks count do grow with the square of a label's different vectors: one-dimensional windows
    let about half of them be skipped by strips, and no more.

    Rows that repeat an id are rows of their own, so with equal vectors they link with each other; ids that are null sort last, and
    a group of null ids has a null component and is kept.  An empty table gives an empty one; other columns are not read,
    whatever their names.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    rows = stored(rows.mapInArrow(_prepared, "vec_id long, label string, key binary, dim int, cell int, vec binary"), "vectors")
    ids = F.min("vec_id").alias("least_id")
    groups = rows.where("key IS NOT NULL").groupBy("label", "key", "dim", "cell").agg(F.count(F.lit(1)).alias("copies"), ids, F.first("vec").alias("vec"))
    groups = stored(groups.withColumn("node", F.monotonically_increasing_id()), "groups")

    space = ["label", "dim"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*space).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # cells of a bounded range
    cells = groups.groupBy(*space, "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.floor(before / STRIP_ROWS))
    cells = stored(cells.withColumn("parts", F.ceil(F.col("n") / STRIP_ROWS)), "cells")
    strips = cells.select(*space, "cell", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("parts") - 1)).alias("strip"))
    strips = strips.groupBy(*space, "strip").agg(F.min("cell").alias("low"), F.max("cell").alias("high"))
    later = strips.select(*space, F.col("strip").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    reach = calibrated(threshold)[0]
    gap = (F.greatest("low", "b_low") - F.least("high", "b_high") - 1) * CELL
    meetings = strips.withColumnRenamed("strip", "a").join(later, space).where((F.col("b") >= F.col("a")) & (gap <= reach)).select(*space, "a", "b")
    sides = meetings.select(*space, F.col("a").alias("strip"), "a", "b", F.lit(0).alias("side"))
    sides = stored(sides.unionByName(meetings.where("a <> b").select(*space, F.col("b").alias("strip"), "a", "b", F.lit(1).alias("side"))), "meetings")
    placed = groups.join(cells.select(*space, "cell", "start", "parts"), [*space, "cell"])
    placed = placed.select(*space, "node", "copies", "vec", (F.col("start") + F.pmod(F.xxhash64("key"), "parts")).alias("strip"))
    met = placed.join(sides, [*space, "strip"]).groupBy(*space, "a", "b").applyInArrow(lambda g: _met(g, threshold), "node long, degree long, other long")
    met = stored(met, "met")

    degrees = met.groupBy("node").agg(F.sum("degree").alias("degree"))
    parts = components(met.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = groups.join(degrees, "node", "left").join(parts, "node", "left").select(
        F.col("label").alias("g_label"), F.col("key").alias("g_key"), "least_id",
        (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"),
    )
    known = stored(known, "known")
    heads = known.groupBy(F.col("component").alias("head")).agg(F.min("least_id").alias("component_id"))
    known = known.join(heads, F.col("component") == F.col("head")).select("g_label", "g_key", "n_links", "component_id")
    out = rows.select("vec_id", "label", "key").join(known, (F.col("label") == F.col("g_label")) & (F.col("key") == F.col("g_key")), "left")
    component = F.when(F.col("g_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    dropped(sides)
    dropped(cells)
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
