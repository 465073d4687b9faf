"""Exact Shapley values of tree ensembles: what each feature adds to a prediction, averaged over all orders of knowing features."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LeafGames:
    """A row a leaf: its value times its tree's weight, and for each feature on its path the interval that leads to it and the share of training rows that take it.

    A leaf is a game of its own: with a set S of known features its worth is value * product of (in the interval: 1 or 0) over S *
    product of shares over the rest.  Paths with fewer features are filled up with one whose interval and share are everything.
    """

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    @property
    def base(self) -> float:
        return float((self.value * self.share.prod(1)).sum())


def saved_games(spark: SparkSession, path: str) -> LeafGames:
    """The leaves of a tree ensemble saved at path: boosted trees by their weights, a forest by its mean."""
    forest = spark.read.text(f"{path}/metadata").first()[0]
    weights = {r.tree: r.weight for r in spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight").collect()}  # a row a tree
    if "RandomForest" in forest:
        weights = dict.fromkeys(weights, 1 / len(weights))
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # trees * 2 ** (depth + 1) nodes at most
    nodes = {(r.treeID, r.id): r for r in rows}
    leaves = []
    for tree, weight in sorted(weights.items()):
        waiting = [(nodes[tree, 0], {})]
        while waiting:
            node, path_ = waiting.pop()
            if node.leftChild < 0:
                leaves.append((node.prediction * weight, path_))
                continue
            f, cut = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
            low, high, share = path_.get(f, (-math.inf, math.inf, 1.0))
            left, right = nodes[tree, node.leftChild], nodes[tree, node.rightChild]
            total = left.rawCount + right.rawCount
            waiting.append((left, {**path_, f: (low, min(high, cut), share * left.rawCount / total)}))
            waiting.append((right, {**path_, f: (max(low, cut), high, share * right.rawCount / total)}))
    width = max((len(p) for _, p in leaves), default=1) or 1
    filled = [[(f, *p[f]) for f in sorted(p)] + [(0, -math.inf, math.inf, 1.0)] * (width - len(p)) for _, p in leaves]
    cells = np.array(filled, float).reshape(len(leaves), width, 4)
    return LeafGames(np.array([v for v, _ in leaves]), cells[:, :, 0].astype(int), cells[:, :, 1], cells[:, :, 2], cells[:, :, 3])


def shapley_tables(games: LeafGames) -> np.ndarray:
    """[leaf, pattern, place]: the Shapley value of each place on a leaf's path, for every pattern of features that lie in their intervals.

    The worths of all sets of one size without a feature add up to a coefficient of the product over the others of
    (share + known * t), so no set is listed.
    """
    leaves, width = games.share.shape
    known = (np.arange(1 << width)[:, None] >> np.arange(width)) & 1
    out = np.zeros((leaves, 1 << width, width))
    for i in range(width):
        sums = np.zeros((leaves, 1 << width, width))
        sums[:, :, 0] = 1
        for j in range(width):
            if j != i:
                longer = sums * games.share[:, None, j, None]
                longer[:, :, 1:] += sums[:, :, :-1] * known[None, :, j, None]
                sums = longer
        chances = np.array([math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width) for k in range(width)])
        out[:, :, i] = (sums @ chances) * (known[None, :, i] - games.share[:, None, i]) * games.value[:, None]
    return out


def shapley_values(x: np.ndarray, games: LeafGames, tables: np.ndarray) -> np.ndarray:
    """[row, feature]: with the base they add up to the prediction."""
    leaves, width = games.feature.shape
    columns, out = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1])  # a row a feature
    filled = np.isinf(games.low) & np.isinf(games.high)  # everything lies in their interval and they get nothing
    always = filled @ (1 << np.arange(width))
    for leaf in range(leaves):
        pattern, places = np.full(len(x), always[leaf], np.intp), np.flatnonzero(~filled[leaf])
        for i in places:
            at, low, high = columns[games.feature[leaf, i]], games.low[leaf, i], games.high[leaf, i]
            known = at > low if np.isinf(high) else at <= high if np.isinf(low) else (at > low) & (at <= high)
            pattern |= known.astype(np.intp) << i
        for i in places:
            out[games.feature[leaf, i]] += tables[leaf, :, i][pattern]
    return out.T


def tree_shapley(ready: DataFrame, keys: Sequence[str], columns: Sequence[str], games: LeafGames, marked: Sequence[str] | None = None) -> DataFrame:
    """keys, a column of contributions for each of columns, and base; ready: rows with `features` as `models.vectors` makes them of columns and marked.

    A column's own and its missing-value feature are added up.  Base and contributions add up to the prediction of the row.
    """

    def explainer() -> Callable[[np.ndarray], np.ndarray]:
        tables = shapley_tables(games)
        return lambda x: shapley_values(x, games, tables)

    return credited(ready, keys, columns, explainer, marked).withColumn("base", F.lit(games.base))


def credited(ready: DataFrame, keys: Sequence[str], columns: Sequence[str], explainer: Callable[[], Callable[[np.ndarray], np.ndarray]], marked: Sequence[str] | None = None) -> DataFrame:
    """keys and a column of contributions for each of columns, whose own and missing-value features (of all columns, or of marked) are
    added up; a task makes its explainer once, and it turns the features of some rows into as many contributions."""
    first = np.cumsum([0, *(2 if marked is None or c in marked else 1 for c in columns[:-1])])  # places of the own features
    kinds = ", ".join(f"`{k}` {ready.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explain = None
        for batch in batches:
            if batch.num_rows:
                explain = explainer() if explain is None else explain
                parts = explain(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                both = np.ascontiguousarray(np.add.reduceat(parts, first, axis=1).T)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *map(pa.array, both)], [*keys, *columns])

    schema = f"{kinds}, " + ", ".join(f"`{c}` double" for c in columns)
    return ready.select(*keys, vector_to_array("features").alias("x")).mapInArrow(run, schema)


def long_contributions(wide: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, contribution) rows of `tree_shapley`."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("contribution")) for c in columns))
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def aspect_impacts(wide: DataFrame, keys: Sequence[str], aspects: Sequence[str], rate: str = "_rate", most: int = 3) -> DataFrame:
    """keys, top_risks and top_strengths: the `most` aspects that lower and that lift the prediction most, score and mention rate together, to two digits."""
    whole = [F.struct((F.col(a) + F.col(a + rate)).alias("v"), F.lit(i).alias("i"), F.lit(a).alias("aspect")) for i, a in enumerate(aspects)]
    shown = lambda s: F.struct(s["aspect"].alias("aspect"), F.round(F.abs(s["v"]) * s["sign"], 2).alias("impact"))

    def side(sign: int):
        chosen = F.filter(F.array(*whole), lambda s: s["v"] * sign > 0)
        falling = F.array_sort(F.transform(chosen, lambda s: F.struct((-F.abs(s["v"])).alias("o"), s["i"].alias("i"), s["aspect"].alias("aspect"), s["v"].alias("v"), F.lit(sign).alias("sign"))))
        return F.transform(F.slice(falling, 1, most), shown)

    return wide.select(*keys, side(-1).alias("top_risks"), side(1).alias("top_strengths"))
