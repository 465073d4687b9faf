"""Training, comparing and applying regressors; bootstrap; greedy removal of similar texts."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from ..shared import dropped, shared_path, stored
from .explain import credited, long_contributions
from .reviews import seeded
from .statistics import kfold, regression_metrics
from .todo import perhaps_done


def vectors(df: DataFrame, columns: Sequence[str], marked: Sequence[str] | None = None) -> DataFrame:
    """df with `features`: missing values become -1 and an indicator column each (of `marked` only, if given), as trees can't take them."""
    cells = {"filled": lambda c: F.coalesce(F.col(c), F.lit(-1.0)), "missing": lambda c: F.col(c).isNull().cast("double")}
    made = {f"{c}_{s}": x(c) for c in columns for s, x in cells.items() if s == "filled" or marked is None or c in marked}
    return VectorAssembler(inputCols=list(made), outputCol="features").transform(df.withColumns(made))


def gappy(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that some rows lack and others have: boosted trees need no other indicator.

    They search splits in all features of a node, and a constant feature has none, so without it they are the same.  Forests draw
    features, so they keep all.
    """
    seen = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(c)).alias(f"n_{c}") for c in columns)).first()  # one row
    return [c for c in columns if 0 < seen[f"n_{c}"] < seen["n"]]


def learners(label: str, rounds: int = 600) -> dict:
    """Boosted trees of depth 5, rate .05 and at most `rounds` rounds, fewer if the validation rows stop gaining; a forest; ridge."""
    return {
        "boosted_trees": GBTRegressor(labelCol=label, maxDepth=5, stepSize=0.05, maxIter=rounds, seed=42, validationIndicatorCol="validation", validationTol=0.01),
        "random_forest": RandomForestRegressor(labelCol=label, numTrees=20, maxDepth=6, seed=42),
        "ridge": LinearRegression(labelCol=label, elasticNetParam=0.0, regParam=1.0),
    }


def folded(df: DataFrame, key: str, columns: Sequence[str], folds: int = 5, sets: Mapping[str, tuple[Sequence[str], Sequence[str] | None]] | None = None) -> DataFrame:
    """df with features, fold (`kfold`) and validation (a tenth of the rows, by a hash of the key); written once for all fits.

    sets: names, columns and marked ones of `vectors`, if not `features` of all columns alone.
    """
    out = kfold(df, key, folds).withColumn("validation", F.pmod(F.xxhash64(seeded(key, seed="v")), F.lit(10)) == 0)
    for name, (own, marked) in (sets or {"features": (columns, None)}).items():  # after the folds, as vectors need not be shuffled
        out = vectors(out, own, marked).select(*out.columns, F.col("features").alias(name))
    return stored(out, "folded")


def _fitted(ready: DataFrame, label: str, learner: str, folds: int, rounds: int, features: str = "features") -> tuple[DataFrame, list[float]]:
    """Out-of-fold predictions and the seconds of each fit; the fits of the folds run side by side."""
    ready = ready.withColumn("features", F.col(features))

    def fit(i: int) -> tuple[DataFrame, float]:
        began = time.time()
        model = learners(label, rounds)[learner].fit(ready.where(F.col("fold") != i))
        return model.transform(ready.where(F.col("fold") == i)), time.time() - began

    with ThreadPoolExecutor(folds) as pool:
        parts = list(pool.map(fit, range(folds)))
    return reduce(DataFrame.unionByName, [p for p, _ in parts]), [t for _, t in parts]


def out_of_fold(df: DataFrame, key: str, label: str, columns: Sequence[str], learner: str = "boosted_trees", folds: int = 5, rounds: int = 600) -> DataFrame:
    """df with fold and prediction, each row predicted by a model of the other folds; a tenth of these stops boosting early."""
    return out_of_folds(df, key, [label], columns, learner, folds, rounds)[label]


def out_of_folds(df: DataFrame, key: str, labels: Sequence[str], columns: Sequence[str], learner: str = "boosted_trees", folds: int = 5, rounds: int = 600) -> dict[str, DataFrame]:
    """`out_of_fold` of each label; the folds are dealt and the features written once for all."""
    ready = folded(df, key, columns, folds, {"features": (columns, gappy(df, columns) if learner == "boosted_trees" else None)})
    return {label: _fitted(ready, label, learner, folds, rounds)[0].select(*df.columns, "fold", "prediction") for label in labels}


def out_of_fold_sets(df: DataFrame, key: str, label: str, sets: Mapping[str, Sequence[str]], folds: int = 5, rounds: int = 600) -> dict[str, DataFrame]:
    """`out_of_fold` by boosted trees with each of the sets of columns; the folds are dealt and the features written once for all."""
    columns = list(dict.fromkeys(c for own in sets.values() for c in own))
    marked = gappy(df, columns)
    ready = folded(df, key, columns, folds, {f"features_{name}": (own, marked) for name, own in sets.items()})
    return {name: _fitted(ready, label, "boosted_trees", folds, rounds, f"features_{name}")[0].select(*df.columns, "fold", "prediction") for name in sets}


def compare(df: DataFrame, key: str, label: str, columns: Sequence[str], folds: int = 5, rounds: int = 600) -> DataFrame:
    """(learner, fold, rmse, mae, r2, fit_seconds) of every learner on the same folds."""
    ready, parts = folded(df, key, columns, folds, {"tree_features": (columns, gappy(df, columns)), "features": (columns, None)}), []
    for name in learners(label):
        out, seconds = _fitted(ready, label, name, folds, rounds, "tree_features" if name == "boosted_trees" else "features")
        metrics = regression_metrics(out, label, "prediction", ["fold"])
        parts.append(metrics.withColumn("learner", F.lit(name)).withColumn("fit_seconds", F.element_at(F.array(*map(F.lit, seconds)), F.col("fold") + 1)))
    return reduce(DataFrame.unionByName, parts)


def linear_contributions(df: DataFrame, key: str, label: str, columns: Sequence[str]) -> DataFrame:
    """(key, feature, contribution) of a ridge model: weight times distance from the mean."""
    model = learners(label)["ridge"].fit(df if "features" in df.columns else vectors(df, columns))
    means = df.agg(*(F.avg(F.coalesce(F.col(c), F.lit(-1.0))).alias(c) for c in columns)).first()
    weights = model.coefficients.toArray()[::2]
    parts = [F.struct(F.lit(c).alias("feature"), ((F.coalesce(F.col(c), F.lit(-1.0)) - means[c]) * float(w)).alias("contribution")) for c, w in zip(columns, weights)]
    return df.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.feature", "p.contribution")


def tree_tables(model: RandomForestRegressionModel) -> list[dict[str, np.ndarray]]:
    """Of each tree of a saved forest, arrays by node: value, left and right child (-1 in leaves), feature, threshold."""
    spark = SparkSession.getActiveSession()
    path = shared_path(spark, "forest")
    model.save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # trees * 2 ** depth nodes at most
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r.treeID, []).append(r)
    out = []
    for _, nodes in sorted(trees.items()):
        nodes.sort(key=lambda r: r.id)
        column = lambda f: np.array([f(r) for r in nodes])
        out.append({
            "value": column(lambda r: r.prediction), "left": column(lambda r: r.leftChild), "right": column(lambda r: r.rightChild),
            "feature": column(lambda r: r.split.featureIndex), "threshold": column(lambda r: (r.split.leftCategoriesOrThreshold or [0.0])[0]),
        })
    return out


def path_contributions(x: np.ndarray, trees: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Contributions of the features of each row, and the forest's base: on the way down a tree, what each split adds to the node's value
    is credited to the split's feature.  Base and contributions add up to the prediction."""
    flat, out, base = np.ascontiguousarray(x).ravel(), np.zeros(x.size), 0.0
    for t in trees:
        base += t["value"][0] / len(trees)
        children = np.stack([t["right"], t["left"]], 1).ravel()
        start, node = np.arange(len(x)) * x.shape[1], np.zeros(len(x), int)
        while True:
            inner = t["left"][node] >= 0
            start, node = start[inner], node[inner]
            if not len(node):
                break
            place = start + t["feature"][node]
            below = children[2 * node + (flat[place] <= t["threshold"][node])]
            out[place] += (t["value"][below] - t["value"][node]) / len(trees)  # a row occurs once
            node = below
    return out.reshape(x.shape), base


def tree_contributions(df: DataFrame, key: str, label: str, columns: Sequence[str], model: RandomForestRegressionModel | None = None) -> DataFrame:
    """(key, feature, contribution) of a forest by its paths; a column's own and its missing-value feature are added up.

    df may have the `features` that `vectors` makes of the columns, here and in `linear_contributions`: then they are not made again.
    """
    ready = df if "features" in df.columns else vectors(df, columns)
    model = learners(label)["random_forest"].fit(ready) if model is None else model
    trees = tree_tables(model)
    return long_contributions(credited(ready, [key], columns, lambda: lambda x: path_contributions(x, trees)[0]), [key], columns)


#: Distribution function of Poisson(1).
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def poisson_weights(hashes: np.ndarray, first: int, end: int) -> np.ndarray:
    """Counts of rows (by a hash of their key) in the replicates first to end - 1, Poisson(1) by a hash of both: a row each replicate."""
    x = hashes.astype(np.uint64)[None, :] ^ (np.arange(first, end, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53), "right")


def bootstrap(df: DataFrame, key: str, pairs: dict[str, tuple[str, str]], replicates: int = 10_000) -> DataFrame:
    """(statistic, lo, hi): 95 % intervals of correlations under Poisson(1) weights hashed from replicate and key.

    Rows are weighted, not drawn.  Each task multiplies the weights of its rows with their products in numpy and returns a row of
    sums a replicate, so the shuffle has tasks * replicates rows, whatever the size of the table.  With two statistics, their
    difference is added.
    """
    columns = sorted({c for pair in pairs.values() for c in pair})
    terms = [(x,) for x in columns] + [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    names = ["n", *("*".join(t) for t in terms)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, len(names)))
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start : start + 1000]
                values = np.stack([np.ones(len(part)), *(part[list(t)].prod(axis=1).to_numpy(float) for t in terms)], 1)
                for first in range(0, replicates, 500):
                    end = min(first + 500, replicates)
                    total[first:end] += poisson_weights(part["h"].to_numpy().view(np.uint64), first, end) @ values
        yield pd.DataFrame(total, columns=names).assign(b=np.arange(replicates))

    rows = df.where(" and ".join(f"`{c}` is not null" for c in columns)).select(F.xxhash64(key).alias("h"), *(F.col(c).cast("double").alias(c) for c in columns))
    sums = rows.mapInPandas(run, ", ".join(f"`{n}` double" for n in names) + ", b long").groupBy("b").agg(*(F.sum(f"`{n}`").alias(n) for n in names))
    stats = []
    for name, (x, y) in pairs.items():
        n, sx, sy, sxx, syy, sxy = (F.col(f"`{c}`") for c in ("n", x, y, f"{x}*{x}", f"{y}*{y}", "*".join(sorted((x, y)))))
        spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
        stats.append(F.when(spread > 0, (n * sxy - sx * sy) / F.sqrt(spread)).alias(name))
    per = sums.select("b", *stats)
    shown = list(pairs)
    if len(shown) == 2:
        per = per.withColumn("difference", F.col(shown[0]) - F.col(shown[1]))
        shown.append("difference")
    long = per.select(F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("v")) for s in shown))).alias("s")).select("s.*")
    return long.groupBy("statistic").agg(F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"))


@F.pandas_udf(ArrayType(LongType()))
def _wide_sketch(words: pd.Series) -> pd.Series:
    """Longs whose bits are the parities of parts of a set, so that a word in one of two sets alone flips one bit: one to two bits or more a word,
    2 ** k longs, so that halves laid over each other are the sketch of half as many."""

    def sketch(hashes) -> np.ndarray:
        bits = 64 << (max(len(hashes) - 1, 0) // 32).bit_length()
        places = (np.asarray(hashes, np.int64).view(np.uint64) % np.uint64(bits)).astype(np.int64)
        return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)

    return words.map(sketch, na_action="ignore")


def _wide_flips(a: str, b: str) -> Column:
    """Bits in which two wide sketches differ, the longer one folded once; sets of sizes that similar ones may have need no more."""
    least = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda s: F.when(F.size(s) > least, F.zip_with(F.slice(s, F.lit(1), least), F.slice(s, least + 1, least), xor)).otherwise(F.col(s))
    return F.aggregate(F.zip_with(fold(a), fold(b), xor), F.lit(0), lambda n, x: n + F.bit_count(x))


#: Cells in which words are counted, a byte each once they are ranked, whatever the number of words; sets whose words are put in order at once.
CELLS, SETS = 1 << 22, 250


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch, the hashes in their `words` end to end, and how many each has."""
    for start in range(0, batch.num_rows, SETS):
        rows = batch.slice(start, SETS)
        words = rows.column("words")
        yield rows, words.flatten().to_numpy().view(np.uint64), np.diff(words.offsets.to_numpy())


def _cells(words: np.ndarray) -> np.ndarray:
    return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def _word_levels(sets: DataFrame) -> np.ndarray:
    """Levels of all cells, more for more words in them: about 8 a doubling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, words, _ in _flat(batch):
                counts += np.bincount(_cells(words), minlength=CELLS)
        full = np.flatnonzero(counts)
        for some in np.array_split(full, len(full) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["cell", "n"])

    counted = sets.select("words").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    found = counted.select("cell", F.least(F.round(8 * F.log2("n")), F.lit(255)).cast("short").alias("level")).toArrow()  # CELLS rows at most
    levels = np.zeros(CELLS, np.uint8)
    levels[found["cell"].to_numpy()] = found["level"].to_numpy()
    return levels


#: Words that similar sets are asked to share among their first ones, if they have as many.
SHARED = 4


def _prefixes(sets: DataFrame, levels: Broadcast, jaccard: float) -> DataFrame:
    """(word, row, n, after) of the first words of sets of n, as many as leave similar sets no way to share fewer than SHARED, and of the words
    after each.  Words come by the level of their cell and by their hash, an order that all sets share: any would do, but few sets share rare words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for rows, words, n in _flat(batch):
                at = np.repeat(np.arange(len(n)), n)
                # Rows hold their words sorted, so that words alike in these bits keep one order too.
                rank = (at.astype(np.uint64) << np.uint64(53)) | (level[_cells(words)].astype(np.uint64) << np.uint64(45)) | (words >> np.uint64(19))
                words = words[np.argsort(rank, kind="stable")]
                after = np.repeat(np.cumsum(n), n) - np.arange(len(words)) - 1
                size = n[at]
                first = after >= np.ceil(size * jaccard - 1e-9) - SHARED
                columns = [words[first].view(np.int64), rows.column("row").to_numpy()[at[first]], size[first].astype(np.int32), after[first].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "row", "n", "after"])

    return sets.select("row", "words").mapInArrow(run, "word long, row long, n int, after int")


def _candidates(some: DataFrame, among: DataFrame, jaccard: float) -> DataFrame:
    """Pairs (a, b) of rows of `among`, one of them of `some`, that share as many of their first words as similar sets do."""
    one, other = (df.withColumnsRenamed({"row": u, "n": f"n{u}", "after": f"after_{u}"}) for df, u in ((some, "a"), (among, "b")))
    least = jaccard / (1 + jaccard) * (F.col("na") + F.col("nb")) - 1e-9  # similar sets have more words in common
    # From the last of the first SHARED common words on, the others must follow in both.
    met = one.join(other, "word").where("a < b" if some is among else "a <> b").where(SHARED + F.least("after_a", "after_b") > least)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least(F.lit(SHARED), F.ceil(least)).cast("int").alias("need"))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need").select("a", "b")


#: Keys of a set that near copies share with others, and least hashes in each.
BANDS, BAND_HASHES = 8, 8


def _stars(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set and the best one that has the same least hashes in some part of the hash space: nearly all near copies are in one with
    the best of theirs, and a crowd of them makes no more pairs than it has keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BANDS * BAND_HASHES
        for batch in batches:
            for rows, words, n in _flat(batch):
                place = np.repeat(np.arange(len(n)), n) * bins + (words >> np.uint64(32)).astype(np.int64) * bins // (1 << 32)
                least = np.full(len(n) * bins, np.iinfo(np.uint64).max)
                np.minimum.at(least, place, words)
                empty = (least == np.iinfo(np.uint64).max).reshape(len(n), BANDS, BAND_HASHES).all(2)
                mixed = (least ^ (least >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                weights = np.arange(1, 2 * bins, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                keys = ((mixed ^ (mixed >> np.uint64(29))).reshape(len(n), bins) * weights).reshape(len(n), BANDS, BAND_HASHES).sum(2, dtype=np.uint64)
                at = np.nonzero(~empty)[0]
                yield pa.RecordBatch.from_arrays([pa.array(keys[~empty].view(np.int64)), pa.array(rows.column("row").to_numpy()[at])], ["key", "b"])

    keys = texts.mapInArrow(run, "key long, b long").join(sets.select(F.col("row").alias("b"), "score", "uid"), "b")
    best = keys.groupBy("key").agg(F.min_by("b", F.struct((-F.col("score")).alias("falling"), "uid", "b")).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return best.select("key", "a").join(keys.select("key", "b"), "key").where("a <> b").select("a", "b").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, jaccard: float) -> DataFrame:
    """(cat, better, uid) of the pairs (a, b) of rows of sets that are similar: sketches are compared first, word sets only of those that may be."""
    for u in "ab":
        pairs = pairs.join(sets.withColumnsRenamed({"row": u, "cat": f"cat_{u}", "uid": f"u{u}", "score": f"s{u}", "n": f"n{u}", "wide": f"wide_{u}"}), u)
    near = pairs.where("cat_a = cat_b and ua <> ub").where(_wide_flips("wide_a", "wide_b") < (1 - jaccard) / (1 + jaccard) * (F.col("na") + F.col("nb")) + 1e-9)
    near = stored(near.select("a", "b", F.col("cat_a").alias("cat"), "ua", "sa", "ub", "sb"), "near")
    compared = perhaps_done(texts, near.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "row")
    for u in "ba":
        near = near.join(compared.withColumnsRenamed({"row": u, "words": f"w{u}"}), u)
    common = F.size(F.array_intersect("wa", "wb"))
    near = near.where(common > jaccard * (F.size("wa") + F.size("wb") - common))
    # By falling score and then by id, as among copies; a missing score comes first.
    a_first = F.struct((-F.col("sa")).alias("falling"), F.col("ua").alias("uid")) < F.struct((-F.col("sb")).alias("falling"), F.col("ub").alias("uid"))
    return near.select("cat", F.when(a_first, F.col("ua")).otherwise(F.col("ub")).alias("better"), F.when(a_first, F.col("ub")).otherwise(F.col("ua")).alias("uid"))


def _lost(similar: DataFrame) -> DataFrame:
    """(cat, uid) of the texts that are similar to a better one that stays, by rounds: what no better one disputes stays, and what is similar to it goes."""
    open_ = stored(similar, "similar")
    lost = [similar.sparkSession.createDataFrame([], similar.select("cat", "uid").schema)]
    while not open_.isEmpty():
        disputed = open_.select("cat", F.col("uid").alias("better")).distinct()
        gone = stored(open_.join(disputed, ["cat", "better"], "left_anti").select("cat", "uid").distinct(), "gone")
        lost.append(gone)
        rest = open_.join(gone, ["cat", "uid"], "left_anti").join(gone.withColumnRenamed("uid", "better"), ["cat", "better"], "left_anti")
        before, open_ = open_, stored(rest.select("cat", "better", "uid"), "similar")
        dropped(before)
    return reduce(DataFrame.unionByName, lost)


def greedy_dedup(df: DataFrame, category: str, uid: str, score: str, text: str, jaccard: float = 0.7, most: int | None = 400) -> DataFrame:
    """By falling score, a text stays unless its word set is similar to one that stayed; `most` a category, if given.

    Texts of equal word sets (by 128 bits) count as their best one, since the others always go with or because of it.  Texts without words are similar
    to none.  Word sets are written once, and shuffled only where two are compared.  First, sets meet the best of their near copies; those similar to it are
    left aside.  Of the others, similar pairs are found over the rare words they share, with only numbers beside them, and settled by rounds of joins.  A set left
    aside is gone if one it is similar to stayed; one that has none is taken back, meets the others, and all are settled again, so that what stays is
    what the greedy walk keeps, whatever was left aside.
    """
    words = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w, category))))
    rows = df.select(F.col(category).alias("cat"), F.col(uid).alias("uid"), F.col(score).alias("score"), F.coalesce(words, F.array().cast("array<long>")).alias("words"))
    digest = [F.size("words").alias("n"), F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("set"), "words").alias("h2")]
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "cat", "uid", "score", *digest, _wide_sketch("words").alias("wide"), "words"), "words")
    order = F.struct((-F.col("score")).alias("falling"), "uid")
    best = rows.where("n > 0").groupBy("cat", "n", "h1", "h2").agg(F.min_by(F.struct("row", "uid", "score", "wide"), order).alias("best"))
    sets = stored(best.select("cat", "n", "best.*"), "sets")
    named = sets.where("cat is not null and uid is not null").select("row", "cat", "uid", "score", "n", "wide")  # others are similar to none
    texts = rows.select("row", "words")
    theirs = perhaps_done(texts, named, "row")
    levels = sets.sparkSession.sparkContext.broadcast(_word_levels(theirs))
    stars = stored(_similar(_stars(theirs, named), named, texts, jaccard), "stars")
    aside = stored(stars.select("cat", "uid").distinct(), "aside")
    similar = None
    while True:
        undecided = stored(named.join(aside, ["cat", "uid"], "left_anti").select(*named.columns), "undecided")
        among = _prefixes(perhaps_done(texts, undecided, "row"), levels, jaccard)
        some = among if similar is None else _prefixes(perhaps_done(texts, undecided.join(back, ["cat", "uid"], "left_semi"), "row"), levels, jaccard)
        among = among if similar is None else perhaps_done(among, some, "word")
        found = stored(_similar(_candidates(some, among, jaccard), undecided, texts, jaccard), "pairs")
        similar = found if similar is None else similar.unionByName(found)
        lost = _lost(similar.distinct())
        stays = undecided.select("cat", F.col("uid").alias("better")).join(lost.withColumnRenamed("uid", "better"), ["cat", "better"], "left_anti").distinct()
        gone = stars.join(stays, ["cat", "better"], "left_semi").select("cat", "uid").distinct()
        back = stored(aside.join(gone, ["cat", "uid"], "left_anti"), "back")
        if back.isEmpty():
            break
        aside = stored(aside.join(back, ["cat", "uid"], "left_anti"), "aside")
    left_over = rows.where("n = 0").select("cat", "uid", "score").unionByName(sets.select("cat", "uid", "score"))
    left_over = left_over.join(lost.unionByName(aside), ["cat", "uid"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("cat").orderBy(F.desc("score"), "uid"))
    shown = [F.col("cat").alias(category), F.col("uid").alias(uid), F.col("score").alias(score)]
    return left_over.select(*shown) if most is None else left_over.withColumn("nth", nth).where(F.col("nth") <= most).select(*shown, "nth")
