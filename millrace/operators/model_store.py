"""Fitted models on the shared folder, with the ordered columns they were fitted on and the version of their training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dropped, stored
from .explain import LeafGames, saved_games, tree_shapley
from .models import gappy, learners, vectors
from .reviews import seeded
from .statistics import values_fingerprint

_KINDS = {"boosted_trees": GBTRegressionModel, "random_forest": RandomForestRegressionModel, "ridge": LinearRegressionModel}
_MANIFEST = "kind string, columns array<string>, version string, marked array<string>"


class ManifestError(ValueError):
    """The stored columns are not the ones asked for, in this order."""


@dataclass(frozen=True)
class StoredModel:
    """A loaded model; nothing here fits."""

    spark: SparkSession
    path: str
    kind: str
    columns: tuple[str, ...]
    version: str
    model: object = field(repr=False)
    marked: tuple[str, ...] | None = None  # the columns whose missing-value indicators it was fitted on; None: all

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """df with `out`; columns of the manifest that df lacks are an error of Spark's."""
        scored = self.model.transform(vectors(df, self.columns, self.marked))
        return scored.select(*df.columns, F.col("prediction").alias(out))

    @cached_property
    def games(self) -> LeafGames:
        return saved_games(self.spark, f"{self.path}/model")

    def explain(self, df: DataFrame, keys: Sequence[str], ready: bool = False) -> DataFrame:
        """keys, a contribution a column, and base (`explain.tree_shapley`); ready: df has the `features` of the columns and marked ones already."""
        return tree_shapley(df if ready else vectors(df, self.columns, self.marked), keys, self.columns, self.games, self.marked)


def train(df: DataFrame, path: str, key: str, label: str, columns: Sequence[str], learner: str = "boosted_trees", rounds: int = 600) -> str:
    """Fits on all rows (a tenth, by a hash of the key, says when to stop boosting) and saves model and manifest at path; the version.

    The version is the fingerprint of key, label and columns of the training rows, so the same rows in any order have the same.
    Boosted trees get the indicators of `gappy` columns only.
    """
    marked = gappy(df, columns) if learner == "boosted_trees" else list(columns)
    ready = vectors(df, columns, marked).withColumn("validation", F.pmod(F.xxhash64(seeded(key, seed="v")), F.lit(10)) == 0)
    ready = stored(ready.select("features", F.col(label).cast("double").alias(label), "validation"), "ready")  # fits read it several times
    model = learners(label, rounds)[learner].fit(ready)
    dropped(ready)
    print_ = values_fingerprint(df, [key, label, *columns]).first()
    version = f"{print_.n}-{int(print_.fingerprint or 0) % (1 << 64):x}"
    model.write().save(f"{path}/model")
    df.sparkSession.createDataFrame([(learner, list(columns), version, marked)], _MANIFEST).coalesce(1).write.json(f"{path}/manifest")
    return version


def load(spark: SparkSession, path: str, columns: Sequence[str], version: str | None = None) -> StoredModel:
    """The model saved at path, if its manifest has exactly these columns in this order (and this version, if one is given)."""
    saved = spark.read.schema(_MANIFEST).json(f"{path}/manifest").first()
    if saved is None or saved["columns"] != list(columns):
        first = next((f"{a!r} instead of {b!r}" for a, b in zip(saved["columns"], columns) if a != b), "another number of columns") if saved else "nothing"
        raise ManifestError(f"{path}: the manifest has {first}")
    if version is not None and saved["version"] != version:
        raise ManifestError(f"{path}: version {saved['version']} instead of {version}")
    return StoredModel(spark, path, saved["kind"], tuple(columns), saved["version"], _KINDS[saved["kind"]].load(f"{path}/model"), None if saved["marked"] is None else tuple(saved["marked"]))
