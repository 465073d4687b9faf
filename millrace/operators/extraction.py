"""Checking model output and turning aspect scores into features, profiles and estimates."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..shared import stored

MOST_PROVIDERS = 16
_MARK = re.compile(r'["{}]')
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)


def _first_object(text: str | None) -> str | None:
    """From mark to mark (brace or quote): strings are skipped whole."""
    start = at = (text or "").find("{")
    depth = 0
    while at >= 0:
        mark = _MARK.search(text, at)
        if mark is None:
            return None
        at = mark.end()
        if mark[0] == '"':
            end = _STRING_END.match(text, at)
            if end is None:
                return None
            at = end.end()
            continue
        depth += 1 if mark[0] == "{" else -1
        if not depth:
            return text[start:at]
    return None


@F.pandas_udf(StringType())
def json_strip(text: pd.Series) -> pd.Series:
    """The first balanced JSON object in a text, without fences and prose; null if there is none."""
    return text.map(_first_object)


def aspect_aggregates(df: DataFrame, key: str, aspects: Sequence[str], scores: str | None = "scores", confidence: str = "confidence", least: float = 0.3) -> DataFrame:
    """key, <aspect>_mean (null if never mentioned), <aspect>_rate: one pass over the map, or over a column an aspect where scores is None; nothing is exploded."""
    kept = df.where(F.coalesce(F.col(confidence), F.lit(0.0)) >= least)
    columns = []
    for a in aspects:
        score = F.col(a) if scores is None else F.try_element_at(F.col(scores), F.lit(a))
        columns += [F.avg(score).alias(f"{a}_mean"), (F.count(score) / F.count(F.lit(1)).cast("double")).alias(f"{a}_rate")]
    return kept.groupBy(key).agg(*columns)


def aspect_columns(aspects: Sequence[str], confidence: str = "confidence", least: float = 0.3) -> list[Column]:
    """The aggregates of `aspect_aggregates` over a column an aspect, to be taken beside others of all rows; all null if no row is confident."""
    kept, columns = F.coalesce(F.col(confidence), F.lit(0.0)) >= least, []
    rows = F.count_if(kept)
    for a in aspects:
        score = F.when(kept, F.col(a))
        mentions = F.count(score)
        columns += [(F.sum(score) / F.nullif(mentions, F.lit(0))).alias(f"{a}_mean"), (mentions / F.nullif(rows, F.lit(0)).cast("double")).alias(f"{a}_rate")]
    return columns


def long_scores(df: DataFrame, keys: Sequence[str], scores: str = "scores") -> DataFrame:
    """(keys, aspect, score) rows of a map of scores."""
    return df.select(*keys, F.explode(scores).alias("aspect", "score"))


def unpivoted(df: DataFrame, keys: Sequence[str], aspects: Sequence[str], suffix: str) -> DataFrame:
    """(keys, aspect, position, value) rows of the columns <aspect><suffix>."""
    structs = [F.struct(F.lit(a).alias("aspect"), F.lit(i).alias("position"), F.col(a + suffix).alias("value")) for i, a in enumerate(aspects)]
    return df.select(*keys, F.explode(F.array(*structs)).alias("s")).select(*keys, "s.aspect", "s.position", "s.value")


def bridge_estimate(base: Column, price: Column, median: Column, aspect: str) -> Column:
    """Category mean nudged by the price's place: full for value_for_money, three tenths for others; 0..10, one digit."""
    nudge = F.greatest(F.lit(-1.5), F.least(F.lit(1.5), 2 * (median - price) / F.greatest(median, F.lit(1.0))))
    start = F.when(base.isNull() | (base == 0), 5.0).otherwise(base)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), start + nudge * (1.0 if aspect == "value_for_money" else 0.3))), 1)


def pairwise_agreement(df: DataFrame, uid: str, provider: str, aspects: Sequence[str], scores: str = "scores", providers: Sequence[str] | None = None) -> DataFrame:
    """(a, b, n, mean_diff, null_agreement) of every two providers a < b that scored the same rows, over all aspects of a row.

    A row's scores meet in one hash aggregate, a number for each provider and aspect, combined before the shuffle; nothing is
    collected or joined.  Providers that are not given are looked up first; there are a few, MOST_PROVIDERS at most (more are an error).
    A provider that scored a row twice counts with its higher score.
    """
    if providers is None:
        providers = [r[0] for r in df.where(F.col(provider).isNotNull()).select(provider).distinct().limit(MOST_PROVIDERS + 1).collect()]
    if len(providers) > MOST_PROVIDERS:
        raise ValueError(f"more than {MOST_PROVIDERS} providers")
    names = sorted(providers)
    cells = []
    for i, p in enumerate(names):
        mine = F.col(provider) == p
        cells.append(F.max(mine.cast("int")).alias(f"has{i}"))
        cells += [F.max(F.when(mine, F.try_element_at(scores, F.lit(a)))).alias(f"s{i}_{j}") for j, a in enumerate(aspects)]
    met = df.groupBy(uid).agg(*cells)
    sums = []
    pairs = [(i, k) for i in range(len(names)) for k in range(i + 1, len(names))]
    for i, k in pairs:
        both = (F.col(f"has{i}") == 1) & (F.col(f"has{k}") == 1)
        columns = [(F.col(f"s{i}_{j}"), F.col(f"s{k}_{j}")) for j in range(len(aspects))]
        diff = sum((F.coalesce(F.abs(x - y), F.lit(0.0)) for x, y in columns), F.lit(0.0))
        shared = sum(((x.isNotNull() & y.isNotNull()).cast("long") for x, y in columns), F.lit(0))
        alike = sum(((x.isNull() == y.isNull()).cast("long") for x, y in columns), F.lit(0))
        n = F.sum(F.when(both, shared))
        share = F.sum(F.when(both, alike)) / (F.count_if(both) * float(len(aspects)))
        sums.append(F.struct(F.lit(names[i]).alias("a"), F.lit(names[k]).alias("b"), n.alias("n"), (F.sum(F.when(both, diff)) / F.when(n > 0, n)).alias("mean_diff"), share.alias("null_agreement"), F.count_if(both).alias("rows")))
    empty = F.array().cast("array<struct<a:string,b:string,n:bigint,mean_diff:double,null_agreement:double,rows:bigint>>")
    one = met.agg(F.array(*sums).alias("p") if sums else F.first(empty).alias("p"))  # one row
    return one.select(F.explode("p").alias("p")).select("p.*").where("rows > 0").drop("rows")


def evidence(df: DataFrame, uid: str, category: str, most: int = 15, scores: str = "scores") -> DataFrame:
    """(category, aspect, kind, nth, uid): the `most` rows of lowest (pain) and of highest (strength) score; ties by uid.

    Counts per category, aspect and score say at which score `most` rows are reached; only rows up to there are sorted.  These
    scores, a row a category and aspect, are written before rows meet them: as the table is small, the rows are not shuffled for it.
    """
    rows = df.select(uid, category, F.explode(F.map_entries(scores)).alias("e")).where("e.value is not null").select(uid, category, F.col("e.key").alias("aspect"), F.col("e.value").alias("score"))
    counts = rows.groupBy(category, "aspect", "score").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for kind, order in (("pain", F.col("score").asc()), ("strength", F.col("score").desc())):
        before = F.sum("n").over(Window.partitionBy(category, "aspect").orderBy(order)) - F.col("n")  # a row a score
        reached = counts.withColumn("before", before).where(F.col("before") < most).groupBy(F.col(category).alias("k_cat"), F.col("aspect").alias("k_aspect"))
        cut = stored(reached.agg((F.max("score") if kind == "pain" else F.min("score")).alias("cut")), "cuts")
        side = F.col("score") <= F.col("cut") if kind == "pain" else F.col("score") >= F.col("cut")
        near = rows.join(cut, (F.col(category) == F.col("k_cat")) & (F.col("aspect") == F.col("k_aspect"))).where(side)
        nth = F.row_number().over(Window.partitionBy(category, "aspect").orderBy(order, uid))
        parts.append(near.withColumn("nth", nth).where(F.col("nth") <= most).select(category, "aspect", F.lit(kind).alias("kind"), "nth", uid))
    return parts[0].unionByName(parts[1])


def marginal_contributions(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """keys and a column for each feature: slope of the label on that feature alone, times the distance from the feature's mean; 0 where it is null."""
    fits = df.agg(*(f(c).alias(f"{c}_{n}") for c in features for n, f in (("slope", lambda c: F.regr_slope(label, c)), ("avg", F.avg))))
    joined = df.crossJoin(F.broadcast(fits))  # one row
    return joined.select(*keys, *(F.coalesce(F.col(f"{c}_slope") * (F.col(c) - F.col(f"{c}_avg")), F.lit(0.0)).alias(c) for c in features))
