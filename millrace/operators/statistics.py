"""Ranks, correlation, tiers and other evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_before(counts: DataFrame, by: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """counts (a row a group and value) with `out`: the sum of weight over smaller values of the group.

    Values are cut into as many blocks as there are shuffle partitions, at approximate quantiles; sums run inside blocks and
    start from those of the blocks before, so no task holds a group.  Null values and groups are left out.
    """
    parts = max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = counts.where(F.col(value).isNotNull())
    bounds = counts.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("cuts"))
    blocked = counts.crossJoin(F.broadcast(bounds)).withColumn("block", F.size(F.filter("cuts", lambda x: x < F.col(value)))).drop("cuts")  # one row
    sizes = blocked.groupBy(*by, "block").agg(F.sum(weight).alias("size"))
    start = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*by, "block", start.alias("start"))  # a row a group and block
    inside = F.sum(weight).over(Window.partitionBy(*by, "block").orderBy(value)) - F.col(weight)
    return blocked.join(starts, [*by, "block"]).withColumn(out, F.col("start") + inside).drop("block", "start")


def quantiles(df: DataFrame, by: Sequence[str], wanted: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """by, and for each column of `wanted` its exact quantiles, interpolated between neighbours, under the names given for the fractions.

    Values are counted per group and column; running counts in blocks of value (`running_before`) say at which values the two
    neighbouring positions of a fraction lie, and an aggregate picks these.  No task holds the values of a group or of the
    table.  Null values don't count, a column without values has null, groups of null are left out; by nothing: one row.
    """
    cells = [F.struct(F.lit(i).alias("q_column"), F.col(c).cast("double").alias("q_value")) for i, c in enumerate(wanted)]
    rows = df.select(*by, F.explode(F.array(*cells)).alias("q")).select(*by, "q.*").where("q_value IS NOT NULL")
    counts = rows.groupBy(*by, "q_column", "q_value").agg(F.count(F.lit(1)).alias("q_n"))
    totals = rows.groupBy(*by, "q_column").agg(F.count(F.lit(1)).alias("q_total"))
    placed = running_before(counts, [*by, "q_column"], "q_value", "q_n", "q_below").join(totals, [*by, "q_column"])
    picked = []
    for i, names in enumerate(wanted.values()):
        mine = F.col("q_column") == i
        for name, fraction in names.items():
            at = (F.col("q_total") - 1) * F.lit(float(fraction))
            holds = lambda p: mine & (F.col("q_below") <= p) & (p < F.col("q_below") + F.col("q_n"))  # noqa: B023, E731
            low, high = (F.max(F.when(holds(p), F.col("q_value"))) for p in (F.floor(at), F.ceil(at)))
            picked.append((low + (high - low) * F.max(F.when(mine, at - F.floor(at)))).alias(name))
    return placed.groupBy(*by).agg(*picked)


def avg_ranks(df: DataFrame, columns: Sequence[str], suffix: str = "_rank", by: Sequence[str] = ()) -> DataFrame:
    """df with average ranks (ties share the mean) of columns over all rows, or over the rows of a group.

    Values are counted first, and running counts are taken over distinct values, in blocks (`running_before`).
    """
    out = df
    for c in columns:
        counts = df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("n"))
        ranks = running_before(counts, by, c, "n", "below").select(*(F.col(g).alias(f"r_{g}") for g in by), F.col(c).alias("v"), (F.col("below") + (F.col("n") + 1) / 2.0).alias(c + suffix))
        on = F.col(c) == F.col("v")
        for g in by:
            on = on & (F.col(g) == F.col(f"r_{g}"))
        out = out.join(ranks, on, "left").drop("v", *(f"r_{g}" for g in by))
    return out


def percentile_of_score(df: DataFrame, by: str, column: str, out: str = "pct") -> DataFrame:
    """df with the percentile rank within the group: 50 * (rows below + rows up to the value + 1) / rows."""
    counts = df.groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(F.col(by).alias("t_by")).agg(F.count(column).alias("total"))
    placed = running_before(counts, [by], column, "n", "below").join(totals, F.col(by) == F.col("t_by"))
    placed = placed.select(F.col(by).alias("p_by"), F.col(column).alias("p_value"), (50 * (2 * F.col("below") + F.col("n") + 1.0) / F.col("total")).alias(out))
    return df.join(placed, (F.col(by) == F.col("p_by")) & (F.col(column) == F.col("p_value")), "left").drop("p_by", "p_value")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rho, the correlation of average ranks."""
    return avg_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b]).agg(F.corr(f"{a}_rank", f"{b}_rank").alias("rho"))


def quantile_tier(df: DataFrame, column: str, q: int = 5, category: str | None = None) -> DataFrame:
    """df with tier: number of distinct inner quantile edges (interpolated) strictly below the value; edges equal to the ends are dropped."""
    keys = [category] if category else []
    inner = {f"cut{i}": i / q for i in range(1, q)}
    edges = quantiles(df, keys, {column: {"lo": 0.0, **inner, "hi": 1.0}}).select(*keys, F.array(*inner).alias("cuts"), "lo", "hi")
    joined = df.join(edges, category) if category else df.crossJoin(F.broadcast(edges))  # one row
    inner = F.filter(F.array_distinct("cuts"), lambda e: (e > F.col("lo")) & (e < F.col("hi")) & (e < F.col(column)))
    return joined.withColumn("tier", F.size(inner)).drop("cuts", "lo", "hi")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: auc by the rank-sum identity; label is 0 or 1."""
    ranked = avg_ranks(df, [score])
    n1, n0 = F.sum(F.col(label).cast("double")), F.sum(1 - F.col(label).cast("double"))
    rank_sum = F.sum(F.when(F.col(label) == 1, F.col(f"{score}_rank")))
    return ranked.agg(((rank_sum - n1 * (n1 + 1) / 2) / F.when(n1 * n0 > 0, n1 * n0)).alias("auc"))


def class_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and what follows from them, per group; 0 where a denominator is 0."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    out = df.groupBy(*by).agg(*(F.sum(c.cast("double")).alias(n) for n, c in (("tp", a & p), ("fp", ~a & p), ("fn", a & ~p), ("tn", ~a & ~p))))

    def ratio(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(0.0)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select(
        *by, "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    error = F.col(predicted) - F.col(actual)
    sse, n = F.sum(error * error), F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.sqrt(sse / n).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.when((n >= 5) & (F.var_pop(actual) > 1e-9), 1 - sse / F.when(F.var_pop(actual) > 0, F.var_pop(actual) * n)).alias("r2"),
    )


def loo_shrinkage(df: DataFrame, key: str, group: str, x: str, y: str, base: str) -> DataFrame:
    """df with shrunk: w * x + (1 - w) * base, w the correlation of x and y (0 at least) over all other rows of the group.

    The correlation without a row follows from the group's sums less the row, so nothing is quadratic.
    """
    terms = {"n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) ** 2, "yy": F.col(y) ** 2, "xy": F.col(x) * F.col(y)}
    sums = df.groupBy(group).agg(*(F.sum(t).alias(f"s_{k}") for k, t in terms.items()))
    out = df.join(sums, group)
    n, sx, sy, sxx, syy, sxy = (F.col(f"s_{k}") - t for k, t in terms.items())
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    r = F.when(spread > 1e-9, (n * sxy - sx * sy) / F.sqrt(spread)).otherwise(0.0)
    weight = F.greatest(r, F.lit(0.0))
    return out.withColumn("weight", weight).withColumn("shrunk", F.col("weight") * F.col(x) + (1 - F.col("weight")) * F.col(base)).drop(*(f"s_{k}" for k in terms))


def kfold(df: DataFrame, key: str, folds: int = 5, out: str = "fold") -> DataFrame:
    """df with fold: rows in the seeded order of their keys are dealt in turn, so that folds differ by a row at most.

    Places are counted inside 4,096 parts of the order, from the number of rows in the parts before.
    """
    rows = df.withColumn("k_seed", F.md5(F.concat_ws("|", F.lit("42"), F.col(key).cast("string")))).withColumn("k_part", F.substring("k_seed", 1, 3))
    sizes = rows.groupBy(F.col("k_part").alias("s_part")).agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("s_part", start.alias("k_start"))  # 4096 rows
    place = F.row_number().over(Window.partitionBy("k_part").orderBy("k_seed")) - 1
    placed = rows.withColumn("k_place", place).join(F.broadcast(starts), F.col("k_part") == F.col("s_part"))
    return placed.select(*df.columns, ((F.col("k_start") + F.col("k_place")) % folds).cast("int").alias(out))


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: fingerprint (the sum of 48-bit hashes of all rows, in decimal, whatever their order) and n; null differs from every value."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    digest = F.md5(F.concat_ws("|", *map(value, columns)))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.sum(number).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def values_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As `table_fingerprint`, of the values' 64-bit hashes instead of their texts, which numbers are slow to turn into."""
    hashed = F.xxhash64(*(c for name in columns for c in (F.col(name), F.col(name).isNull())))  # null alone would be left out
    return df.agg(F.sum(hashed.cast("decimal(20,0)")).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("n"))
