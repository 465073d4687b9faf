"""Cleaning, selecting and flagging reviews and products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..shared import stored

DAY = 86400


def seeded(*key: str, seed: str = "42") -> Column:
    """A pseudo-random order that depends on the seed and the key alone."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key)))


def global_text_counts(df: DataFrame, text: str = "text", least: int = 4) -> DataFrame:
    """h, n: hashes of normalised texts that occur `least` times or more; hashed before the shuffle."""
    return df.groupBy(T.norm_text_hash(F.col(text)).alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def gauntlet_verdicts(df: DataFrame, product: str, text: str, rating: str, ts: str | None, order: str, english: Column | None = None, distinct_keys: bool = False) -> DataFrame:
    """order, drop_reason (null: kept) of every row of df: the first rule that fails names the drop.

    Entities are decoded first.  Without ts, times are not judged.  A duplicate is a later row of the same product and text among rows that pass all other rules, in
    the order of `order`.  Template texts are those on four rows or more, over all products; with distinct_keys, those of four
    products or more.  Texts are cleaned and hashed once, into a written table of keys, hashes and verdicts (no text) that
    the counts and the ranks read; only rows that pass everything else are ranked, so copies of a template are no group.
    """
    clean = df.select(F.col(product).alias("product"), F.col(order).alias("order"), T.clean_text(F.col(text)).alias("t"), T.rating_or_null(F.col(rating)).alias("r"), (F.lit(0) if ts is None else T.ts_seconds(F.col(ts))).alias("s"))
    words = F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", " ")))
    first = (
        F.when(F.col("t") == "", "empty_after_cleaning")
        .when(F.col("r").isNull(), "bad_rating")
        .when(F.col("s").isNull(), "bad_timestamp")
        .when(words < 10, "too_short")
        .when(words > 400, "too_long")
    )
    last = F.when(~(T.is_english(F.col("t")) if english is None else english), "non_english")
    rows = stored(clean.select("product", "order", F.unhex(T.norm_text_hash(F.col("t"))).alias("h"), first.alias("first"), F.when(first.isNull(), last).alias("last")), "verdicts")
    counted = rows.select("product", "h").distinct() if distinct_keys else rows
    spam = counted.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 3").select(F.col("h").alias("spam_h"))
    told = rows.join(spam, F.col("h") == F.col("spam_h"), "left")
    told = told.withColumn("drop_reason", F.coalesce("first", F.when(F.col("spam_h").isNotNull(), "template_spam"), "last"))
    nth = F.row_number().over(Window.partitionBy("product", "h").orderBy("order"))
    fine = told.where("drop_reason IS NULL").select("order", F.when(nth > 1, "duplicate_in_product").alias("drop_reason"))
    return fine.unionByName(told.where("drop_reason IS NOT NULL").select("order", "drop_reason")).withColumnRenamed("order", order)


def review_gauntlet(df: DataFrame, product: str, text: str, rating: str, ts: str, order: str, english: Column | None = None, distinct_keys: bool = False) -> DataFrame:
    """df with text_clean, ts_clean and drop_reason (null: kept), as `gauntlet_verdicts` says; `order` must tell rows apart."""
    verdicts = gauntlet_verdicts(df, product, text, rating, ts, order, english, distinct_keys).withColumnRenamed(order, "v_order")
    out = df.join(verdicts, F.col(order) == F.col("v_order")).drop("v_order")
    return out.withColumn("text_clean", T.clean_text(F.col(text))).withColumn("ts_clean", T.ts_seconds(F.col(ts))).select(*df.columns, "text_clean", "ts_clean", "drop_reason")


def burst_flag(df: DataFrame, key: str, ts: str, days: int = 14, share: float = 0.4, least: int = 5) -> DataFrame:
    """key, burst: some closed window of `days` ending at a row holds more than `share` of the key's rows.

    Time is cut into buckets as long as the window, so a window lies in a bucket and the one before.  Rows are counted by bucket;
    only where two neighbours together hold more than the share, their rows are counted by second and windows run inside
    (key, bucket) over both: a hot key is as many tasks as it has such buckets.  Rows without a time count for the total alone.
    """
    length = days * DAY
    rows = df.select(F.col(key).alias("b_key"), F.col(ts).cast("long").alias("b_ts"), F.floor(F.col(ts).cast("long") / length).alias("source"))
    by_bucket = Window.partitionBy("b_key").orderBy("source")  # a row a bucket
    before = F.when(F.lag("source").over(by_bucket) == F.col("source") - 1, F.lag("n").over(by_bucket)).otherwise(0)
    counts = rows.groupBy("b_key", "source").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("near", F.col("n") + before).withColumn("total", F.sum("n").over(Window.partitionBy("b_key")))
    counts = stored(counts.withColumn("full", F.col("source").isNotNull() & (F.col("total") >= least) & (F.col("near") > share * F.col("total"))), "buckets")
    wanted = counts.where("full").select("b_key", "total", F.col("source").alias("bucket"), F.explode(F.array(F.col("source"), F.col("source") - 1)).alias("source"))
    close = rows.withColumnRenamed("b_key", "r_key").join(wanted, F.col("r_key").eqNullSafe(F.col("b_key")) & (rows["source"] == wanted["source"]))
    seconds = close.groupBy("b_key", "total", "bucket", "b_ts").agg(F.count(F.lit(1)).alias("n"))
    recent = F.sum("n").over(Window.partitionBy("b_key", "bucket").orderBy("b_ts").rangeBetween(-length, 0))
    bursts = seconds.withColumn("recent", recent).where(F.col("recent") > share * F.col("total")).select(F.col("b_key").alias("burst_key"), F.lit(True).alias("burst")).distinct()
    keys = counts.groupBy("b_key").agg(F.first("total").alias("total"))
    return keys.join(bursts, F.col("b_key").eqNullSafe(F.col("burst_key")), "left").select(F.col("b_key").alias(key), F.coalesce("burst", F.lit(False)).alias("burst"))


def extreme_j(df: DataFrame, key: str, rating: str) -> DataFrame:
    """key, high, low, extreme: nearly all ratings high, some low, hardly any between."""
    high, low = F.avg((F.col(rating) >= 4.5).cast("double")), F.avg((F.col(rating) <= 1.5).cast("double"))
    return df.groupBy(key).agg(high.alias("high"), low.alias("low"), ((high > 0.85) & (low > 0.05) & (1 - high - low < 0.05)).alias("extreme"))


def _in_pairs(jaccard: float):
    part = round(jaccard * 100)

    @F.pandas_udf("int")
    def hits(samples: pd.Series) -> pd.Series:
        """Texts of a sample whose word sets are similar to another one's, from one product of set and word incidences."""

        split: dict[str, list[bytes]] = {}  # each text of the batch once

        def words(text: str) -> list[bytes]:
            if text not in split:
                split[text] = text.encode().split()  # of bytes, blank are 20 and 09 to 0D alone
            return split[text]

        def count(texts) -> int:
            number: dict[bytes, int] = {}
            sets = [{number.setdefault(w, len(number)) for w in words(t)} for t in texts]
            sizes = np.array([len(s) for s in sets])
            has = np.zeros((len(sets), len(number)), np.float32)
            has[np.repeat(np.arange(len(sets)), sizes), [i for s in sets for i in s]] = 1
            common = (has @ has.T).astype(np.int64)
            similar = (100 + part) * common > part * (sizes[:, None] + sizes)  # in whole numbers: 100 * common > part * (sizes - common)
            np.fill_diagonal(similar, False)
            return int(similar.any(1).sum())

        return samples.map(count)

    return hits


def near_duplicates(df: DataFrame, key: str, uid: str, text: str, sample: int = 60, jaccard: float = 0.7, share: float = 0.3, least: int = 5) -> DataFrame:
    """key, dup_share, near_duplicate: share of a seeded sample of texts that are in a pair of similar word sets.

    The sample of a key, at most `sample` texts, meets in one row, so that no pairs are shuffled; a window collects it, as the rows
    of a key lie together already and an aggregate would sort them once more.
    """
    taken = capped(df.select(key, uid, text), key, [F.unhex(seeded(uid)), F.col(uid)], sample)  # pruned before the shuffle
    together = F.collect_list(F.coalesce(F.lower(F.col(text)), F.lit(""))).over(Window.partitionBy(key))
    texts = taken.select(key, "nth", together.alias("texts")).where("nth = 1").drop("nth")  # a sample a row
    ratio = _in_pairs(jaccard)(F.col("texts")) / F.size("texts").cast("double")
    out = texts.select(key, ratio.alias("dup_share"), F.size("texts").alias("n"))
    return out.select(key, "dup_share", ((F.col("n") >= least) & (F.col("dup_share") > share)).alias("near_duplicate"))


def suspect_reasons(df: DataFrame, key: str, uid: str, ts: str, rating: str, text: str) -> DataFrame:
    """key, reasons (of burst, extreme_j, near_duplicates, in this order), suspect (there is a reason), for every key.

    df is read twice: key, time and rating into a slim written table, and texts for the samples.
    """
    slim = stored(df.select(F.col(key).alias("k"), F.col(ts).alias("ts"), F.col(rating).alias("rating")), "slim")
    near = near_duplicates(df, key, uid, text).select(F.col(key).alias("k"), "near_duplicate")
    flags = burst_flag(slim, "k", "ts").join(extreme_j(slim, "k", "rating").select("k", "extreme"), "k").join(near, "k")
    named = {"burst": "burst", "extreme": "extreme_j", "near_duplicate": "near_duplicates"}
    reasons = F.array_compact(F.array(*(F.when(F.col(c), name) for c, name in named.items())))
    return flags.select(F.col("k").alias(key), reasons.alias("reasons"), (F.size(reasons) > 0).alias("suspect"))


def category_terciles(df: DataFrame, category: str, price: str, key: str) -> DataFrame:
    """df with tercile 0, 1, 2 by price position: the first n div 3, up to 2n div 3, the rest.

    Only the prices and keys at a third and at two thirds are needed: rows are counted per category and price, running counts over
    the prices give the two prices, and only rows of these prices are numbered, so a category is no task of its own.
    """
    prices = df.groupBy(category, price).agg(F.count(F.lit(1)).alias("n_at"))
    spread = prices.withColumn("block", F.floor(F.log2(F.greatest(F.col(price).cast("double"), F.lit(1e-9))) * 64).cast("long"))
    blocks = spread.groupBy(category, "block").agg(F.sum("n_at").alias("n_block"))
    order = Window.partitionBy(category).orderBy("block")  # some thousand blocks a category at most
    blocks = blocks.select(F.col(category).alias("b_cat"), F.col("block").alias("b_block"), (F.sum("n_block").over(order) - F.col("n_block")).alias("b_start"), F.sum("n_block").over(Window.partitionBy(category)).alias("n_in"))
    inside = Window.partitionBy(category, "block").orderBy(price)
    starts = spread.join(blocks, F.col(category).eqNullSafe(F.col("b_cat")) & F.col("block").eqNullSafe(F.col("b_block")))
    starts = starts.withColumn("start", F.col("b_start") + F.sum("n_at").over(inside) - F.col("n_at"))
    cuts = [F.floor(F.col("n_in") * i / 3) for i in (1, 2)]
    tier = [F.when(F.col("start") >= c, 1).when(F.col("start") + F.col("n_at") <= c, 0) for c in cuts]  # null: the cut lies among rows of this price
    known = starts.select(F.col(category).alias("k_cat"), F.col(price).alias("k_price"), "start", *(t.alias(f"t{i}") for i, t in enumerate(tier)), *(c.alias(f"c{i}") for i, c in enumerate(cuts)))
    joined = stored(df.join(known, F.col(category).eqNullSafe(F.col("k_cat")) & F.col(price).eqNullSafe(F.col("k_price"))), "priced")
    place = F.col("start") + F.row_number().over(Window.partitionBy("k_cat", "k_price").orderBy(key)) - 1
    clear = joined.where("t0 is not null and t1 is not null").withColumn("tercile", F.col("t0") + F.col("t1"))
    torn = joined.where("t0 is null or t1 is null").withColumn("tercile", (place >= F.col("c0")).cast("int") + (place >= F.col("c1")).cast("int"))
    return clear.unionByName(torn).select(*df.columns, "tercile")


def quota_round_robin(df: DataFrame, category: str, tercile: str, best: Sequence[Column], quota: int) -> DataFrame:
    """The best of each tercile in turn until `quota` rows a category; adds pick (from 1).

    No tercile gives more than `quota` rows, so all but these are pruned before the shuffle.
    """
    ranked = df.withColumn("in_tercile", F.row_number().over(Window.partitionBy(category, tercile).orderBy(*best))).where(F.col("in_tercile") <= quota)
    pick = F.row_number().over(Window.partitionBy(category).orderBy("in_tercile", tercile))
    return ranked.withColumn("pick", pick).where(F.col("pick") <= quota).drop("in_tercile")


def splice_replace(
    old: DataFrame, new: DataFrame, key: str, category: str, gone: Sequence[str], old_reviews: DataFrame, new_reviews: DataFrame, review_key: str
) -> tuple[DataFrame, DataFrame]:
    """(products with origin, reviews): categories in `gone` leave the old products, and so do those whose key is among the new ones,
    which are added; reviews of products that are gone go with them, and new products come with their new reviews."""
    kept = old.where(~F.col(category).isin(*gone)).join(new.select(key), key, "left_anti")
    products = new.withColumn("origin", F.lit("new")).unionByName(kept.withColumn("origin", F.lit("old")))
    staying, added = (df.select(F.col(key).alias("own_key")) for df in (kept, new))
    rows = old_reviews.join(staying, F.col(review_key) == F.col("own_key"), "left_semi")
    return products, rows.unionByName(new_reviews.join(added, F.col(review_key) == F.col("own_key"), "left_semi"))


def capped(df: DataFrame, key: str, order: Sequence[Column | str], most: int) -> DataFrame:
    """At most `most` rows a key, the first of the order; Spark prunes with a window group limit before the shuffle."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= most)


def minmax_in(df: DataFrame, category: str, columns: Sequence[str]) -> DataFrame:
    """df with <column>_mm: (x - min) / (max - min) within the category, 0.5 where it is constant.

    Minima and maxima are a small aggregate that is joined back, so that a large category is not one task.
    """
    bounds = df.groupBy(category).agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(bounds, category)
    for c in columns:
        span = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        out = out.withColumn(f"{c}_mm", F.when(span < 1e-12, 0.5).otherwise((F.col(c) - F.col(f"{c}_lo")) / span))
    return out.drop(*(f"{c}_{n}" for c in columns for n in ("lo", "hi")))


def success_score(df: DataFrame, category: str, weights: dict[str, float]) -> DataFrame:
    """df with success_score: 100 times the weighted sum of min-max scaled columns, to three digits."""
    scaled = minmax_in(df, category, list(weights))
    total = sum((F.col(f"{c}_mm") * w for c, w in weights.items()), F.lit(0.0))
    return scaled.withColumn("success_score", F.round(100 * total, 3))
