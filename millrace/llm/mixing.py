"""Mixing sources to target weights by Poisson replication; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored, unused

#: Rates per source are broadcast up to this many sources; beyond it they are joined by salted keys, with the same result.
BROADCAST_SOURCES = 20_000
SALTS = 64


def uniform(key: Column, seed: str | Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the key, with 48 bits; null counts as the text 'null'."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    digest = F.md5(F.concat(seed, F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def poisson_inverse(draw: Callable[[Column], Column], rate: Column) -> Column:
    """The smallest n whose Poisson distribution function at the given mean exceeds draw(0), a number in [0, 1).

    Means over 16 are the sum of equal parts of at most 16, part i inverted at a number of its own, draw(i), so that
    exp(-mean) never vanishes.  Every part ends after 100 terms, where its tail is under 1e-40.
    """
    parts = F.greatest(F.lit(1), F.ceil(rate / 16.0)).cast("int")
    mean = rate / parts

    def part(i: Column) -> Column:
        v, first = draw(i), F.exp(-mean)
        start = F.struct(F.lit(0).alias("n"), first.alias("p"), first.alias("c"), v.alias("v"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * mean / k
            more = s["c"] <= s["v"]
            return F.struct(F.when(more, s["n"] + 1).otherwise(s["n"]).alias("n"), p.alias("p"), F.when(more, s["c"] + p).otherwise(s["c"]).alias("c"), s["v"].alias("v"))

        terms = F.least(F.lit(100), F.ceil(mean + 12 * F.sqrt(mean) + 20)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda s: s["n"])

    counts = F.transform(F.sequence(F.lit(0), parts - 1), part)
    return F.when(rate > 0, F.aggregate(counts, F.lit(0), lambda a, b: a + b)).otherwise(0)


def hashed_poisson(key: Column, seed: str, rate: Column) -> Column:
    """A Poisson count of the given mean that depends on seed and key alone."""
    return poisson_inverse(lambda i: uniform(key, F.when(i == 0, seed).otherwise(F.concat(F.lit(f"{seed}/"), i.cast("string")))), rate)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, source_col: str = "source", size_col: str | None = None, text_col: str = "text") -> DataFrame:
    """m_source, amount, rate: how often each document of a source is to appear on average.

    Amounts are characters of text (or size_col).  The mix holds `epochs` times all characters; a source gets its share
    of `weights`, or of its amount to the given power if there are none.  Sources without a weight get rate 0.  Null is
    a source of its own, named by the weight of key None.  A source without any text has rate 0.
    """
    amount = F.col(size_col).cast("double") if size_col else F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("double")
    amounts = docs.groupBy(F.col(source_col).alias("m_source")).agg(F.sum(amount).alias("amount"))
    if weights is None:
        amounts = amounts.withColumn("w", F.when(F.col("amount") > 0, F.pow("amount", F.lit(power))).otherwise(0.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "g_source string, w double")
        amounts = amounts.join(given, F.col("m_source").eqNullSafe(F.col("g_source")), "left").select("m_source", "amount", F.coalesce("w", F.lit(0.0)).alias("w"))
    totals = amounts.agg(F.sum(F.when(F.col("amount") > 0, F.col("w"))).alias("all_w"), F.sum("amount").alias("all_amount"))
    share = F.col("w") / F.col("all_w") * F.col("all_amount") * float(epochs)
    return amounts.crossJoin(F.broadcast(totals)).select("m_source", "amount", F.when((F.col("amount") > 0) & (F.col("all_w") > 0), share / F.col("amount")).otherwise(0.0).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", extras: bool = True) -> DataFrame:
    """docs with every row as often as a Poisson draw of its source's rate says, in a global random order.

    The draw inverts the distribution function at a uniform number hashed from seed and id, so a rerun, another
    partitioning or a lost executor gives the same rows.  Every copy gets its own hashed position.  Positions are uniform, so
    equal parts of [0, 1) are the partitions, no splitters are sampled, and each is sorted.  The documents are read twice:
    for the amounts of sources and for the mix.  Rows of equal id get equal counts; a null id counts as the text 'null'; an
    empty table gives an empty one.  All columns are returned as they are; with `extras`, mix_copy (from 0) and mix_position
    are added, and the caller's columns of these two names are replaced.
    """
    own, rate, number, copy, place, salt = unused(docs, "m_source", "m_rate", "m_number", "m_copy", "m_place", "m_salt")
    rates = stored(source_rates(docs, weights, power, epochs, source_col, None, text_col).select(F.col("m_source").alias(own), F.col("rate").alias(rate)), "rates")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rated = docs.join(F.broadcast(rates), docs[source_col].eqNullSafe(rates[own]))
    else:
        salted = rates.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        spread = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
        rated = spread.join(salted, spread[source_col].eqNullSafe(salted[own]) & (spread[salt] == salted[salt])).drop(spread[salt]).drop(salted[salt])
    counted = rated.withColumn(number, hashed_poisson(F.col(id_col), seed, F.col(rate))).where(F.col(number) > 0)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(number) - 1)))
    key = F.concat_ws("/", F.col(copy).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    placed = copies.withColumn(place, uniform(key, seed + "/order"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = placed.repartitionById(parts, F.floor(F.col(place) * parts).cast("int")).sortWithinPartitions(place)
    kept = [c for c in docs.columns if not extras or c.lower() not in ("mix_copy", "mix_position")]
    return mixed.select(*kept, *([F.col(copy).alias("mix_copy"), F.col(place).alias("mix_position")] if extras else []))
