"""What is left to do beside results that only grow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 1 << 20  # of 64 bits: 8 MB, whatever the number of ids
BITS = 4  # of its word that an id sets


def results_since(spark: SparkSession, path: str, day: str, first: str | None = None) -> DataFrame:
    """Results in folders by day, from `first` on: older folders are not read."""
    done = spark.read.parquet(path)
    return done if first is None else done.where(F.col(day) >= F.lit(first).cast(done.schema[day].dataType))


def _word(uid: str) -> Column:
    return F.pmod(F.xxhash64(F.col(uid)), F.lit(WORDS))


def _mask(uid: str) -> Column:
    h = F.xxhash64(F.col(uid), F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return reduce(Column.bitwiseOR, map(bit, range(BITS)))


def bloom(done: DataFrame, uid: str) -> DataFrame:
    """(word, bits): a Bloom filter of the ids, WORDS rows at most; ids are combined before the shuffle."""
    return done.where(F.col(uid).isNotNull()).groupBy(_word(uid).alias("word")).agg(F.bit_or(_mask(uid)).alias("bits"))


def not_done(rows: DataFrame, done: DataFrame, uid: str) -> DataFrame:
    """rows whose uid is not in done (rows without a uid stay).

    A Bloom filter of fixed size goes to every task; rows that it rules out are new and leave at once, and only the others, done or
    taken for it, are shuffled to the ids.  With a done set so large that the filter is full, all rows are: the plain anti-join.
    """
    tested = rows.join(F.broadcast(bloom(done, uid)), _word(uid) == F.col("word"), "left")  # 2 ** 20 rows of 16 bytes at most
    perhaps = F.coalesce(F.col("bits").bitwiseAND(_mask(uid)) == _mask(uid), F.lit(False))
    new, maybe = (tested.where(c).select(*rows.columns) for c in (~perhaps, perhaps))
    return new.unionByName(maybe.join(done.select(F.col(uid).alias("done_uid")), F.col(uid) == F.col("done_uid"), "left_anti"))


def perhaps_done(rows: DataFrame, done: DataFrame, uid: str) -> DataFrame:
    """The rows that the Bloom filter of done's ids does not rule out: all that are in done, and few others; rows are not shuffled."""
    filter_ = bloom(done, uid).select(F.col("word").alias("bloom_word"), F.col("bits").alias("bloom_bits"))  # 2 ** 20 rows of 16 bytes at most
    tested = rows.join(F.broadcast(filter_), _word(uid) == F.col("bloom_word"))
    return tested.where(F.col("bloom_bits").bitwiseAND(_mask(uid)) == _mask(uid)).select(*rows.columns)
