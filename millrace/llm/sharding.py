"""Sharding by balanced label propagation; DataFrame functions only."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import dropped, stored

LAW = "rows"


def _unit(*columns: Column) -> Column:
    """A hashed number in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)).cast("double") / float(1 << 40)


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _sizes(df: DataFrame, n_shards: int) -> list[int]:
    """Rows of each shard: n_shards numbers."""
    found = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(s, 0) for s in range(n_shards)]


def propagate(nodes: DataFrame, n_shards: int, rounds: int = 3) -> DataFrame:
    """nodes (with at least node and key) and: shard, and linked (another node has the same non-null key).

    Shards start hashed.  A shard has room for linked nodes up to its even size, as nodes without links can make way.  In each
    round the nodes of a key are counted per shard; a key that is cut asks for the shard that holds most of it among those that
    can take the rest of it (or most of it at all, if none can), and a shard accepts the hashed share of its askers that its
    room allows, each key as a whole.  What is refused asks again in the next round.  A key of more than half a shard is dealt
    into parts of that size, which move on their own; there are fewer than 2 * n_shards of these keys, which bounds the table that
    is broadcast.  Counts are combined before the shuffle (a key gives n_shards rows at most), and rows meet the decisions in joins
    of two written tables, so that Spark splits a hot key over tasks.  Only n_shards numbers a round reach the driver.
    """
    total = nodes.count()
    even = max(1, total // n_shards)
    sizes = stored(nodes.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("all_n")).where("all_n > 1"), "sizes")
    big = sizes.where(F.col("all_n") * 2 > even).select(F.col("key").alias("b_key"), F.ceil(F.col("all_n") * 2 / even).cast("int").alias("parts"))
    start = nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit("start")), F.lit(n_shards)).cast("int"))
    joined = start.join(sizes.select(F.col("key").alias("s_key"), F.lit(True).alias("linked")), F.col("key") == F.col("s_key"), "left").drop("s_key")
    joined = joined.join(F.broadcast(big), F.col("key") == F.col("b_key"), "left").drop("b_key")
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.coalesce("parts", F.lit(1))).cast("int")
    state = stored(joined.withColumn("part", part).withColumn("linked", F.coalesce("linked", F.lit(False))).drop("parts"), "shards")
    dropped(sizes)
    for turn in range(rounds):
        linked = state.where("linked")
        room = [max(0, even - n) for n in _sizes(linked, n_shards)]
        votes = linked.groupBy("key", "part", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("key", "part")
        votes = votes.agg(F.collect_list(F.struct("shard", "n")).alias("held"), F.sum("n").alias("all_n")).where(F.size("held") > 1)  # n_shards entries at most
        choices = F.transform(
            "held",
            lambda v: F.struct(
                (F.element_at(_longs(room), v["shard"] + 1) >= F.col("all_n") - v["n"]).alias("fits"), v["n"].alias("n"), _unit(F.col("key"), F.col("part"), v["shard"]).alias("tie"), v["shard"].alias("shard")
            ),
        )
        asks = votes.withColumn("best", F.array_max(choices)).select("key", "part", F.col("best.shard").alias("shard"), (F.col("all_n") - F.col("best.n")).alias("more"))
        asks = stored(asks, "asks")
        wanted = {r["shard"]: r["n"] for r in asks.groupBy("shard").agg(F.sum("more").alias("n")).collect()}
        if not wanted:
            dropped(asks)
            break
        odds = F.array(*(F.lit(room[s] / wanted[s] if wanted.get(s) else 0.0) for s in range(n_shards)))
        accepted = asks.where(_unit(F.col("key"), F.col("part"), F.lit(turn)) < F.element_at(odds, F.col("shard") + 1))
        goal = accepted.select(F.col("key").alias("g_key"), F.col("part").alias("g_part"), F.col("shard").alias("goal"))
        moved = state.join(goal, (F.col("key") == F.col("g_key")) & (F.col("part") == F.col("g_part")) & F.col("linked"), "left")
        after = stored(moved.withColumn("shard", F.coalesce("goal", "shard")).drop("g_key", "g_part", "goal"), "shards")
        dropped(state)
        dropped(asks)
        state = after
    return state.drop("part")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `rank`, gapless from 0 in the given order: local numbers of range partitions plus the sizes of those before."""
    local = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("r_id", F.monotonically_increasing_id())
    local = stored(local, "ranked")
    part = F.shiftright("r_id", 33)
    sizes = local.groupBy(part.alias("r_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("r_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("r_start"))
    out = local.join(F.broadcast(starts), part == F.col("r_part"))
    return out.withColumn("rank", F.col("r_start") + F.col("r_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("r_id", "r_part", "r_start")


def shard_documents(docs: DataFrame, n_shards: int = 8, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row; documents of equal text are linked.

    Rows stay in the shard that label propagation gives them, but for what is over a shard's even size: the last rows in the
    order of their links (rows with equal texts come first and side by side, rows of their own last) fill the shards under it.
    So the law is `rows`: counts differ by one at most, and texts are cut only by a shard's edge or if they fill over half a
    shard.  Null text counts as empty (size 1, CRC 0).  Rows that repeat an id are rows of their own; a null id sorts first; an
    empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("c_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text).alias("key"),
    )
    rows = stored(rows.withColumn("node", F.xxhash64("c_id", "key", F.monotonically_increasing_id())), "rows")
    placed = propagate(rows, n_shards, rounds)
    counts = _sizes(placed, n_shards)
    total = sum(counts)
    larger = sorted(range(n_shards), key=lambda s: (-counts[s], s))[: total % n_shards]
    even = [total // n_shards + (s in larger) for s in range(n_shards)]
    starts, surplus, lack = ([0, *accumulate(x)] for x in (counts, [max(0, c - e) for c, e in zip(counts, even)], [max(0, e - c) for c, e in zip(counts, even)]))
    ordered = placed.select("c_id", "size", "text_crc32", "shard", (~F.col("linked")).alias("alone"), F.xxhash64("key").alias("mix"), "key", "node")
    own = lambda values: F.element_at(_longs(values), F.col("shard") + 1)
    ranked = numbered(ordered, "shard", "alone", "mix", "key", "node").withColumn("place", F.col("rank") - own(starts[:-1]))
    number = F.when(F.col("place") >= own(even), own(surplus[:-1]) + F.col("place") - own(even))
    ranked = ranked.withColumn("number", number).withColumn("taker", F.size(F.filter(_longs(lack[1:]), lambda c: c <= F.col("number"))))
    slot = F.element_at(_longs(counts), F.col("taker") + 1) + F.col("number") - F.element_at(_longs(lack[:-1]), F.col("taker") + 1)
    goes = F.col("number").isNotNull()
    return ranked.select(
        F.col("c_id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), F.when(goes, F.col("taker")).otherwise(F.col("shard")).cast("int").alias("shard"),
        F.when(goes, slot).otherwise(F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
