"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import dropped, stored

BITS = 64
#: Radii up to the first number are searched in all segments at once; beyond it, in so many steps, of some segments each.
TOGETHER, STEPS = 1, 4


def sign_code(vector: Column) -> Column:
    """A 64-bit code: bit i is set where component i is positive.  Null, NaN and missing components give 0 bits.

    A vector of more than 64 components is an error, as its code would leave some out.
    """
    bits = F.transform(
        F.when(F.size(vector) <= BITS, vector).otherwise(F.raise_error(F.lit(f"vectors may have {BITS} components at most"))),
        lambda x, i: F.when((x > 0) & ~F.isnan(x), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def segments(n_rows: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments: at most as wide as log2 of the number of codes, so that a bucket holds one or a few.

    Wider ones would mostly probe empty buckets, and the masks of a radius grow with a power of the width.
    """
    count = math.ceil(BITS / max(4.0, math.log2(max(2, n_rows))))
    cuts = [i * BITS // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def _masks(width: int, radius: int) -> Column:
    """All values of `width` bits with `radius` of them set; wide ones are put together from two halves."""

    def listed(n: int, ones: int, shift: int = 0) -> Column:
        return F.split(F.lit(",".join(str(sum(1 << (b + shift) for b in chosen)) for chosen in combinations(range(n), ones))), ",").cast("array<bigint>")

    if width <= 16:
        return listed(width, radius)
    low, high = width // 2, width - width // 2

    def joined(ones: int) -> Column:
        return F.flatten(F.transform(listed(high, ones, low), lambda h: F.transform(listed(low, radius - ones), lambda x: x.bitwiseOR(h))))

    return F.concat(*map(joined, range(max(0, radius - low), min(high, radius) + 1)))


def _segment(code: str, first: int, width: int) -> str:
    return f"(shiftrightunsigned({code}, {first}) & {(1 << width) - 1}L)" if width < BITS else code


def _steps(parts: list[tuple[int, int]]) -> list[tuple[int, list[int]]]:
    """(radius, segments whose radius grows to it), in order."""
    out = []
    for radius in range(max(w for _, w in parts) + 1):
        grow = [i for i, (_, width) in enumerate(parts) if radius <= width]
        size = len(grow) if radius <= TOGETHER else -(-len(grow) // STEPS)
        out += [(radius, grow[i : i + size]) for i in range(0, len(grow), size)]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbour_id, distance: the k nearest other ids of every query by Hamming distance of sign codes.

    Ties go to the smaller id, so the result is exact and unique.  Equal codes are searched once: the index holds distinct
    codes, cut into segments, and only the k + 1 smallest ids of a code can matter.  Radii 0 and 1 are searched in all
    segments, then a quarter of the segments at a time grow by one bit; a code not met yet differs in more bits than its
    segment's radius in each of them (pigeonhole), so each grown segment covers one more bit of distance, and a query is done
    when its kth verified distance is covered.  Only queries that are not done probe further, and codes beyond their kth distance so far
    are left out as they are met.  A code is verified where it is met first, found from the codes themselves, so that
    nothing is made distinct.

    Rows with a null id or vector are not searched.  Rows that repeat an id are one candidate and one query: if their codes
    differ, the least code (as a signed number) stands for the id.  Queries with fewer than k others get all of them; without
    vectors or queries there are no rows.  Other columns are not read.  No table is broadcast and nothing but counts reaches
    the driver.
    """

    def coded(df: DataFrame, name: str, code: str) -> DataFrame:
        rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias(name), sign_code(F.col(vector_col)).alias(code))
        return rows.groupBy(name).agg(F.min(code).alias(code))

    data, asked = coded(vectors, "id", "code"), coded(queries, "query_id", "q_code")
    smallest = Window.partitionBy("code").orderBy("id")
    ids = stored(data.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1), "ids")
    codes = stored(data.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")), "codes")
    n_codes, need = codes.count(), k + 1
    parts = segments(n_codes)

    def cut(code: str, which: list[int]) -> Column:
        return F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), F.expr(_segment(code, *parts[i])).alias("value")) for i in which)))

    index = stored(codes.select("code", "n", "first_id", cut("code", list(range(len(parts)))).alias("s")).select("s.seg", "s.value", "code", "n", "first_id"), "index")
    dropped(codes)
    active = stored(asked.select("q_code").distinct().withColumn("bound", F.lit(BITS)), "active")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = best = None
    order = Window.partitionBy("q_code").orderBy("d", "first_id", "code")
    reached = [-1] * len(parts)
    xor = "(q_code ^ code)"
    far = [f"bit_count({_segment(xor, *part)})" for part in parts]
    steps = _steps(parts)
    for turn, (radius, grow) in enumerate(steps):
        probes = active.repartition(tasks, "q_code").withColumn("s", cut("q_code", grow))
        masked = [(width, [i for i in grow if parts[i][1] == width]) for width in sorted({parts[i][1] for i in grow})]
        probes = [
            probes.where(F.col("s.seg").isin(which)).withColumn("mask", F.explode(_masks(width, radius))) if len(masked) > 1 else probes.withColumn("mask", F.explode(_masks(width, radius)))
            for width, which in masked
        ]
        probes = [p.select("q_code", "bound", F.col("s.seg").alias("p_seg"), F.col("s.value").bitwiseXOR(F.col("mask")).alias("p_value")) for p in probes]
        probes = probes[0] if len(probes) == 1 else probes[0].unionByName(probes[1])
        met = probes.join(index.hint("shuffle_hash"), (F.col("p_seg") == F.col("seg")) & (F.col("p_value") == F.col("value")))
        earlier = [f"{far[i]} <= {reached[i]}" for i in range(len(parts)) if reached[i] >= 0] + [f"({far[i]} = {radius} and {i} < seg)" for i in grow]
        new = met.where(f"bit_count({xor}) <= bound and not ({' or '.join(earlier)})").select("q_code", "code", "n", "first_id", F.expr(f"cast(bit_count({xor}) as int)").alias("d"))
        pool = new if found is None else new.unionByName(best)
        ranked = pool.withColumn("place", F.row_number().over(order)).where(F.col("place") <= need)
        nearer = Window.partitionBy("q_code").orderBy("d").rangeBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).where(F.col("before") < need)
        latest = stored(ranked.select("q_code", "code", "n", "first_id", "d"), "best")
        for i in grow:
            reached[i] = radius
        covered = sum(r + 1 for r in reached) - 1
        last = turn == len(steps) - 1
        done = latest.groupBy("q_code").agg(F.max("d").alias("far"), F.sum("n").alias("have"))
        done = done.where((F.col("have") >= need) & (F.col("far") <= covered))
        finished = latest if last else latest.join(done, "q_code", "left_semi")
        found = finished if found is None else found.unionByName(finished)
        if last:
            break
        bounds = latest.groupBy("q_code").agg(F.when(F.sum("n") >= need, F.max("d")).otherwise(BITS).alias("bound"))
        left = active.select("q_code").join(done, "q_code", "left_anti").join(bounds, "q_code", "left")
        rest = stored(left.select("q_code", F.coalesce("bound", F.lit(BITS)).alias("bound")), "active")
        dropped(active)
        active = rest
        if active.isEmpty():
            break
        best = latest.join(active.select("q_code"), "q_code", "left_semi").select("q_code", "code", "n", "first_id", "d")
    dropped(index)
    hits = asked.join(found.select("q_code", "code", "d"), "q_code").join(ids.select("code", "id"), "code").where("id <> query_id")
    last_order = Window.partitionBy("query_id").orderBy("d", "id")
    return hits.withColumn("rank", F.row_number().over(last_order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("neighbour_id"), F.col("d").alias("distance"))
