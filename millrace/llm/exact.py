"""Exact duplicates by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .store import stored, unused

SPACE = r"[ \t-\r]+"
HEAD_CHARS = 32


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def _numbered(batches: Iterator[pa.RecordBatch], norm_of, seq_name: str | None, drop: list[str], heads_only: bool) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal neighbours of a sorted partition, comparing whole normalised texts; heads_only: the first row of each run."""
    last, seq = None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = norm_of(batch)
        before = pa.concat_arrays([pa.array([last], norm.type), norm.slice(0, len(norm) - 1)])
        new = pc.fill_null(pc.not_equal(norm, before), True)
        numbers = pc.add(pc.cumulative_sum(pc.cast(new, pa.int64())), seq)
        last, seq = norm[-1].as_py(), numbers[-1].as_py()
        out = batch.drop_columns(drop).append_column(seq_name, numbers)
        yield out.filter(new) if heads_only else out


def _starts(runs: DataFrame, part: str, seq: str, sha: str) -> DataFrame:
    """(part, offset, goes_on): a row a partition.  offset and seq add up to the number of a run over all partitions; goes_on is
    true where a splitter has cut a run, so that the partition's first run is the last one of the partition before.

    Rows of equal texts follow each other in the order of the range partitions, so only last and first runs can be one.
    """
    edges = runs.groupBy(F.col(part).alias("c_part")).agg(F.min_by(sha, seq).alias("first_sha"), F.max_by(sha, seq).alias("last_sha"), (F.max(seq) + 1).alias("n_runs"))
    order = Window.orderBy("c_part")  # one row a partition
    edges = edges.withColumn("goes_on", F.coalesce(F.col("first_sha") == F.lag("last_sha").over(order), F.lit(False)))
    before = F.coalesce(F.sum("n_runs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = F.sum(F.col("goes_on").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return edges.select("c_part", (before - cuts).alias("offset"), "goes_on")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every white space character of 0x20 and 0x09-0x0D; null counts as
    empty.  Sampled splitters range-partition the rows by the first bytes of the normalised text and its hash (so that
    samples are short) and, inside a text, by length and id, so that a hot text spreads over partitions.  Spark's external
    sort puts equals side by side, and neighbours are compared whole.  These runs are the groups; where a splitter has cut
    one, the last run of a partition and the first of the next are joined by the hash and number of the partition, so a hot
    text costs a row a partition and no task gathers its rows.  The longest original stays, then the smallest id.  Rows that
    repeat an id and a text are all kept or all dropped with it; a null id sorts last.  An empty table gives an empty one;
    other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("c_id"),
        F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("c_len"),
        _normal(F.col(text_col)).alias("c_norm"),
    )
    rows = rows.withColumn("c_sha", F.unhex(F.sha2("c_norm", 256))).withColumn("c_head", F.substring("c_norm", 1, HEAD_CHARS))
    order = F.col("c_head"), F.col("c_sha"), F.desc("c_len"), F.asc_nulls_last("c_id")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("c_part"), "c_sha", "c_len", "c_id", "c_norm")
    runs = rows.mapInArrow(lambda b: _numbered(b, lambda x: x.column("c_norm"), "c_seq", ["c_norm"], False), "c_part int, c_sha binary, c_len long, c_id long, c_seq long")
    runs = stored(runs, "runs")
    best = F.min(F.struct((-F.col("c_len")).alias("l"), F.col("c_id").isNull().alias("z"), F.col("c_id").alias("i")))
    local = runs.groupBy("c_part", "c_seq").agg(best.alias("c_best"), F.count(F.lit(1)).alias("c_n"), F.first("c_sha").alias("c_sha"))
    starts = _starts(local, "c_part", "c_seq", "c_sha").select("c_part", "offset")
    local = local.select("c_part", "c_seq", "c_best", "c_n").join(F.broadcast(starts), "c_part").withColumn("c_group", F.col("offset") + F.col("c_seq"))
    whole = local.groupBy(F.col("c_group").alias("w_group")).agg(F.min("c_best").alias("w_best"), F.sum("c_n").alias("w_n"))
    heads = local.join(whole, F.col("c_group") == F.col("w_group")).select(F.col("c_part").alias("h_part"), F.col("c_seq").alias("h_seq"), "w_best", "w_n")
    return runs.join(heads, (F.col("c_part") == F.col("h_part")) & (F.col("c_seq") == F.col("h_seq"))).select(
        F.col("c_id").alias(id_col),
        F.col("w_best.i").alias("keep_id"),
        F.col("w_n").alias("group_size"),
        (F.col("c_id").eqNullSafe(F.col("w_best.i")) & (F.col("c_len") == -F.col("w_best.l"))).alias("kept"),
        F.lower(F.hex("c_sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, as `exact_groups` chooses it; all columns as they are, whatever their names.

    The documents are shuffled once, in the order of `exact_groups`, in which the row that stays is the first of its run: first
    rows are kept, less those of runs that began in the partition before.  Rows that repeat both id and text leave one of them.
    """
    sha, head, size, part, seq = unused(docs, "x_sha", "x_head", "x_len", "x_part", "x_seq")
    norm = _normal(F.col(text_col))
    rows = docs.withColumns({sha: F.unhex(F.sha2(norm, 256)), head: F.substring(norm, 1, HEAD_CHARS), size: F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    order = F.col(head), F.col(sha), F.desc(size), F.asc_nulls_last(id_col)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(head, size).withColumn(part, F.spark_partition_id())

    def texts(batch: pa.RecordBatch) -> pa.Array:
        return pc.replace_substring_regex(pc.fill_null(pc.cast(batch.column(text_col), pa.large_string()), ""), SPACE, "")

    schema = StructType([*docs.schema.fields, StructField(sha, BinaryType()), StructField(part, IntegerType()), StructField(seq, LongType())])
    firsts = stored(rows.mapInArrow(lambda b: _numbered(b, texts, seq, [], True), schema), "firsts")
    cut = _starts(firsts, part, seq, sha).where("goes_on").select(F.col("c_part").alias(part), F.lit(0).cast("long").alias(seq))
    return firsts.join(F.broadcast(cut), [part, seq], "left_anti").select(*docs.columns)  # a row a partition at most
