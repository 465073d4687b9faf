"""Reading and writing review files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shuffles_dropped


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array each; anything else is an error that names the file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def context_rows(text: DataFrame, column: str, most: int = 50) -> DataFrame:
    """(category, position, text) of JSON maps from category to a list of texts, the first `most` of each."""
    parsed = text.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("category", "texts"))
    return parsed.select("category", F.posexplode(F.slice("texts", 1, most)).alias("position", "text"))


def write_columns(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Parquet with exactly these columns in this order."""
    df.select(*columns).write.parquet(path)


def append_results(df: DataFrame, ok: str, failed: str, error: str, by: str) -> None:
    """Appends rows without an error to one table and the others to a second, both partitioned."""
    df.where(F.col(error).isNull()).drop(error).write.mode("append").partitionBy(by).parquet(ok)
    df.where(F.col(error).isNotNull()).write.mode("append").partitionBy(by).parquet(failed)


#: Least buckets of the mirror's tables, and rows of a table a bucket: a join of two of them has as many tasks, each with one bucket of both.
BUCKETS, BUCKET_ROWS = 32, 500_000
#: Rows of a table that are shuffled at once.
PART_ROWS = 100_000_000


def write_mirror(products: DataFrame, reviews: DataFrame, scores: DataFrame, path: str, name: str, product: str, review: str, buckets: int | None = None) -> None:
    """Three browsing tables under path, registered as <name>_products, _reviews and _scores: a review (of a product) that repeats is scored once.

    All are cut into buckets by product and sorted by it inside, so that lookups of a product read one bucket and joins by product
    shuffle nothing; scores, rows of (review, product, aspect, score), lie in a folder an aspect.  A product is in one bucket, and the
    task that writes or joins it has all its rows as a stream; the number of buckets follows the rows of the largest table, if it is
    not given, so that a task sorts in memory.  Scores are shuffled once, as maps, and lose repeats and are exploded where they are written.
    Tables of over PART_ROWS rows are read once for each part of their buckets, and a part's shuffle goes when it is written: beside the tables, the disk
    holds no more than the shuffle of one part.
    """
    exploded = lambda df: df.dropDuplicates([product, review]).select(review, product, F.explode("scores").alias("aspect", "score"))  # noqa: E731  stays in its bucket
    tables = (("products", products, None, []), ("reviews", reviews, None, []), ("scores", scores.select(review, product, "scores"), exploded, ["aspect"]))
    with shuffles_dropped(products.sparkSession):
        rows = {part: df.count() for part, df, _, _ in tables}
        if buckets is None:
            buckets = max(BUCKETS, -(-max(rows.values()) // BUCKET_ROWS))
        bucket = F.pmod(F.hash(product), F.lit(buckets))  # where both repartition and bucketBy put a row
        for part, df, made, folders in tables:
            order = [product] if part == "products" else [product, review]  # ids beside their neighbours take less space
            parts = max(1, min(buckets, -(-rows[part] // PART_ROWS)))
            for i in range(parts):
                some = df if parts == 1 else df.where((bucket >= i * buckets // parts) & (bucket < (i + 1) * buckets // parts))
                some = some.repartition(buckets, product)
                some = some if made is None else made(some)
                writer = some.write.mode("append" if i else "errorifexists").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9")
                writer = writer.bucketBy(buckets, product).sortBy(*order).option("path", f"{path}/{part}")  # a file a bucket
                (writer.partitionBy(*folders) if folders else writer).saveAsTable(f"{name}_{part}")


def drop_mirror(spark: SparkSession, name: str) -> None:
    """Forgets the tables; their files stay."""
    for part in ("products", "reviews", "scores"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def mirror_scores(spark: SparkSession, name: str, product_key: str = "product_uid", aspect: str | None = None, product: int | str | None = None) -> DataFrame:
    """Scores with their products' columns, of all or of one aspect (one folder is read) or product (one bucket is read)."""
    scores, products = spark.table(f"{name}_scores"), spark.table(f"{name}_products")
    scores = scores if aspect is None else scores.where(F.col("aspect") == aspect)
    if product is not None:
        scores, products = (t.where(F.col(product_key) == product) for t in (scores, products))
    return scores.join(products, product_key)
