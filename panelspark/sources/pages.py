"""Pages of a large sorted table (S17, T5): written once in ranges of its order, so that a page reads the files it lies in.

Counting a filter's rows by file reads the filter's columns alone (none, without a filter: row counts stand in the footers); a
running sum over files, one row each, says which files hold a page, and only those are read in full. Page 10,000 costs what page 1 costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Writes df as files of consecutive ranges of `order`, which must tell rows apart if pages are to be the same in every run."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)


def page(spark: SparkSession, path: str, number: int, size: int, where: Column | None = None) -> tuple[DataFrame, int]:
    """Page `number` (from 1) of `size` rows that meet `where`, with row_number (from 1) over all of them, and how many there are."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes begin at 1")
    every = spark.read.parquet(path)
    kept = every.where(where) if where is not None else every
    per = kept.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"))
    files = Window.orderBy(F.length("name"), "name")  # part files are numbered in the order of their ranges; one row a file
    placed = per.withColumn("before", F.sum("n").over(files) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    start, end = (number - 1) * size, number * size
    hit = placed.where((F.col("before") < end) & (F.col("before") + F.col("n") > start)).orderBy("before").collect()  # the files of one page
    if not hit:
        total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return every.limit(0).withColumn("row_number", F.lit(0).cast("long")), total
    rows = spark.read.schema(every.schema).parquet(*[r.file for r in hit])
    rows = rows.where(where) if where is not None else rows
    place = F.row_number().over(Window.orderBy(F.length("__name"), "__name", "__at")) + F.lit(hit[0].before)
    rows = rows.select("*", F.col("_metadata.file_name").alias("__name"), F.col("_metadata.row_index").alias("__at"))
    return rows.withColumn("row_number", place.cast("long")).where(F.col("row_number").between(start + 1, end)).drop("__name", "__at"), hit[0].total
