"""Partitioned datasets as plain Parquet tables, and the jobs that keep them.

A dataset is a folder partitioned by one column. Publishing replaces just the partitions
that a frame has, so a job that is run again leaves the same table: they are written beside the
dataset, read back and compared, and then put in place folder by folder, each by a rename; if one fails, those
before it are put back. Reading leaves pruning to Spark. Content hashes of partitions are DataFrame jobs:
which partitions changed, or differ from what was recorded, is a join of two tables of hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.relational import content_hash, latest, require_unique
from panelspark.sources import artifacts


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """The dataset (S1): columns and filters reach the scan, filters on the partition column prune folders."""
    rows = spark.read.parquet(path)
    rows = rows.where(where) if where is not None else rows
    return rows.select(*columns) if columns else rows


def _swapped(spark: SparkSession, staged: str, path: str) -> None:
    """Moves each partition folder of `staged` into `path`, those in its place aside; all of them or none."""
    at, fs = artifacts.files(spark, staged)
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]  # a name a partition
    aside, moved = f"{path}.replaced-{uuid.uuid4().hex}", []
    try:
        for name in names:
            steps = [(f"{path}/{name}", f"{aside}/{name}")] if artifacts.exists(spark, f"{path}/{name}") else []
            for source, target in [*steps, (f"{staged}/{name}", f"{path}/{name}")]:
                artifacts.move(spark, source, target)
                moved.append((source, target))
    except BaseException:
        for source, target in reversed(moved):
            artifacts.move(spark, target, source)
        raise
    finally:
        artifacts.remove(spark, staged)
        artifacts.remove(spark, aside)


def publish(df: DataFrame, path: str, by: str, keys: Sequence[str] = ()) -> None:
    """Replaces the partitions of the dataset that df has (S10). Primary keys, if given, must be unique; rows are sorted by them, so that file statistics prune.

    df is worked out once. A partition of very many rows is split over tasks. What was written is read back and compared by count and
    content before anything of the dataset moves.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    staged, seen = f"{path}.staging-{uuid.uuid4().hex}", Observation()
    marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("content")]
    try:
        dealt = df.hint("rebalance", F.col(by)).sortWithinPartitions(by, *keys)
        dealt.observe(seen, *marks).write.option("compression", "zstd").partitionBy(by).parquet(staged)
        back = spark.read.schema(df.schema).parquet(staged)
        if seen.get != back.agg(*marks).first().asDict():
            raise OSError(f"{staged} doesn't hold what was written")
        if keys:
            require_unique(back, [by, *keys])
    except BaseException:
        artifacts.remove(spark, staged)
        raise
    _swapped(spark, staged, path)


def publish_raw(df: DataFrame, path: str, by: str) -> None:
    """Keeps df as it came, all columns as strings (S9): repeated rows and unparsable values stay; `normalized` makes the typed table of it."""
    publish(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]), path, by)


def upsert(df: DataFrame, path: str, by: str, keys: Sequence[str]) -> None:
    """Publishes the touched partitions with df's rows in place of those of equal keys (S11); of equal keys in df one stays."""
    both = df.withColumn("__order", F.lit(1))
    if artifacts.exists(df.sparkSession, path):
        kept = read(df.sparkSession, path).join(df.select(by).distinct(), by, "left_semi").select(*df.columns)
        both = both.unionByName(kept.withColumn("__order", F.lit(0)))
    publish(latest(both, [by, *keys], ["__order"]).drop("__order"), path, by, keys)


def partition_hashes(df: DataFrame, by: str) -> DataFrame:
    """partition_value, n_rows, xor_hash, sum_hash: the content of each partition, whatever the order of its rows."""
    value = F.coalesce(F.col(by).cast("string"), F.lit("__null__"))
    rows = df.select(*[F.col(c) for c in df.columns if c != by], value.alias("partition_value"))
    return content_hash(rows, ["partition_value"])


def changed_partitions(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """partition_value and status of two tables of `partition_hashes` (S2, N3): new_partition, raw_input_changed, canonical_file_missing or unchanged."""
    new, old = now.alias("n"), recorded.alias("r")
    met = new.join(old, F.col("n.partition_value") == F.col("r.partition_value"), "full")
    same = F.lit(True)
    for c in ("n_rows", "xor_hash", "sum_hash"):
        same = same & (F.col(f"n.{c}") == F.col(f"r.{c}"))
    status = F.when(F.col("r.partition_value").isNull(), "new_partition").when(F.col("n.partition_value").isNull(), "canonical_file_missing").when(same, "unchanged").otherwise("raw_input_changed")
    return met.select(F.coalesce("n.partition_value", "r.partition_value").alias("partition_value"), status.alias("status"))


def catalog_hash(hashes: DataFrame) -> DataFrame:
    """One row for all datasets (N8): equal before and after a job if nothing moved below it. hashes: dataset and the columns of `partition_hashes`."""
    return content_hash(hashes.select("dataset", "partition_value", "n_rows", "xor_hash", "sum_hash"))


def open_gates(results: DataFrame) -> DataFrame:
    """dataset, open: whether all that was validated passed (N7). results: dataset, status, blocks (see `quality.run_rules`)."""
    return results.groupBy("dataset").agg((~F.bool_or(F.coalesce("blocks", F.lit(True)))).alias("open"))


def file_years(spark: SparkSession, path: str, day: str) -> DataFrame:
    """Files of a Parquet path with the years they hold."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.array_sort(F.collect_set(F.year(day))).alias("years"))


def normalized(raw: DataFrame, names: dict[str, str], types: dict[str, str], scales: dict[str, float]) -> DataFrame:
    """Renamed, trimmed, cast and scaled columns of a string table (N4): blanks become null, unparsable values too."""
    out = []
    for source, target in names.items():
        c = F.nullif(F.trim(F.col(source)), F.lit(""))
        kind = types.get(target, "string")
        c = F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date") if kind == "date" else c if kind == "string" else c.try_cast(kind)
        out.append((c * scales[target] if target in scales else c).alias(target))
    return raw.select(*out)


def revisions(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows without repeats of content, numbered from 0 within their key (N5). A row whose content is that of the one before it in order is no revision."""
    content = [c for c in rows.columns if c not in (*keys, *order)]
    w = Window.partitionBy(*keys).orderBy(*order)
    h = F.sha2(F.to_json(F.struct(*content)), 256) if content else F.lit("")
    first = F.row_number().over(Window.partitionBy(*keys, "__h").orderBy(*order)) == 1
    once = rows.withColumn("__h", h).withColumn("__first", first).where("__first")
    return once.withColumn("revision", F.row_number().over(w).cast("long") - 1).drop("__h", "__first")


def consolidated_industries(rows: DataFrame) -> DataFrame:
    """One row per membership (N6): first entry and first exit times known, and the latest row's values. rows: instrument_id, code, in_date, out_date, available_at, name."""
    keys = ["instrument_id", "code", "in_date"]
    times = rows.groupBy(*keys).agg(F.min("available_at").alias("in_available_at"), F.min(F.when(F.col("out_date").isNotNull(), F.col("available_at"))).alias("out_available_at"))
    return latest(rows, keys, ["available_at"]).join(times, keys)
