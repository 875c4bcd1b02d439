"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; bytes.split() follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a local one; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/panelspark-checkpoints"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/panelspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written once as a table in the shared folder and read again: later reads don't repeat the work above it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(text: Column | str = "text") -> Column:
    """The text's UTF-8 bytes; null reads as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("binary"), F.lit(b""))


def text_key(text: Column | str = "text") -> Column:
    """64 bits of the text; with doc_id it tells rows apart even where ids repeat or are null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.isnull(text))


def same_row(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("doc_id", "text_key")) -> Column:
    """Null-safe equality on keys."""
    parts = [left[k].eqNullSafe(right[k]) for k in keys]
    return chain_and(parts)


def chain_and(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def carried(docs: DataFrame, *columns: str) -> DataFrame:
    """Each whole row as one struct `__row` beside the named columns, so that no other column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[F.col(c) for c in columns])
