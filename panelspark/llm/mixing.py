"""Mixing sources to target weights by repeating and dropping whole documents.

Sizes are summed per source; weights share the total out, but no target exceeds
`most` times its source's size: what a source can't take is shared again by weight
until no target is above its bound. A source's rate is target / size. A document
is emitted floor(rate) times, and once more if a hash of the seed and the document, read
as a number in [0, 1), is below rate - floor(rate). The document is named by its id, text
and source; rows equal in these are numbered, and the number is hashed too, so that
each of them draws for itself.

The share-out in closed form: sources in ascending order of bound / weight are
capped while bound_i * (weights from i on) < (total less bounds before i) * weight_i;
the others get weight * (total - capped bounds) / (weights of the uncapped).
Comparisons are made on integers in decimal(38), so they are exact.

Defined results: a null text has size 0, a null source is a source of its own and
comes last; rows equal in id, text and source are interchangeable: how many of them
are taken how often is fixed, whatever other columns they have; a source without words has
target 0; an empty table gives an empty result. The windows that share weights out run
over the table of sources in one task: sources are taken to be names, not URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, carried, text_bytes, written

WEIGHTS = (5, 2, 1)
#: The table of sources is broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_SOURCES = 50_000
#: So are the names of rows that repeat.
BROADCAST_NAMES = 200_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def name_of(doc_id: Column, text: Column, source: Column) -> Column:
    """The same for rows equal in all three; null and empty texts count as equal."""
    parts = (F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(text_bytes(text)), F.coalesce(source, F.lit("null")))
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def draw(name: Column, number: Column, seed: int) -> Column:
    """A number in [0, 1) from 48 bits of an MD5 of the seed, the name and the row's number among those of its name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), number.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target: from one row per source with its source_size. The windows below run over that table alone."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("bound"))
    total, mass = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    by_bound = Window.orderBy((F.col("bound") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", total.alias("total"), mass.alias("mass"), F.coalesce(F.sum("bound").over(by_bound), F.lit(0)).alias("b0"), F.coalesce(F.sum("weight").over(by_bound), F.lit(0)).alias("w0"))
    big = lambda c: c.cast("decimal(19,0)")
    capped = big(F.col("bound")) * big(F.col("mass") - F.col("w0")) < big(F.col("total") - F.col("b0")) * big(F.col("weight"))
    s = s.withColumn("capped", capped)
    cb = F.sum(F.when(F.col("capped"), F.col("bound")).otherwise(0)).over(Window.partitionBy())
    cw = F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(Window.partitionBy())
    s = s.withColumns({"cb": cb, "cw": cw})
    shared = (F.col("weight") * (F.col("total") - F.col("cb"))).cast("double") / (F.col("mass") - F.col("cw")).cast("double")
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("bound").cast("double")).otherwise(shared).alias("target"))


def numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with `__number`, from 0 among those of one `__name`. repeated: the names of more than one row, as a written table.

    Rows of one name are numbered part by part of a table, parts following one another: a
    name that a third of all rows have is spread over as many tasks as that table has parts.
    """
    n = repeated.count()
    if not n:
        return rows.withColumn("__number", F.lit(0).cast("long"))
    mark = F.broadcast(repeated) if n <= BROADCAST_NAMES else repeated
    once = rows.join(mark, "__name", "left_anti").withColumn("__number", F.lit(0).cast("long"))
    many = written(rows.join(mark, "__name", "left_semi"), "repeated-rows").withColumn("__part", F.spark_partition_id())
    before = F.sum("__n").over(Window.partitionBy("__name").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    bases = many.groupBy("__name", "__part").agg(F.count("*").alias("__n")).select("__name", "__part", F.coalesce(before, F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__name", "__part").orderBy("__name"))
    placed = many.withColumn("__within", within).join(bases, ["__name", "__part"]).withColumn("__number", F.col("__base") + F.col("__within") - 1)
    return once.unionByName(placed.drop("__part", "__base", "__within"))


def _with_copies(rows: DataFrame, narrow: DataFrame, seed: int, weights: tuple[int, ...], most: int) -> DataFrame:
    """rows (source, __size, __name and others) with source_size, target and __copies. narrow: a written table of source, __size and __name of the same rows."""
    sizes = narrow.groupBy("source").agg(F.sum("__size").alias("source_size"))
    repeated = written(narrow.groupBy("__name").count().where("count > 1").select("__name"), "repeated-names")
    t = targets(sizes, weights, most).withColumnRenamed("source", "__source")
    t = F.broadcast(t) if sizes.count() <= BROADCAST_SOURCES else t
    rows = numbered(rows, repeated)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    out = rows.join(t, rows["source"].eqNullSafe(t["__source"])).withColumn("__rate", rate)
    extra = draw(F.col("__name"), F.col("__number"), seed) < F.col("__rate") - F.floor("__rate")
    return out.withColumn("__copies", (F.floor("__rate") + extra.cast("int")).cast("int")).drop("__source", "__rate")


def _narrow(docs: DataFrame) -> DataFrame:
    """What the plan of a mix needs of each row, written: texts are read for it once."""
    columns = docs.select("doc_id", "source", n_words(F.col("text")).alias("__size"), name_of(F.col("doc_id"), F.col("text"), F.col("source")).alias("__name"))
    return written(columns, "sizes")


def mix_sizes(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes) of every row."""
    rows = _narrow(docs)
    return _with_copies(rows, rows, seed, weights, most).select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """The mix: every row of docs as often as its source's rate says, repeats as rows."""
    rows = carried(docs, "doc_id", "source").select("__row", "source", name_of(F.col("doc_id"), F.col("__row.text"), F.col("source")).alias("__name"))
    taken = _with_copies(rows, _narrow(docs), seed, weights, most).where("__copies > 0")
    return taken.select("__row", F.explode(F.expr("sequence(1, __copies)")).alias("__copy")).select("__row.*")
