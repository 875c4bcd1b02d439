"""Reproducible shuffling into shards: a Feistel permutation over global row numbers.

Rows get global numbers 0..n-1, their ranks by key and tie: they depend on the rows
alone, not on how Spark happens to split the input. The rows are dealt by ranges of these
and sorted within, so a number is the count of rows in the ranges before plus the place
in its own; equal rows are told apart by their place in the input, so that a key which a
third of all rows have spreads over ranges too. A Feistel network over Z_a x Z_b, a*b being the least such product at or
above n, permutes [0, a*b); a value at or beyond n is permuted again until it
falls below n (cycle walking). Place p of the permutation is row p // shards of
shard p % shards: shard sizes differ by at most one and slots have no gaps.
`place` computes the same in plain Python for a single row number.

Defined results: null texts count as empty; rows of one id are ordered by their
text hash, and wholly equal rows are interchangeable; an empty table gives an
empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import carried, let, partitions, text_bytes, text_key, written


def grid(n: int) -> tuple[int, int]:
    """The sides a, b of the domain: a*b >= n with fewer than a values to spare."""
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _round_keys(seed: int, rounds: int) -> list[int]:
    return [(seed * 1_000_003 + i * 7_919) % (1 << 62) for i in range(rounds)]


def permuted(x: Column, n: int, seed: int = 7, rounds: int = 6) -> Column:
    """One pass of the network over [0, a*b)."""
    a, b = (F.lit(side).cast("long") for side in grid(n))
    sides = F.lit(sum(grid(n))).cast("long")

    def start(v: Column) -> Column:
        return F.struct(a.alias("m"), ((v - F.pmod(v, b)) / b).cast("long").alias("l"), F.pmod(v, b).alias("r"))

    def step(s: Column, k: Column) -> Column:
        # l lies in Z_m and r in the other ring; they change places and rings in each round
        return F.struct((sides - s["m"]).alias("m"), s["r"].alias("l"), F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k), s["m"]), s["m"]).alias("r"))

    keys = F.array(*[F.lit(k).cast("long") for k in _round_keys(seed, rounds + rounds % 2)])
    # after an even number of rounds l lies in Z_a and r in Z_b again
    return let(x, lambda v: F.aggregate(keys, start(v), step, lambda s: s["l"] * b + s["r"]))


def permuted_int(x: int, n: int, seed: int = 7, rounds: int = 6) -> int:
    """What `permuted` computes, for one integer."""
    import struct

    import xxhash

    a, b = grid(n)
    m, (left, right) = a, divmod(x, b)
    for k in _round_keys(seed, rounds + rounds % 2):
        h = 42
        for v in (right, k):
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        h -= (h >> 63) << 64
        m, left, right = a + b - m, right, (left + h % m) % m
    return left * b + right


def place(row: int, n: int, shards: int, seed: int = 7, rounds: int = 6) -> tuple[int, int]:
    """Shard and slot of global row number `row`."""
    x = permuted_int(row, n, seed, rounds)
    while x >= n:
        x = permuted_int(x, n, seed, rounds)
    return x % shards, x // shards


def walks(n: int, seed: int = 7, rounds: int = 6) -> int:
    """How many further passes the longest walk from a row number can need: the longest chain of values at or beyond n, of which there are at most sqrt(n) + 1."""
    a, b = grid(n)
    longest = 0
    for x in range(n, a * b):
        steps = 1
        while (x := permuted_int(x, n, seed, rounds)) >= n and steps <= a * b - n:
            steps += 1
        longest = max(longest, steps)
    return longest


def walked(x: Column, n: int, seed: int = 7, rounds: int = 6) -> Column:
    """The place in [0, n) of row number x."""
    place = permuted(x, n, seed, rounds)
    for _ in range(walks(n, seed, rounds)):
        place = let(place, lambda p: F.when(p >= n, permuted(p, n, seed, rounds)).otherwise(p))
    return place


def numbered(rows: DataFrame, key: Column, tie: Column) -> tuple[DataFrame, int]:
    """rows with a global number `__row_number` in [0, n), and n. key and tie: what the numbers depend on."""
    spark = rows.sparkSession
    order = [F.col("__key").asc_nulls_last(), F.col("__tie").asc_nulls_last(), F.col("__input_place").asc()]
    keyed = rows.withColumns({"__key": key, "__tie": tie, "__input_place": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # the upper bits of such an id are the partition's number, the lower 33 the row's place in it
    ranged = written(dealt.drop("__key", "__tie", "__input_place").withColumn("__range_place", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("__range", F.shiftright("__range_place", 33).cast("int"))
    counts = sorted(tuple(r) for r in ranged.groupBy("__range").count().collect())  # one row per partition
    bases, n = [], 0
    for number, count in counts:
        bases.append((number, n))
        n += count
    base = F.broadcast(spark.createDataFrame(bases, "__range int, __base long"))  # one row per partition
    out = ranged.join(base, "__range").withColumn("__row_number", F.col("__base") + F.pmod("__range_place", F.lit(1 << 33)))
    return out.drop("__range_place", "__range", "__base"), n


def placed(rows: DataFrame, key: Column, tie: Column, shards: int, seed: int = 7, rounds: int = 6) -> DataFrame:
    """rows with `shard` (int) and `slot` (long), which replace columns of these names."""
    numbers, n = numbered(rows, key, tie)
    x = F.col("__row_number")
    out = numbers.withColumn("__place", walked(x, n, seed, rounds) if n else x)
    at = F.col("__place")
    shard = F.pmod(at, F.lit(shards).cast("long"))
    return out.withColumns({"shard": shard.cast("int"), "slot": ((at - shard) / shards).cast("long")}).drop("__place", "__row_number")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, shard and slot of every row."""
    # written first, so that dealing by ranges samples this and not the texts
    narrow = written(docs.select("doc_id", (F.length(text_bytes()) + 16).cast("long").alias("size"), F.crc32(text_bytes()).alias("text_crc32"), text_key().alias("__text")), "sizes")
    return placed(narrow, F.col("doc_id"), F.col("__text"), shards, seed).select("doc_id", "size", "text_crc32", "shard", "slot")


def with_shards(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Every whole row of docs, with shard and slot."""
    rows = carried(docs, "doc_id").withColumn("__text", text_key("__row.text"))
    kept = [f"__row.`{c}`" for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed(rows, F.col("doc_id"), F.col("__text"), shards, seed).select(*kept, "shard", "slot")
