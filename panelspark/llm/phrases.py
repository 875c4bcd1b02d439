"""Phrase collocation mining: contiguous words that stand together more often than their parts suggest.

1. Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and equal pieces of a
   language become one row with its multiplicity, so that copied passages are looked at once.
2. A task takes pieces worth PIECE_WORDS words, adds up the weights of their n-grams and sends them,
   sorted and packed, to hash buckets. There is a bucket for each BUCKET_WORDS words, so a bucket doesn't grow
   with the input; DuckDB counts it as a stream, out of core: beyond MEMORY it spills to the shared folder, where
   that is a mounted one. N-grams below the least frequency end here: a part of a candidate is at
   least as frequent as the candidate, so no later step misses them. A common n-gram
   comes once a task and language, not once an occurrence.
3. Each candidate asks for the frequencies of its parts: requests are shuffled to the parts' keys and
   answers come back by phrase. A part that very many phrases ask for is split by AQE's skew join.
4. Candidates inside a longer candidate of similar frequency go, and each language's best are ranked, in
   salted parts first, so that no task sorts a language.

Defined results: a null text has no pieces, a null lang is `und`; repeated rows count each time; ids play
no part; a language without a candidate returns nothing, and so does an empty table; columns other
than text and lang are ignored. Arithmetic is in 64-bit sums and decimals of 38 digits: exact up to 10**15 occurrences.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import partitions, scratch, written
from panelspark.llm.superkmer import mixed

CUT = r"[.,;:!?\x0A-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the pieces that a task counts together, and words of distinct pieces for each bucket.
PIECE_WORDS, BUCKET_WORDS = 1_000_000, 1_000_000
#: What DuckDB may hold of a bucket.
MEMORY = "384MB"
#: Parts of a language that are ranked apart before they meet, at most; each sends on as many rows as are asked for.
MOST_SALTS = 128

_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.large_string()), ("n", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words joined by single spaces), words (how many), m (its multiplicity)."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER + "\t", LOWER + " ")
    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, CUT)).alias("piece"))
    each = each.select("lang", F.trim("piece").alias("piece")).where("piece <> ''")
    each = each.withColumn("piece", F.when(F.col("piece").contains("  "), F.regexp_replace("piece", " +", " ")).otherwise(F.col("piece")))
    counted = each.groupBy("lang", "piece").agg(F.count("*").alias("m"))
    return counted.select("lang", "piece", (F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"), "m")


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, ascending; the sums of their weights; each position's place among them."""
    order = np.argsort(codes)
    ordered = codes[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    place = np.empty(len(codes), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], np.add.reduceat(weights[order], np.nonzero(new)[0]), place


def weighted_grams(texts: pa.Array, weights: np.ndarray, most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each length up to most: n-grams in byte order, their weights, their hashes."""
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    words = pc.list_flatten(split).dictionary_encode()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids, known = rank[words.indices.to_numpy()], words.dictionary.take(pa.array(order))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known.to_pylist()), np.uint64, len(known))
    of = np.repeat(np.arange(len(sizes)), sizes)
    at, place = np.arange(len(ids)), ids
    grams, own, weight = known, hashes, weights[of]
    for n in range(1, most + 1):
        if n == 1:
            _, total, place = _summed(ids, weight)
        else:
            stays = at + n - 1 < len(ids)
            stays[stays] = of[at[stays]] == of[at[stays] + n - 1]
            at, place = at[stays], place[stays]
            if not len(at):
                return
            found, total, place = _summed(place * len(known) + ids[at + n - 1], weight[at])
            before, last = found // len(known), found % len(known)
            grams = pc.binary_join_element_wise(grams.take(pa.array(before)), known.take(pa.array(last)), pa.scalar(" ", pa.large_string()))
            own = mixed(own[before] * _BASE + hashes[last])
        yield grams, total, own


def _packed(rows: list[pa.RecordBatch], most: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs of weighted n-grams by bucket; the empty n-gram carries a language's count of words."""
    table = pa.Table.from_batches(rows).combine_chunks()
    langs = table["lang"].combine_chunks().dictionary_encode()
    code, weights = langs.indices.to_numpy(), table["m"].to_numpy()
    grams, names, counts, where = [], [], [], []
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        mine = np.nonzero(code == i)[0]
        salt = np.array([xxhash.xxh64_intdigest(lang)], np.uint64)
        total = int((weights[mine] * table["words"].to_numpy()[mine]).sum())
        parts = [(pa.array([""], pa.large_string()), np.array([total]), np.zeros(1, np.uint64)), *weighted_grams(table["piece"].combine_chunks().take(pa.array(mine)), weights[mine], most)]
        for gram, n, own in parts:
            grams.append(gram)
            names.append(pa.DictionaryArray.from_arrays(pa.array(np.full(len(gram), i, np.int32)), langs.dictionary).cast(pa.string()))
            counts.append(n)
            where.append((mixed(own + salt) % np.uint64(buckets)).astype(np.int64))
    bucket = np.concatenate(where)
    order = np.argsort(bucket, kind="stable")
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.concat_arrays(grams), pa.array(np.concatenate(counts).astype(np.int64))], schema=_GRAMS)
    bucket = bucket[order]
    edges = np.nonzero(np.r_[True, bucket[1:] != bucket[:-1], True])[0]
    how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        blob = _serialized(batch.take(pa.array(order[a:z])), how)
        yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def _serialized(batch: pa.RecordBatch, how: pa.ipc.IpcWriteOptions) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=how) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def spill_folder(spark: SparkSession) -> str | None:
    """A folder of the shared one that DuckDB can write to, or None where the shared folder is no mounted one."""
    at = scratch(spark, "grams")
    return at.removeprefix("file://") if at.startswith(("file:///", "/")) else None


def _counted(blobs: Iterator[bytes], least: int, spill: str | None) -> pa.Table:
    """One bucket's n-grams of at least that weight, counted as they come."""
    folder = spill and f"{spill}-{uuid.uuid4().hex}"

    def read() -> Iterator[pa.RecordBatch]:
        for blob in blobs:
            yield from pa.ipc.open_stream(blob)

    config = {"memory_limit": MEMORY, "threads": "1", "preserve_insertion_order": "false", "temp_directory": folder or ""}
    if folder:
        os.makedirs(folder, exist_ok=True)
    try:
        with duckdb.connect(":memory:", config=config) as c:
            c.register("sent", pa.RecordBatchReader.from_batches(_GRAMS, read()))
            return c.execute("SELECT lang, gram, CAST(sum(n) AS BIGINT) AS f FROM sent GROUP BY lang, gram HAVING sum(n) >= ? OR gram = ''", [least]).to_arrow_table()
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def counted_grams(rows: DataFrame, most: int, least: int) -> DataFrame:
    """lang, gram, f of all n-grams of at least that frequency; the empty gram has the count of all words. rows: those of pieces()."""
    spark = rows.sparkSession
    words = rows.agg(F.sum("words")).first()[0] or 0
    buckets, spill = max(partitions(spark), -(-words // BUCKET_WORDS)), spill_folder(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += pc.sum(b.column(2)).as_py() or 0
            if n >= PIECE_WORDS:
                yield from _packed(held, most, buckets)
                held, n = [], 0
        if n:
            yield from _packed(held, most, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((bucket, blob) for b in batches for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)))
        ahead = next(stream, None)
        while ahead is not None:
            now = ahead[0]

            def own() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[0] == now:
                    yield ahead[1].as_buffer()
                    ahead = next(stream, None)

            yield from _counted(own(), least, spill).cast(pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64())])).to_batches(max_chunksize=20_000)

    sent = rows.select("lang", "piece", "words", "m").mapInArrow(send, "bucket int, blob binary")
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "lang string, gram string, f long")


def _floor_score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 a**2 / (left right)), exactly."""
    wide = lambda x: x.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def scored(grams: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of all candidates (n-grams of two words or more), by their lowest-scoring cut."""
    words = F.split("gram", " ")
    phrases = grams.where("instr(gram, ' ') > 0").select("lang", F.col("gram").alias("phrase"), F.size(words).alias("size"), F.col("f").alias("a"), words.alias("w"))
    part = lambda k, side: F.struct((k * 2 + side).alias("slot"), F.array_join(F.slice("w", F.lit(1) if side == 0 else k + 1, k if side == 0 else F.col("size") - k), " ").alias("part"))
    asked = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(part(k, 0), part(k, 1))))
    requests = phrases.select("lang", "phrase", "size", "a", F.explode(asked).alias("ask")).select("lang", "phrase", "size", "a", "ask.slot", "ask.part")
    answers = requests.join(grams.select("lang", F.col("gram").alias("part"), "f"), ["lang", "part"])
    met = answers.groupBy("lang", "phrase", "size", "a").agg(F.map_from_entries(F.collect_list(F.struct("slot", "f"))).alias("f"))
    cut = lambda k: F.struct(_floor_score(F.col("a"), F.col("f")[k * 2], F.col("f")[k * 2 + 1]).alias("score"), k.alias("k"), F.col("f")[k * 2].alias("l"), F.col("f")[k * 2 + 1].alias("r"))
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut))
    return met.select("lang", "phrase", "size", "a", best.alias("best")).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def contained(candidates: DataFrame, percent: int) -> DataFrame:
    """lang, phrase of candidates that lie inside a longer one of at least percent/100 of their frequency."""
    w, n = F.split("phrase", " "), F.col("size")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    longer = candidates.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(longer, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("a") * percent).select("lang", "phrase")


def best_of_each(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of each lang by score, a and phrase, with their rank."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salts = min(MOST_SALTS, partitions(rows.sparkSession))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= limit)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= limit).drop("__salt")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, percent: int = 50, limit: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `most` words."""
    grams = written(counted_grams(written(pieces(docs), "pieces"), most, least), "grams")
    candidates = written(scored(grams), "phrases")
    stays = candidates.join(contained(candidates, percent), ["lang", "phrase"], "left_anti")
    words = grams.where("gram = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    best = best_of_each(stays, limit).join(words, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
