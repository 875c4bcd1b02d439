"""From `documents` to a shuffled, sharded training mix, in five stages.

Each stage takes all rows that the one before it kept, is written as Parquet and read
again. All but the last return the columns of `documents`:

1. language ID drops rows without a letter and rows that fit no learned language;
2. SimHash near-dedup leaves one row of each group of near duplicates: fingerprints of
   op10's kind within 2 bits, or wide fingerprints over five words that show a
   similarity of 0.8 or more;
3. decontamination drops rows that hold half or more of a benchmark item;
4. mixing repeats and drops whole rows until sources come near their target weights;
5. sharding adds `shard` (0 to 39) and `slot`.

Null texts and texts without a letter go in stage 1; null sources are mixed as a
source of their own; an empty table stays empty. SQL can't express EM, so ORACLE_SQL is
None and the stages are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontam, langid, mixing, sharding, simhash
from panelspark.llm.common import table, written

SHARDS = 40
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shards(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
