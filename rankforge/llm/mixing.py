"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Sizes are words.  A source's target is its share of the mix by weight, at most max_times its own size; what a full source
leaves is shared among the others by weight until none is above its limit.  The targets are then turned into whole blocks
of block_words words by highest quotients (target divided by 1, 3, 5, ...).  Sources are cut into shards of about
shard_words words by a hash of the document, a source's blocks are dealt to its shards in proportion, and each shard takes
its quota of blocks: all blocks so many times, and the rest chosen by a seeded permutation of the block numbers.  A block
may begin and end inside documents; a document's words count once for each time that a block that holds them is taken.

Everything about sources and shards is a table; the driver sees single sums only.  No window spans more than one shard or
the shards of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import content_key, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_TIMES = 2
BLOCK_WORDS = 16
SHARD_WORDS = 250_000
#: Primes above any shard's number of blocks: multiplying by one permutes block numbers modulo that number (fixed values).
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with n, the number of each row in this order from 0, without moving all rows to one task."""
    parts = written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "numbered")
    offsets, at = [], 0
    for part, count in sorted((r[0], r[1]) for r in parts.groupBy("part").count().collect()):
        offsets += [F.lit(part), F.lit(at)]
        at += count
    if not offsets:
        return parts.withColumn("n", F.lit(0).cast("long")).drop("part")
    within = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("n", (within + F.create_map(*offsets)[F.col("part")]).cast("long")).drop("part")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_times: float = MAX_TIMES) -> DataFrame:
    """source, source_size, n (its number by code point, null last), target."""
    rows = numbered(sources, F.col("source").isNull().cast("int"), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("n") % len(weights) + 1).cast("int"))
    rows = written(rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(max_times)), "sources")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, None
    while total:
        above = F.col("weight") * level > F.col("most") if full is not None else F.lit(False)
        row = rows.agg(F.sum(above.cast("long")), F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if row[0] == full or not row[2]:
            break
        full, level = row[0], (total - row[1]) / row[2]
    return rows.withColumn("target", F.least("most", F.col("weight") * level)).drop("weight", "most")


def apportioned(parties: DataFrame, blocks: int) -> DataFrame:
    """parties (n, target, ...) with seats: blocks seats given out by highest quotients target / (2 * seat - 1), ties by n.

    Finds a divisor by which almost all seats are given, from sums over the table, then ranks the quotients between that
    and the next divisor.
    """
    count, total = parties.agg(F.count(F.lit(1)), F.sum("target")).first()
    if not total or blocks <= 0:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    seats = lambda d: F.floor(F.col("target") / d + 0.5)
    low, high = total / (blocks + count / 2 + 1), total / (blocks - count / 2 - 1) if blocks > count / 2 + 1 else 4 * total
    for _ in range(40):
        steps = [low + (high - low) * i / 32 for i in range(33)]
        got = {r[0]: r[1] for r in parties.select("target", F.posexplode(F.array(*map(F.lit, steps))).alias("i", "d")).groupBy("i").agg(F.sum(seats(F.col("d")))).collect()}
        i = max(i for i in got if got[i] >= blocks)
        low, high = steps[i], steps[min(i + 1, 32)]
        if got[i] - got[min(i + 1, 32)] <= max(count // 8, 32) or high - low <= 1e-15 * high:
            break
    spare = blocks - got[min(i + 1, 32)]
    base = parties.withColumn("seats", seats(F.lit(high)).cast("long"))
    open_seats = base.select("n", "target", F.explode(F.when(seats(F.lit(low)) > F.col("seats"), F.sequence(F.col("seats") + 1, seats(F.lit(low)).cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("seat"))
    ranked = numbered(open_seats.select(F.col("n").alias("party"), (F.col("target") / (2 * F.col("seat") - 1)).alias("quotient"), "seat"), F.col("quotient").desc(), F.col("party"), F.col("seat"))
    more = ranked.where(F.col("n") < spare).groupBy("party").agg(F.count(F.lit(1)).alias("more"))
    return base.join(more, F.col("n") == F.col("party"), "left").withColumn("seats", F.col("seats") + F.coalesce("more", F.lit(0))).drop("party", "more")


def mixture(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_times: float = MAX_TIMES, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 17) -> DataFrame:
    """doc_id, key_a, key_b (content key), source, size, source_size, target, shard, taken for every row of docs.

    Null texts have size 0 and are never taken; null sources form one source, the last; repeated rows are documents of
    their own; an empty table gives no rows.  A rerun on the same rows gives the same mix.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *content_key(F.col(text)), word_count(F.col(text)).alias("size"))
    rows = written(rows, "sizes")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_times)
    blocks = round((aims.agg(F.sum("target")).first()[0] or 0) / block_words)
    shares = written(apportioned(aims, blocks).withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")), "shares")
    mine = F.col("source").eqNullSafe(F.col("of"))
    by_source = shares.withColumnRenamed("source", "of")
    lot = F.xxhash64(F.lit(seed), "doc_id", "key_a", "key_b")
    placed = rows.join(by_source.select("of", "source_size", "target", "n_shards"), mine, "left").drop("of").withColumn("lot", lot).withColumn("shard", F.pmod("lot", "n_shards"))
    shard_sizes = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    dealt = shard_sizes.join(by_source.select("of", "source_size", "seats"), mine, "left").drop("of")
    so_far = F.floor(F.col("seats") * F.col("upto") / F.greatest(F.col("source_size"), F.lit(1)) + 0.5)
    before = F.floor(F.col("seats") * (F.col("upto") - F.col("shard_size")) / F.greatest(F.col("source_size"), F.lit(1)) + 0.5)
    n_blocks = F.ceil(F.col("shard_size") / block_words)
    dealt = dealt.withColumn("upto", F.sum("shard_size").over(W.partitionBy("source").orderBy("shard"))).select(
        F.col("source").alias("of"), F.col("shard").alias("of_shard"), n_blocks.alias("n_blocks"), F.least(so_far - before, max_times * n_blocks).cast("long").alias("quota")
    )
    running = F.sum("size").over(W.partitionBy("source", "shard").orderBy("lot", "doc_id", "key_a", "key_b").rowsBetween(W.unboundedPreceding, 0))
    laid = placed.withColumn("to", running).join(dealt, mine & (F.col("shard") == F.col("of_shard")), "left").drop("of", "of_shard")
    b, start = F.lit(block_words), F.col("to") - F.col("size")
    # each shard's own permutation, by the seed: a factor and a shift
    dice = F.xxhash64(F.lit(seed), "source", "shard")
    by, shift = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(dice, F.lit(len(PRIMES))) + 1).cast("int")).cast("long"), F.pmod(F.shiftrightunsigned(dice, 8), F.col("n_blocks"))
    chosen = lambda j: F.pmod(j * by + shift, F.col("n_blocks")) < F.pmod("quota", "n_blocks")
    part = lambda j: F.least(F.col("to"), (j + 1) * b) - F.greatest(start, j * b)
    some = F.aggregate(F.sequence(F.floor(start / b), F.floor((F.col("to") - 1) / b)), F.lit(0).cast("long"), lambda acc, j: acc + F.when(chosen(j), part(j)).otherwise(F.lit(0)))
    taken = F.when(F.col("size") > 0, F.col("size") * F.floor(F.col("quota") / F.col("n_blocks")) + some).otherwise(F.lit(0).cast("long"))
    return laid.select("doc_id", "key_a", "key_b", "source", "size", "source_size", "target", "shard", taken.cast("long").alias("taken"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
