"""Mixing sources to target weights, in DataFrame operations only.

Words are packed into fixed-length blocks, source by source. Each output shard draws a multinomial number of
blocks per source; the drawn slots of a source are numbered through all shards, and slot q takes block
`perm(q mod n)` of pass `q div n`, perm being a pseudorandom permutation of the source's n blocks for that pass.
Slots and blocks meet in one join by index.

What multinomial noise leaves over or short of a source's whole-corpus target is settled: slots past the
target are dropped and the missing ones make up a last shard, so a source's blocks are within one of the target.

Cases: a null text has no words; a null source is a source of its own, last in order; repeated rows are
separate documents; documents without words take nothing; an empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 4096
ROUNDS = 12
SEED = 20240717
GRID = 4096
#: Shards whose drawn slots are summed up in one task.
SPAN = 4096


@dataclass
class Mix:
    """documents: uid, doc_id, source_id, start, size, source_size, target, n_blocks. slots: shard, source_id, q, block."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], passes: int) -> DataFrame:
    """sizes (skey, source, source_size) with source_id, weight, target.

    Water filling: with sources ordered by cap/weight, the level at which the uncapped ones share what the capped
    ones leave is the largest of the levels found after each prefix of caps. One row per source, so small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last(), "skey")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    before, all_ = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    return (
        sizes.withColumn("source_id", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("source_id") % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * passes)
        .withColumn("left_words", F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("left_weight", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("level", F.max(F.col("left_words") / F.col("left_weight")).over(all_))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("skey", "source", "source_id", "source_size", "weight", "target")
    )


def permuted(df: DataFrame, rounds: int, seed: int) -> DataFrame:
    """df (source_id, q, n_blocks, ...) with block: swap-or-not shuffle of q mod n, keyed by source and pass (Hoang et al., 2012).

    It permutes a domain of any size, in 64-bit sums and hashes only.
    """
    df = df.withColumn("pass", F.floor(F.col("q") / F.col("n_blocks")))

    def swap_or_not(x: Column, key: Column) -> Column:
        n = F.col("n_blocks")
        y = F.pmod(F.pmod(F.xxhash64(key, "source_id", "pass"), n) - x, n)
        bit = F.xxhash64(-key, "source_id", "pass", F.greatest(x, y)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, y).otherwise(x)

    # a fold, not a chain of columns: the optimizer would write those out into 2^rounds expressions
    return df.withColumn("block", F.aggregate(F.sequence(F.lit(seed), F.lit(seed + rounds - 1)), F.col("q") % F.col("n_blocks"), swap_or_not)).drop("pass")


def mix(
    docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, rounds: int = ROUNDS, seed: int = SEED,
) -> Mix:
    """The mix of docs (doc_id, text, source; other columns are ignored)."""
    spark: SparkSession = docs.sparkSession
    sized = scratch.keep(
        docs.select(
            F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), "source",
            word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
        ),
        "sized",
    )
    # positions in two levels, so that no source, however large, is summed up in one task
    salts = max(256, sized.count() // 50_000)
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", "text_hash"), F.lit(salts)))
    cells = scratch.keep(salted.groupBy("skey", "source", "salt").agg(F.sum("size").alias("cell_words")), "cells")
    sources = targets(cells.groupBy("skey", "source").agg(F.sum("cell_words").alias("source_size")), weights, passes)
    by_id = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    sources = scratch.keep(
        sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
        .withColumn("quota", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("high", F.sum("quota").over(by_id)),
        "sources",
    )
    first = Window.partitionBy("skey").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("cell_start", F.coalesce(F.sum("cell_words").over(first), F.lit(0))).select("skey", "salt", "cell_start")
    starts = starts.join(sources.select("skey", "source_id", "source_size", "target"), "skey")
    inside = Window.partitionBy("skey", "salt").orderBy("doc_id", "size", "text_hash", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        salted.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["skey", "salt"])
        .select("uid", "doc_id", "source_id", (F.col("cell_start") + F.col("before")).alias("start"), "size", "source_size", "target")
    )

    total, n_sources = sources.agg(F.coalesce(F.max("high"), F.lit(0)), F.count("*")).first()
    live = sources.where("quota > 0").select("source_id", "n_blocks", "quota", "high", (F.col("high") - F.col("quota")).alias("low"))
    step = max(1, -(-total // GRID))
    grid = live.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step))))
    grid = F.broadcast(grid) if n_sources <= BROADCAST_ROWS else grid
    parts = max(spark.sparkContext.defaultParallelism, -(-total // 250_000))
    draws = (
        spark.range(0, total, 1, parts)
        .select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("ticket"))
        .withColumn("cell", F.floor(F.col("ticket") / step))
        .join(grid, "cell")
        .where("ticket >= low AND ticket < high")
        .groupBy("shard", "source_id", "n_blocks", "quota")
        .agg(F.count("*").alias("drawn"))
    )
    # running sums in two levels, so that the shards of one source are not in one task
    draws = scratch.keep(draws.withColumn("span", F.floor(F.col("shard") / SPAN)), "draws")
    running = Window.partitionBy("source_id", "span").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = draws.groupBy("source_id", "span").agg(F.sum("drawn").alias("all_drawn"))
    earlier = Window.partitionBy("source_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("source_id", "span", F.coalesce(F.sum("all_drawn").over(earlier), F.lit(0)).alias("span_start"))
    draws = draws.withColumn("inside", F.coalesce(F.sum("drawn").over(running), F.lit(0))).join(spans, ["source_id", "span"]).withColumn("offset", F.col("span_start") + F.col("inside")).drop("span", "span_start", "inside")
    n_shards = -(-total // shard_slots)
    short = (
        live.join(draws.groupBy("source_id").agg(F.sum("drawn").alias("all_drawn")), "source_id", "left")
        .select(F.lit(n_shards).cast("long").alias("shard"), "source_id", "n_blocks", "quota", (F.col("quota") - F.coalesce("all_drawn", F.lit(0))).alias("drawn"), F.coalesce("all_drawn", F.lit(0)).alias("offset"))
        .where("drawn > 0")
    )
    slots = (
        draws.unionByName(short)
        .withColumn("last", F.least(F.col("offset") + F.col("drawn"), F.col("quota")) - 1)
        .where("last >= offset")
        .repartition(parts, "shard", "source_id")
        .select("shard", "source_id", "n_blocks", F.explode(F.sequence("offset", "last")).alias("q"))
    )
    return Mix(placed, sources, permuted(slots, rounds, seed).select("shard", "source_id", "q", "block"), block_words)


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """A row per document and block that it reaches into, with `words` in it and `skip`, the words of the document before it."""
    end = F.col("start") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)))
    low, high = F.greatest(F.col("start"), F.col("block") * block_words), F.least(end, (F.col("block") + 1) * block_words)
    return placed.withColumn("block", F.explode_outer(blocks)).withColumn("words", high - low).withColumn("skip", low - F.col("start"))


def taken(m: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), and uid."""
    # slots come from a small table of counts, by whose size Spark would take them for small: no broadcast
    times = m.slots.groupBy("source_id", "block").agg(F.count("*").alias("times")).hint("merge")
    return (
        pieces(m.documents, m.block_words)
        .join(times, ["source_id", "block"], "left")
        .groupBy("uid", "doc_id", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken", "uid")
    )


def blocks(m: Mix, docs: DataFrame) -> DataFrame:
    """The mixed blocks themselves: shard, source_id, q, block, text (its words, joined by spaces).

    docs must have a unique doc_id here, since texts are found by it.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    parts = (
        pieces(m.documents, m.block_words)
        .where("words > 0")
        .join(docs.select("doc_id", words.alias("all_words")), "doc_id")
        .select("source_id", "block", F.struct("start", F.slice("all_words", (F.col("skip") + 1).cast("int"), F.col("words").cast("int")).alias("ws")).alias("part"))
        .groupBy("source_id", "block")  # a block has block_words words at most, so its parts are few
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select("source_id", "block", F.array_join(F.flatten(F.col("parts.ws")), " ").alias("text"))
    )
    return m.slots.hint("merge").join(parts, ["source_id", "block"]).select("shard", "source_id", "q", "block", "text")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken(mix(docs, Scratch(spark, "mix"))).drop("uid")
