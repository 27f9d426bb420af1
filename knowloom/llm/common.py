"""Helpers shared by the training-data operators: scratch tables, skew-safe joins, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, delete_path, path_exists, shared_dir

__all__ = ["Scratch", "delete_path", "path_exists", "shared_dir"]

#: A join side is broadcast only if it has at most this many rows (of a few dozen bytes each).
BROADCAST_ROWS = 50_000

#: Keys that hold at least 1/HOT_SHARE of all rows are joined by broadcast; there can be HOT_SHARE of them at most.
HOT_SHARE = 1000

BITMAP_BITS = 1 << 26

#: Characters of texts that a Python worker works on at once; a longer text is taken alone.
SLICE = 1_000_000

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > SLICE:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if len(texts) > lo:
        yield lo, len(texts)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small enough, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """left join right on key, right being unique by key with its number of left rows in column n.

    Keys with at least 1/HOT_SHARE of all `total` left rows (so HOT_SHARE keys at most) meet their
    rows by broadcast, without a shuffle; all other keys by a shuffled join whose groups are small.
    """
    limit = max(total // HOT_SHARE, 1000)
    hot = F.broadcast(right.where(F.col(n) >= limit).drop(n))
    marked = left.join(hot.select(key, F.lit(True).alias("__hot")), key, "left")
    warm = left.join(hot, key)
    cold = marked.where(F.col("__hot").isNull()).drop("__hot").join(right.where(F.col(n) < limit).drop(n), key, how)
    return warm.unionByName(cold)


def among(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows of df as `row`, their key as `key`, and whether it `maybe` is among ids (one column): true for all that are, and for a few others.

    A filter before a join: df's rows are not shuffled. The ids become a bitmap of BITMAP_BITS hashed bits in 4 KB
    pieces, 16 MB at most as a broadcast table whatever their number; with very many ids it just lets more rows through.
    """
    hashed = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(BITMAP_BITS))
    pieces = ids.select(hashed.alias("h")).groupBy(F.floor(F.col("h") / 32768).alias("piece")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("bits"))
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key"))
    marked = marked.withColumn("h", F.pmod(F.xxhash64("key"), F.lit(BITMAP_BITS))).withColumn("piece", F.floor(F.col("h") / 32768))
    byte = F.expr("CAST(conv(hex(substring(bits, CAST(h % 32768 DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    maybe = F.coalesce(F.getbit(byte, (F.col("h") % 8).cast("int")) == 1, F.lit(False))
    return marked.join(F.broadcast(pieces), "piece", "left").select("row", "key", maybe.alias("maybe"))


def with_ids_among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key is among ids (one column), and a few others whose hash falls together with one."""
    return among(df, F.col(f"`{key}`"), ids).where("maybe").select("row.*")


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of df whose key is not among gone (one column); only rows that a bitmap can't clear are shuffled. A null key is not among any."""
    marked = among(df, key, gone)
    name = gone.columns[0]
    rest = marked.where("maybe").join(gone.select(F.col(name).alias("gone")).distinct(), F.col("key") == F.col("gone"), "left_anti")
    return marked.where("NOT maybe").select("row.*").unionByName(rest.select("row.*"))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): a table (node, label), label being the smallest node.

    Alternates the two star operations of Kiveris et al. (2014): each shuffle is keyed by a node, groups are
    reduced to their minimum before the shuffle, and hot nodes are joined by broadcast. Only a count and two hashes reach
    the driver each round; the rounds end when the edges stay as they are. Nodes may be any 64-bit numbers.
    """
    edges = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state = F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "a", "b"))
    seen = edges.agg(*state).first()
    for k in count(1):
        total = seen[0]  # neither star has more rows
        if not total:
            break
        # large star: each node's larger neighbours go to its smallest neighbour (or itself)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = join_hot(both.where("v > u"), low, "u", "n", 2 * total).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large, f"{name}-{k}-large")
        # small star: each node's smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        pairs = join_hot(large, low, "a", "n", total)
        edges = scratch.keep(
            pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(pairs.select("a", F.col("m").alias("b"))).distinct(),
            f"{name}-{k}",
        )
        # stable once every node has one edge, to a node that has none itself, and nothing moves
        now = edges.agg(*state).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
