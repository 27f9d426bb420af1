"""Benchmark decontamination, in DataFrame operations only.

Every window of words of a text is hashed by doubling: hashes of single words give those of two words, these those of
four, and so on. The hashes of the benchmark's windows form a set that goes to every task, a broadcast table up to
BROADCAST_HASHES (some 60 bytes each), beyond it a bitmap of a fixed size; texts are scanned once. Only windows whose
hash is in the set are spelled out, and they are then verified against the benchmark's own words by an exact join.

Cases: a null text has no words; an item without words has no window; an item of fewer words than a window is one
window; items without id take part in hits and in no item list; repeated items count once per id; repeated
document rows are separate rows of the result; texts of any length are scanned whole, in time and memory that grow
with their words; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, with_ids_among

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
WINDOW = 10
#: Up to so many distinct window hashes are broadcast, 30 MB at most.
BROADCAST_HASHES = 500_000
#: Stands for the document itself among its windows.
SELF = 0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(1)), F.array().cast("array<string>"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being computed once per row."""
    return F.transform(F.array(value), then)[0]


def window_hashes(ws: Column, sizes: list[int]) -> Column:
    """array<struct<n, hs>>: for each size n the hashes of all windows of n words of ws, in order."""

    def joined(x: Column, y: Column, k: int) -> Column:
        """Each window of x with the one of y that begins k words later."""
        return F.zip_with(x, F.slice(y, F.lit(k + 1), F.greatest(F.size(y) - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def of(powers: dict[int, Column], n: int) -> Column:
        out, done = None, 0
        for p in sorted(powers, reverse=True):
            if (n - done) // p:
                out = powers[p] if out is None else joined(out, powers[p], done)
                done += p
        return F.slice(out, F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(0)))

    def level(powers: dict[int, Column]) -> Column:
        p = max(powers)
        if 2 * p <= max(sizes):
            return let(joined(powers[p], powers[p], p), lambda x: level({**powers, 2 * p: x}))
        return F.array(*[F.struct(F.lit(n).alias("n"), of(powers, n).alias("hs")) for n in sizes])

    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda x: level({1: x}))


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Windows of items (item_id, text): item, n, said (its words, joined by spaces, which no word holds), h."""
    cut = (
        items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("all"))
        .where(F.size("all") > 0)
        .select("item", "all", F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - n + 1, F.lit(1)))).alias("k"))
        .select("item", F.slice("all", F.col("k"), F.lit(n)).alias("ws"))
    )
    own = F.filter(window_hashes(F.col("ws"), list(range(1, n + 1))), lambda x: x["n"] == F.size("ws"))[0]["hs"][0]
    return cut.select("item", F.size("ws").alias("n"), F.array_join("ws", " ").alias("said"), own.alias("h")).distinct()


def scan(docs: DataFrame, items: DataFrame, scratch: Scratch, n: int = WINDOW) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, hits (start and length of each window that occurs), items."""
    table = scratch.keep(windows(items, n), "windows")
    sizes = sorted(r[0] for r in table.select("n").distinct().collect()) or [n]  # n of them at most
    hashes = scratch.keep(table.select("h").distinct().unionByName(docs.sparkSession.range(1).select(F.lit(SELF).cast("long").alias("h"))), "hashes")
    base = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", words(F.col("text")).alias("ws"))
    own = F.array(F.struct(F.lit(0).alias("n"), F.array(F.lit(SELF).cast("long")).alias("hs")))
    base = base.select("uid", "doc_id", "ws", F.explode(F.concat(own, window_hashes(F.col("ws"), sizes))).alias("w"))
    at = base.select("uid", "doc_id", "ws", F.col("w.n").alias("n"), F.posexplode("w.hs").alias("start", "h"))
    met = at.join(F.broadcast(hashes), "h") if hashes.count() <= BROADCAST_HASHES else with_ids_among(at, "h", hashes)
    met = met.select(
        "uid", "doc_id", F.when(F.col("n") == 0, F.size("ws").cast("long")).alias("n_words"), "start", "n",
        F.when(F.col("n") > 0, F.array_join(F.slice("ws", F.col("start") + 1, F.col("n")), " ")).alias("said"),
    )
    met = scratch.keep(met, "candidates")
    rows = met.where("n = 0").select("uid", "doc_id", "n_words")
    sure = met.where("n > 0").join(table.select("said").distinct(), "said").select("uid", F.struct("start", "n").alias("hit"), "said")
    named = sure.select("uid", "said").distinct().join(table.where("item IS NOT NULL").select("said", "item"), "said").select("uid", "item").distinct()
    every = (
        rows.unionByName(sure.select("uid", "hit"), allowMissingColumns=True)
        .unionByName(named, allowMissingColumns=True)
        .groupBy("uid")
        .agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("item").alias("items"))
    )
    return every.select("uid", "doc_id", "n_words", "hits", "items")


def hit_words(hits: Column) -> Column:
    """Places of the words inside any hit, each once."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = scan(docs, items, Scratch(spark, "decontam"))
    n_hit = F.size(hit_words(F.col("hits"))).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT uid, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, sizes WHERE len(w) >= n),
ds AS (SELECT uid, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM dw),
hits AS (SELECT ds.uid, ds.k, ds.n, win.item_id FROM ds JOIN win ON ds.n = win.n AND ds.s = win.s),
covered AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT uid, k, n FROM hits)) GROUP BY uid),
found AS (SELECT uid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (uid) LEFT JOIN found USING (uid)
"""
