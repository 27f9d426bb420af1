"""Incremental refresh, validation, audit and quality metrics over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ITEMS


def stale(files: DataFrame, cku: DataFrame) -> DataFrame:
    """files (source, hash, ...) that no record has with the same hash."""
    known = cku.select(F.col("meta.source").alias("source"), F.col("meta.hash").alias("hash"))
    return files.join(known, ["source", "hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


# --- merging chunks of a document: rows carry (source, chunk, pos, key), key being null where an item has no id ---


def first_wins(rows: DataFrame, by: tuple[str, ...] = ("source",), keep_empty: bool = True) -> DataFrame:
    """The first row of each key; rows without key are all kept, or all dropped. Reduced before the shuffle, so a key may be in any number of rows."""
    columns = rows.columns
    named = rows.where("key IS NOT NULL").groupBy(*by, "key").agg(F.min_by(F.struct(*columns), F.struct("chunk", "pos")).alias("first")).select("first.*")
    return named.unionByName(rows.where("key IS NULL")) if keep_empty else named


def merged_relations(rows: DataFrame) -> DataFrame:
    """rows (source, chunk, pos, key, relations): source, key, relations. All of a key's first occurrence, later ones if new."""
    rows, at = rows.where("key IS NOT NULL"), F.struct("chunk", "pos").alias("at")
    flat = rows.select("source", "key", at, F.posexplode("relations").alias("k", "r")).select("source", "key", "at", "k", "r.target", "r.type")
    firsts = rows.groupBy("source", "key").agg(F.min(at).alias("first"))
    own = flat.join(firsts, ["source", "key"]).where("at = first").drop("first")
    new = flat.groupBy("source", "key", "target", "type").agg(F.min(F.struct("at", "k")).alias("m")).select("source", "key", "m.at", "m.k", "target", "type").join(firsts, ["source", "key"]).where("at > first").drop("first")
    listed = own.unionByName(new, allowMissingColumns=True).groupBy("source", "key").agg(F.array_sort(F.collect_list(F.struct("at", "k", "target", "type"))).alias("r"))
    return listed.select("source", "key", F.transform("r", lambda x: F.struct(x["target"].alias("target"), x["type"].alias("type"))).alias("relations"))


def language_mode(chunks: DataFrame) -> DataFrame:
    """chunks (source, chunk, language): the most frequent language, ties to the first seen; nulls don't count."""
    counted = chunks.where("language IS NOT NULL").groupBy("source", "language").agg(F.count("*").alias("n"), F.min("chunk").alias("first"))
    return counted.groupBy("source").agg(F.max_by("language", F.struct("n", -F.col("first"))).alias("language"))


def merged_dependencies(chunks: DataFrame) -> DataFrame:
    """chunks (source, chunk, dependencies): distinct, in the order first seen, without nulls."""
    each = chunks.select("source", "chunk", F.posexplode("dependencies").alias("pos", "d")).where("d IS NOT NULL").groupBy("source", "d").agg(F.min(F.struct("chunk", "pos")).alias("at"))
    return each.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]).alias("dependencies"))


def merged(chunks: DataFrame) -> DataFrame:
    """chunks (source, chunk, n_chunks, CHUNK_DDL's columns) to one row per source: source, summaries, entities, facts, visuals, dependencies, language.

    A document of one chunk stays as it is (its language null if it was no text); of several, items are merged by key
    and summaries joined. Items whose types don't fit go after the merge, so they still stand before later ones.
    """
    kinds = list(ITEMS)

    def tagged(kind: str) -> Column:
        bodies = lambda x: [(x if k == kind else F.lit(None).cast(ITEMS[k])).alias(k) for k in kinds]
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["key"].alias("key"), *bodies(x)))

    rows = chunks.select("source", "chunk", "n_chunks", F.posexplode(F.concat(*[tagged(k) for k in kinds])).alias("pos", "i")).select("source", "chunk", "n_chunks", "pos", "i.*")
    several = rows.where("n_chunks > 1 AND NOT (kind = 'entities' AND key IS NULL)")
    relations = merged_relations(several.where("kind = 'entities'").select("source", "chunk", "pos", "key", F.col("entities.relations").alias("relations")))
    several = first_wins(several, ("source", "kind")).join(relations.withColumn("kind", F.lit("entities")), ["source", "kind", "key"], "left")
    several = several.withColumn("entities", F.when(F.col("relations").isNotNull(), F.col("entities").withField("relations", F.col("relations"))).otherwise(F.col("entities"))).drop("relations")
    every = rows.where("n_chunks = 1").unionByName(several)

    def listed(kind: str) -> Column:
        own = F.when((F.col("kind") == kind) & F.col(kind)["ok"], F.struct("chunk", "pos", F.col(kind).alias("x")))
        return F.transform(F.array_sort(F.collect_list(own)), lambda y: y["x"].dropFields("key", "ok")).alias(kind)

    found = every.groupBy("source").agg(*[listed(k) for k in kinds])
    one = F.col("n_chunks") == 1
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("chunk", "said")))), lambda x: x["said"]), " ")
    heads = chunks.groupBy("source").agg(F.max("n_chunks").alias("n"), said.alias("said"), F.first("document").alias("document"), F.first("language").alias("own"))
    out = heads.join(found, "source", "left").join(language_mode(chunks), "source", "left").join(merged_dependencies(chunks.where(~one)), "source", "left")
    out = out.join(chunks.where(one).select("source", F.col("dependencies").alias("own_dependencies")), "source", "left")
    empty = lambda k, t: F.coalesce(k, F.array().cast(t))
    types = {f.name: f.dataType for f in found.schema.fields}
    return out.select(
        "source", F.struct(F.when(F.col("n") == 1, F.col("document")).otherwise(F.col("said")).alias("document"), empty("sections", types["sections"]).alias("sections")).alias("summaries"),
        *[empty(k, types[k]).alias(k) for k in kinds[1:]], empty(F.when(F.col("n") == 1, F.col("own_dependencies")).otherwise(F.col("dependencies")), "array<string>").alias("dependencies"),
        F.when(F.col("n") == 1, F.col("own")).otherwise(F.coalesce("language", F.lit("en"))).alias("language"),
    )


# --- validation ---


def issues(cku: DataFrame) -> DataFrame:
    """id, issue: a row for each finding. All within a record, so without a join."""
    ids = F.transform("entities", lambda e: e["id"])
    fact_ids = F.transform("facts", lambda f: f["id"])

    def repeated(kind: str, xs: Column) -> Column:
        return F.when(F.size(xs) != F.size(F.array_distinct(xs)), F.array(F.lit(f"duplicate {kind} ids"))).otherwise(F.array().cast("array<string>"))

    targets = F.flatten(F.transform("entities", lambda e: F.transform(e["relations"], lambda r: F.struct(e["id"].alias("a"), r["target"].alias("b")))))
    refs = F.flatten(F.transform("facts", lambda f: F.transform(f["entities"], lambda r: F.struct(f["id"].alias("a"), r.alias("b")))))

    def unknown(what: str, pairs: Column) -> Column:
        return F.transform(F.filter(pairs, lambda p: ~F.array_contains(ids, p["b"])), lambda p: F.concat(F.lit(f"{what} "), p["a"], F.lit(": unknown entity "), p["b"]))

    def empty(name: str, c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array(F.lit(f"{name} is empty"))).otherwise(F.array().cast("array<string>"))

    found = F.concat(repeated("entity", ids), repeated("fact", fact_ids), unknown("entity", targets), unknown("fact", refs), empty("meta.source", "meta.source"), empty("meta.hash", "meta.hash"), empty("summaries.document", "summaries.document"))
    return cku.select("id", F.explode(found).alias("issue"))


# --- audit ---


def list_events(events: DataFrame, event: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    found = events.where(F.col("event") == event) if event else events
    return found.orderBy(F.desc("id")).offset(offset).limit(limit)


def count_events(events: DataFrame, event: str | None = None) -> DataFrame:
    found = events.where(F.col("event") == event) if event else events
    return found.agg(F.count("*").alias("n"))


# --- metrics ---


def averages(results: DataFrame) -> DataFrame:
    return results.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in ("keyword_score", "latency_ms", "token_estimate")])


def category_scores(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(F.count("*").alias("n"), F.avg("keyword_score").alias("avg_score"))
