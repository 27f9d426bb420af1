"""The knowledge map: tables derived from cku rows, and searches over them. Nothing is mutated; changed ids are recomputed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, fts_line


def ckus(cku: DataFrame) -> DataFrame:
    return cku.select("id", F.col("meta.source").alias("source"), F.col("meta.compiled").alias("compiled"), F.col("summaries.document").alias("doc_summary"))


def last_of_ids(items: str) -> Column:
    """The items of an array column of which no later one has the same id: within the row, without a shuffle."""
    ids = F.transform(items, lambda x: x["id"])
    late = lambda back: F.filter(items, lambda x, i: F.size(items) - F.array_position(back, x["id"]) == i)
    return F.when(F.size(F.array_distinct(ids)) == F.size(ids), F.col(items)).otherwise(F.transform(F.array(F.reverse(ids)), late)[0])


def entities(cku: DataFrame, relations: bool = False) -> DataFrame:
    """id, cku_id, name, type: of repeated ids in a document the last one stays, with its relations only."""
    rows = cku.select(F.col("id").alias("cku_id"), "entities").select("cku_id", F.explode(last_of_ids("entities")).alias("e"))
    return rows.select(F.col("e.id").alias("id"), "cku_id", F.col("e.name").alias("name"), F.col("e.type").alias("type"), *([F.col("e.relations").alias("relations")] if relations else []))


def entity_relations(cku: DataFrame) -> DataFrame:
    rows = entities(cku, relations=True).select(F.col("id").alias("entity_id"), "cku_id", F.explode("relations").alias("r"))
    return rows.select("entity_id", "cku_id", F.col("r.target").alias("target"), F.col("r.type").alias("relation_type"))


def facts_all(cku: DataFrame) -> DataFrame:
    """cku_id, seq, id, claim: repeated ids kept (what full-text search sees)."""
    return cku.select(F.col("id").alias("cku_id"), F.posexplode("facts").alias("seq", "f")).select("cku_id", "seq", F.col("f.id").alias("id"), F.col("f.claim").alias("claim"))


def facts(cku: DataFrame) -> DataFrame:
    rows = cku.select(F.col("id").alias("cku_id"), "facts").select("cku_id", F.explode(last_of_ids("facts")).alias("f"))
    return rows.select(F.col("f.id").alias("id"), "cku_id", F.col("f.claim").alias("claim"))


def topics(cku: DataFrame) -> DataFrame:
    """Per document the distinct non-empty types of entities and titles of sections, lower-cased: per-row sets, no shuffle."""
    found = F.array_union(F.transform("entities", lambda e: F.lower(e["type"])), F.transform("summaries.sections", lambda s: F.lower(s["title"])))
    return cku.select(F.col("id").alias("cku_id"), F.explode(F.filter(F.array_distinct(found), lambda t: t.isNotNull() & (t != ""))).alias("topic"))


def like(col, pattern: str):
    """Contains, ignoring case of ASCII letters; _ stands for any character and % for any text; a backslash is itself."""
    return ascii_fold(col).like("%" + pattern.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\\", "\\\\") + "%")


def find_by_entity(entity: DataFrame, name: str) -> DataFrame:
    return entity.where(like(F.col("name"), name)).select("cku_id").distinct()


def find_by_topic(topic: DataFrame, name: str) -> DataFrame:
    return topic.where(like(F.col("topic"), name)).select("cku_id").distinct()


def find_by_keywords(fact: DataFrame, keywords: list[str], any_of: bool = False) -> DataFrame:
    """cku_id, hits: facts that hold all keywords, each as a phrase (any_of: one of them at least)."""
    spark = fact.sparkSession
    if not keywords:
        return spark.createDataFrame([], "cku_id string, hits long")
    asked = spark.createDataFrame([(k,) for k in keywords], "k string").select(F.collect_list(fts_line(F.col("k"))).alias("phrases"))
    held = F.exists if any_of else F.forall
    # the phrases are one literal row
    phrases = asked.first()[0]
    line = fts_line(F.col("claim"))
    hit = held(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.col("line"), p))
    return fact.select("cku_id", line.alias("line")).where(hit).groupBy("cku_id").agg(F.count("*").alias("hits"))


def relations_of(entity: DataFrame, relation: DataFrame, name: str) -> DataFrame:
    found = entity.where(like(F.col("name"), name)).select(F.col("id").alias("entity_id"), "cku_id", "name")
    return found.join(relation, ["entity_id", "cku_id"]).select("cku_id", "name", "relation_type", "target")


def all_entities(entity: DataFrame) -> DataFrame:
    return entity.orderBy(ascii_fold(F.col("name")), "name", "cku_id", "id")


def stats(cku: DataFrame) -> DataFrame:
    """ckus, entities, facts, relations, topics: sums of per-row sizes, and one distinct count."""
    size = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    relations = F.aggregate(last_of_ids("entities"), F.lit(0), lambda n, e: n + F.greatest(F.size(e["relations"]), F.lit(0)))
    distinct = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["id"])))
    rows = cku.agg(F.count("*").alias("n_ckus"), size(distinct("entities")).alias("n_entities"), size(distinct("facts")).alias("n_facts"), size(relations).alias("n_relations"))
    both = rows.unionByName(topics(cku).agg(F.countDistinct("topic").alias("n_topics")), allowMissingColumns=True)
    return both.agg(*[F.max(f"n_{c}").alias(c) for c in ("ckus", "entities", "facts", "relations", "topics")])
