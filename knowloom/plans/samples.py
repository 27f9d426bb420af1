"""Records made from the tables by rule, so that the operators can run on them: capitalised words are entities, sentences facts.

These rules are ours; a real extraction provider takes their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_hash, source_to_id
from ..scratch import Scratch


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.concat(F.lit("docs/"), "source", F.lit("/Doc "), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))


def cku(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}{4,})"), F.lit(1))))
    sentences = F.filter(F.transform(F.split("text", r"[.\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    d = d.select("*", names.alias("names"), sentences.alias("sentences"))
    # pairs of neighbours by zip: an index into names inside the lambda would extract the names anew for each element
    none = F.array().cast("array<struct<target:string,type:string>>")
    relation = lambda m: F.when(m.isNotNull(), F.array(F.struct(F.lower(m).alias("target"), F.lit("next").alias("type")))).otherwise(none)
    following = F.zip_with("names", F.slice("names", 2, 1 << 30), lambda n, m: F.struct(F.lower(n).alias("id"), n.alias("name"), F.col("source").alias("type"), relation(m).alias("relations")))
    roles = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("hr"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("admin"), F.lit("hr"))).otherwise(F.array().cast("array<string>"))
    facts = F.transform("sentences", lambda s, i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("id"), s.alias("claim"), F.struct((i % 7).alias("page"), F.lit(None).cast("string").alias("section")).alias("source"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("entities")))
    return d.select(
        "doc_id", source_to_id(F.col("path")).alias("id"),
        F.struct(F.col("path").alias("source"), F.lit("2024-01-01T00:00:00+00:00").alias("compiled"), content_hash(F.col("text")).alias("hash"), F.lit("markdown").alias("type"), F.col("lang").alias("language"), F.struct(roles.alias("roles")).alias("access")).alias("meta"),
        F.struct(F.try_element_at("sentences", F.lit(1)).alias("document"), F.array(F.struct(F.lit("s1").alias("id"), F.col("lang").alias("title"), F.col("lang").alias("summary"))).alias("sections")).alias("summaries"),
        following.alias("entities"), facts.alias("facts"),
        F.array().cast("array<struct<id:string,type:string,source:struct<page:int,section:string>,description:string,structured_data:string,context:string>>").alias("visuals"),
        F.array().cast("array<string>").alias("dependencies"),
    )


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entities and topics are made from, written once and read back, so that names are looked for once. Facts are the whole texts: they stay in the input."""
    return Scratch(spark, "records").keep(cku(spark, sf_dir).select("id", "entities", F.struct("summaries.sections").alias("summaries")), "ckus", "zstd")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole user turn as a question."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))
