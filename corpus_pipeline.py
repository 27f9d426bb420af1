"""The corpus pipeline: five stages over documents, each of which works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs, extra ones included. Empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowloom.llm import decontam, langid, mixing, neardup, pii
from knowloom.llm.common import Scratch, among, without

#: Texts whose language is less sure than this go.
MIN_LANGUAGE_SCORE = 0.4
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def whole(docs: DataFrame) -> Column:
    """A row as one column, so that no column of docs meets a name that a stage uses."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (or null), and those of no clear language; if nothing is labelled, nothing can be judged and all stay. Repeated rows are judged each."""
    model = langid.learned(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs
    judged = langid.predict(docs.select(whole(docs), "text"), model, keep=("row",))
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (one row of it), and all rows without doc_id. Only rows that may go are shuffled."""
    scratch = Scratch(spark, "pipeline")
    found = neardup.near_duplicates(docs.select("doc_id", "text"), scratch, SHINGLE_WORDS, SIMILAR_PERCENT)
    found = scratch.keep(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"), "judged")
    once = without(docs, F.col("doc_id"), found.select("doc_id"))
    repeated = among(docs, F.col("doc_id"), found.where("kept").select("doc_id")).where("maybe").join(found.where("kept").select(F.col("doc_id").alias("key")), "key")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row.text")))
    return once.unionByName(repeated.withColumn("nth", first).where("nth = 1").select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null texts stay. Rows of one doc_id and text go together, those without doc_id by their text. Only rows that may go are shuffled."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    scratch = Scratch(spark, "pipeline")
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    found = decontam.scan(docs.select(key.alias("doc_id"), "text"), items, scratch)
    leaked = scratch.keep(found.where(F.size("hits") > 0).select(F.col("doc_id").alias("gone")).distinct(), "leaked")
    return without(docs, key, leaked)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind's mark; n_chars, where there is such a column, follows the text. Null and empty texts stay as they are, repeated rows are masked each."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with doc_id, size, source_size, target and taken (words that the mix takes). Those of which it takes none, so null and empty texts too, are left out; repeated rows are documents each."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source"), Scratch(spark, "pipeline"))
    return mixing.taken(mixed).where("taken > 0").drop("uid")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, f"{k}-{name}")
    return docs


#: Language identification, the field of the personal-data stage and the pseudorandom mix can't be written in SQL.
ORACLE_SQL: str | None = None
