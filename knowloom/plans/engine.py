"""Compiling files to records and answering questions from them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions.ids import source_to_id
from ..functions.text import keyword_score, matched_keywords
from ..operators import coerce, kmap, providers, records, route, split
from ..schema import CHUNK_DDL, CKU_DDL, PARSED_DDL
from ..sources import files
from ..sources.store import Store

FOUND_DDL = "source string, chunk int, n_chunks int, found string, error string"


def parsed(found: DataFrame) -> DataFrame:
    """Files (source, content, hash) to documents (PARSED_DDL); an error is the row's, not the job's."""
    parsers = files.PARSERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["source"], pdf["content"], strict=True):
                try:
                    kind, pages = files.parse(path, bytes(content), parsers)
                    rows.append((kind, pages, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"source": pdf["source"], "hash": pdf["hash"], "type": [r[0] for r in rows], "pages": [r[1] for r in rows], "error": [r[2] for r in rows]})

    return found.select("source", "content", "hash").mapInPandas(run, PARSED_DDL)


def extracted(documents: DataFrame, max_lines: int, provider: str, options: dict) -> DataFrame:
    """Documents (source, pages) to what the provider finds in each of their chunks (FOUND_DDL; found is JSON of CHUNK_DDL)."""
    chunks = documents.select("source", split.chunks(F.col("pages"), max_lines).alias("cs")).select("source", F.size("cs").alias("n_chunks"), F.posexplode("cs").alias("chunk", "c"))
    rows = chunks.select("source", "chunk", "n_chunks", F.to_json("c").alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = providers.get_provider(provider, **options)
        for pdf in batches:
            out = []
            for pages in pdf["pages"]:
                try:
                    out.append((json.dumps(coerce.chunk(model.compile_document({"pages": json.loads(pages)})), ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pdf[["source", "chunk", "n_chunks"]].assign(found=[r[0] for r in out], error=[r[1] for r in out])

    return rows.mapInPandas(run, FOUND_DDL)


def compiled(found: DataFrame) -> DataFrame:
    """What was found in chunks (FOUND_DDL) to one row per document: source, error, and where there is none summaries, entities, facts, visuals, dependencies, language."""
    errors = found.groupBy("source").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk"))).alias("error"))
    good = found.join(errors.where("error IS NOT NULL").select("source"), "source", "left_anti")
    typed = good.select("source", "chunk", "n_chunks", F.from_json("found", CHUNK_DDL, {"mode": "FAILFAST"}).alias("c")).select("source", "chunk", "n_chunks", "c.*")
    out = errors.join(records.merged(typed), "source", "left")
    return out.withColumn("error", F.when(F.col("error").isNull() & F.col("language").isNull(), "ValueError: language must be text").otherwise(F.col("error")))


class Compiler:
    def __init__(self, spark: SparkSession, config: files.Config):
        self.spark, self.config, self.store = ship(spark), config, Store(spark, config.store_dir)

    def compile(self, source: str | list[str], force: bool = False, roles: list[str] | None = None, names: dict[str, str] | None = None, user: str | None = None) -> DataFrame:
        """Compile a file, a directory or a list of files: (source, status, error), status compiled, skipped or failed.

        roles None keeps the stored ones; names gives files logical source names.
        """
        paths = [p for s in ([source] if isinstance(source, str) else source) for p in files.collect_files(s)]
        found = files.files(self.spark, paths)
        if names:
            given = self.spark.createDataFrame(list(names.items()), "source string, name string")
            found = found.join(given, "source", "left").withColumn("source", F.coalesce("name", "source")).drop("name")
        old = self.store.ckus()
        todo = found if force else records.stale(found, old)
        # parsing and paid calls are made once: their output is written before it is used
        stage = f"{self.config.store_dir.rstrip('/')}/staging/{uuid.uuid4().hex}"
        documents = self._kept(parsed(todo), f"{stage}/parsed")
        options = {"model": self.config.model, "url": self.config.url, "api_key": self.config.api_key}
        found_in = self._kept(extracted(documents.where("error IS NULL"), self.config.max_section_lines, self.config.provider, options), f"{stage}/found")
        done = self._kept(documents.select("source", "hash", "type", F.col("error").alias("unread"), F.exists("pages", lambda p: F.size(p["visuals"]) > 0).alias("seen")).join(compiled(found_in), "source", "left"), f"{stage}/done")
        done = done.withColumn("error", F.coalesce("unread", "error")).withColumn("type", F.when(F.col("seen"), F.concat("type", F.lit("/multimodal"))).otherwise(F.col("type")))
        kept = old.select(F.col("meta.source").alias("source"), F.col("meta.access.roles").alias("old_roles"))
        given = F.lit(None).cast("array<string>") if roles is None else F.array(*[F.lit(r) for r in roles]).cast("array<string>")
        access = F.struct(F.coalesce(given, "old_roles", F.array().cast("array<string>")).alias("roles")).alias("access")
        now = datetime.now(timezone.utc).isoformat()
        new = done.where("error IS NULL").join(kept, "source", "left").select(
            source_to_id(F.col("source")).alias("id"), F.struct("source", F.lit(now).alias("compiled"), "hash", "type", "language", access).alias("meta"),
            "summaries", "entities", "facts", "visuals", "dependencies",
        )
        if roles is not None and not force:  # changed roles of unchanged files
            same = found.select("source").join(done.select("source"), "source", "left_anti")
            moved = old.join(same.withColumnRenamed("source", "__s"), F.col("meta.source") == F.col("__s")).drop("__s").where(~F.col("meta.access.roles").eqNullSafe(given))
            new = new.unionByName(moved.withColumn("meta", F.col("meta").withField("access", F.struct(given.alias("roles")))))
        self.store.save(new)
        status = F.when(F.col("error").isNotNull(), "failed").when(F.col("hash").isNotNull(), "compiled").otherwise("skipped")
        out = self._kept(found.select("source").join(done.select("source", "hash", "error"), "source", "left").select("source", status.alias("status"), "error"), f"{stage}/outcome")
        self.store.log("compile", {"source": source, "status": {r[0]: r[1] for r in out.groupBy("status").count().collect()}, "roles": roles}, user)
        return out

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


class Asker:
    def __init__(self, spark: SparkSession, config: files.Config):
        self.spark, self.config, self.store = ship(spark), config, Store(spark, config.store_dir)

    def ask(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        """questions (qid, question, role): with prompt, sources, tokens, ckus (routed and allowed, in order) and answer. Roles are applied after top-k."""
        c = self.store.ckus()
        found = route.top(route.scores(questions, kmap.entities(c), kmap.topics(c), kmap.facts_all(c)), top_k or self.config.top_k)
        found = route.allowed(found.join(questions.select("qid", "role"), "qid"), c.select(F.col("id").alias("cku_id"), F.col("meta.access.roles").alias("roles")))
        context = route.assemble(found, c).join(found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cku_id"))), lambda x: x["cku_id"]).alias("ckus")), "qid")
        provider, options = self.config.provider, {"model": self.config.model, "url": self.config.url, "api_key": self.config.api_key}

        @F.pandas_udf("string")
        def said(prompt: pd.Series, question: pd.Series) -> pd.Series:
            if prompt.isna().all():
                return prompt  # nothing found: no provider is needed
            model = providers.get_provider(provider, **options)
            return pd.Series([None if p is None else model.answer_query(q, p) for p, q in zip(prompt, question, strict=True)])

        return route.answer(questions, context, said.asNondeterministic())

    def query(self, question: str, role: str | None = None, top_k: int | None = None, user: str | None = None) -> dict:
        one = self.spark.createDataFrame([(1, question, role)], "qid long, question string, role string")
        row = self.ask(one, top_k).first().asDict()
        row["ckus"], row["sources"] = row["ckus"] or [], row["sources"] or []
        self.store.log("query", {"question": question, "cku_ids": row["ckus"], "sources": row["sources"], "user_role": role}, user)
        return row


def benchmark(spark: SparkSession, config: files.Config, folder: str, force: bool = True, clock: Callable[[], float] = time.perf_counter) -> tuple[dict, DataFrame]:
    """Compile a data set's documents, ask its questions one after the other, each timed, and score the answers by expected keywords: (report, results)."""
    questions, paths = files.load_dataset(spark, folder)
    began = clock()
    Compiler(spark, config).compile(f"{folder}/docs", force=force).count()
    taken, asker, rows = clock() - began, Asker(spark, config), []
    asked = questions.collect()  # a data set's questions, by hand
    for q in asked:
        began = clock()
        got = asker.query(q.question)
        rows.append((q.id, got["answer"], got["tokens"] or 0, len(got["sources"]), len(got["ckus"]), (clock() - began) * 1000))
    said = spark.createDataFrame(rows, "id string, answer string, token_estimate long, sources_used int, routed_ckus int, latency_ms double")
    results = questions.join(said, "id").withColumn("matched_keywords", matched_keywords(F.col("answer"), F.col("expected_keywords"))).withColumn("keyword_score", keyword_score(F.col("answer"), F.col("expected_keywords")))
    means = records.averages(results).first()
    by_id = {r.id: r for r in results.collect()}
    report = {
        "dataset": Path(folder).name, "total_questions": len(asked), "compile_time_s": round(taken, 2), "compile_doc_count": len(paths), "avg_keyword_score": round(means.avg_keyword_score, 3),
        "avg_latency_ms": round(means.avg_latency_ms, 1), "avg_tokens": round(means.avg_token_estimate, 1), "category_scores": {r[0]: round(r[2], 3) for r in records.category_scores(results).collect()},
        "questions": [
            {"id": r.id, "question": r.question, "category": r.category, "keyword_score": round(r.keyword_score, 3), "latency_ms": round(r.latency_ms, 1), "token_estimate": r.token_estimate, "matched_keywords": r.matched_keywords, "expected_keywords": r.expected_keywords}
            for r in (by_id[q.id] for q in asked)
        ],
    }
    return report, results
