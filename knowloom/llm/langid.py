"""Language identification by words first, then by shorter and shorter character n-grams.

A known word adds its smoothed log frequency in each language. An unknown word is scored by its padded character
n-grams of the longest order, 5 to 1, of which the model knows at least one: their mean log frequency, as a word's.

The classifier is fit on a bounded sample of labelled rows: of each language all up to LANG_ROWS, else about that many
by a hash of the id, so a rare language is learned from all of its rows. Words and n-grams are counted in distributed
form; the model then holds those seen MIN_COUNT times or more, the MAX_FEATURES most frequent ones at most, so what is
sent to the workers is bounded.

Cases: a null text, and one without a letter (of Unicode's class L), is `und` with score 0; rows without lang or doc_id
are not learned from; a null doc_id is not held out; without any labelled row every text is `und`; repeated rows are
separate rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from .common import Scratch, bounded

LANG_ROWS = 1000
MIN_COUNT = 3
MAX_FEATURES = 500_000
MAX_ORDER = 5
ALPHA = 0.2
CACHE = 50_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def fold(key: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(mod))


def drawn(limit: Column | int, n: Column | int, seed: int = 5) -> Column:
    """Whether a row (with doc_id) is among about `limit` of n, by a hash of the id; all are if n <= limit."""
    steps = 1 << 52
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(steps)) < F.lit(float(steps)) * limit / n


def sample(rows: DataFrame, limit: int, seed: int = 5) -> DataFrame:
    """All rows (with doc_id) up to the limit, else about as many, by a hash of the id."""
    n = rows.count()
    return rows if n <= limit else rows.where(drawn(limit, n, seed))


def sample_by(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The same for each value of key."""
    n = bounded(rows.groupBy(key).agg(F.count("*").alias("__n")))
    return rows.join(n, key).where(drawn(limit, F.col("__n"))).drop("__n")


def counted(text: str) -> Counter:
    """The words of a text, lower case, each with its number."""
    out = Counter(LETTERS.findall(text.lower()))
    for w in [w for w in out if not w.isalpha()]:  # LETTERS takes some number characters for letters
        n = out.pop(w)
        for x in "".join(c if c.isalpha() else " " for c in w).split():
            out[x] += n
    return out


def grams(word: str, order: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to partial counts (lang, kind, feature, n): kind 0 a word, 1..5 an n-gram's order."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(counted(text or ""))
        rows: list[tuple[str, int, str, int]] = []
        for lang, words in counts.items():
            by_order = [Counter() for _ in range(MAX_ORDER + 1)]
            for w, n in words.items():
                for order in range(1, MAX_ORDER + 1):
                    for g in grams(w, order):
                        by_order[order][g] += n
            by_order[0] = words
            rows += [(lang, order, f, n) for order, c in enumerate(by_order) for f, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (list(c) for c in zip(*rows, strict=True))], names=["lang", "kind", "feature", "n"])


class Model:
    """langs, and a table of features: kind (0 words, 1..5 n-grams), feature, and its count in each language.

    The look-up tables are built where texts are judged; the driver only passes the feature table on.
    """

    def __init__(self, langs: list[str], features: pa.Table):
        self.langs, self.features, self.cache = langs, features, {}

    @cached_property
    def tables(self) -> tuple[list[dict[str, int]], np.ndarray]:
        """By kind, a feature's row in the matrix of log frequencies."""
        kinds, names = self.features.column("kind").to_numpy(), self.features.column("feature")
        counts = np.stack([self.features.column(f"n{i}").to_numpy() for i in range(len(self.langs))], axis=1).astype(np.float32)
        out, logs = [], np.empty_like(counts)
        for kind in range(MAX_ORDER + 1):
            rows = np.flatnonzero(kinds == kind)
            logs[rows] = np.log(counts[rows] + ALPHA) - np.log(counts[rows].sum(axis=0) + ALPHA * max(1, len(rows)))
            out.append(dict(zip(names.take(pa.array(rows)).to_pylist(), rows.tolist(), strict=True)))
        return out, logs

    def word(self, w: str) -> np.ndarray:
        rows, logs = self.tables
        if (v := rows[0].get(w)) is not None:
            return logs[v]
        for order in range(MAX_ORDER, 0, -1):
            if found := [v for g in grams(w, order) if (v := rows[order].get(g)) is not None]:
                return logs[found].mean(axis=0, dtype=np.float64).astype(np.float32)
        return np.zeros(len(self.langs), np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = counted(text) if text else None
        if not words or not self.langs:
            return UNKNOWN, 0.0
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = self.word(w)
        weights = np.fromiter(words.values(), np.float64, len(words))
        total = weights @ np.array([cache[w] for w in words], np.float64)
        n = weights.sum()
        p = total / n * min(n, 24.0)  # words of a text are not independent: evidence counts as of 24 words at most
        p = np.exp(p - p.max())
        best = int(np.argmax(total))
        return self.langs[best], float(p[best] / p.sum())


def fit(rows: DataFrame, limit: int = LANG_ROWS) -> Model:
    """A model of rows (doc_id, text, lang), of which those with all three count."""
    ship(rows.sparkSession)
    rows = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    counts = sample_by(rows, "lang", limit).select("lang", "text").mapInArrow(count_features, "lang string, kind long, feature string, n long")
    counts = Scratch(rows.sparkSession, "langid").keep(counts.groupBy("kind", "feature", "lang").agg(F.sum("n").alias("n")), "counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    found = counts.groupBy("kind", "feature").agg(F.sum("n").alias("all"), *by_lang).where(F.col("all") >= MIN_COUNT)
    if found.count() > MAX_FEATURES:
        found = found.orderBy(F.desc("all"), "kind", "feature").limit(MAX_FEATURES)
    return Model(langs, found.drop("all").toArrow())


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns of docs with lang_pred and score for each text."""
    sent = ship(docs.sparkSession).sparkContext.broadcast((model.langs, model.features))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*sent.value)
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(lo, 1000)
                said = [judge(t) for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=[*part.schema.names[:n], "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def learned(docs: DataFrame) -> Model:
    """Fit on the rows that are not held out."""
    return fit(docs.where(fold("doc_id", 3) != 1))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.select("doc_id", "text", "lang", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    return predict(held, learned(docs), keep=("doc_id", "held_out"))
