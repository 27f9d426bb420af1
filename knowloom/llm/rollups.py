"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums over committed batches of signed changes: an insert adds a
document and its tokens, a delete takes both away, a revised count takes the old tokens away and adds the new ones.
A batch is reduced to one row per group and written to a folder of its own; then its commit file is created, which
fails if there is one, so of two drivers that bring the same batch one counts. A batch that is committed is never applied
again, one that broke off before its commit file is written anew, so replays and retries change nothing.

`compact` folds what is committed into the base of a new generation, which also holds the ids of all folded batches. The
driver lists only the commits since then.

Cases: a null text has no tokens; null sources, languages and tokenizers are groups of their own; repeated rows are
separate documents; a change without an op that is known, or without a count that it needs, fails its batch, and
nothing of it counts; groups whose documents and tokens cancel out are left out of the totals; an empty batch commits as
such.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from .common import Scratch, delete_path, path_exists

TOKENIZERS = "/opt/tokenizers"
BPE = "byte_bpe_50k"
#: Splits text into pieces within which pairs merge; fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS = "words"
GROUP = ("source", "lang", "tokenizer")
CHANGE = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


class Rollup:
    """Additive totals under a folder that the cluster shares, in a store that can create a file only if it is not there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _create(self, path: str, text: str) -> bool:
        """A new file; False if there is one."""
        fs, where = self._fs(path)
        if fs.exists(where):
            return False
        try:
            out = fs.create(where, False)
        except Py4JJavaError:
            if fs.exists(where):
                return False
            raise
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def _listed(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(n for x in fs.listStatus(where) if not (n := x.getPath().getName()).startswith((".", "_"))) if fs.exists(where) else []

    def _text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def generation(self) -> tuple[int, str]:
        """Number and folder of the present generation."""
        last = max(self._listed(f"{self.root}/generations"), default=None)
        return (0, f"{self.root}/g0") if last is None else (int(last), f"{self.root}/{self._text(f'{self.root}/generations/{last}')}")

    def committed(self, batch: str) -> bool:
        n, folder = self.generation()
        return path_exists(self.spark, f"{folder}/commits/{batch}") or bool(n) and not self.spark.read.parquet(f"{folder}/folded").where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (columns of CHANGE) as a batch once; False if it was committed before."""
        if not re.fullmatch(r"\w[\w.-]*", batch):
            raise ValueError(f"bad batch id {batch!r}")
        if self.committed(batch):
            return False
        op, tokens, old = F.col("op"), F.col("tokens"), F.col("old_tokens")
        fail = lambda what: F.raise_error(F.concat(F.lit(what), F.to_json(F.struct("op", "source", "lang", "tokenizer", "tokens", "old_tokens")))).cast("long")
        count = F.when(~F.coalesce(op.isin("insert", "delete", "revise"), F.lit(False)), fail("unknown change: ")).when(tokens.isNull() | ((op == "revise") & old.isNull()), fail("a count is missing: "))
        signed = count.when(op == "delete", -tokens).when(op == "revise", tokens - old).otherwise(tokens)
        docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
        deltas = changes.groupBy(*GROUP).agg(F.sum(docs).cast("long").alias("docs"), F.sum(signed).cast("long").alias("tokens"))
        folder, name = self.generation()[1], f"{batch}-{uuid.uuid4().hex}"
        deltas.write.parquet(f"{folder}/batches/{name}")
        return self._create(f"{folder}/commits/{batch}", name)

    def deltas(self) -> DataFrame:
        """Base and committed batches: source, lang, tokenizer, docs, tokens."""
        n, folder = self.generation()
        out = self.spark.read.parquet(f"{folder}/base") if n else self.spark.createDataFrame([], DELTA)
        if self._listed(f"{folder}/commits"):
            names = [r[0] for r in self.spark.read.text(f"{folder}/commits", wholetext=True).collect()]  # those since the last compaction
            out = out.unionByName(self.spark.read.schema(DELTA).parquet(*[f"{folder}/batches/{x}" for x in names]))
        return out

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        return self.deltas().groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold what is committed into a new generation; the one before is kept, older ones go. Single writer: no commit may run meanwhile."""
        n, folder = self.generation()
        name = f"g{n + 1}-{uuid.uuid4().hex}"
        ids = self.spark.createDataFrame([(x,) for x in self._listed(f"{folder}/commits")], "batch string")
        (self.spark.read.parquet(f"{folder}/folded").unionByName(ids) if n else ids).write.parquet(f"{self.root}/{name}/folded")
        self.totals().select(*GROUP, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens")).write.parquet(f"{self.root}/{name}/base")
        if not self._create(f"{self.root}/generations/{n + 1:012d}", name):
            raise RuntimeError("compacted by another driver")
        kept = {name, folder.rpartition("/")[2], "generations"}
        for old in self._listed(self.root):
            if old not in kept:
                delete_path(self.spark, f"{self.root}/{old}")


def ranks(folder: str, name: str = BPE) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, f"{name}.tiktoken").read_bytes().splitlines())}


def count_tokens(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """docs (source, lang, text): source, lang, words, bpe. The vocabulary goes to executors by broadcast (under 1 MB)."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(ranks(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding(BPE, pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(lo, 500)
                n = [len(encoding.encode_ordinary(t)) if t else 0 for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64())], names=["source", "lang", "words", "bpe"])

    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("source", "lang", words.alias("words"), "text").mapInArrow(run, "source string, lang string, words long, bpe long")


def changes(counts: DataFrame, op: str, tokenizer: str, tokens: str, old: str | None = None) -> DataFrame:
    return counts.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens. All documents arrive with words as a draft of their tokens, then the drafts are deleted and the counts revised."""
    scratch = Scratch(spark, "rollup")
    counts = scratch.keep(count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text"), tokenizers), "counts")
    rollup = Rollup(spark, f"{scratch.root}/totals")
    arrived = changes(counts, "insert", WORDS, "words").unionByName(changes(counts, "insert", "draft", "words")).unionByName(changes(counts, "insert", BPE, "words"))
    revised = changes(counts, "delete", "draft", "words").unionByName(changes(counts, "revise", BPE, "bpe", "words"))
    for batch, feed in (("1-arrived", arrived), ("2-revised", revised), ("2-revised", revised)):  # the last one is a replay
        rollup.commit(batch, feed)
    return rollup.totals()
