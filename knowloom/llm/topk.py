"""Exact top-k search by MaxScore.

Each vector component, turned into an integer, is a term with signed impact; a shard of vectors keeps its terms as
dense postings, one column per dimension in vec_id order, with each column's least and largest impact. For a query,
terms are ordered by what they can still add in this shard (score bound less score floor). Non-essential terms are the
longest tail whose bounds together cannot lift a vector from its floor past the current k-th score; the other terms'
postings are traversed, block by block of terms, and vectors whose score so far plus the rest's bound stays below the
k-th score leave. What is left is probed in the non-essential terms. Shards' lists are merged by (score, vec_id).

The k-th score to beat starts from the query's k-th best score in one seed shard, so that the other shards return only
vectors that may be among the k best of all, and grows with the exact scores of the vectors that look best in the largest
terms. Shards stay where they are: query blocks go to all of them by broadcast, ROUND_BYTES at a time.

Cases: vectors that are null, or hold null or non-finite components, take no part, neither as queries nor as
candidates; vectors of another length than a query's are no candidates of it; rows that repeat a query's vec_id are
that query's own rows and no candidates, all other repeated rows are candidates each; equal repeated query rows are
asked once, and answers to unequal ones are merged under their query_id; a null vec_id takes no part; an empty table
gives no rows. Scores are exact for any finite components; the query fails where a score of the k best, or a component
times 64, does not fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 64
SHARD = 8192
QUERY_BLOCK = 1024
STEP = 16
#: Bytes of query blocks that are broadcast at a time.
ROUND_BYTES = 32 << 20
#: Integer sums below 2^24 are exact in float32, which BLAS multiplies fastest.
EXACT32 = 1 << 24
NONE = np.iinfo(np.int64).min


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 32-bit numbers where they fit."""
    v = np.floor(SCALE * x.astype(np.float64))
    most = np.abs(v).max(initial=0.0)
    if not most < 2.0**63:
        raise OverflowError(f"a component of {most / SCALE} times {SCALE} does not fit into 64 bits")
    return v.astype(np.int32 if most < 2.0**31 else np.int64)


def matrix_of(raw: bytes, rows: int, d: int) -> np.ndarray:
    """A packed matrix (rows, d); its width follows from its length."""
    return np.frombuffer(raw, np.int64 if len(raw) > 4 * rows * d else np.int32).reshape(rows, d)


def pack(rows: int):
    """Vectors of one length to blocks of `rows`: ids and a matrix of integers."""
    schema = pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(d: int) -> pa.RecordBatch:
            ids, m = (np.concatenate(x) for x in zip(*open_.pop(d), strict=True))
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([m[order].tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                lists = part.column(1)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                for d in np.unique(lengths).tolist():
                    here = np.flatnonzero(lengths == d)
                    at = (ends[here] - d)[:, None] + np.arange(d)[None]
                    open_.setdefault(d, []).append((ids[here], integers(flat[at]) if d else np.zeros((len(here), 0), np.int32)))
                    if sum(len(x) for x, _ in open_[d]) >= rows:
                        yield block(d)
        for d in list(open_):
            yield block(d)

    return run, "dims int, ids binary, matrix binary"


def maxscore(ids: np.ndarray, postings: np.ndarray, own: int, q: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, least: int = NONE) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a shard with their scores, among them the k best (score, then smaller id) for query q that score `least` or more. ids ascend; postings: (dims, vectors)."""
    a, b = q * low, q * high
    floor, bound = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(floor - bound, kind="stable")  # the widest first
    rest = np.concatenate([np.cumsum((bound - floor)[order][::-1])[::-1], [0]])  # what terms i.. can add to their floors
    alive = np.flatnonzero(ids != own)
    if len(alive) <= k:
        return alive, q @ postings[:, alive]
    base = floor.sum()
    score = np.full(len(alive), base, postings.dtype)

    def add(lo: int, hi: int, score: np.ndarray) -> np.ndarray:
        terms = order[lo:hi]
        part = postings[terms][:, alive] if 2 * len(alive) > len(ids) else postings[np.ix_(terms, alive)]
        return score + (q[terms] @ part - floor[terms].sum())

    at = min(STEP, len(order))
    score = add(0, at, score)
    lead = alive[np.argpartition(score, len(score) - k)[len(score) - k :]]
    beat = max((q @ postings[:, lead]).min(), least) if least != NONE else (q @ postings[:, lead]).min()
    essential = int(np.searchsorted(-(base + rest), -beat, side="right"))  # from here on, terms can't lift a floor score to beat
    while True:
        if at >= essential:  # a vector at its floor in all essential terms is in none of their postings
            keep = (score > base) & (score + rest[at] >= beat)
        else:
            keep = score + rest[at] >= beat
        if not keep.all():
            alive, score = alive[keep], score[keep]
        if at >= len(order):
            return alive, score
        score = add(at, min(at + STEP, len(order)), score)
        at = min(at + STEP, len(order))
        if len(score) > k:  # scores so far are lower bounds
            beat = max(beat, np.partition(score, len(score) - k)[len(score) - k])
            essential = int(np.searchsorted(-(base + rest), -beat, side="right"))


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= kth)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


def exact(ids: np.ndarray, v: np.ndarray, own: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores in Python's integers, for products that 64 bits can't hold."""
    alive = np.flatnonzero(ids != own)
    return alive, np.array([sum(a * b for a, b in zip(q.tolist(), v[i].tolist(), strict=True)) for i in alive], object)


def search(k: int, seed: bool = False):
    """Rows (dims, shard ids and matrix, block, query ids, matrix and least scores) to each query's k best of the shard; with seed, to (block, each query's k-th score)."""
    schema = pa.schema([("block", pa.int64()), ("least", pa.binary())]) if seed else pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                d, raw_ids, raw_matrix, number, raw_qids, raw_queries, raw_least = (c[row].as_py() for c in batch.columns)
                ids, qids = np.frombuffer(raw_ids, np.int64), np.frombuffer(raw_qids, np.int64)
                v, q = matrix_of(raw_matrix, len(ids), d), matrix_of(raw_queries, len(qids), d)
                least = np.frombuffer(raw_least, np.int64) if raw_least else np.full(len(qids), NONE)
                most = int(np.abs(v.astype(np.float64)).max(initial=0)) * int(np.abs(q.astype(np.float64)).max(initial=0)) * 4 * max(d, 1)
                large = most >= 1 << 62
                kind = np.float32 if most < EXACT32 else np.float64 if most < 1 << 53 else np.int64
                if not large:
                    postings, asked = np.ascontiguousarray(v.T).astype(kind), q.astype(kind)
                    low, high = (f(postings, axis=1, initial=0) if d else np.zeros(0, kind) for f in (np.min, np.max))
                out, kth = [], np.full(len(qids), NONE)
                for i in range(len(qids)):
                    alive, score = exact(ids, v, int(qids[i]), q[i]) if large else maxscore(ids, postings, int(qids[i]), asked[i], k, low, high, int(least[i]))
                    top = best(ids[alive], score, k)
                    if seed:
                        if len(top) >= k and -(1 << 62) < score[top[k - 1]] < 1 << 62:
                            kth[i] = int(score[top[k - 1]])
                    elif len(top):
                        out.append((np.full(len(top), qids[i]), ids[alive[top]], np.array([int(x) for x in score[top]], np.int64) if large else score[top].astype(np.int64)))
                if seed:
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([kth.tobytes()], pa.binary())], schema=schema)
                elif out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run, "block long, least binary" if seed else "query_id long, vec_id long, score long"


PAIR = ("dims", "ids", "matrix", "block", "qids", "queries", "least")


def exact_topk(vectors: DataFrame, is_query, scratch: Scratch, k: int, shard: int = SHARD, query_block: int = QUERY_BLOCK, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """vectors (vec_id, embedding), is_query a condition on vec_id: query_id, rank, vec_id, score."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    usable = vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    run, schema = pack(shard)
    shards = scratch.keep(usable.mapInArrow(run, schema), "shards")
    asked = scratch.keep(usable.where(is_query).dropDuplicates(["vec_id", "embedding"]), "asked")
    run, schema = pack(query_block)
    n = max(1, -(-asked.count() // query_block))
    asked = asked.repartition(n).mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("block"), "dims", F.col("ids").alias("qids"), F.col("matrix").alias("queries"))
    asked = scratch.keep(asked, "queries")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("queries") + 2 * F.octet_length("qids")), F.lit(0))).first()[0]
    rounds = max(1, -(-size // round_bytes))
    # the stated query set against all rows: each shard meets each query block of its length once, in some round
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, min(10_000, shards.count()))
    seeds = scratch.keep(shards.groupBy("dims").agg(F.max_by(F.struct("ids", "matrix"), F.octet_length("ids")).alias("s")).select("dims", "s.ids", "s.matrix"), "seeds")
    found: DataFrame | None = None
    for r in range(rounds):
        here = asked.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == r)
        run, schema = search(k, seed=True)
        least = F.broadcast(here).join(seeds, "dims").withColumn("least", F.lit(None).cast("binary")).select(*PAIR).repartition(n).mapInArrow(run, schema)
        here = scratch.keep(here.join(scratch.keep(least, f"least-{r}"), "block", "left"), f"round-{r}")
        run, schema = search(k)
        part = scratch.keep(shards.repartition(tasks).join(F.broadcast(here), "dims").select(*PAIR).mapInArrow(run, schema), f"found-{r}")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(vectors, F.col("vec_id") % 20 == 0, Scratch(spark, "topk"), 20)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
