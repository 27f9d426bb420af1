"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes the set of hashes of its distinct k-word shingles; equal sets form one class, and only the
   class's smallest doc_id goes on.
2. MinHash signatures are cut into bands; classes that share a band are candidates. With b bands of r hashes a pair
   of similarity t is missed with probability (1 - t^r)^b: 6e-11 for t = 0.85, 5e-8 for t = 0.8 (b = 32, r = 4).
3. First each bucket's members are compared with its smallest and largest id, which joins dense groups in time
   linear in their size. The pairs that are not pruned make clusters of similar documents. In clusters that still
   hold several components all pairs across components are compared, in blocks of a cluster, so that no group of
   any size is in one task; a block gives only the links that join components, not its pairs. Members of the largest
   component meet no block of their own component, so with n members, r of them outside it, r * n pairs are compared
   and r * n / CLUSTER_BLOCK rows are sent: linear in n while r is a block or two, and quadratic only where most
   members of a cluster are linked with few others. Last, the members of a bucket that are in different clusters are
   compared in the same way, each pair in the first band that it shares.
4. Each comparison reads the signatures batch by batch and stops where, after m of n equal hashes, the posterior
   probability (uniform prior) of the threshold similarity is below `miss`.
5. Survivors are verified on their full shingle sets, and linked ones become connected components.

Cases: texts without words, and null texts, have an empty set, are linked with nothing and are their own component;
rows of the same doc_id are one node; a row without doc_id is linked with nothing, has a null component and is kept;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, Scratch, components, join_hot, with_ids_among

BANDS, ROWS, BATCH, MISS = 32, 4, 32, 1e-6
#: Members, and shingles, of a block of a cluster or bucket.
CLUSTER_BLOCK, CLUSTER_SHINGLES = 256, 500_000
SEED = 11
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
CACHE = 150_000
U64 = np.uint64


@lru_cache(1)
def hash_family(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 2**63, n, dtype=U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Text to the sorted hashes of its distinct k-word shingles (fewer words: the whole sequence is one)."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        ws = WORDS.findall(text.translate(LOWER) if not text.isascii() else text.lower()) if text else []
        if not ws:
            return np.empty(0, U64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(ws):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, ws), U64, len(ws))
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, U64)
        for i in range(k):
            out = mixed(out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """n minima under multiply-add hashing, 32 bits of each; in slices, so that memory is bounded for any text."""
    a, b = hash_family(n)
    low = np.full(n, np.iinfo(U64).max, U64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[i : i + 2048, None] * a + b).min(axis=0), out=low)
    return (low >> U64(32)).astype(np.uint32)


def sign(k: int, n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids, ns, digests, sigs, bands = part.column(0), [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text)
                    ns.append(len(s))
                    if len(s):
                        sig = signature(s, n).astype(np.uint16)  # 16 bits do: equal hashes stay equal
                        digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                        sigs.append(sig.tobytes())
                        bands.append(band_keys(sig))
                    else:
                        digests.append(None), sigs.append(None), bands.append(None)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return run, "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    x = np.arange(1, len(sig) // rows + 1, dtype=U64)
    for column in sig.reshape(-1, rows).T:
        x = mixed(x * U64(0x9E3779B97F4A7C15) + column.astype(U64))
    return x.view(np.int64)


def least_matches(t: float, n: int, miss: float) -> int:
    """The fewest equal hashes of n at which P(similarity >= t), with a uniform prior, is still `miss` or more."""
    # 1 - I_t(m+1, n-m+1) = P(Binomial(n+1, t) <= m)
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survives(a: np.ndarray, b: np.ndarray, t: float, miss: float) -> np.ndarray:
    """Which rows of the signature pairs (a, b) stay above the bound, batch after batch."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for lo in range(0, a.shape[1], BATCH):
        equal = equal + (a[alive, lo : lo + BATCH] == b[alive, lo : lo + BATCH]).sum(axis=1, dtype=np.int32)
        keep = equal >= least_matches(t, min(lo + BATCH, a.shape[1]), miss)
        alive, equal = alive[keep], equal[keep]
    return alive


def prune_pairs(n: int, t: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, n) for c in (2, 3))
                yield part.select([0, 1]).take(pa.array(survives(a, b, t, miss)))

    return run, "a long, b long"


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by keys to a table per group; a group may go over several batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        at = np.stack([table.column(c).to_numpy() for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield table.slice(lo, hi - lo)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def across(side: np.ndarray, rep: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block pair (side 0, 1) or within a block (side 2) whose values of `apart` differ."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    x, y = (v.ravel() for v in np.meshgrid(left, right, indexing="ij"))
    ok = (apart[x] != apart[y]) & ((rep[x] < rep[y]) | ((side[x] == 0) & (side[y] == 1)))
    return x[ok], y[ok]


def signatures(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, n)


def batch_of(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if pairs and len(out := np.concatenate(pairs)):
        yield pa.RecordBatch.from_arrays([pa.array(out.min(axis=1)), pa.array(out.max(axis=1))], names=["a", "b"])


def bucket_pairs(n: int, t: float, miss: float):
    """Rows (bkey, i, j, band, side, rep, cluster, sig), sorted: survivors across clusters, in the first band that they share."""

    def compare(table: pa.Table) -> np.ndarray:
        side, rep, cluster = (table.column(c).to_numpy() for c in ("side", "rep", "cluster"))
        band, sig, out = table.column("band")[0].as_py(), signatures(table.column("sig"), n), []
        x, y = across(side, rep, cluster)
        for lo in range(0, len(x), 8192):
            i, j = x[lo : lo + 8192], y[lo : lo + 8192]
            same = (sig[i].reshape(len(i), -1, ROWS) == sig[j].reshape(len(i), -1, ROWS)).all(axis=2)
            here = same.argmax(axis=1) == band
            i, j = i[here], j[here]
            alive = survives(sig[i], sig[j], t, miss)
            out.append(np.stack([rep[i[alive]], rep[j[alive]]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for table in grouped(batches, ("bkey", "i", "j")):
            if table.num_rows > 1:
                found.append(compare(table))
            if len(found) >= 1000:
                yield from batch_of(found)
                found = []
        yield from batch_of(found)

    return run, "a long, b long"


def overlap(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: products of 0/1 matrices over slices of the shingles that several sets have."""
    out = np.zeros((len(left), len(right)), np.float32)
    mine = [sets[k] for k in (*left, *right)]
    owner = np.repeat(np.arange(len(mine)), [len(s) for s in mine])
    _, place, count = np.unique(np.concatenate(mine), return_inverse=True, return_counts=True)
    shared = count > 1
    place, owner = (np.cumsum(shared) - 1)[place[keep := shared[place]]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for lo in range(0, int(shared.sum()), 8192):
        a, b = np.searchsorted(place, (lo, lo + 8192))
        m = np.zeros((len(mine), 8192), np.float32)
        m[owner[a:b], place[a:b] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def cluster_links(n: int, percent: int, miss: float):
    """Rows (cluster, i, j, side, rep, comp, sig, shingles), sorted: links (a, b) that join the components of a block pair."""

    def compare(table: pa.Table) -> np.ndarray:
        side, rep, comp = (table.column(c).to_numpy() for c in ("side", "rep", "comp"))
        sig = signatures(table.column("sig"), n)
        x, y = across(side, rep, comp)
        alive = [lo + survives(sig[x[lo : lo + 8192]], sig[y[lo : lo + 8192]], percent / 100, miss) for lo in range(0, len(x), 8192)]
        alive = np.concatenate(alive) if alive else np.empty(0, np.int64)
        if not len(alive):
            return np.empty((0, 2), np.int64)
        x, y = x[alive], y[alive]
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        sets = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        size = np.diff(offsets)
        left, right = np.unique(x), np.unique(y)
        common = overlap(sets, left, right)[np.searchsorted(left, x), np.searchsorted(right, y)].astype(np.int64)
        linked = 100 * common >= percent * (size[x] + size[y] - common)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        out = []
        for i, j in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
            p, q = find(int(comp[i])), find(int(comp[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((rep[i], rep[j]))
        return np.array(out, np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ("cluster", "i", "j")):
            if table.num_rows > 1:
                yield from batch_of([compare(table)])

    return run, "a long, b long"


def deal(members: DataFrame, key: str, part: str, size: Column, heavy: Column, total: int) -> DataFrame:
    """members (key, part, rep, ...) of groups that have several parts, with what block_rows needs: large (in the group's largest part), rest and main (blocks of the other parts and of the largest).

    size, heavy: rows' weight, and the blocks that (n, s) rows of that weight make.
    """
    parts = members.groupBy(key, part).agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    groups = parts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", F.col(part).alias("p"))).alias("top")).where("n > top.n")
    blocks = lambda n, s: F.ceil(F.greatest(n / F.lit(float(CLUSTER_BLOCK)), s / heavy)).cast("long")
    groups = groups.select(key, F.col("n"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("rest"), blocks(F.col("top.n"), F.col("top.s")).alias("main"), F.col("top.p").alias("top"))
    return join_hot(members, groups, key, "n", total).withColumn("large", F.col(part) == F.col("top")).drop("top")


def block_rows(members: DataFrame, key: str) -> DataFrame:
    """members (key, rep, large, rest, main, ...), each dealt to a block, to rows of all the pairs (i, j) of blocks that it belongs to, but for pairs inside the largest part."""
    mine = F.when(F.col("large"), F.col("rest") + F.pmod(F.xxhash64("rep"), F.col("main"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("rest")))
    others = F.when(F.col("large"), F.col("rest")).otherwise(F.col("rest") + F.col("main"))
    rows = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    rows = rows.select("*", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side")).drop("mine", "other", "large", "rest", "main")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def shingle_sets(k: int):
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], schema=schema)

    return run, "rep long, shingles array<long>"


class Linker:
    """Candidate pairs (a, b) of representatives to linked pairs: Bayesian pruning, then full sets."""

    def __init__(self, docs: DataFrame, sigs: DataFrame, scratch: Scratch, k: int, percent: int, n: int, miss: float):
        self.docs, self.sigs, self.scratch, self.k, self.percent, self.n, self.miss = docs, sigs, scratch, k, percent, n, miss

    def pruned(self, pairs: DataFrame, name: str) -> DataFrame:
        sig = self.sigs.select("rep", "sig")
        run, schema = prune_pairs(self.n, self.percent / 100, self.miss)
        both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
        return self.scratch.keep(both.mapInArrow(run, schema), f"pruned-{name}")

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """rep, shingles of the representatives ids (rep), and of a few more; one row for each that has shingles."""
        run, schema = shingle_sets(self.k)
        texts = with_ids_among(self.docs, "doc_id", ids).select(F.col("doc_id").alias("rep"), "text")
        return self.scratch.keep(texts.mapInArrow(run, schema).where(F.size("shingles") > 0), f"sets-{name}")

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs is a written table."""
        sets = self.sets(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))), name)
        sets = sets.dropDuplicates(["rep"]) if self.copies else sets
        near = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        near = near.where(100 * common >= self.percent * (F.size("x") + F.size("y") - common)).select("a", "b")
        near = self.scratch.keep(near, f"linked-{name}")
        self.scratch.drop(f"sets-{name}")
        return near

    #: Whether rows repeat wholly.
    copies = False


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int, percent: int, bands: int = BANDS, miss: float = MISS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept. Links: Jaccard similarity of k-word shingles >= percent/100."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = bands * ROWS
    run, schema = sign(k, n)
    sigs = scratch.keep(docs.mapInArrow(run, schema), "signatures")
    total = max(1, sigs.count())
    full = sigs.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.keep(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")

    # rows of one doc_id with different texts are one node with several sets
    several = full.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.max("digest").alias("top")).where("digest <> top")
    if not several.isEmpty():  # nodes by row instead of by doc_id, so that each node has one set
        return _by_row(docs, scratch, k, percent, bands, miss)
    reps = full.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "sig", "bands")
    linker = Linker(docs, reps, scratch, k, percent, n, miss)
    if full.count() > full.select("doc_id").distinct().count():
        linker.copies = True
        reps = linker.sigs = reps.dropDuplicates(["rep"])

    members = reps.select("rep", F.posexplode("bands").alias("band", "bkey"))
    buckets = scratch.keep(members.groupBy("bkey").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = scratch.keep(join_hot(members, buckets, "bkey", "n", total), "shared")
    stars = shared.where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).unionByName(shared.where("rep <> hi").select(F.col("rep").alias("a"), F.col("hi").alias("b")))
    similar = linker.pruned(stars.distinct(), "stars")
    clusters = components(scratch, similar, "clusters").select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
    labels = components(scratch, linker.linked(similar, "stars"), "stars").select(F.col("node").alias("rep"), F.col("label").alias("comp"))

    # clusters of several components
    inside = clusters.unionByName(clusters.select(F.col("cluster").alias("rep"), "cluster").distinct())
    inside = inside.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(reps.select("rep", "n_shingles"), "rep")
    inside = scratch.keep(inside, "inside")
    open_ = scratch.keep(deal(inside, "cluster", "comp", F.col("n_shingles"), F.lit(float(CLUSTER_SHINGLES)), total).drop("n_shingles"), "open")
    sets = linker.sets(open_.select("rep"), "open")
    sets = sets.dropDuplicates(["rep"]) if linker.copies else sets
    run, schema = cluster_links(n, percent, miss)
    rows = block_rows(open_.join(reps.select("rep", "sig"), "rep").join(sets, "rep"), "cluster").select("cluster", "i", "j", "side", "rep", "comp", "sig", "shingles")
    more = scratch.keep(rows.mapInArrow(run, schema), "linked-open")
    scratch.drop("sets-open")

    # buckets of several clusters
    named = shared.join(inside.select("rep", "cluster"), "rep", "left").select("bkey", "band", "rep", F.coalesce("cluster", "rep").alias("cluster"))
    named = scratch.keep(named, "named")
    wide = deal(named, "bkey", "cluster", F.lit(1), F.lit(float(CLUSTER_BLOCK)), total)
    run, schema = bucket_pairs(n, percent / 100, miss)
    rows = block_rows(wide.join(reps.select("rep", "sig"), "rep"), "bkey").select("bkey", "i", "j", "band", "side", "rep", "cluster", "sig")
    last = linker.linked(scratch.keep(rows.mapInArrow(run, schema), "pruned-buckets"), "buckets")
    ends = labels.select(F.col("rep").alias("a"), F.col("comp").alias("b"))
    labels = components(scratch, ends.unionByName(more).unionByName(last), "last")

    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "n", F.coalesce("label", "rep").alias("component_id"))
    out = join_hot(full.select("digest", "doc_id", "n_shingles"), named, "digest", "n", total).select("doc_id", "n_shingles", "component_id")
    alone = sigs.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _by_row(docs: DataFrame, scratch: Scratch, k: int, percent: int, bands: int, miss: float) -> DataFrame:
    """Where doc_ids repeat with different texts: the same over row numbers, then rows of one doc_id are joined into one node."""
    rows = scratch.keep(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    inner = Scratch(scratch.spark, "neardup-rows")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), inner, k, percent, bands, miss)
    found = scratch.keep(found.withColumnsRenamed({"doc_id": "row", "component_id": "part"}).join(rows.select("row", F.col("doc_id").alias("id")), "row"), "found")
    # parts and ids form a graph: ids are numbered by the smallest of their rows, apart from rows' own parts
    ids = found.where("id IS NOT NULL").groupBy("id").agg(F.min("part").alias("p"), F.count("*").alias("n"))
    edges = join_hot(found.where("id IS NOT NULL").select("id", "part"), ids, "id", "n", max(1, found.count())).select(F.col("part").alias("a"), F.col("p").alias("b"))
    labels = components(scratch, edges, "ids")
    joined = found.join(labels.withColumnRenamed("node", "part"), "part", "left").withColumn("part", F.coalesce("label", "part"))
    least = joined.groupBy("part").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    out = join_hot(joined.select("part", "id", "n_shingles"), least, "part", "n", max(1, found.count()))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull(), F.col("least")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "neardup"), 3, 85)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT uid, doc_id, array_to_string(w[k:k + 2], ' ') AS s FROM (SELECT uid, doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT uid, any_value(doc_id) AS doc_id, count(*) AS n FROM sh GROUP BY uid),
rare AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
p AS (SELECT x.uid AS a, y.uid AS b, count(*) AS c FROM sh x JOIN rare USING (s) JOIN sh y USING (s) WHERE x.uid < y.uid GROUP BY 1, 2),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON x.uid = p.a JOIN n y ON y.uid = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, x.b FROM reach r JOIN both_ways x ON x.a = r.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept FROM d LEFT JOIN n USING (uid) LEFT JOIN comp ON comp.doc_id = d.doc_id
"""
