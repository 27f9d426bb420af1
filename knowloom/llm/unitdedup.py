"""Substring dedup by hashed units: whole lines, and pieces of long lines cut where the content says so.

A text's words are cut at every line break and before each word whose hash is the least within RADIUS words on either
side of it. Cuts thus depend on nearby words only, so a passage gets the same pieces wherever it stands, also in the
middle of another line. Units are normalised (case folded, white space collapsed) and hashed to 128 bits; digests are
grouped over all documents; the occurrence with the least (doc_id, offset) is kept.

Lines: each later occurrence of a whole line is removed, whatever its length. Passages: a run of consecutive later
pieces is removed if it has MIN_WORDS words or more, so chance repeats of a few words inside lines stay; it is then
extended word by word, on both sides, as far as the text where the run's end (or what stands within REACH words of it)
occurs first goes on alike.

Spans are code points of the original text, end exclusive. `kind` says line or passage; a passage may hold lines.

Cases: null and empty texts have no units; a null doc_id ranks after all others; repeated rows are copies, the first
by (doc_id, row) being kept; an empty table gives no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, join_hot, slices, with_ids_among

RADIUS = 4
MIN_WORDS = 20
#: How far from a run's end its source is looked for.
REACH = 40
CACHE = 300_000
TOKENS = re.compile(r"\S+")
SPACES = np.array([chr(c).isspace() for c in range(0x3001)])
U64 = np.uint64
#: Odd multipliers of the two digests, and their inverses modulo 2^64.
FACTORS = tuple((U64(b), U64(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

#: What a row of units is: a piece of a line, a whole line that is one unit, a whole line of several units.
PIECE, LINE, LINES = 0, 1, 2
NAMES = ("seq", "start", "stop", "words", "before", "after", "kind", "upto")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Cutter:
    """Texts to units, many texts at once."""

    def __init__(self, radius: int = RADIUS):
        self.radius, self.known = radius, {}

    def hashes(self, words: list[str]) -> np.ndarray:
        """64-bit hashes of the case-folded words."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.lower().encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), U64, len(words))

    def minima(self, keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Words that are the leftmost least of 2 * radius + 1 in their line; first and last are the line's ends at each word."""
        n, r = len(keys), self.radius
        at = np.arange(n)
        ok = (at - first >= r) & (last - at >= r)
        for k in range(1, min(r, n - 1) + 1):
            ok[k:] &= keys[k:] < keys[:-k]
            ok[:-k] &= keys[:-k] <= keys[k:]
        return ok

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """Of all units: the place of their text, NAMES, digests (two numbers each)."""
        joined = "\n".join(texts)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = ~SPACES[np.minimum(codes, len(SPACES) - 1)] | (codes >= len(SPACES))
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = joined.split()
        n = len(words)
        if not n:
            return np.empty(0, np.int64), {k: np.empty(0, np.int64) for k in NAMES}, np.empty((0, 2), U64)
        line = np.searchsorted(np.flatnonzero(codes == 10), starts)
        opens = np.concatenate([[True], line[1:] != line[:-1]])
        heads = np.flatnonzero(opens)
        sizes = np.diff([*heads, n])
        first = np.repeat(heads, sizes)
        keys = self.hashes(words)
        opens |= self.minima(keys, first, first + np.repeat(sizes, sizes) - 1)
        lo = np.flatnonzero(opens)
        hi = np.concatenate([lo[1:], [n]])
        owner = np.searchsorted(begin, starts[lo], side="right") - 1
        offset = begin[owner]
        new = np.concatenate([[True], owner[1:] != owner[:-1]])
        seq = np.arange(len(lo)) - np.repeat(np.flatnonzero(new), np.diff([*np.flatnonzero(new), len(lo)]))
        size = hi - lo
        before = np.where(new, 0, np.concatenate([[0], size[:-1]]))
        after = np.where(np.concatenate([new[1:], [True]]), 0, np.concatenate([size[1:], [0]]))
        # lines as ranges of units
        a = np.searchsorted(lo, heads)
        z = np.concatenate([a[1:], [len(lo)]]) - 1
        kind = np.where(np.repeat(z == a, z - a + 1), LINE, PIECE)
        long = z > a
        a, z = a[long], z[long]
        digests = self.digests(keys, np.concatenate([lo, lo[a]]), np.concatenate([hi, hi[z]]), np.concatenate([np.zeros(len(lo), U64), np.ones(len(a), U64)]))
        none = np.zeros(len(a), np.int64)
        own = (seq, starts[lo] - offset, stops[hi - 1] - offset, size, before, after, kind, seq)
        lines = (seq[a], own[1][a], own[2][z], none, none, none, none + LINES, seq[z])
        return np.concatenate([owner, owner[a]]), {k: np.concatenate(v) for k, v in zip(NAMES, zip(own, lines, strict=True), strict=True)}, digests

    def digests(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Polynomials of the hashes from lo to hi in two factors, by prefix sums modulo 2^64."""
        out = []
        for k, (factor, inverse) in enumerate(FACTORS):
            powers = np.cumprod(np.full(len(keys), factor, U64))
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mixed(keys + U64(k)) * powers, dtype=U64)])
            back = np.concatenate([np.ones(1, U64), np.cumprod(np.full(len(keys), inverse, U64))])
            out.append(mixed(mixed((sums[hi] - sums[lo]) * back[lo]) + (hi - lo).astype(U64) * U64(2) + seed))
        return np.stack(out, axis=1)


def unit_rows(radius: int):
    """Rows of units; before and after are the words of the neighbouring units, upto is a line's last unit."""
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), *((n, pa.int32()) for n in NAMES), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(radius)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(2).to_pylist()
                for lo, hi in slices(texts):
                    owner, columns, digests = cutter([t or "" for t in texts[lo:hi]])
                    take = pa.array(owner + lo)
                    packed = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(np.arange(0, 16 * len(owner) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(digests))])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take).cast(pa.int64()), part.column(1).take(take), *[pa.array(columns[k].astype(np.int32)) for k in NAMES], packed], schema=schema)

    return run, "doc_id long, uid long, " + ", ".join(f"{n} int" for n in NAMES) + ", digest binary"


RUN = "uid long, doc_id long, span_start long, span_end long, words long, first_doc_id long, first_start long, l_uid long, l_first int, l_at int, l_inner int, l_need int, l_stop int, r_uid long, r_first int, r_at int, r_inner int, r_need int, r_stop int"


def span_rows(radius: int, min_words: int):
    """A document's later units and lines (uid, doc_id, us) to spans, those of long runs with the places to extend them from."""

    def anchor(units: list[dict], source: int) -> tuple[dict, int]:
        """The unit from which an end is extended, and the words from it to that end: the first one from the source within REACH, else the last one."""
        words = 0
        for u in units:
            if u["first_uid"] == source:
                return u, words
            words += u["words"]
            if words > REACH:
                break
        return units[0], 0

    def spans(us: list[dict]) -> Iterator[tuple]:
        units = sorted((u for u in us if u["piece"]), key=lambda u: u["seq"])
        lines = {q for u in us if u["line"] for q in range(u["seq"], u["upto"] + 1)}
        runs: list[list[dict]] = []
        for u in units:
            if runs and runs[-1][-1]["seq"] + 1 == u["seq"]:
                runs[-1].append(u)
            else:
                runs.append([u])
        found: list[tuple[list[dict], bool]] = []
        for run in runs:
            if sum(u["words"] for u in run) >= min_words:
                found.append((run, True))
                continue
            part: list[dict] = []
            for u in [*run, None]:
                if u is not None and u["seq"] in lines:
                    part.append(u)
                elif part:
                    found.append((part, False))
                    part = []
        for k, (run, long) in enumerate(found):
            row = [run[0]["start"], run[-1]["stop"], sum(u["words"] for u in run), run[0]["first_doc_id"], run[0]["first_start"]]
            if not long:
                yield (*row, *[None] * 12)
                continue
            shares: dict[int, int] = {}
            for u in run:
                shares[u["first_uid"]] = shares.get(u["first_uid"], 0) + u["words"]
            source = max(shares, key=lambda x: (shares[x], -x))
            (left, near), (right, far) = anchor(run, source), anchor(run[::-1], source)
            # cuts depend on radius words, so what is shared beyond a run ends within the next unit and as many words
            yield (
                *row, left["first_uid"], left["first_start"], left["start"], near, near + run[0]["before"] + radius + 1, found[k - 1][0][-1]["stop"] if k else 0,
                right["first_uid"], right["first_stop"], right["stop"], far, far + run[-1]["after"] + radius + 1, found[k + 1][0][0]["start"] if k + 1 < len(found) else 2**31 - 1,
            )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 8 + [pa.int32()] * 5 + [pa.int64()] + [pa.int32()] * 5
        names = [x.split()[0] for x in RUN.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = [(uid, doc, *x) for uid, doc, us in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in spans(us)]
                cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return rows


def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with places (uid, text, asked) to the words beyond each place, nearest first, and where each begins or ends."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            out = []
            for uid, text, asked in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns), strict=True):
                for q in asked:
                    at, need = q["at"], q["need"]
                    if q["side"] == "l":
                        head = text[:at].rsplit(None, need)
                        found = list(TOKENS.finditer(text, len(head[0]) if len(head) > need else 0, at))[::-1]
                        places = [m.start() for m in found]
                    else:
                        found = list(islice(TOKENS.finditer(text, at), need))
                        places = [m.end() for m in found]
                    out.append((f"{uid}{q['side']}{at}", [m[0].lower() for m in found], places))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)], names=["key", "said", "places"])


def extended(runs: DataFrame, numbered: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans (RUN) with their ends moved out as far as the text of their source goes on alike."""
    key = lambda uid, side, at: F.concat(F.col(uid).cast("string"), side, F.col(at).cast("string"))
    side = lambda s: F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in ("uid", "first", "at", "inner", "need", "stop")])
    sides = runs.where("l_uid IS NOT NULL").select(F.col("uid").alias("own"), "span_start", F.explode(F.array(side("l"), side("r"))).alias("s")).select("own", "span_start", "s.*")
    asked = sides.select(F.col("own").alias("uid"), "side", "at", "need", F.lit(0).alias("n")).unionByName(sides.select("uid", "side", F.col("first").alias("at"), "need", F.lit(1).alias("n")))
    asked = asked.groupBy("uid", "side", "at").agg(F.max("need").alias("need"), F.sum("n").alias("n"))
    asked = scratch.keep(asked, "asked")
    by_text = asked.groupBy("uid").agg(F.collect_list(F.struct("side", "at", "need")).alias("asked"))
    texts = with_ids_among(numbered.select("uid", "text"), "uid", asked.select("uid"))
    context = scratch.keep(texts.join(by_text, "uid").select("uid", "text", "asked").mapInArrow(context_rows, "key string, said array<string>, places array<int>"), "context")
    own = sides.withColumn("key", key("own", F.col("side"), "at")).join(context, "key").drop("key").withColumn("key", key("uid", F.col("side"), "first"))
    theirs = context.join(asked.where("n > 0").select(key("uid", F.col("side"), "at").alias("key"), "n"), "key").select("key", F.col("said").alias("other"), "n")
    met = join_hot(own, theirs, "key", "n", max(1, sides.count()))
    same = F.array_position(F.zip_with("said", "other", lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False))
    matched = F.when(same == 0, F.least(F.size("said"), F.size("other"))).otherwise(same - 1).cast("int")
    more = F.slice("places", F.col("inner") + 1, F.greatest(F.lit(0), matched - F.col("inner")))
    more = F.filter(more, lambda x: F.when(F.col("side") == "l", x >= F.col("stop")).otherwise(x <= F.col("stop")))
    met = met.select(F.col("own").alias("uid"), "span_start", "side", more.alias("more"))
    ends = met.groupBy("uid", "span_start").agg(*[F.max(F.when(F.col("side") == s, F.col("more"))).alias(s) for s in "lr"])
    # where a run's right end met the next one's left end, the words between go to the former
    none = F.array().cast("array<int>")
    found = runs.join(ends, ["uid", "span_start"], "left").withColumn("l", F.coalesce("l", none)).withColumn("r", F.coalesce("r", none))
    found = found.withColumn("stop", F.coalesce(F.array_max("r").cast("long"), "span_end"))
    found = found.withColumn("last", F.coalesce(F.lag("stop").over(Window.partitionBy("uid").orderBy("span_start")), F.lit(0).cast("long")))
    found = found.withColumn("l", F.filter("l", lambda x: x >= F.col("last")))
    return found.select(
        "doc_id", "uid", F.coalesce(F.array_min("l").cast("long"), "span_start").alias("span_start"), F.col("stop").alias("span_end"),
        (F.col("words") + F.size("l") + F.size("r")).alias("words"), "first_doc_id", "first_start",
        F.when(F.col("l_uid").isNull(), "line").otherwise("passage").alias("kind"), F.when(F.col("l_uid").isNull(), 0).otherwise(F.col("words")).cast("long").alias("passage_words"),
    )


def repeated_spans(docs: DataFrame, scratch: Scratch, radius: int = RADIUS, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text), read twice in the same order: a row per span to remove: doc_id, uid, span_start, span_end, words, first_doc_id (that keeps its first unit), first_start, kind, passage_words (0 for lines)."""
    run, schema = unit_rows(radius)
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text")
    units = scratch.keep(numbered.mapInArrow(run, schema), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "start", "stop")
    piece, line = F.col("kind") != LINES, F.col("kind") != PIECE
    firsts = units.groupBy("digest").agg(F.min(F.when(piece, rank)).alias("p"), F.min(F.when(line, rank)).alias("l"), F.count("*").alias("n")).where("n > 1")
    firsts = scratch.keep(firsts.select("digest", "n", F.col("p.doc_id").alias("first_doc_id"), F.col("p.uid").alias("first_uid"), F.col("p.start").alias("first_start"), F.col("p.stop").alias("first_stop"), F.col("l.uid").alias("line_uid"), F.col("l.start").alias("line_start")), "firsts")
    met = join_hot(units, firsts, "digest", "n", max(1, units.count())).drop("digest")
    met = met.withColumn("piece", piece & F.expr("uid <> first_uid OR start <> first_start")).withColumn("line", line & F.expr("uid <> line_uid OR start <> line_start")).where("piece OR line")
    # one document's rows at most come together
    each = F.struct("seq", "upto", "start", "stop", "words", "before", "after", "piece", "line", "first_doc_id", "first_uid", "first_start", "first_stop")
    by_text = met.groupBy("uid", "doc_id").agg(F.collect_list(each).alias("us"))
    runs = scratch.keep(by_text.mapInArrow(span_rows(radius, min_words), RUN), "runs")
    return extended(runs, numbered, scratch)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs, Scratch(spark, "unitdedup")).drop("uid")
