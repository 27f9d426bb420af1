"""Toxicity of obfuscated text: a noisy-channel decoder restores words, a linear model scores what it restores.

Channel: a symbol may stand for the letters it resembles, a repeated letter for one or two of it, and a separator
between single letters for nothing. Each odd token is a lattice of such readings; Viterbi finds the likeliest under a
character trigram model. A plain token has one reading, itself, so it is not decoded. Spaced-out words are found as
runs of single characters and decoded as one token, and again with word breaks in the lattice, as are tokens of more
than LONGEST runs of a character. The lattice is as long as the token, so nothing is cut.

Score: each restored word has the evidence of its strongest feature (the word, or its first 4, 5 or 6 letters), a
shrunk log ratio of document rates in the two classes. A logistic model maps the strongest and the summed evidence
of a document's words to a probability. A ratio counts only where it is unlikely by chance.

The trigrams are counted over all texts, labelled or not, in distributed form. Label evidence and weights are fitted on
a bounded sample of labelled rows: all up to SAMPLE_ROWS, else about that many by a hash of the id; the model keeps
features of MIN_DOCS documents or more that point to label 1.

Cases: null, empty and wordless texts have no evidence and the score of the intercept; rows without label or text are
not learned from; a number (digits only) is no word; without rows of both labels every score is the rate of label 1 (0 without any); a null doc_id is not
held out; repeated label rows count each; texts of any length are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from .common import Scratch, bounded
from .langid import fold, sample

SAMPLE_ROWS = 16_000
MIN_DOCS = 5
MIN_RATIO = 1.0
MAX_FEATURES = 20_000
CACHE = 200_000
LONGEST = 64
#: What symbols may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "%": "x", "*": "aeiou", "#": "h"}
SEPARATORS = frozenset("._-~ '`·*+")
SYMBOL_COST, REPEAT_COST, DROP_COST, BREAK_COST = 0.7, 0.2, 0.3, 0.3
EDGES = " \t\r\n.,;:?\"'()[]{}<>«»„“”…"
NOISE = re.compile(r"([!@#$%&*+|])\1+$|[&%*#!]$")
RUN = re.compile(r"(\w)\1\1")
LETTER = re.compile(r"[^\W\d_]")
LETTERS = re.compile(r"[^\W\d_]+")
PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\Z")
CHAIN = re.compile(r"(?<![^\W\d_])[^\W\d_](?:['’-][^\W\d_]){2,}(?![^\W\d_])")
SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S){2,}(?!\S)")


class Spelling:
    """A character trigram model with interpolated lower orders, over ^word$."""

    def __init__(self, counts: dict[str, int]):
        self.logs: dict[str, float] = {}
        self.counts = counts
        self.letters = max(2, sum(len(g) == 1 for g in counts))
        self.total = sum(n for g, n in counts.items() if len(g) == 1) or 1

    def log(self, before: str, c: str) -> float:
        """log P(c | the two characters before)."""
        key = before + c
        if (v := self.logs.get(key)) is None:
            n = self.counts.get
            p = (n(c, 0) + 0.5) / (self.total + 0.5 * self.letters)
            for k in (1, 2):
                h = before[-k:]
                p = (n(h + c, 0) + 4 * p) / (n("h" + h, 0) + 4)
            v = self.logs[key] = math.log(p)
        return v


def spelling_counts(words: Counter) -> Counter:
    """n-grams of the words; contexts are marked h."""
    out: Counter = Counter()
    if not words:
        return out
    codes = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 3
    inside = np.ones(len(codes), bool)
    starts = np.cumsum(lengths) - lengths
    inside[starts] = inside[starts + 1] = False
    at = np.flatnonzero(inside)
    keys, place = np.unique(codes[at - 2] << 42 | codes[at - 1] << 21 | codes[at], return_inverse=True)
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), lengths - 2)
    for key, n in zip(keys.tolist(), np.bincount(place, times).astype(np.int64).tolist(), strict=True):
        a, b, c = (chr(key >> k & 0x1FFFFF) for k in (42, 21, 0))
        for g in (c, b + c, a + b + c, "h" + b, "h" + a + b):
            out[g] += n
    return out


def readings(c: str) -> list[tuple[str, float]]:
    """Letters that c may stand for, with costs; '' where it may be dropped."""
    out = []
    if LETTER.match(c):
        out.append((c, 0.0))
    out += [(x, SYMBOL_COST) for x in LEET.get(c, "")]
    if c in SEPARATORS or not out:
        out.append(("", DROP_COST))
    return out


def decode(token: str, lm: Spelling, breaks: bool = False) -> str:
    """The likeliest word behind token, by Viterbi over states (the two letters before); '' if it has no letter at all.

    A run of one character reads as one of it at REPEAT_COST for each further one, or as itself up to twice. With
    breaks a word may end after any letter at BREAK_COST, so the words are given with spaces between them.
    """
    chars = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.S)]
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for c, n in chars:
        new: dict[str, tuple[float, tuple | None]] = {}
        for before, (cost, path) in states.items():
            for letter, price in readings(c):
                for times in (1, 2) if letter and n > 1 else (1,):
                    h, total, p = before, cost + price + REPEAT_COST * (n > 1) * max(0, min(n, 4) - times), path
                    for x in letter * times:
                        total -= lm.log(h, x)
                        h, p = h[1:] + x, (p, x)
                    if h not in new or total < new[h][0]:
                        new[h] = (total, p)
        if breaks:
            ends = [(cost - lm.log(h, "$") + BREAK_COST, path) for h, (cost, path) in new.items() if h[1] != "^"]
            if ends and ((end := min(ends, key=lambda x: x[0]))[0] < new.get("^^", (math.inf,))[0]):
                new["^^"] = (end[0], (end[1], " "))
        states = new
    best = min(((cost - lm.log(h, "$") * (h != "^^" or not breaks), path) for h, (cost, path) in states.items()), key=lambda x: x[0])[1]
    out = []
    while best is not None:
        best, x = best
        out.append(x)
    return "".join(reversed(out))


def runs(token: str) -> int:
    """Runs of one character in token."""
    return sum(a != b for a, b in zip(token, token[1:], strict=False)) + 1


class Restorer:
    """Tokens of a text to the set of its words, odd ones restored."""

    def __init__(self, counts: dict[str, int]):
        self.lm, self.known = Spelling(counts), {}

    def word(self, token: str) -> tuple[str, ...]:
        if (v := self.known.get(token)) is None:
            if len(self.known) > CACHE:
                self.known.clear()
            v = self.known[token] = self.restored(token)
        return v

    def restored(self, token: str) -> tuple[str, ...]:
        t = NOISE.sub("", token.strip(EDGES)).strip(EDGES)
        if not t or not LETTER.search(t):
            if not t or not any(c in LEET for c in t) or t.isdigit():
                return ()
        if PLAIN.match(t) and not RUN.search(t) and not CHAIN.search(t):
            return (t,)
        if runs(t) > LONGEST:  # no word is as long: pieces of a chain are words themselves, and the whole may hold several
            pieces = (p for p in re.split(r"[^\w@$!|]+", t) if p and p != t)
            return tuple(sorted({x for p in pieces for x in self.restored(p)} | self.several(t)))
        got = decode(t, self.lm)
        parts = {got, *re.findall(r"[^\W\d_]{2,}", t)} if got else set(re.findall(r"[^\W\d_]{2,}", t))
        return tuple(sorted(parts))

    def several(self, token: str) -> set[str]:
        """The words of a token that may hold more than one."""
        return set(decode(token, self.lm, breaks=True).split())

    def __call__(self, text: str | None) -> set[str]:
        if not text:
            return set()
        low = text.lower()
        out = {w for t in set(low.split()) for w in self.word(t)}
        for m in SPACED.finditer(low):
            joined = m[0].replace(" ", "")
            out.update(self.word(joined))
            if LETTER.search(joined):
                out |= self.several(joined)
        return out


def features(word: str) -> list[str]:
    n = len(word)
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if n > k)] if n >= 3 else []


class Model:
    def __init__(self, spelling: dict[str, int], evidence: dict[str, float], weights: tuple[float, ...]):
        self.spelling, self.evidence, self.weights = spelling, evidence, weights
        self.restore, self.cache = Restorer(spelling), {}

    def strength(self, word: str) -> float:
        if (v := self.cache.get(word)) is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            get = self.evidence.get
            v = self.cache[word] = max((get(f, 0.0) for f in features(word)), default=0.0)
        return v

    def summary(self, text: str | None) -> tuple[float, float]:
        found = [v for w in self.restore(text) if (v := self.strength(w)) > 0]
        return (max(found), math.log1p(sum(found))) if found else (0.0, 0.0)

    def __call__(self, text: str | None) -> float:
        a, b = self.summary(text)
        z = self.weights[0] + self.weights[1] * a + self.weights[2] * b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01) -> np.ndarray:
    """Newton's method with an L2 prior on all but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [l2] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def spelling_of(texts: DataFrame) -> dict[str, int]:
    """Trigram counts of all texts (text)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            counts = spelling_counts(Counter({w: n for w, n in words.items() if len(w) <= LONGEST and not RUN.search(w)}))
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

        words: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(set(LETTERS.findall(text.lower())))
                if len(words) > CACHE:
                    yield counted()
        yield counted()

    grams = texts.where("text IS NOT NULL").select("text").mapInArrow(spell, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(grams.column(0).to_pylist(), grams.column(1).to_pylist(), strict=True))


def fit(rows: DataFrame, limit: int = SAMPLE_ROWS, texts: DataFrame | None = None) -> Model:
    """A model of rows (doc_id, text, toxic); its spelling is that of all texts (text), or of all rows."""
    spark = ship(rows.sparkSession)
    spelling = spelling_of(rows if texts is None else texts)
    rows = sample(rows.where("text IS NOT NULL AND toxic IN (0, 1) AND doc_id IS NOT NULL"), limit).select("text", "toxic")
    sent = spark.sparkContext.broadcast(spelling)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(sent.value)
        for batch in batches:
            both = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both[toxic].update({f for w in restore(text) for f in features(w)})
            both[0]["#"] += sum(t == 0 for t in batch.column(1).to_pylist())
            both[1]["#"] += sum(t == 1 for t in batch.column(1).to_pylist())
            names = list({**both[0], **both[1]})
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in both)], names=["f", "n0", "n1"])

    counted = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    top = counted.where(f"f = '#' OR n1 >= {MIN_DOCS}").orderBy(F.col("f") != "#", F.desc("n1"), "f").limit(MAX_FEATURES).toArrow()
    counts = {f: (a, b) for f, a, b in zip(*(c.to_pylist() for c in top.columns), strict=True)}
    d0, d1 = counts.pop("#", (0, 0))
    if not d0 or not d1:
        rate = d1 / (d0 + d1) if d0 + d1 else 0.0
        return Model(spelling, {}, (40.0 if rate == 1 else -40.0, 0.0, 0.0))
    evidence = {}
    for f, (n0, n1) in counts.items():
        r1, r0 = (n1 + 0.5) / (d1 + 1), (n0 + 0.5) / (d0 + 1)
        spread = math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
        ratio = math.log(r1 / r0) - 2 * spread  # a lower bound, so that chance is no evidence
        if ratio >= MIN_RATIO:
            evidence[f] = ratio
    model = Model(spelling, evidence, (0.0, 0.0, 0.0))
    sent_model = spark.sparkContext.broadcast((spelling, evidence, (0.0, 0.0, 0.0)))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*sent_model.value)
        for batch in batches:
            s = [judge.summary(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in s], pa.float64()), pa.array([x[1] for x in s], pa.float64()), batch.column(1)], names=["a", "b", "toxic"])

    # (evidence, label) of the bounded sample, two numbers a row
    x = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(summaries, "a double, b double, toxic int").toArrow()
    w = logistic(np.column_stack([x.column(0).to_numpy(), x.column(1).to_numpy()]), x.column(2).to_numpy().astype(float))
    model.weights = tuple(float(v) for v in w)
    return model


def scores(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """keep columns of docs with score and predicted."""
    sent = ship(docs.sparkSession).sparkContext.broadcast((model.spelling, model.evidence, model.weights))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*sent.value)
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(lo, 1000)
                s = [judge(t) for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=[*part.schema.names[:n], "score", "predicted"])

    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    # labels go to their texts by id: only the sampled ones, counted to be few, so that no text is shuffled for them
    chosen = sample(labels.where((fold("doc_id", 5) != 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic"), SAMPLE_ROWS)
    texts = docs.join(bounded(chosen), "doc_id").select("doc_id", "text", "toxic")
    model = fit(Scratch(spark, "toxicity").keep(texts, "sample"), texts=docs)
    return scores(docs, model, ("doc_id", "held_out"))
