"""Personal data: exact base patterns, and a linear-chain conditional random field that adds what they miss.

The field labels tokens with O, and B-/I- of four kinds, from word-shape features of a token and its neighbours. It
is trained by gradient ascent on a small labelled table that is written down below, and decoded by Viterbi in numpy
batches: every token of every text, each text as one chain, however long. Where the emissions prove that O is best,
the chain need not be walked (see Field.label); the labels are those of the whole chain all the same.

Cases: a null text is empty and has no spans; repeated rows are separate rows; texts of any length are decoded whole;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from .common import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Steps whose emissions are looked up at once, and places of a batch of sequences that is padded to its longest.
BLOCK, PLACES = 256, 100_000
#: Tokens about a hot place that are decoded with it, at first and if that does not do; by how much a place must be cold.
AROUND, SURE = (3, 24), 0.01
MASK = {k: f"<{k.upper()}>" for k in KINDS}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a greedy first part always ends before a non-digit, so a match starts where a run of digits does
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\W_]+(?:[._%+-][^\W_]+)*|\S")
CUES = frozenset("at dot mail email e-mail phone tel telefon call ring dial fax card visa ip host server version section page".split())
#: Words that stand in no address.
COMMON = frozenset("the a an this that my his her our its of on in and or to is was with for as by".split())
CACHE, CLASSES = 150_000, 20_000
#: Shorter than any address, number or card.
LEAST = 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @: its local part is the whole run before it, past the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL_CHARS:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


#: The labelled table: {kind: text} stands for a labelled stretch, all else is O.
TRAINING = (
    "please write to {email: anna.berg@mail.example.org} for details",
    "contact {email: j_doe+news@example.com} or call {phone: +1 (212) 555-0147} today",
    "mail {email: office@firma.example.de}, or {email: sales.team@shop.example.net}",
    "reach me under {email: maria @ example.com} after six",
    "send it to {email: info at example dot org} now",
    "mail {email: maria.lopez at firma dot example dot de} or come by",
    "the {email: help.desk at company dot net} was ertion onan",
    "{email: jo_k7 at some-site dot com} is my mail and his",
    "ertio nd {email: tom at verlag dot example} sand ertion",
    "we met at noon at the station and looked at the map",
    "there is a dot on the page, call it a dot or ring me at home",
    "he looked at a dot on the map and at this page of that section",
    "come at once, they said at last, and it began at dawn",
    "the server and the host are at the table near the card shop",
    "his address {email: k.lopez99@correo.example.es} is old",
    "{email: root@host1.example.com} wrote 3 times in 2019",
    "my number is {phone: +49 30 1234567} at work",
    "call {phone: (262) 555-3752} or {phone: (977) 555-9792} before noon",
    "ring {phone: 555-867-5309} or {phone: 212-555-0187} for help",
    "tel {phone: 030 555 12345}, fax {phone: 030 555 12346}",
    "phone: {phone: +33 1 23 45 67 89} or {phone: +1-415-555-0100}",
    "dial {phone: (415) 555-0132} now",
    "the and {phone: +1 (262) 555-3752} of the",
    "text {phone: 415.555.0199} any time",
    "write or {phone: (262) 555-3752} here",
    "and {phone: (415) 555-0132} too",
    "sand ertio {phone: (312) 555-0178} onan the",
    "see (12) and (a) of part (3) above",
    "server {ip: 192.168.10.24} did not answer",
    "from {ip: 10.0.0.7} to {ip: 172.16.254.3} in 12 ms",
    "login at {ip: 81.226.233.170} failed 5 times",
    "host {ip: 61.131.143.218} was seen",
    "ping {ip: 8.8.4.4} took 20 ms",
    "paid by {card: 4539 1488 0343 6467} in May 2020",
    "card {card: 4539-1488-0343-6468} was refused",
    "charge {card: 4691172130117446} with 20 euros",
    "her card {card: 5500 0055 5555 5559} expires 12 2027",
    "visa {card: 4470 1234 5678 9012} and pin 4321",
    "the {card: 4111-2222-3333-4444} was ertion onan",
    "sold under {card: 5105-1051-0510-5100} to him",
    "we took {card: 5200 8282 8282 8210} and {card: 4012-8888-8888-1881} of them",
    "number {card: 6011000990139424} is blocked",
    "version 2.0.1 and version 3.14 were released in 2021",
    "licensed under version 2.0. you may obtain a copy",
    "section 4.0. of 12 pages and 300 lines",
    "on 2021-03-04 at 10:30 we sold 1,200 units for 3,50 each",
    "the year 1999 had 365 days and 12 months",
    "chapter 7 paragraph 3 lines 10-20",
    "password=e3b3ed3cc8548923d6 and key AKIA3CKHQ4CSD5ESBS6",
    'token "76ce86d4952db1ee140095c8f6e334d186126d15" end',
    "at 5 of 7 the 100 @ sign",
    "see http://www.example.com/fr/825?page=2 for 9 more",
    "rooms 101-110, 200-210 and 12 more",
    "score 3-2 after 90 minutes, 45-12 then",
    "about 1000000 people in 2 cities",
    "isbn 978-3-16-148410-0 on page 12",
    "order 20210304 and invoice 7741 of 1 2 3",
    "he went to to to to to to the at at at at of of of at to",
    "look at the at to of to to at at sand to to to at",
    "at at at at at at at ertion onan to to to to to to ertio nd",
    "100% at 50% to 20%, at%% to%%% and%",
)

#: Rows without personal data, by rule: signs that stand in none, and common words, among other words.
PLAIN = tuple(f"ertio {x} onan {x} nd{x} {x} sand {x} ion" for x in "!#$%&*/:;=?[]^_`{|}~\"',.<>") + tuple(f"ertio {x} onan, {x} {x}. Sand {x} ion" for x in sorted(COMMON))


def shape(token: str) -> str:
    """Upper, lower, digit and other classes, runs shortened; exact lengths of digit groups matter, so they follow."""
    s = re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]", "x", token))
    return re.sub(r"x+", "x", s)


def token_features(token: str) -> list[str]:
    digits = sum(c.isdigit() for c in token)
    out = [f"s={shape(token)[:24]}", f"n={min(digits, 20)}"]
    if not token[0].isalnum():
        out.append(f"c={token}")
    if digits and digits == len(token):
        out.append("all-digits")
    if token.count(".") == 3:
        out.append("three-dots")
    if digits == 0 and token.isalpha():
        out.append(f"w={token.lower()}" if token.lower() in CUES | COMMON else "w=other")
    return out


class Field:
    """Weights of the field. Features of a token: its own, and its neighbours' within one, marked by place.

    Tokens with the same features are one class, so emissions are looked up by class.
    """

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        self.known: dict[str, int] = {}
        self.classes: dict[tuple[str, ...], int] = {}
        self.rows = [np.zeros((3, len(LABELS)))]  # class 0 stands beyond a text's ends
        self.table = np.zeros((3, 0, len(LABELS)), np.float32)
        self.gains = np.zeros((3, 0, len(LABELS) - 1), np.float32)

    def __reduce__(self):
        return Field, (self.index, self.emit, self.move)

    def read(self, tokens: list[str]) -> np.ndarray:
        """The tokens' classes."""
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
        except KeyError:
            pass
        for t in set(tokens).difference(known):
            fs = tuple(token_features(t))
            if (c := self.classes.get(fs)) is None:
                c = self.classes[fs] = len(self.rows)
                ids = [[i for f in fs if (i := self.index.get(p + f)) is not None] for p in ("-", "", "+")]
                self.rows.append(np.stack([self.emit[i].sum(axis=0) for i in ids]))
            known[t] = c
        out = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
        if len(known) > CACHE:
            known.clear()
        return out

    def forget(self) -> None:
        """Classes are few, but texts may hold any number of new ones; to be called between batches."""
        if len(self.rows) > CLASSES:
            self.known.clear()
            self.classes.clear()
            del self.rows[1:]
            self.table, self.gains = self.table[:, :0], self.gains[:, :0]

    def scores(self, classes: np.ndarray) -> np.ndarray:
        """Emissions of classes (steps + 2, sequences), whose first and last steps are neighbours only: (steps, labels, sequences)."""
        if self.table.shape[1] < len(self.rows):
            self.table = np.stack(self.rows, axis=1).astype(np.float32)
        out = self.table[1][classes[1:-1]]
        out += self.table[0][classes[:-2]]
        out += self.table[2][classes[2:]]
        return np.ascontiguousarray(out.transpose(0, 2, 1))

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(enter, cost, leave), all against staying in O.

        leave is the best way out of a span. cost is what a label costs at least where it is entered the best way, with
        leave added for B; at cold places it and the emissions are below 0, so a span that begins there has lost leave, and
        one that lies there whole only costs. enter is the best way into a label at the first place of a window: out of
        O, or with a span that comes from the cold before; that has lost leave, be it that it began there, be it that it
        came out of another window, where its end was paid leave.
        """
        o, inner = self.move[0, 0], np.array([x[0] == "I" for x in LABELS])
        leave = max(0.0, float((self.move[1:-1, 0] - o).max()))
        into = self.move[:-1].max(axis=0)
        into[0] = o
        cost = np.maximum(into - o, self.move[-1] - self.move[-1, 0]) + np.where(inner, 0.0, leave)
        enter = np.maximum(self.move[0], self.move[1:-1].max(axis=0) - leave)
        enter[0] = o
        return enter, cost[1:], leave

    def hot(self, classes: np.ndarray) -> np.ndarray:
        """Places where some label but O may pay. Elsewhere each further token of a span, and each whole span, costs."""
        if self.table.shape[1] < len(self.rows):
            self.table = np.stack(self.rows, axis=1).astype(np.float32)
        if self.gains.shape[1] < self.table.shape[1]:
            self.gains = self.table[:, :, 1:] - self.table[:, :, :1]
            self.gains[1] += self.bounds[1]
        padded = np.concatenate([[0], classes, [0]])
        gain = self.gains[1][classes]
        gain += self.gains[0][padded[:-2]]
        gain += self.gains[2][padded[2:]]
        return np.flatnonzero((gain > -SURE).any(axis=1))

    def label(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of texts (classes of their tokens), each as one chain.

        Only windows of AROUND tokens about hot places are decoded, with ends that give a span that reaches beyond them
        the most that it could gain there (see bounds). If even so the best path of each window of a text has O at its
        ends, these paths with O between them are the best of the whole chain. Otherwise the windows are widened, and
        last the text is decoded whole.
        """
        out = [np.zeros(len(c), np.int8) for c in texts]
        left = [(k, at) for k, c in enumerate(texts) if len(at := self.hot(c))]
        for around in (*AROUND, None):
            jobs: list[tuple[int, int, np.ndarray, bool, bool]] = []
            for k, at in left:
                c = texts[k]
                padded = np.concatenate([[0], c, [0]])
                if around is None:
                    jobs.append((k, 0, padded, True, True))
                    continue
                lo, hi = np.maximum(at - around, 0), np.minimum(at + around + 1, len(c))
                cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
                for x, y in zip(lo[[0, *cut]].tolist(), hi[[*(cut - 1), -1]].tolist(), strict=True):
                    jobs.append((k, x, padded[x : y + 2], x == 0, y == len(c)))
            again = set()
            for (k, lo, _, begin, end), path in zip(jobs, self.decode([j[2:] for j in jobs]), strict=True):
                if path[0] and not begin or path[-1] and not end:
                    again.add(k)
                out[k][lo : lo + len(path)] = path
            left = [x for x in left if x[0] in again]
        return out

    def decode(self, jobs: list[tuple[np.ndarray, bool, bool]]) -> list[np.ndarray]:
        """Best labels of stretches (classes with the neighbours' before and behind, whether a text begins, or ends, there), like lengths together."""
        out = [np.zeros(0, np.int8)] * len(jobs)
        order = sorted((i for i in range(len(jobs)) if len(jobs[i][0]) > 2), key=lambda i: len(jobs[i][0]))
        while order:
            n = max(1, min(2048, PLACES // len(jobs[order[-1]][0])))
            batch, order = order[-n:], order[:-n]
            for i, path in zip(batch, self._viterbi([jobs[i] for i in batch]), strict=True):
                out[i] = path
        return out

    def _viterbi(self, jobs: list[tuple[np.ndarray, bool, bool]]) -> list[np.ndarray]:
        """Viterbi over a batch that is padded to the longest.

        Scores are kept relative to O's, so they don't grow with the text. A step that leads from O to O in every
        sequence needs no look at the way back.
        """
        lengths = np.array([len(c) - 2 for c, _, _ in jobs])
        longest, n, labels = int(lengths.max()), len(jobs), len(LABELS)
        classes = np.zeros((longest + 2, n), np.int32)
        for k, (c, _, _) in enumerate(jobs):
            classes[: len(c), k] = c
        move, (enter, _, leave) = self.move.astype(np.float32), self.bounds
        begin = [j for j, x in enumerate(LABELS) if x[0] != "I"]
        into = move[:-1][:, begin][:, :, None]  # (from, to, 1); an I follows its own B or I only
        inner = [(j, move[j - 1, j], move[j, j]) for j, x in enumerate(LABELS) if x[0] == "I"]
        scores = np.empty((longest, labels, n), np.float32)
        for lo in range(0, longest, BLOCK):
            scores[lo : lo + BLOCK] = self.scores(classes[lo : lo + BLOCK + 2])
        best = scores[0]
        best += np.where(np.array([x for _, x, _ in jobs])[None], self.move[-1][:, None], enter[:, None]).astype(np.float32)
        for t in range(1, longest):
            last, best = best, scores[t]
            best[begin] += (last[:, None] + into).max(axis=0)
            for j, after_b, after_i in inner:
                best[j] += np.maximum(last[j - 1] + after_b, last[j] + after_i)
            best -= best[0].copy()
        # from O, the label before; O wherever nothing else stands behind
        back = np.concatenate([(scores[lo : lo + BLOCK] + move[:-1, 0][None, :, None]).argmax(axis=1).astype(np.int8) for lo in range(0, longest, BLOCK)])
        out = []
        for k, m in enumerate(lengths.tolist()):
            path = np.zeros(m, np.int8)
            turns = np.flatnonzero(back[: m - 1, k]).tolist()
            last = scores[m - 1, :, k].copy()
            last[1:] += 0 if jobs[k][2] else leave
            t, label = m - 1, int(last.argmax())
            while t >= 0:
                if label:
                    path[t] = label
                    t -= 1
                    label = int((scores[t, :, k] + move[:-1, label]).argmax()) if t >= 0 else 0
                else:
                    while turns and turns[-1] >= t:
                        turns.pop()
                    t = turns[-1] if turns else -1
                    label = int(back[t, k]) if t >= 0 else 0
            out.append(path)
        return out


def labelled(row: str) -> tuple[list[str], list[int]]:
    tokens, labels = [], []
    for part in re.split(r"(\{\w+: [^}]*\})", row):
        m = re.fullmatch(r"\{(\w+): ([^}]*)\}", part)
        found = TOKEN.findall(m[2] if m else part)
        tokens += found
        labels += [LABELS.index(("I-" if i else "B-") + m[1]) if m else 0 for i in range(len(found))]
    return tokens, labels


@lru_cache(1)
def train(rows: tuple[str, ...] = TRAINING + PLAIN, steps: int = 200, rate: float = 0.15, l2: float = 0.02) -> Field:
    """Maximum likelihood with an L2 prior, by full-batch gradient steps (Adam); forbidden moves stay at -1e4."""
    data = [labelled(r) for r in rows if labelled(r)[0]]
    index: dict[str, int] = {}
    for tokens, _ in data:
        for t in tokens:
            for f in token_features(t):
                for p in ("-", "", "+"):
                    index.setdefault(p + f, len(index))
    n_labels = len(LABELS)
    emit, move = np.zeros((len(index), n_labels)), np.zeros((n_labels + 1, n_labels))
    ban = np.zeros_like(move)
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            for i in range(n_labels + 1):
                if i == n_labels or LABELS[i][2:] != label[2:]:
                    ban[i, j] = -1e4
    lengths = np.array([len(t) for t, _ in data])
    longest = lengths.max()
    x = np.zeros((len(data), longest, len(index)))
    y = np.zeros((len(data), longest), np.int64)
    for k, (tokens, labels) in enumerate(data):
        y[k, : len(labels)] = labels
        for i in range(len(tokens)):
            for p, j in (("-", i - 1), ("", i), ("+", i + 1)):
                if 0 <= j < len(tokens):
                    for f in token_features(tokens[j]):
                        x[k, i, index[p + f]] = 1
    inside = np.arange(longest)[None] < lengths[:, None]
    gold = np.zeros((len(data), longest, n_labels))
    np.put_along_axis(gold, y[:, :, None], 1.0, axis=2)
    gold *= inside[:, :, None]
    gold_move = np.zeros_like(move)
    for k in range(len(data)):
        gold_move[n_labels, y[k, 0]] += 1
        for t in range(1, lengths[k]):
            gold_move[y[k, t - 1], y[k, t]] += 1

    def log_sum(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis=axis))

    params, first, second = [emit, move], [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, steps + 1):
        e, m = x @ params[0], params[1] + ban
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + m[-1]
        for t in range(1, longest):
            new = log_sum(alpha[:, t - 1][:, :, None] + m[None, :-1], 1) + e[:, t]
            alpha[:, t] = np.where(inside[:, t][:, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = log_sum(m[None, :-1] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1][:, None], new, 0.0)
        z = log_sum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * inside[:, :, None]
        grad_move = -gold_move.copy()
        grad_move[n_labels] += p[:, 0].sum(axis=0)
        for t in range(1, longest):
            pair = np.exp(alpha[:, t - 1][:, :, None] + m[None, :-1] + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            grad_move[:-1] += (pair * inside[:, t][:, None, None]).sum(axis=0)
        grads = [np.einsum("kti,ktj->ij", x, p - gold) + l2 * params[0], grad_move + l2 * params[1]]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Field(index, params[0], params[1] + ban)


def decoded(labels: np.ndarray, places: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    start, kind = None, None
    for i, label in enumerate([*labels.tolist(), 0]):
        name = LABELS[label]
        if start is not None and name[0] != "I":
            yield places[start][0], KINDS.index(kind), places[i - 1][1]
            start = None
        if name[0] == "B":
            start, kind = i, name[2:]


def free_of(base: list[tuple[int, int, int]], extra: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of extra that touch no base span; base spans may overlap each other."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in sorted(base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for s in extra:
        at = bisect_left(starts, s[2]) - 1
        if at < 0 or ends[at] <= s[0]:
            out.append(s)
    return out


def field_labels(texts: list[str], field: Field) -> list[np.ndarray]:
    """Labels of the tokens of each text."""
    field.forget()
    return field.label([field.read(TOKEN.findall(t)) for t in texts])


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans, and those with the field's added: spans of it that touch no base span."""
    result = []
    for lo, hi in slices(texts):
        part = [t or "" for t in texts[lo:hi]]
        for text, labels in zip(part, field_labels(part, field), strict=True):
            base, extra = base_spans(text), []
            if labels.any():
                extra = [s for s in decoded(labels, [m.span() for m in TOKEN.finditer(text)]) if s[2] - s[0] >= LEAST]
            result.append((base, sorted(base + free_of(base, extra)) if extra else base))
    return result


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_spans (all of them)."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(train())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(lo, 1000)
                found = all_spans(part.column(1).to_pylist(), field)
                counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([listed(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64())], names=names
                )

    schema = docs.select("doc_id").schema
    for name in names[1:]:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind's mark; all other columns as they are."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(train())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(at).to_pylist()
                marked = [masked(t, spans) if t else t for t, (_, spans) in zip(texts, all_spans(texts, field), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(marked, pa.string()) if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Base spans of different kinds may overlap: what overlaps goes as one, under the first kind."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], MASK[KINDS[k]]]
        done = max(done, b)
    return "".join([*out, text[done:]])


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
