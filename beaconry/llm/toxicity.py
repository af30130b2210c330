"""Toxicity scores from a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding: lower case, homoglyphs of other scripts to Latin letters, zero-width characters dropped, digits and signs to
letters inside words that have letters (1d10t, $cum), all other signs to single spaces.  Entries are whole words or
beginnings of words; a match inside an exception phrase doesn't count.  Weighted matches, as a sum and as a rate by
length, go through a logistic function.

The lexicon, the exception phrases and the logistic weights are learned from labelled rows: entries are the words and
beginnings of words that occur in toxic texts far more often than chance allows, exception phrases the pairs of words
around an entry that stand in unrelated clean texts and in no toxic one.  Ids, languages, sources and labels are no inputs of a score.

Null and empty texts have no matches and get the score of such texts.  Labels that are null are left out; an id with
several labels counts as its largest.  Without a toxic label nothing is learned and scores are 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batches, texts

#: Cyrillic and Greek letters that look like Latin ones
HOMOGLYPHS = dict(zip("абвгезікмнорстухѕјԁһⅼϲ", "a6breeikmhopctyxsjdhlc")) | dict(zip("αβεικνορτυχ", "abeiknoptux")) | {"ı": "i", "ɡ": "g", "ａ": "a", "ｅ": "e", "ｉ": "i", "ｏ": "o"}
INVISIBLE = "​‌‍⁠﻿­"
DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
TABLE = str.maketrans(HOMOGLYPHS | {c: None for c in INVISIBLE})
MIXED = re.compile(r"(?<![\w@$!|€])(?=[\w@$!|€]*[^\W\d_])[@$|€]?\w+(?:[@$!|€]+\w+)*")
HINT = re.compile(r"[^\W\d_][0-9@$!|€]+\w|[0-9@$|€]\w")
SIGNS = re.compile(r"[\W_]+")
def fold(text: str) -> str:
    """Folded words with single spaces around each."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(TABLE)
    if HINT.search(t):
        t = MIXED.sub(lambda m: m[0].translate(DIGITS), t)
    return " " + SIGNS.sub(" ", t).strip() + " "


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # " beginning" or " word " -> weight
    weights: tuple[float, ...] = (-50.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = ()

    def __post_init__(self):
        self.automaton = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "exceptions": self.exceptions, "automaton": None}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """(end, entry) of each match outside exception phrases."""
        import ahocorasick

        if not self.lexicon:
            return []
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for entry in self.lexicon:
                self.automaton.add_word(entry, (entry, False))
            for x in self.exceptions:
                self.automaton.add_word(fold(x), (fold(x), True))
            self.automaton.make_automaton()
        found = list(self.automaton.iter(folded))
        free = [(e - len(x) + 1, e) for e, (x, exception) in found if exception]
        return [(e, x) for e, (x, exception) in found if not exception and not any(a <= e - len(x) + 1 and e <= b for a, b in free)]

    def features(self, text: str) -> tuple[float, float, Counter]:
        if not text or not self.lexicon:
            return 0.0, 0.0, Counter()
        t = fold(text)
        got = Counter(x for _, x in self.matches(t))
        total = sum(self.lexicon[x] * n for x, n in got.items())
        return math.log1p(total), math.log1p(100 * total / max(1, t.count(" ") - 1)), got

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -40, 40)))


def word_features(text: str, longest: int) -> set[str]:
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(3, min(longest, len(w)) + 1))
    return out


def tail(n1: int, n: int, p: float) -> float:
    """Log of a bound of the chance of n1 or more in n at rate p."""
    q = n1 / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))


def select_entries(counts: dict[str, tuple[int, int]], toxic: int, clean: int, precision: float = 0.75, risk: float = 0.1) -> dict[str, float]:
    """Lexicon from feature -> (toxic texts, clean texts): beginnings where most continuations are toxic, else longer ones."""
    # a word brings some seven features, which say nearly the same
    base = toxic / max(1, toxic + clean)
    limit = math.log(min(1.0, 7 * risk / max(1, len(counts))))
    good = {f for f, (a, b) in counts.items() if a >= precision * (a + b) and tail(a, a + b, base) <= limit}
    children: dict[str, list[str]] = {}
    for f in good:
        stem = f.rstrip()[:-1] if not f.endswith(" ") else f[:-1]
        while len(stem) > 1:
            children.setdefault(stem, []).append(f)
            stem = stem[:-1]
    out: dict[str, float] = {}

    def take(f: str) -> None:
        a, b = counts[f]
        for g in sorted(children.get(f, ()), key=lambda g: (-counts[g][0], -len(g), g)):
            c, d = counts[g]
            left, rest = a - c, b - d
            if left < 3 or left < precision * (left + rest):
                return take(g)
            break
        out[f] = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))

    taken: set[str] = set()
    for f in sorted(good, key=lambda f: (len(f.strip()), f)):
        body = f.strip()
        if not any(f" {body[:k]}" in taken for k in range(1, len(body) + 1)) and f not in taken:
            take(f)
            taken.add(f)
    return out


def kin(text: str) -> int:
    """Smallest hash of the folded text's word triples: copies of a text mostly agree in it, other texts don't."""
    w = fold(text).split()
    return min((xxhash.xxh3_64_intdigest(" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))), default=0)


def around(model: Model, text: str) -> set[str]:
    """Pairs of neighbouring words of which one matches."""
    t = fold(text)
    hit = {t[e - len(x) + 2 : t.index(" ", e - len(x) + 2)] for e, x in model.matches(t)}
    w = t.split() if hit else []
    return {f"{a} {b}" for a, b in zip(w, w[1:]) if a in hit or b in hit}


def spread(lexicon: dict[str, float], found: list[tuple[int, list[str]]], share: float = 0.5) -> dict[str, float]:
    """Entries of unrelated texts: many copies of one toxic text make none of its other words entries."""
    n, kinds = Counter(), {}
    for k, row in found:
        n.update(row)
        for x in row:
            kinds.setdefault(x, set()).add(k)
    return {x: w for x, w in lexicon.items() if len(kinds.get(x, ())) >= max(2, share * n[x])}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, longest: int = 9) -> Model:
    """Model from labelled texts: at most `rows` of them, those with the smallest hashes of their ids.

    labels: doc_id, toxic.  Entries are whole words of any length, or beginnings of words of 3 to `longest` letters.  All
    features of three toxic texts or more are considered; they are those of the sample, so `rows` bounds them."""
    batches(docs.sparkSession)
    chosen = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts_ = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").groupBy(F.xxhash64("text"), F.length("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")

    def count(wanted):
        def run(it):
            for b in it:
                n = Counter()
                for t, y in zip(texts(b), b.column(1).to_pylist()):
                    got = word_features(t, longest)
                    n.update((f, y) for f in (got if wanted is None else got & wanted))
                yield {"f": [f for f, _ in n], "y": [y for _, y in n], "n": list(n.values())}

        return run

    def counted(source, wanted):
        return arrow_map(source, count(wanted), "f string, y int, n long").groupBy("f").agg(F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") > 0, 0).otherwise(F.col("n"))).alias("b"))

    sizes = {r["toxic"] > 0: r["n"] for r in texts_.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True):
        return Model()
    wanted = {r["f"] for r in counted(texts_.filter("toxic > 0"), None).filter("a >= 3").collect()}
    counts = {r["f"]: (r["a"], r["b"]) for r in counted(texts_, wanted).collect()}
    model = Model(select_entries(counts, sizes[True], sizes.get(False, 0)))

    def listed(it):
        for b in it:
            yield {"kin": [kin(t) >> 1 for t in texts(b)], "entries": [sorted(model.features(t)[2]) for t in texts(b)]}

    # at most `rows` lists
    model = Model(spread(model.lexicon, [tuple(r) for r in arrow_map(texts_.filter("toxic > 0").select("text"), listed, "kin long, entries array<string>").collect()]))

    def placed(it):
        for b in it:
            found = [(around(model, t), t, y) for t, y in zip(texts(b), b.column(1).to_pylist())]
            rows = [(x, k, y) for some, k, y in [(some, kin(t) >> 1, y) for some, t, y in found if some] for x in some]
            yield {k: [r[i] for r in rows] for i, k in enumerate(("phrase", "kin", "toxic"))}

    # phrases of the sample: `rows` bounds them
    clean = arrow_map(texts_, placed, "phrase string, kin long, toxic int").groupBy("phrase").agg(F.max("toxic").alias("toxic"), F.count_distinct("kin").alias("n")).filter("toxic <= 0 and n >= 3").orderBy("phrase")
    model = Model(model.lexicon, exceptions=tuple(r["phrase"] for r in clean.collect()))

    def measure(it):
        for b in it:
            x = [model.features(t)[:2] for t in texts(b)]
            yield {"x1": [a for a, _ in x], "x2": [c for _, c in x], "y": b.column(1)}

    # at most `rows` triples
    got = arrow_map(texts_, measure, "x1 double, x2 double, y int").toPandas()
    if len(got):
        w = logistic(got[["x1", "x2"]].to_numpy(), (got["y"].to_numpy() > 0).astype(float))
        model.weights = tuple(float(v) for v in w)
    return model


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, n_matches, rate (weighted matches per 100 words, as log1p), terms (matched entries)."""
    batches(docs.sparkSession)

    def run(it):
        for b in it:
            got = [model.features(t) for t in texts(b)]
            s = model.score(np.array([g[:2] for g in got]).reshape(-1, 2))
            yield {"doc_id": b.column(0), "score": s, "predicted": (s >= threshold).astype(np.int32), "n_matches": [sum(g[2].values()) for g in got], "rate": [g[1] for g in got], "terms": [sorted(x.strip() for x in g[2]) for g in got]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int, n_matches long, rate double, terms array<string>")
