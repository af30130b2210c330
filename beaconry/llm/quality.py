"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a linear scorer.

1. Overlapping labellers look at a whole text and vote good, bad or not at all.  Only how often each combination of
   votes occurs in all documents reaches the driver, at most 3 ** len(LABELLERS) numbers.
2. Expectation-maximisation (Dawid and Skene's model) estimates how often each labeller votes how on good and on bad
   texts, and so the posterior of each combination.
3. The posteriors of a bounded sample of texts train a logistic scorer on hashed shapes of words: letters, digits and
   signs by kind, with a mark for words that repeat the one before.  It scores every text by the mean of its words;
   a word of over 200 characters, as in texts without spaces, counts as the pieces of that length that it consists of.

Null, empty and blank texts have no words: score 0, not kept.  Other short texts get votes like any other, where a
labeller has enough words to go by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batches, texts

BUCKETS = 1024
GOOD, BAD = 1, 2
RUNS = re.compile(r"(?P<U>[^\W\d_a-zß-öø-ÿ]+)|(?P<L>[^\W\d_]+)|(?P<N>\d+)|(?P<S>[\W_]+)")


class Shapes(dict):
    """Piece of a word -> bucket of its shape, remembered up to a bound."""

    LIMIT, PIECE = 150_000, 200

    def pieces(self, words: list[str]) -> list[str]:
        """The words, long ones cut into consecutive pieces."""
        if max(map(len, words), default=0) <= self.PIECE:
            return words
        return [w[k : k + self.PIECE] for w in words for k in range(0, len(w), self.PIECE)]

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        shape = RUNS.sub(lambda m: m.lastgroup.lower() if m.lastgroup != "S" else m[0], word)
        h = self[word] = xxhash.xxh3_64_intdigest(shape.encode("utf8", "surrogatepass")) % BUCKETS
        return h


SHAPES = Shapes()
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#$%&*+<=>@[\\]^_`{|}~")] = True


def between(x: float, good: float, bad: float) -> int:
    """A vote on a share that is low in good texts."""
    return GOOD if x <= good else BAD if x >= bad else 0


def vote_symbols(t: "Text") -> int:
    return between(t.bytes[SIGNS].sum() / t.size, 0.01, 0.05)


def vote_shouting(t: "Text") -> int:
    upper, lower = t.bytes[65:91].sum(), t.bytes[97:123].sum()
    return between(upper / (upper + lower), 0.12, 0.35) if upper + lower >= 20 else 0


def vote_repeats(t: "Text") -> int:
    return between(t.repeats.mean(), 0.03, 0.15) if t.n >= 10 else 0


def vote_vocabulary(t: "Text") -> int:
    return between(1 - t.distinct / t.n, 0.5, 0.75) if t.n >= 40 else 0


def vote_exclamations(t: "Text") -> int:
    return between(t.bytes[33] / t.n, 0.03, 0.2)


def vote_tables(t: "Text") -> int:
    return between((t.bytes[124] + t.bytes[9]) / t.n, 0.03, 0.15)


def vote_sentences(t: "Text") -> int:
    ends = t.bytes[[46, 63, 33]].sum() / t.n
    return (GOOD if 0.02 <= ends <= 0.35 else BAD if ends > 0.6 else 0) if t.n >= 20 else 0


def vote_lengths(t: "Text") -> int:
    mean = t.size / t.n - 1
    return GOOD if 2.5 <= mean <= 8 else BAD if mean >= 20 else 0


LABELLERS = (vote_symbols, vote_shouting, vote_repeats, vote_vocabulary, vote_exclamations, vote_tables, vote_sentences, vote_lengths)


def repeats(words: list[str]) -> np.ndarray:
    """Which words equal the one before."""
    out = np.zeros(len(words), bool)
    if words:
        out[1:] = np.fromiter(map(str.__eq__, words[1:], words), bool, len(words) - 1)
    return out


class Text:
    """Counts that the labellers share, and the shapes that the scorer reads."""

    def __init__(self, text: str):
        data = text.encode("utf8", "surrogatepass")
        words = text.split()
        self.n, self.size = len(words), len(data)
        self.bytes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        # by stretches of a hundred words, so that long texts aren't called poor for being long
        self.distinct = sum(len(set(words[k : k + 100])) for k in range(0, len(words), 100))
        self.repeats = repeats(words)
        pieces = SHAPES.pieces(words)
        self.features = 2 * np.fromiter(map(SHAPES.__getitem__, pieces), np.int64, len(pieces)) + (self.repeats if pieces is words else repeats(pieces))

    def pattern(self) -> int:
        out = 0
        for vote in LABELLERS if self.n else ():
            out = 3 * out + vote(self)
        return out


def votes(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS) - 1, -1, -1) % 3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, [bad or good, labeller, vote] probabilities).

    Bad texts are bad in different ways, each of which few labellers see, so the bad class is a mixture of kinds, as many
    as labellers; kind k starts from the texts that labeller k calls bad.  A vote that wasn't cast says nothing."""
    v = votes(patterns)
    k = v.shape[1]
    one = np.stack([v == x for x in (GOOD, BAD)], axis=2).astype(float)
    bad = (v == BAD).astype(float)
    post = np.concatenate([np.where(bad.any(1)[:, None], 0.97 * bad / np.maximum(bad.sum(1, keepdims=True), 1), 0.03 / k), np.where(bad.any(1), 0.03, 0.97)[:, None]], axis=1)
    for _ in range(rounds):
        old = post
        weight = (post * counts[:, None]).T
        prior = (weight.sum(1) + 0.5) / (counts.sum() + 0.5 * (k + 1))
        table = np.einsum("cp,plx->clx", weight, one) + 0.5
        table /= table.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("plx,clx->cp", one, np.log(table))
        post = np.exp(log - log.max(0)).T
        post /= post.sum(1, keepdims=True)
        if np.abs(post - old).max() < 1e-9:
            break
    both = np.stack([np.einsum("p,plx->lx", counts * w, one) + 0.5 for w in (1 - post[:, -1], post[:, -1])])
    return post[:, -1], both / both.sum(2, keepdims=True)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    accuracies: dict[str, tuple[float, float]]  # of each labeller: share of good votes on good, of bad votes on bad texts
    posterior: dict[int, float]

    def score(self, t: Text) -> float:
        return 1 / (1 + np.exp(-np.clip(self.weights[t.features].mean() + self.bias, -40, 40))) if t.n else 0.0


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, ridge: float = 3e-5, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic fit by Newton steps, each solved by conjugate gradients; rows are distinct feature
    numbers and how often each occurs.  Features that stand in one text of the sample weigh nothing."""
    seen = np.zeros(2 * BUCKETS, np.int64)
    for f, _ in rows:
        seen[f] += 1
    use = np.flatnonzero(seen > 1)
    x = np.ones((len(rows), len(use) + 1))
    for k, (f, n) in enumerate(rows):
        x[k, 1:] = np.bincount(f, weights=n, minlength=2 * BUCKETS)[use] / max(1, n.sum())
    penalty, w = np.full(len(use) + 1, ridge * len(rows)), np.zeros(len(use) + 1)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = p * (1 - p)
        step = conjugate_gradients(lambda v: x.T @ (curve * (x @ v)) + penalty * v, x.T @ (p - target) + penalty * w, (x * x).T @ curve + penalty)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    weights = np.zeros(2 * BUCKETS)
    weights[use] = w[1:]
    return weights, float(w[0])


def conjugate_gradients(product, right: np.ndarray, diagonal: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Solution of a positive definite system, given the product with its matrix and that one's diagonal."""
    x, r = np.zeros_like(right), right.copy()
    y = r / diagonal
    d, old = y.copy(), float(r @ y)
    for _ in range(rounds):
        if np.abs(r).max() <= 1e-10 * max(1.0, np.abs(right).max()):
            break
        q = product(d)
        a = old / float(d @ q)
        x += a * d
        r -= a * q
        y = r / diagonal
        new = float(r @ y)
        d, old = y + new / old * d, new
    return x


def fit(docs: DataFrame, sample: int = 4000) -> Scorer:
    """sample: so many distinct texts, those of the least hashes, train the scorer; the votes are those of all texts."""
    batches(docs.sparkSession)
    source = docs.select("text")

    def count(it):
        for b in it:
            k, n = np.unique(np.array([Text(t).pattern() for t in texts(b)], np.int64), return_counts=True)
            yield {"pattern": k, "n": n}

    rows = arrow_map(source, count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).filter("pattern > 0").collect()
    if not rows:
        return Scorer(np.zeros(2 * BUCKETS), 0.0, {}, {})
    patterns, counts = np.array([r["pattern"] for r in rows]), np.array([r["n"] for r in rows], float)
    post, table = expectation_maximisation(patterns, counts)
    posterior = dict(zip(patterns.tolist(), post.tolist()))

    def examples(it):
        for b in it:
            got = [(h, t) for h, t in zip(b.column(0).to_pylist(), map(Text, texts(b))) if t.n]
            f = [np.unique(t.features, return_counts=True) for _, t in got]
            # whole texts: at most one number for each feature goes to the driver
            yield {"h": [h for h, _ in got], "pattern": [t.pattern() for _, t in got], "f": [x.astype(np.int32) for x, _ in f], "n": [n for _, n in f]}

    # hashes alone find the bound, so copies of one text fill no sample and move no text
    hashed = source.filter(F.col("text").rlike(r"\S")).select(F.xxhash64("text", F.lit(3)).alias("h"), "text")
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = hashed.filter(F.col("h") <= F.lit(last)).distinct()
    # sorted, so that sums don't depend on the order of partitions
    got = arrow_map(chosen, examples, "h long, pattern long, f array<int>, n array<long>").toPandas().sort_values("h", kind="stable")
    got = got[got["pattern"].isin(posterior)]
    target = np.array([posterior[p] for p in got["pattern"].tolist()])
    w, b = train([(np.asarray(f), np.asarray(n)) for f, n in zip(got["f"], got["n"])], target) if len(got) else (np.zeros(2 * BUCKETS), 0.0)
    return Scorer(w, b, {f.__name__[5:]: (float(table[1, k, 0]), float(table[0, k, 1])) for k, f in enumerate(LABELLERS)}, posterior)


def score_quality(docs: DataFrame, threshold: float = 0.5, sample: int = 4000, keep_text: bool = False, scorer: Scorer | None = None) -> DataFrame:
    """doc_id, score, keep (score >= threshold), posterior (of its votes), n_words; with keep_text the row's columns and score, keep."""
    scorer = scorer or fit(docs, sample)
    batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("score", "keep")] if keep_text else ["doc_id"]
    kinds = dict(docs.dtypes)
    source = docs.select(*[F.col(f"`{c}`") for c in own]) if keep_text else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(it):
        for b in it:
            got = [Text(t) for t in texts(b)]
            s = np.array([scorer.score(t) for t in got], float)
            out = {c: b.column(b.schema.get_field_index(c)) for c in own} | {"score": s, "keep": s >= threshold}
            yield out if keep_text else out | {"posterior": [scorer.posterior.get(t.pattern(), 0.0) for t in got], "n_words": [t.n for t in got]}

    schema = ", ".join(f"`{c}` {kinds[c] if keep_text else 'long'}" for c in own) + ", score double, keep boolean"
    return arrow_map(source, run, schema + ("" if keep_text else ", posterior double, n_words long"))
