"""Toxicity by weak supervision.

Voters are lexicon entries (words), patterns (word stems) and a few typographic patterns, of both polarities: some speak for a toxic
text, some for a clean one. Labelled training documents only propose the entries and say which side each is on. How often a voter fires
on either class, and which voters are correlated given the class, is estimated by a generative label model from their agreement alone,
by expectation maximisation from the same first guess for all voters of a side; a clique of correlated voters counts once. A linear
classifier over a wider vocabulary is trained on the model's posterior labels, scaled to them, and scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import durable
from .textkit import slices

_WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
#: Typographic patterns; their names cannot be words.
#: How often a voter fires on the class it speaks for, and on the other, before anything is known of it.
FIRST_GUESS = 0.2, 0.01
PATTERNS = {"!shout": re.compile(r"!!"), "!capitals": re.compile(r"\b[A-ZÀ-Þ]{4,}\W+[A-ZÀ-Þ]{4,}"), "!symbols": re.compile(r"[#$%&*]{3}"), "!table": re.compile(r" \| ")}


def features(text: str) -> set[str]:
    """The different words, stems (with a star) and patterns of a whole text."""
    words = set(_WORD.findall(text.lower()))
    found = {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
    found |= words
    found.update(name for name, p in PATTERNS.items() if p.search(text))
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class LabelModel:
    """A two-class model of voters that fire or not, with cliques of correlated voters."""

    def __init__(self, correlated: float = 0.5, rounds: int = 25):
        self.correlated, self.rounds = correlated, rounds

    def fit(self, fires: np.ndarray, prior: float, hit: np.ndarray, miss: np.ndarray) -> LabelModel:
        """fires [document, voter]; prior: the share of toxic documents, which is given; hit and miss: first guesses of firing on either class."""
        x = fires.astype(float)
        self.prior, self.hit, self.miss = prior, hit, miss
        self.clique = np.arange(x.shape[1])
        for turn in range(self.rounds):
            if turn == 2 and x.shape[1]:
                self.clique = self._cliques(x, self.posterior(fires))
            q = self.posterior(fires)
            # The share of toxic documents is given: the model moves its prior until its posteriors have that mean.
            logit = np.log(self.prior / (1 - self.prior))
            for _ in range(20):
                q = _sigmoid(self.evidence(fires) + logit)
                logit += np.clip((prior - q.mean()) / max((q * (1 - q)).mean(), 1e-6), -2, 2)
            self.prior = float(np.clip(_sigmoid(logit), 1e-6, 1 - 1e-6))
            self.hit = np.clip((q @ x + 0.5) / (q.sum() + 1), 1e-4, 0.9999)
            self.miss = np.clip(((1 - q) @ x + 0.5) / ((1 - q).sum() + 1), 1e-6, 0.9999)
        return self

    def _cliques(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Components of voters whose correlation given the class, averaged over the classes, is high."""
        joint = np.zeros((x.shape[1],) * 2)
        for w in (q, 1 - q):
            mean = w @ x / max(w.sum(), 1e-9)
            d = x - mean
            c = (d * w[:, None]).T @ d / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(c), 1e-9))
            joint += c / np.outer(sd, sd) * w.sum() / len(x)
        label = np.arange(x.shape[1])
        near = joint > self.correlated
        for _ in range(len(label)):
            least = np.where(near, label[None, :], len(label)).min(axis=1)
            least = np.minimum(least, label)
            if (least == label).all():
                break
            label = least
        return label

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        return _sigmoid(self.evidence(fires) + np.log(self.prior / (1 - self.prior)))

    def evidence(self, fires: np.ndarray) -> np.ndarray:
        """Of a clique counts the voter that says most; silence of all counts too."""
        x = fires.astype(bool)
        on, off = np.log(self.hit / self.miss), np.log((1 - self.hit) / (1 - self.miss))
        total = np.zeros(len(x))
        for c in np.unique(self.clique):
            of = np.flatnonzero(self.clique == c)
            votes = np.where(x[:, of], on[of], off[of])
            total += np.take_along_axis(votes, np.abs(votes).argmax(axis=1)[:, None], axis=1)[:, 0]
        return total


def fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, m: int, target: np.ndarray, l2: float = 0.3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over binary features (rows[k], cols[k]); (weights, bias)."""
    w, b = np.zeros(m), 0.0
    gw, gb = np.full(m, 1e-6), 1e-6
    for _ in range(steps):
        error = _sigmoid(b + np.bincount(rows, w[cols], n)) - target
        g, h = np.bincount(cols, error[rows], m) + l2 * w, error.sum()
        gw, gb = gw + g * g, gb + h * h
        w, b = w - g / np.sqrt(gw), b - h / np.sqrt(gb)
    return w, float(b)


class Classifier:
    """score(features) in 0..1."""

    def __init__(self, weights: dict[str, float], bias: float, scale: float, shift: float):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def score(self, found: set[str]) -> float:
        raw = self.bias + sum(sorted(self.weights[f] for f in found & self.weights.keys()))
        return float(_sigmoid(np.float64(self.scale * raw + self.shift)))


def _counts(train: DataFrame) -> DataFrame:
    """(feature, n, n1): training documents, and toxic ones, that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            seen: dict[str, list[int]] = {}
            for text, y in zip(s.texts.to_pylist(), s.rows.column(0).to_pylist(), strict=True):
                for f in features(text):
                    c = seen.setdefault(f, [0, 0])
                    c[0] += 1
                    c[1] += y
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], ["feature", "n", "n1"])

    return train.select("toxic", "text").mapInArrow(run, "feature string, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def train_classifier(docs: DataFrame, labels: DataFrame, allowed: Column, *, sample_docs: int = 12_000, support: int = 6, voter_share: float = 0.004, max_voters: int = 150, max_features: int = 4_000) -> Classifier:
    """Learn from at most sample_docs labelled documents whose doc_id is `allowed`, the least by a hash of their id.

    Of several labels of an id one toxic one counts, of several texts that with the least hash. Where all labels agree, every text
    scores 0.02 or 0.98; where no label belongs to a document, every text scores the share of toxic labels.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # At most sample_docs rows of two numbers.
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    train = durable(train.select("toxic", "text"))
    n, n1 = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n1 or n1 == n:
        return Classifier({}, 0.0, 0.0, 4.0 if n1 else -4.0)
    base = n1 / n
    # How far a feature's share of toxic documents is from the share of all, in standard deviations.
    z = (F.col("n1") - base * F.col("n")) / F.sqrt(base * (1 - base) * F.col("n"))
    wide = _counts(train).filter(F.col("n") >= support).withColumn("z", z).filter(F.abs("z") >= 3).orderBy(F.abs("z").desc(), "feature").limit(max_features).collect()
    names = [r.feature for r in wide] + [p for p in PATTERNS if p not in {r.feature for r in wide}]
    index = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            found = [sorted(index[f] for f in features(t) & index.keys()) for t in s.texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([s.rows.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    rows = train.mapInArrow(run, "toxic int, found array<int>").collect()
    if not rows:
        return Classifier({}, 0.0, 0.0, float(np.log(base / (1 - base))))
    at = np.repeat(np.arange(len(rows)), [len(r.found) for r in rows])
    cols = np.array([k for r in rows for k in r.found], np.int64)
    # What a few copies of one document have in common is no entry, so a voter must fire on a share of all.
    wide_enough = [(k, r) for k, r in enumerate(wide) if r.n >= voter_share * len(rows)]
    toxic = [k for k, r in wide_enough if r.n1 >= 0.75 * r.n][:max_voters]
    clean = [k for k, r in wide_enough if r.n1 <= base / 4 * r.n][: max_voters // 2]
    found = {r.feature: r.z for r in wide}
    patterns = [index[p] for p in PATTERNS if index[p] not in toxic + clean]
    voters = np.array(toxic + clean + patterns)
    side = np.array([1] * len(toxic) + [-1] * len(clean) + [int(np.sign(found.get(names[k], 0.0))) for k in patterns])
    column = np.full(len(names), -1)
    column[voters] = np.arange(len(voters))
    fires = np.zeros((len(rows), len(voters)), bool)
    votes = column[cols] >= 0
    fires[at[votes], column[cols][votes]] = True
    often, rare = FIRST_GUESS
    guess = np.select([side > 0, side < 0], [often, rare], rare), np.select([side > 0, side < 0], [rare, often], rare)
    posterior = LabelModel().fit(fires, base, *guess).posterior(fires)
    w, b = fit_linear(at, cols, len(rows), len(names), posterior)
    raw = b + np.bincount(at, w[cols], len(rows))
    scale, shift = _calibrate(raw, posterior)
    return Classifier({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-3}, b, scale, shift)


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the scores to labels between 0 and 1, by Newton steps on the logistic loss with a weak prior at (1, 0)."""
    p = np.array([1.0, 0.0])
    x = np.stack([np.clip(raw, -15, 15), np.ones(len(raw))])
    for _ in range(50):
        q = _sigmoid(p @ x)
        gradient = x @ (q - y) + 0.1 * (p - [1, 0])
        p = p - np.linalg.solve((x * (q * (1 - q))) @ x.T + 0.1 * np.eye(2), gradient)
    return (float(max(p[0], 0.05)), float(p[1])) if np.isfinite(p).all() else (1.0, 0.0)


def score_toxicity(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score) of every whole text.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no features and get the bias. Repeated rows each give
    a row; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for s in slices(batches):
            yield pa.RecordBatch.from_arrays([s.rows.column(0), pa.array([model.score(features(t)) for t in s.texts.to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
