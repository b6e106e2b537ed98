"""The word model against a slow one, and its probabilities against one."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.llm import queries, shards, wordlm
from prismlake.llm.textkit import slices

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
END, START = ("end",), ("start",)


def tokens(text):
    return [*WORDS.findall((text or "").translate(LOWER)), END]


def cuts(n):
    if not n[1]:
        return [0.5] * 3
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] else y * k / 2 for k in (1, 2, 3)]


class Slow:
    """Interpolated modified Kneser-Ney of order 2 with dictionaries."""

    def __init__(self, texts):
        self.pairs, self.count, self.after = Counter(), Counter(), defaultdict(list)
        for t in texts:
            seq = tokens(t)
            self.count.update(seq)
            self.pairs.update(zip([START, *seq[:-1]], seq, strict=True))
        self.before = Counter(w for _, w in self.pairs)
        for (v, _), n in self.pairs.items():
            self.after[v].append(n)
        self.two, self.one = cuts(Counter(self.pairs.values())), cuts(Counter(self.before.values()))
        self.total, self.n = len(self.pairs), sum(self.count.values())
        self.free = sum(self.one[min(n, 3) - 1] for n in self.before.values()) / self.total if self.total else 1.0

    def low(self, w):
        n = self.before[w]
        return ((n - self.one[min(n, 3) - 1]) / self.total if n else 0.0) + self.free / (len(self.before) + 1)

    def p(self, v, w):
        seen = self.after.get(v)
        if not seen:
            return self.low(w)
        n = self.pairs[v, w]
        return ((n - self.two[min(n, 3) - 1] if n else 0.0) + sum(self.two[min(k, 3) - 1] for k in seen) * self.low(w)) / sum(seen)

    def score(self, text):
        seq = tokens(text)
        base = sum(math.log10((self.count[w] + 0.5) / (self.n + 0.5 * (len(self.count) + 1))) for w in seq)
        return len(seq), sum(self.count[w] > 0 for w in seq), self.n, base, sum(math.log10(self.p(v, w)) for v, w in zip([START, *seq[:-1]], seq, strict=True))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def compare(docs, got):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    slow = Slow([t for i, t in rows if not held(i)])
    want = sorted(((i, held(i), *slow.score(t)) for i, t in rows), key=str)
    found = sorted((tuple(r) for r in got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    assert len(want) == len(found)
    for a, b in zip(sorted(want, key=lambda r: (str(r[:5]), r[5])), sorted(found, key=lambda r: (str(r[:5]), r[5])), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-9)
    return slow


def test_query_equals_slow_model(spark):
    got = queries.op12_wordlm_scores(spark, SF)
    slow = compare(spark.read.parquet(f"{SF}/documents.parquet"), got)
    for v in [START, END, "neverseen", *list(slow.count)[:5]]:
        assert sum(slow.p(v, w) for w in [*slow.count, "unknown"]) == pytest.approx(1)
    out = got.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1], "the model must foretell texts that it has not seen better than word counts do"


def run(docs):
    learned = ~queries.held_out(5)
    return wordlm.score(docs, wordlm.train(docs.filter(learned)), F.col("doc_id"), queries.held_out(5).alias("held_out"))


def test_awkward_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(1, "a b a b A B"), (2, None), (3, ""), (None, "x y z"), (1, "a b a b A B"), (4, " \t\n"), (5, "a b " * 40_000), (6, "É é a b"), (7, "q"), (8, "a c"), (9, "a d"), (10, "b c")]
    docs = spark.createDataFrame([(i, t, 1, "c", {"k": 1}) for i, t in rows], "doc_id long, text string, c0 int, n_tokens string, score map<string,int>").repartition(3)
    compare(docs, run(docs))
    compare(docs.limit(0), run(docs.limit(0)))
    only = spark.createDataFrame([(k, "all are held out") for k in range(200)], "doc_id long, text string").filter(queries.held_out(5))
    compare(only, run(only))


def test_frequent_first_words_are_spread(spark, monkeypatch):
    """Cells of a frequent first word hold parts of it; scores stay the same, also with many small cells and tasks that send early."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, " ".join("the " + "".join(rng.choice(list("abcdef"), 3)) for _ in range(30))) for k in range(400)], "doc_id long, text string")
    assert len(wordlm._frequent(docs)) >= 1
    compare(docs, run(docs))
    cells = wordlm.cell_of(np.full(1000, 77, np.uint64), np.arange(1000, dtype=np.uint64), np.array([77], np.uint64), 50)
    assert len(set(cells.tolist())) > 20


def test_arrays_survive_a_repeated_task(tmp_path):
    for _ in range(2):
        shards.write_arrays(f"{tmp_path}/m/x-1", a=np.arange(5, dtype=np.uint64), b=np.arange(3, dtype=np.uint8))
    found = shards.arrays(f"{tmp_path}/m", "x-1")
    assert found["a"].tolist() == [0, 1, 2, 3, 4] and found["b"].tolist() == [0, 1, 2]
    assert shards.arrays(f"{tmp_path}/m", "none") == {}
    assert [p.name for p in (tmp_path / "m").iterdir()] == ["x-1"]


def test_counts_above_a_byte(spark):
    docs = spark.createDataFrame([(k, "of the of the of it") for k in range(1, 300)], "doc_id long, text string")
    model = wordlm.train(docs)
    assert model.tokens == 299 * 7 and model.words == 4
    v, w, _ = wordlm.token_hashes(next(slices(iter(docs.limit(1).select("text").toArrow().to_batches()))))
    assert model.of_pairs(v, w).tolist() == [299, 598, 598, 598, 598, 299, 299]
