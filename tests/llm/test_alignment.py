"""Alignment of two tokenizers against a version that lists every link."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from prismlake.llm import alignment, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spell(tokens):
    ends, at = [], 0
    for t in tokens:
        at += len(t)
        ends.append(at)
    return ends


class Slow:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(c): c for c in kept} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in kept)}

    def groups(self, text):
        """[(ids of one side, ids of the other)], or nothing."""
        if not text:
            return []
        whole = (" " + text).encode()
        ia, ib = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        ta = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [self.b.id_to_piece(i)]]
        if b"".join(ta) != whole or b"".join(tb) != whole:
            return []
        ea, eb = spell(ta), spell(tb)
        out, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            x, y = [], []
            while i < len(ea) and ea[i] <= end:
                x.append(ia[i])
                i += 1
            while j < len(eb) and eb[j] <= end:
                y.append(ib[j])
                j += 1
            out.append((x, y))
        return out

    def all(self, rows):
        groups = [self.groups(t) for _, t in rows]
        links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in groups]
        count = Counter(p for c in links for p in c)
        best = defaultdict(int)
        for (x, _), n in count.items():
            best[x] = max(best[x], n)
        for (i, _), g, c in zip(rows, groups, links, strict=True):
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            n_best = sum(k for p, k in c.items() if count[p] == best[p[0]])
            yield (i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), n_best, sum(k * count[p] for p, k in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else "")


def compare(docs, got):
    want = sorted(Slow().all([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]), key=str)
    found = sorted((tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)
    assert found == want


def test_query_equals_brute_force(spark):
    compare(spark.read.parquet(f"{SF}/documents.parquet"), queries.op13_align_tokenizers(spark, SF))


TEXTS = [
    None, "", " ", "  ", "\n", " a b ", "a  b   c", "<|endoftext|> and </s> <s> <unk> <0x41>", "▁under", "a▁b", "é ü 漢字 🙂 ﬁ １２", "x\x00y\tz\r\n", "one two", "one two", "it's 'll we'LL", "a b c　d",
    "漢字" * 300, "🙂" * 200, "word " * 3000, "qzxj" * 2000, " \n \n  x", "é combining", "ab" * 5000 + " tail",
]


@pytest.mark.parametrize("large", [alignment.LARGE, 1])
def test_awkward_rows(spark, monkeypatch, large):
    """Nulls, empty and long texts, special strings, other spaces, repeated rows, ties, and columns with clashing names; `large` takes the other way of expanding a group."""
    rows = [(k if k % 5 else None, t, 1, "p", [1]) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 int, pairs string, n_a array<int>").repartition(3)
    compare(docs, alignment.align(docs, A, B, F.col("doc_id")))
    monkeypatch.setattr(alignment, "LARGE", large)
    compare_local(TEXTS)
    empty = docs.limit(0)
    compare(empty, alignment.align(empty, A, B, F.col("doc_id")))
    wide = alignment.align(docs, A, B, F.col("n_a").alias("own"), F.col("doc_id"), F.col("c0"))
    assert wide.columns[:3] == ["own", "doc_id", "c0"] and wide.count() == len(TEXTS)


def compare_local(texts):
    """Different pairs of each text with occurrences, without Spark."""
    import pyarrow as pa

    from prismlake.llm.textkit import slices

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    slow = Slow()
    for s in slices(iter([batch])):
        x = alignment.Aligned(s, alignment.side(A), alignment.side(B))
        text, key, n = x.pairs()
        for k, t in enumerate(texts):
            want = Counter((a, b) for xs, ys in slow.groups(t) for a in xs for b in ys)
            mine = {divmod(int(p), x.b.size): int(c) for p, c in zip(key[text == k], n[text == k], strict=True)}
            assert mine == want


def test_byte_level_bytes():
    t = alignment.side(A)
    text = "naïve 漢字 🙂\n\ttabs"
    ids = Tokenizer.from_file(A).encode(text).ids
    assert b"".join(t.encoder.spelled[i] for i in ids) == text.encode()
    assert decoders.ByteLevel().decode([Tokenizer.from_file(A).id_to_token(i) for i in ids]) == text


def test_tasks_that_send_early(spark, monkeypatch):
    """Counts of pairs do not depend on how many a task holds."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j} word" for j in range(50))) for k in range(60)], "doc_id long, text string").repartition(5)
    tokenized = alignment._tokenized(docs, A, B, (F.col("doc_id"),))
    want = {r.pair: r.n for r in alignment.pair_counts(tokenized).collect()}
    slow = Counter(p for r in docs.collect() for p in {(a, b) for xs, ys in Slow().groups(r.text) for a in xs for b in ys})
    assert {divmod(k, alignment.side(B).size): n for k, n in want.items()} == slow
    assert np.max(list(want.values())) == 60
