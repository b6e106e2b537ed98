"""The pipeline's stages, each against brute force on what its predecessor kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest

from prismlake.llm import quality
from prismlake.plans.durable import durable

from .test_operators import SF, WORDS, brute_cut, copy_groups, first_of, grams, prose, reference_ids


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = durable(stage(spark, docs, SF))
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for docs, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.count() <= docs.count()


def test_quality_stage(stages):
    docs, after = stages[0]
    assert set(texts(after)) == {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert 0 < after.count() < docs.count()


def test_near_dedup_stage(stages):
    before, after = map(texts, stages[1])
    rows = list(before.items())
    assert after == {i: before[i] for i in (first_of(rows, g) for g in copy_groups(rows))}


def test_substring_stage(stages):
    before, after = map(texts, stages[2])
    for i, w, gone in brute_cut([(i, tuple(WORDS.findall(t))) for i, t in before.items()], 35):
        assert WORDS.findall(after[i]) == [x for x, g in zip(w, gone, strict=True) if not g]
        assert any(gone) or after[i] == before[i]


def test_decontamination_stage(spark, stages):
    before, after = map(texts, stages[3])
    items = [grams(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {i for i, t in before.items() if not any(len(q & grams(t, 5)) >= 0.8 * len(q) for q in items)}


def test_packing_stage(spark, stages):
    docs, after = stages[4]
    want = {i: len(x) for i, x in reference_ids("word_bpe_49k.json", texts(docs).items())}
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == want
    assert corpus_pipeline.run(spark, SF).count() == after.count()


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, bucket string, k string, row string, grp long, c0 string, copies long, vertex string, n_words int, kept_sha256 string, _row_key string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like those the stages use inside."""
    texts = [prose(k, 60) for k in range(60, 66)]
    rows = [
        (1, texts[0], "en"), (2, texts[0], "en"), (3, None, "en"), (4, "", None), (5, " \n ", "en"), (None, texts[1], None), (None, texts[2], "en"), (7, texts[3], "en"), (7, texts[4], "en"),
        (8, prose(70, 20_000), "en"), (9, texts[5] + "\n\n  " + prose(71, 40), "en"), (9, texts[5] + "\n\n  " + prose(71, 40), "en"), (10, prose(72, 40) + "\n" + texts[5], "en"),
    ]
    return spark.createDataFrame([(i, t, g, None, len(t or ""), "b", None, "r", k, "c", 3, "v", 5, "h", "key") for k, (i, t, g) in enumerate(rows)], CLASHING).repartition(3)


def test_stages_keep_columns_and_defined_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns and [t for _, t in got.dtypes] == [t for _, t in odd.dtypes], name
        assert all(r.bucket == "b" and r._row_key == "key" and r.copies == 3 and r.n_words == 5 and r.kept_sha256 == "h" for r in got.collect())
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    assert not {3, 4, 5} & set(ids(quality.keep(odd, low=1e9, high=1e9)))
    assert ids(corpus_pipeline.near_dedup(spark, odd, SF)) == Counter([1, 3, None, None, 7, 7, 8, 9, 10])
    cut = {(r.doc_id, r.text) for r in corpus_pipeline.substring_dedup(spark, odd, SF).collect()}
    assert {(1, ""), (2, ""), (3, None), (4, ""), (5, " \n "), (9, ""), (7, prose(63, 60)), (10, prose(72, 40) + "\n")} <= cut
    assert ids(corpus_pipeline.decontamination(spark, odd, SF)) == ids(odd)
    tokens = Counter()
    for r in corpus_pipeline.pack(spark, odd, SF).collect():
        tokens[r.doc_id] += r.length
    want = Counter()
    for i, x in reference_ids("word_bpe_49k.json", [(r.doc_id, r.text) for r in odd.collect()]):
        want[i] += len(x)
    assert tokens == want


def test_stages_carry_columns_of_any_type(spark):
    """Maps, arrays, binary, dates, decimals, structs with odd field names, and names with dots and ticks."""
    schema = "doc_id long, text string, lang string, m map<string,int>, a array<map<int,string>>, s struct<`a b`:int,`x:y`:array<string>>, `dot.ted` binary, `tick``ed` decimal(9,2), day date, n_chars int"
    from datetime import date
    from decimal import Decimal

    rows = [(k, prose(200 + k // 2, 40), "en", {"x": k // 2} if k % 5 else None, [{1: "y"}], (k, ["z"]) if k % 3 else None, b"\0\1", Decimal("1.50"), date(2020, 1, 2), 7) for k in range(12)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes], name
        for r in got.collect():
            assert tuple(r)[3:9] == rows[r.doc_id][3:9], name
    assert corpus_pipeline.pack(spark, docs, SF).select("doc_id").distinct().count() == 12


def test_stages_on_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_run_leaves_only_the_last_stage_table(spark, tmp_path):
    from pathlib import Path

    from prismlake.plans.durable import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.rglob("stage-*")} | {p.name for p in folder.rglob("table-*")} | {p.name for p in folder.rglob("charlm-*")}
    corpus_pipeline.run(spark, SF).count()
    left = ({p.name for p in folder.rglob("stage-*")} | {p.name for p in folder.rglob("table-*")} | {p.name for p in folder.rglob("charlm-*")}) - before
    assert len([x for x in left if x.startswith("stage-")]) == 1 and not [x for x in left if not x.startswith("stage-")]
