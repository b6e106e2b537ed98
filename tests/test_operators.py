"""Trees, free names, cascades and hash radii against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import raster
from prismlake.operators import cascades, duplicates, library, names
from prismlake.operators.cascades import ForeignKey

# Trees


def nodes(spark, rows):
    return spark.createDataFrame([(a, p, f"t{a}") for a, p in rows], "album_id long, parent_id long, title string")


CHAIN = [(k, k - 1 if k else None) for k in range(40)]
CYCLE = [(100, 102), (101, 100), (102, 101), (103, 102)]
OTHERS = [(200, 999), (201, 200), (202, 200), (300, 300)]


def slow_below(rows):
    kids = {}
    for a, p in rows:
        kids.setdefault(p, []).append(a)
    out = set()
    for a, _ in rows:
        stack, seen = [a], set()
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += kids.get(x, [])
        out |= {(a, x) for x in seen}
    return out


def test_descendants_at_any_depth(spark):
    rows = CHAIN + CYCLE + OTHERS
    got = [tuple(r) for r in library.descendants(nodes(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_below(rows)
    limited = {tuple(r) for r in library.descendants(nodes(spark, rows), depth=12).collect()}
    assert (0, 12) in limited and (0, 13) not in limited and (100, 103) in limited
    assert library.descendants(nodes(spark, [])).count() == 0


def test_paths_at_any_depth(spark):
    got = {r.album_id: r.path for r in library.paths(nodes(spark, CHAIN + CYCLE + OTHERS)).collect()}
    assert got == {k: "/".join(f"t{j}" for j in range(k + 1)) for k in range(40)} | {200: "t200", 201: "t200/t201", 202: "t200/t202"}
    assert library.paths(nodes(spark, [])).count() == 0


# Names


def slow_names(rows, taken=()):
    used, out = {t.lower() for t in taken}, {}
    for pos, name in sorted(rows):
        name = name or ""
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if stem and ext else (name, "")
        new, n = name, 2
        while new.lower() in used:
            new, n = f"{stem} {n}{ext}", n + 1
        used.add(new.lower())
        out[pos] = new
    return out


@pytest.mark.parametrize("at_once", [1000, 2])
def test_free_names_equal_the_loop(spark, monkeypatch, at_once):
    monkeypatch.setattr(names, "AT_ONCE", at_once)
    ranked = names.ranked
    monkeypatch.setattr(names, "ranked", lambda df, by, order: ranked(df, by, order, chunk=37))
    rng = random.Random(3)
    kinds = ["a.jpg", "A.JPG", "a 2.jpg", "a 3.jpg", "a 2 2.jpg", "a", "a 2", "a 3", "b.tar.gz", "b.tar 2.gz", ".hidden", "x.", "x. 2", "", None, "é.png", "É.png", "a 12.jpg"]
    rows = [(k * 3, rng.choice(kinds)) for k in range(150)] + [(1000 + k, "a.jpg") for k in range(30)]
    taken = ["a 5.jpg", "B.tar.gz", "a 20.jpg"]
    df = spark.createDataFrame(rows, "pos long, name string").repartition(3)
    assert {r.pos: r.free_name for r in names.free_names(df, "name", "pos").collect()} == slow_names(rows)
    there = spark.createDataFrame([(t,) for t in taken], "n string")
    assert {r.pos: r.free_name for r in names.free_names(df, "name", "pos", there).collect()} == slow_names(rows, taken)
    assert names.free_names(df.limit(0), "name", "pos").count() == 0


def test_ranks_by_ranges(spark):
    rows = [("x" if k % 3 else "y" if k % 2 else None, k * 7 % 501) for k in range(501)]
    got = names.ranked(spark.createDataFrame(rows, "g string, at long"), ["g"], "at", chunk=50).collect()
    want = {(g, at): 1 + sum(h == g and b < at for h, b in rows) for g, at in rows}
    assert {(r.g, r.at): r._rank for r in got} == want


# Cascades

IDS = {"lib": "lib_id", "item": "item_id", "face": "face_id", "person": "person_id"}
KEYS = [
    ForeignKey("item", "lib_id", "lib"), ForeignKey("item", "up", "item"), ForeignKey("face", "item_id", "item"), ForeignKey("vec", "of", "item", where="kind = 'item'"), ForeignKey("vec", "of", "face", where="kind = 'face'"),
    ForeignKey("member", "face_id", "face"), ForeignKey("member", "person_id", "person", needed=True), ForeignKey("person", "cover", "face", "set_null"), ForeignKey("note", "item_id", "item", "restrict"),
]


def library_tables(spark):
    rows = {
        "lib": ("lib_id long", [(1,), (2,), (3,)]), "item": ("item_id long, lib_id long, up long", [(10, 1, None), (11, 1, 10), (12, 2, 11), (13, 2, 12), (14, 3, None), (15, None, None)]),
        "face": ("face_id long, item_id long", [(10, 10), (21, 12), (22, 13), (23, 14), (24, None)]), "vec": ("of long, kind string", [(10, "item"), (10, "face"), (22, "face"), (14, "item"), (23, "face"), (77, "face"), (14, None)]),
        "person": ("person_id long, cover long", [(31, 22), (32, 23), (33, None)]), "member": ("face_id long, person_id long", [(10, 31), (22, 31), (23, 32), (24, 33), (None, 33)]), "note": ("note_id long, item_id long", [(41, 14)]),
    }
    return {n: spark.createDataFrame(r, schema) for n, (schema, r) in rows.items()}


def held(tables):
    return {n: Counter(tuple(r) for r in df.collect()) for n, df in tables.items()}


def test_delete_cascades(spark):
    tables = library_tables(spark)
    before = held(tables)
    got = held(cascades.delete(tables, IDS, KEYS, {"lib": spark.createDataFrame([(1,)], "x long")}))
    assert set(got["item"]) == {(14, 3, None), (15, None, None)}, "children of a deleted item go too, whatever their library"
    assert set(got["face"]) == {(23, 14), (24, None)} and set(got["lib"]) == {(2,), (3,)}
    assert set(got["vec"]) == {(14, "item"), (23, "face"), (77, "face"), (14, None)}
    assert set(got["person"]) == {(31, None), (32, 23), (33, None)} and set(got["member"]) == {(23, 32), (24, 33), (None, 33)}
    assert got["note"] == before["note"]
    with pytest.raises(ValueError, match="note.item_id restricts"):
        cascades.delete(tables, IDS, KEYS, {"lib": spark.createDataFrame([(3,)], "x long")})
    nothing = cascades.delete(tables, IDS, KEYS, {"lib": spark.createDataFrame([(None,), (99,)], "x long")})
    assert held(nothing) == before


def test_sweep_and_copy(spark):
    tables = library_tables(spark)
    assert set(held(cascades.sweep(tables, IDS, [k for k in KEYS if k.child == "vec"]))["vec"]) == {(10, "item"), (10, "face"), (22, "face"), (14, "item"), (23, "face"), (14, None)}
    keys = [k for k in KEYS if k.child != "note" and k.column != "cover"]
    made = cascades.copy(tables, IDS, keys, {"item": spark.createDataFrame([(10, 110), (13, 113)], "a long, b long")}, {"face": F.col("face_id") + 1000, "person": F.col("person_id") + 500}, {"item": {"lib_id": F.lit(9).cast("long")}})
    got = held(made)
    assert set(got["item"]) == {(110, 9, None), (113, 9, 12)} and set(got["face"]) == {(1010, 110), (1022, 113)}
    assert set(got["vec"]) == {(110, "item"), (1010, "face"), (1022, "face")}
    assert set(got["person"]) == {(531, 22)} and set(got["member"]) == {(1010, 531), (1022, 531)}, "people come along with their faces only"


def test_circles_are_named():
    with pytest.raises(ValueError, match="circle"):
        cascades.in_order([ForeignKey("a", "x", "b"), ForeignKey("b", "y", "a")])


# Hash radii


def near_hashes(seed, n, stuck=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 4).astype(np.int64)
    out = set(base.tolist())
    while len(out) < n:
        h = int(rng.choice(base))
        for b in rng.choice(64, int(rng.integers(1, 22)), replace=False):
            h ^= 1 << int(b)
        out.add(h - (1 << 64) if h >> 63 else h)
    return sorted({h & ~((1 << stuck) - 1) for h in out})


@pytest.mark.parametrize("radius,stuck", [(6, 0), (12, 16), (19, 0)])
def test_hash_pairs_are_exact_at_wide_radii(spark, monkeypatch, radius, stuck):
    monkeypatch.setattr(duplicates, "NESTED_LOOP_ROWS", 0)
    hashes = near_hashes(radius, 400, stuck)
    df = spark.createDataFrame([(h,) for h in [*hashes, None, hashes[0]]], "phash long")
    got = sorted(tuple(r) for r in duplicates.hash_pairs(df, radius).collect())
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = sorted((a, b, apart(a, b)) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if apart(a, b) <= radius)
    assert got == want and want
    plan = duplicates.hamming_parts(df.selectExpr("phash as h").filter("h is not null"), radius)
    assert sum(len(p.masks(True)) + len(p.masks(False)) for p in plan) <= 500
    assert sum(p.errors + 1 for p in plan) > radius, "some part of any pair within the radius has no more than its errors"


def slow_near(rows, blocked, th):
    dot = lambda v, w: sum(a * b for a, b in zip(v, w, strict=True)) if v and w and len(v) == len(w) else -1
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    for k, (a, p, d, v) in enumerate(rows):
        for b, q, e, w in rows[k + 1 :]:
            far, dh = apart(p, q), 0 if d is None or e is None else apart(d, e)
            if not {(a, b), (b, a)} & blocked and ((far <= th.near and dh <= th.dhash) or (far <= th.loose and dot(v, w) >= th.near_cosine)):
                yield min(a, b), max(a, b), far


def test_near_pairs_and_groups_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "hash_pairs", None)  # no pair of hashes is joined to the assets
    monkeypatch.setattr(duplicates, "NESTED_LOOP_ROWS", 0)
    monkeypatch.setattr(duplicates, "ASSET_BLOCK", 60)
    rng, th = np.random.default_rng(5), duplicates.Thresholds(near=14, loose=19, dhash=30, near_cosine=0.3)
    rows = [(9 * k % 331, h, None if k % 9 == 0 else int(rng.integers(0, 1 << 62)), None if k % 11 == 0 else rng.normal(size=4 - (k % 7 == 0)).tolist()) for k, h in enumerate(near_hashes(3, 160))]
    rows += [(1000 + a, *x) for a, *x in rows[::4]] + [(2000 + a, *x) for a, *x in rows[::8]]
    pairs = list(slow_near(rows, set(), th))
    blocked = {(a, b) for a, b, _ in pairs[::5]}
    df = spark.createDataFrame(rows + [(5000, None, None, None)], "asset_id long, phash long, dhash long, vector array<double>")
    no = spark.createDataFrame(sorted(blocked), "asset_a long, asset_b long")
    want = sorted(slow_near(rows, blocked, th))
    assert sorted(tuple(r) for r in duplicates.near_pairs(df, no, th).collect()) == want and len(want) > 100
    for some in (blocked, {pairs[0][:2], pairs[7][:2]}):
        want = list(slow_near(rows, some, th))
        of = {a: a for a, *_ in rows}
        for _ in rows:
            for a, b, _ in want:
                of[a] = of[b] = min(of[a], of[b])
        scores = {}
        for a, _, far in want:
            scores.setdefault(of[a], []).append(1 - far / 64)
        seen = {a for p in want for a in p[:2]}
        got = {r.asset_id: (r.group_id, round(r.similarity, 9)) for r in duplicates.near_groups(df, spark.createDataFrame(sorted(some), "asset_a long, asset_b long"), th).collect()}
        assert got == {a: (of[a], round(sum(scores[of[a]]) / len(scores[of[a]]), 9)) for a in seen}


def test_hash_rows_come_as_often_as_assets_have_them(spark, tmp_path):
    from prismlake.plans.catalog_queries import QUERIES

    rng = np.random.default_rng(8)
    v = rng.normal(size=(40, 64)).round(3)
    rows = [(k, x.tolist()) for k, x in enumerate([*v, *(2 * v), *(3 * v[:9]), *(v + rng.normal(size=v.shape).round(3) / 8)])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in QUERIES["join_hamming_range"](spark, str(tmp_path)).collect())
    x = np.array([x for _, x in rows], np.float32).astype(float)
    s = np.sort(x)
    bits = [int("".join("01"[int(b)] for b in row), 2) for row in x > ((s[:, 31] + s[:, 32]) / 2)[:, None]]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    want = sorted((a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 18)
    assert got == want and len(want) > len(set(want))


def test_bits_that_all_hashes_share_are_not_probed():
    share, parts = duplicates._shared(duplicates._split(5), [1.0, 2.0**-9, 2.0**-13, 2.0**-13, 2.0**-13], 12, 500)
    assert share < 0.2 and all(p.offset for p in parts) and sum(p.errors + 1 for p in parts) > 12
    share, parts = duplicates._shared(duplicates._split(2), [2.0**-32] * 2, 6, 1200)
    assert share < 1e-5 and sorted(p.errors for p in parts) == [2, 3]
    assert duplicates._shared(duplicates._split(2), [2.0**-32] * 2, 19, 500) is None


# Rasters


def test_lanczos_has_no_seams():
    a = np.random.default_rng(0).random((70, 55)) * 255
    assert np.allclose(raster.lanczos(a, 140, 110, 16), raster.lanczos(a, 140, 110, 10**6))
    assert np.allclose(raster.lanczos(np.full((9, 9), 7.0), 31, 20), 7)
    smooth = np.add.outer(np.sin(np.arange(64) / 9), np.cos(np.arange(64) / 7)) * 60 + 128
    assert raster.upscale_quality(smooth, 2)[0] > 45 > raster.upscale_quality(a, 2)[0]


def test_upscale_covers_every_text(spark):
    from prismlake.plans.catalog_queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["upscale"](spark, sf)
    assert got.count() == 2 * spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 0").count()


def test_upscale_reads_texts_once_and_works_on_sizes_together(spark, tmp_path):
    """Against one raster at a time in one tile: odd characters, tiny and large texts, several of one size and more of it than a stack holds."""
    from prismlake.plans.catalog_queries import QUERIES

    rng = random.Random(3)
    texts = ["a", "ab", "aaaaaaaaa", "é😀 x\n\x00z", "\U0010ffff" * 3 + "b", "", None]
    texts += ["".join(rng.choice("abc éß\n漢😀") for _ in range(n)) for n in (8, 9, 9, 10, 255, 256, 257, 257, 4097, 9001, 40000) + (17000,) * 6]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["upscale"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("Scan parquet") == 1, "texts are read and sent once, not once a factor"
    want = {}
    for i, t in enumerate(texts):
        if t:
            side = int(np.ceil(np.sqrt(len(t))))
            a = np.resize([float(ord(c)) for c in t], (side, side))
            for k in (2, 4):
                again = raster.lanczos(raster._resize(a, max(1, side // k), max(1, side // k)), side, side, 10**6)
                sharp = raster.laplacian_variance(a)
                want[i, k] = (raster.psnr(a, again), raster.laplacian_variance(again) / sharp if sharp > 0 else 1.0)
    found = {(r.asset_id, r.factor): (r.psnr, r.sharpness) for r in got.collect()}
    assert found.keys() == want.keys() and got.count() == len(want)
    assert all(np.allclose(found[k], want[k], rtol=1e-9, atol=0) for k in want)
