import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoplex.llm import hard_negatives as H

VECS = "vec_id long, embedding array<double>, label int, cell int, anchor string"


def brute(rows):
    rows = [(i, np.floor(256 * np.array(v)).astype(np.int64), l) for i, v, l in rows]
    out = []
    for x, (a, va, la) in enumerate(rows):
        if a % 10:
            continue
        scored = [(-int(va @ v), i, l == la) for y, (i, v, l) in enumerate(rows) if y != x]
        for p, pi, _ in sorted(s for s in scored if s[2])[:5]:
            fit = sorted((s, i) for s, i, same in scored if not same and -30 * p <= -100 * s <= -90 * p)[:10]
            out += [(a, pi, k, i, -p, -s) for k, (s, i) in enumerate(fit, start=1)]
    return sorted(out)


def rows_of(seed, n=260, d=9, spread=0.3, dtype=float):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, d))
    rows = []
    for i in range(n):
        of = rng.integers(0, 6)
        rows.append((int(i), (middle[of] + spread * rng.normal(size=d)).astype(dtype).tolist(), int(of % 3 if rng.random() < 0.8 else rng.integers(0, 4))))
    rows += [(1000 + i, rows[20][1], i % 3) for i in range(40)]  # copies of one vector
    rows += [(20, rows[20][1], rows[20][2]), (30, rows[31][1], 1), (2000, [0.0] * d, 2)]  # repeated rows and identifiers
    return rows


def got(spark, rows, extra=()):
    df = spark.createDataFrame([(i, v, l, 1, "a") for i, v, l in [*rows, *extra]], VECS).repartition(6)
    return sorted(map(tuple, H.mine_hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))


@pytest.mark.parametrize("seed,first,block,slices", [(0, 2048, 4096, 16384), (1, 20, 16, 7), (2, 1, 5, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, first, block, slices):
    for name, value in (("FIRST_ROWS", first), ("BLOCK_ROWS", block), ("SLICE_ANCHORS", slices), ("CODEWORDS", 5)):
        monkeypatch.setattr(H, name, value)
    rows = rows_of(seed)
    bad = [(None, [0.1] * 9, 1), (50, None, 1), (60, [0.1] * 9, None), (70, [0.1, None] + [0.2] * 7, 1), (80, [float("nan")] * 9, 1), (90, [float("inf")] * 9, 1), (100, [], 1), (110, [1.0] * 4, 1)]
    want = brute(rows)
    assert got(spark, rows, bad) == want and len(want) > 500


def test_large_numbers_stay_exact(spark):
    rows = [(i, [v * 30_000 for v in x], l) for i, x, l in rows_of(3, 60, 4)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(i, [1.0], 1) for i in range(30)], [(i, [-1.0 if i == 10 else 1.0, 0.5], i % 2) for i in range(25)]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_walk_gives_every_cell_once_by_falling_bound_and_bounds_hold():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(500, 6)))
    index = H.MultiIndex(6, (np.zeros((0, 0)),) * 2, (np.zeros(6), np.zeros(6)), np.zeros(36, np.int64))
    index.centres = tuple(H.codebook(x[:, h], 6) for h in index.halves)
    cell, far = index.cells(x)
    index.rows = np.bincount(cell, minlength=36)
    for half, of in enumerate((cell // 6, cell % 6)):
        np.maximum.at(index.radii[half], of, far[half])
    for anchor in x[:20]:
        walked = list(index.walk(anchor))
        assert sorted(c for c, _, _ in walked) == sorted(set(cell.tolist()))
        assert all(a[2] >= b[2] for a, b in zip(walked, walked[1:]))
        for c, low, high in walked:
            s = x[cell == c] @ anchor
            assert low <= s.min() and s.max() <= high
        # the walk stops where the window ends
        top = np.sort(x @ anchor)[-1]
        assert len(index.rest(anchor, [(top, top)])) + len(index.first(anchor, top)) <= len(walked)
        assert set(cell[x @ anchor >= top]) <= {*index.rest(anchor, [(top, top)]), *index.first(anchor, top)}
