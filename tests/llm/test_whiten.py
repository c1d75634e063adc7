"""Operator 12 against numpy on the whole matrix."""

import math

import numpy as np
import pytest

from scrivano.llm import whiten

SF = "/root/testdata/sf0.001"


def expected(vectors):
    """(n, exact deviations, eigenvalues falling, axes, centred rows) of lists of floats."""
    d = max(map(len, vectors))
    x = [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (d - len(v))]] for v in vectors]
    n = len(x)
    total = [sum(column) for column in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, total, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, values[::-1], axes[:, ::-1], centred


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "a", 1.0) for k, v in rows], "vec_id long, embedding array<float>, x string, whitened double")


def check(got, keys, vectors, components=32):
    n, deviation, values, axes, centred = expected(vectors)
    k = min(components, len(values))
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == n * k
    trace = values.sum()
    w = centred @ axes[:, :k] / np.sqrt(values[:k])
    for j in range(k):
        mine = sorted((r.vec_id if r.vec_id is not None else -1, r.deviation, r.whitened) for r in got if r.component == j + 1)
        theirs = [sorted((key if key is not None else -1, dev, float(v)) for key, dev, v in zip(keys, deviation, s * w[:, j], strict=True)) for s in (1, -1)]
        error = min(max(abs(a[2] - b[2]) if a[:2] == b[:2] else 9 for a, b in zip(mine, t, strict=True)) for t in theirs)
        assert error < 1e-6, (j, error)
        share = {r.explained for r in got if r.component == j + 1}
        assert len(share) == 1 and abs(share.pop() - values[j] / trace) < 1e-9
    assert {r.n for r in got} == {n} and all(0 <= r.identity_error < 1e-9 for r in got) and len({r.identity_error for r in got}) == 1


def test_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    said = rows.collect()
    check(whiten.whiten(rows).collect(), [r.vec_id for r in said], [r.embedding for r in said])


def test_odd_rows(spark):
    """Nulls, non-finite and short vectors, repeated and null keys, equal rows, clashing columns."""
    rng = np.random.default_rng(1)
    fine = [(k % 7 if k % 9 else None, rng.standard_normal(5).astype(np.float32).tolist()) for k in range(60)]
    fine += [(3, fine[0][1]), (3, fine[0][1]), (100, [1.5]), (101, []), (102, [0.0, 2.0, -3.25])]
    odd = [(1, None), (2, [1.0, None, 2.0, 3.0, 4.0]), (3, [float("nan")] * 5), (4, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0, 0.0, float("-inf")])]
    got = whiten.whiten(frame(spark, odd + fine).repartition(3)).collect()
    check(got, [k for k, _ in fine], [v for _, v in fine])


def test_few_components_by_small_blocks(spark):
    """Many passes: blocks of two columns, stopped by the residuals before the space is full."""
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((300, 40)) * np.concatenate([[90, 70, 50, 30], np.ones(36)])).astype(np.float32).tolist()
    got = whiten.whiten(frame(spark, list(enumerate(vectors))), components=3, width=2).collect()
    check(got, list(range(300)), vectors, 3)


def test_no_variance(spark):
    assert whiten.whiten(frame(spark, [(1, [0.5, 1.0])] * 4)).collect() == []
    assert whiten.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whiten.whiten(frame(spark, [(1, [1.0])]).where("vec_id > 1")).collect() == []
    # One direction has variance, the other two have none.
    got = whiten.whiten(frame(spark, [(1, [0.5, 1.0, 7.0]), (2, [0.5, 2.0, 7.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in got) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_huge_entries(spark):
    """Sums and products beyond the longs: exact within, the largest long beyond."""
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e9, 2.0])]
    got = whiten.whiten(frame(spark, rows)).collect()
    assert {r.deviation for r in got} == {(1 << 63) - 1} and {r.vec_id for r in got} == {1, 2, 3}


@pytest.mark.parametrize("width", [1, 3, 8])
def test_breakdown(width):
    """Repeated eigenvalues and an exhausted Krylov space: random columns restart the blocks."""
    rng = np.random.default_rng(3)
    turn, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    values = np.array([5.0] * 6 + [2.0] * 6 + [0.0] * 8)
    matrix = (turn * values) @ turn.T
    passes = []

    def product(block):
        passes.append(block.shape[1])
        return matrix @ block

    found, axes = whiten.block_lanczos(product, 20, 8, width)
    if width == 8:
        np.testing.assert_allclose(found, values[:8], atol=1e-10)
    np.testing.assert_allclose(matrix @ axes, axes * found, atol=1e-9)
    np.testing.assert_allclose(axes.T @ axes, np.eye(8), atol=1e-10)
    assert sum(passes) <= 20
