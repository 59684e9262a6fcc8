import math
from fractions import Fraction

import numpy as np
import pytest

from parapet.llm import whitening

INF, NAN = float("inf"), float("nan")


def matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * np.asarray(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    [9, 7, 4, 2, 1, 0.5], [5, 5, 5, 1, 1, 1], [3] * 6, [1e9, 1, 1e-6, 0, 0, 0], [2, 2 - 1e-7, 2 - 2e-7, 1, 1 - 1e-12, 1e-9], [0] * 5, [4],
    [100, *np.linspace(1, 1.001, 40)], np.random.default_rng(4).random(64)])
def test_eigenvectors_are_good_to_double_precision(values):
    a = matrix(values)
    found, x = whitening.eigen(a)
    assert (np.diff(found) <= 0).all()
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(a @ x - x * found).max() <= 1e-14 * scale * len(a)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14 * len(a)
    assert np.abs(found - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * scale * len(a)


def test_float32_alone_would_not_do():
    a = matrix([9, 7, 6.999, 2, 1, 0.5])
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    rough = np.abs(a @ x - x * np.einsum("ij,ij->j", x, a @ x)).max()
    found, y = whitening.eigen(a)
    assert rough > 1e-7 > 1e7 * np.abs(a @ y - y * found).max()


def brute(rows, components=4):
    """Exact sums with fractions; eigenvectors of the exact covariance rounded to doubles."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) and abs(c) < 1e15 for c in v)]
    lengths = [len(x) for _, x in kept]
    d = max(sorted(set(lengths)), key=lengths.count)
    kept = [(i, x) for i, x in kept if len(x) == d]
    own = {tuple(x) for _, x in kept}
    n, sums = len(own), [sum(x[j] for x in own) for j in range(d)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in own), n ** 3) for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array(cov, float))
    out = {}
    for k in range(min(components, d)):
        e, u = values[-1 - k], vectors[:, -1 - k]
        for i, x in kept:
            y = np.array([float(Fraction(n * x[j] - sums[j], n)) for j in range(d)])
            out.setdefault((i, k + 1), []).append((n, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), y @ u / math.sqrt(e),
                                                   e / values.sum()))
    return out


@pytest.fixture
def rows():
    rng = np.random.default_rng(3)
    made = [(i, [float(c) for c in rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1] + 2]) for i in range(300)]
    return [*made, *[(1000 + i, made[7][1]) for i in range(200)], made[3], (None, made[4][1]), (2000, None), (2001, []),
            (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [NAN] + [1.0] * 5), (2004, [1.0, INF, 0.0, 0.0, 0.0, 0.0]), (2005, [1.0, 2.0]), (2006, [0.0] * 6),
            (2007, [-0.0] * 6), (2008, [1e300] * 6)]


def test_like_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, component int, `x` string")
    got = whitening.whiten(df).collect()
    want = brute(rows)
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in got:
        n, deviation, value, explained = want[r["vec_id"], r["component"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        if abs(value) > 1e-6:
            assert signs.setdefault(r["component"], np.sign(value * r["whitened"])) == np.sign(value * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(value)) < 1e-9 and abs(r["explained"] - explained) < 1e-10
        assert 0 <= r["identity_error"] < 1e-10
    assert len({r["identity_error"] for r in got}) == 1


def test_edges(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()

    assert run([]) == [] == run([(1, None)])
    assert run([(1, [1.0, 2.0])] * 5) == []  # one distinct vector: nothing varies
    line = run([(i, [float(i), 2.0 * i]) for i in range(4)])  # one direction only
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    far = run([(1, [1e12]), (2, [0.0]), (3, [5.0])])
    assert [r["deviation"] for r in far][0] is None and all(abs(r["whitened"]) < 2 for r in far)


def test_deviations_beyond_small_numbers_are_exact():
    x = np.array([[2 ** 30, -2 ** 30], [3, 5], [0, 0]])
    n, sums = 10, [7, -9]
    assert whitening._deviations(x, n, sums) == [
        v if (v := sum((n * int(c) - s) ** 2 for c, s in zip(r, sums))) < 2 ** 63 else None for r in x.tolist()]
