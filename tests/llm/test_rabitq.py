"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest

from tessera.llm import rabitq


def made(seed, d=32):
    rng = np.random.default_rng(seed)
    out = []
    for f in range(40):
        base = rng.normal(size=d)
        for _ in range(rng.integers(1, 8)):
            out.append((base + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.3, 0.5])) * rng.uniform(0.1, 9))
            if rng.random() < 0.4:
                base = out[-1]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(out)]
    rows += [(900 + k, rows[3][1]) for k in range(6)] + [rows[7], (rows[8][0], rows[9][1])]
    rows += [(None, rows[0][1]), (1001, None), (1002, [0.0] * d), (1003, [float("nan")] * d), (1004, [float("inf")] + [1.0] * (d - 1)), (1005, [None] + [1.0] * (d - 1)), (1006, []), (1007, rows[0][1][:20])]
    return rows


def brute(rows, threshold, d=32):
    ok = [k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for k, v in rows]
    x = [np.array(v + [0.0] * (d - len(v)), dtype=np.float64) if good else None for (_, v), good in zip(rows, ok, strict=True)]
    root, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        least = min(ids) if ok[i] else k
        out.append((k, links[i], least, k is None or k == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,block,pivots", [(1, 4096, 1024), (2, 16, 1024), (3, 16, 3)])
def test_near_duplicates(spark, seed, block, pivots):
    rows = made(seed)
    table = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, key int")
    got = sorted((tuple(r) for r in rabitq.near_duplicates(table, block=block, pivots=pivots).collect()), key=str)
    assert got == brute(rows, 0.95)


def test_tiny_and_huge_components(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [3e-200, 6e-200]), (3, [1e250, 2e250]), (4, [2e-200, -1e-200])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rabitq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True)}


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rabitq.near_duplicates(table).count() == 0


def test_the_bound_holds_and_the_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 48))
    y = x + rng.normal(size=x.shape) * rng.uniform(0, 0.6, (500, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    true, errors = np.einsum("ij,ij->i", x, y), []
    for seed in range(40):
        turn = rabitq.rotation(48, seed)
        codes = rabitq.Codes(x, turn)
        guess = np.diag(rabitq.Codes.estimate(codes.bits, codes.factor, y @ turn.T))
        for t in (0.8, 0.95):
            assert (guess[true >= t] >= rabitq.Codes.bound(codes.factor, t)[true >= t]).all()
        errors.append(guess - true)
    assert abs(np.mean(errors)) < 0.002
