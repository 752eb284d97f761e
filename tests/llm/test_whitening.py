"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest
from actlake.llm import whitening
from actlake.llm.common import read
from actlake.llm.queries import REGISTRY

SCHEMA = "vec_id long, embedding array<float>"


def expected(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    spread = n * x - sums
    centred = spread / n
    cov = centred.T @ centred / n
    values, columns = np.linalg.eigh(cov)
    values, columns = values[::-1][:k], columns[:, ::-1][:, :k]
    return (spread**2).sum(axis=1), centred @ columns / np.sqrt(values), values / np.trace(cov)


def check(rows, vectors, ids, k=8):
    deviation, whitened, explained = expected(vectors, k)
    place = {i: at for at, i in enumerate(ids)}
    assert len(rows) == len(vectors) * k
    got = np.zeros((len(vectors), k))
    for r in rows:
        at = place[r["vec_id"]]
        assert r["n"] == len(vectors) and r["deviation"] == deviation[at] == int(r["deviation_exact"])
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        got[at, r["component"] - 1] = r["whitened"]
    for c in range(k):
        sign = np.sign(got[:, c] @ whitened[:, c])
        assert np.abs(got[:, c] * sign - whitened[:, c]).max() < 1e-7
    assert np.abs(np.cov(got.T, bias=True) - np.eye(k)).max() < 1e-9


def test_query(spark):
    table = read(spark, "/root/testdata/sf0.001", "embeddings").collect()
    rows = REGISTRY["op13_whiten"].run(spark, "/root/testdata/sf0.001")
    kinds = {"component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert {n: t for n, t in rows.dtypes if n in kinds} == kinds
    check(rows.collect(), [r["embedding"] for r in table], [r["vec_id"] for r in table])


@pytest.mark.parametrize("case", ["close", "steep", "few"])
def test_spectra(spark, case):
    """Eigenvalues close to each other, over many orders of magnitude, and fewer dimensions than the block."""
    chance = np.random.default_rng(5)
    d = 12 if case == "few" else 80
    scale = {"close": 1 + 0.01 * np.arange(d), "steep": 2.0 ** -np.minimum(np.arange(d), 14) * 50, "few": np.ones(d)}[case]
    turn = np.linalg.qr(chance.standard_normal((d, d)))[0]
    vectors = ((chance.standard_normal((700, d)) * scale) @ turn).astype(np.float32).tolist()
    rows = whitening.whiten_embeddings(spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(5)).collect()
    check(rows, vectors, range(len(vectors)))


def test_edges(spark):
    chance = np.random.default_rng(6)
    good = chance.standard_normal((40, 10)).astype(np.float32).tolist()
    bad = [None, [], [1.0] * 9 + [None], [math.nan] * 10, [math.inf] + [0.0] * 9, [-math.inf] + [0.0] * 9, [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(good + bad)] + [(None, good[3]), (5, good[5])]
    df = spark.createDataFrame([(*r, 1, "k", 0.0) for r in rows], SCHEMA + ", x int, key string, component double")
    got = whitening.whiten_embeddings(df).collect()
    deviation, _, _ = expected([*good, good[3], good[5]])
    assert len(got) == 42 * 8 and {r["n"] for r in got} == {42}
    assert sorted((r["vec_id"] is None, r["deviation"]) for r in got if r["component"] == 1) == sorted((i == 40, int(v)) for i, v in enumerate(deviation))
    assert whitening.whiten_embeddings(df.limit(0)).count() == 0 and whitening.whiten_embeddings(df.limit(0)).columns == whitening.whiten_embeddings(df).columns
    # fewer dimensions than components; no variance; variance in one direction only
    assert {r["component"] for r in whitening.whiten_embeddings(spark.createDataFrame([(i, v[:3]) for i, v in enumerate(good)], SCHEMA)).collect()} == {1, 2, 3}
    same = whitening.whiten_embeddings(spark.createDataFrame([(i, good[0]) for i in range(5)], SCHEMA)).collect()
    assert all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in same) and len(same) == 40
    line = whitening.whiten_embeddings(spark.createDataFrame([(i, [float(i)] * 10) for i in range(9)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and {round(r["explained"], 9) for r in line} == {0.0, 1.0}
    assert max(r["identity_error"] for r in line) < 1e-9


def test_deviation_beyond_longs(spark):
    """Exact where n * x - S no longer fits 64 bits, and null where the deviation does not."""
    rows = [(0, [1e15, 0.0]), (1, [-1e15, 0.0]), (2, [0.0, 1.0])]
    got = {r["vec_id"]: r for r in whitening.whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r["component"] == 1}
    x = [[int(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for i, v in enumerate(x):
        exact = sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert int(got[i]["deviation_exact"]) == exact and got[i]["deviation"] == (exact if exact < 2**63 else None)
