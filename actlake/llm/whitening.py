"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become integers first, floor(``SCALE`` * entry) + ``SHIFT``, so that the sums of each dimension are exact. V is the
covariance of all remaining vectors. A block of orthonormal columns Q is refined in cycles. Each application of V is one
pass over the rows: a task centres its vectors, (n * x - S) / n, and adds up Xt(XQ); Spark adds these up by row of the
result; no product of all dimensions is formed. A cycle applies a Chebyshev polynomial of V by its three-term recurrence. It is
small on [0, b], where b is the block's least Ritz value, so what is unwanted is damped and the leading directions grow.
QR makes the columns orthonormal again and a Rayleigh-Ritz step rotates them to the block's best eigenvectors. The loop ends when the
residuals |Vq - eq| of all wanted columns certify them: at most ``TOLERANCE`` of the largest eigenvalue. Residuals that
no longer fall and are within ``ROUNDING`` are those of double precision and accepted too; otherwise it fails loudly.

The driver holds d x block numbers, never vectors. Every pass is a job of its own over a written table, so a lost
executor costs the part of one pass that it held, and no lineage grows.

Rows whose vector is null, empty, or holds a null or non-finite entry take no part. Vectors must have one length: the
most frequent one (the longer one in a tie) counts, others take no part either. Repeated rows count as often as they
occur; null ids are kept. With fewer dimensions than components there are fewer components. Components without
variance (one vector, equal vectors) have whitened null and explained 0 and are left out of identity_error, which is 0
where none is left. ``deviation`` is null where the exact value exceeds a long; ``deviation_exact`` always has it.
Components whose eigenvalues are equal may come in any orthonormal basis. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
OVERSAMPLING = 4  # columns of the block for each wanted one
DEGREE = 10  # of the polynomial in one cycle
GROWTH = 1e11  # of the leading direction over the block's last in one cycle
TOLERANCE = 4e-15
ROUNDING = 1e-11
CYCLES = 200
LEAST = 1e-13  # share of the largest eigenvalue that counts as variance
_LONG = 1 << 62


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of each dimension
    vectors: np.ndarray  # a component in each column
    values: np.ndarray  # eigenvalues, falling
    trace: float
    residual: float  # largest of the components', over the largest eigenvalue
    passes: int
    largest: int  # absolute value of an entry


def integer_vectors(df: DataFrame, vector: str, key: str) -> DataFrame:
    """key and x, the integer vector, of the rows that take part."""
    whole = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad).select(F.col(key).alias("key"), whole.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _spread(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - S, exactly: as longs, or as Python's integers where those would not do."""
    kind = np.int64 if 2 * n * largest < _LONG else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _spread(x, model.n, model.sums, model.largest).astype(np.float64) / model.n


def _added(rows: DataFrame, partial) -> np.ndarray:
    """The sum over all tasks of the matrix that ``partial`` makes of a batch's integer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = partial(batch.column("x"))
                total = found if total is None else total + found
        if total is not None:
            places = np.indices(total.shape, dtype=np.int32).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(places[0]), pa.array(places[1]), pa.array(total.ravel())], ["i", "j", "v"])

    sums = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((sums["i"].max() + 1, sums["j"].max() + 1))
    out[sums["i"], sums["j"]] = sums["v"]
    return out


def _moments(rows: DataFrame) -> tuple[int, list[int], int]:
    """Number of vectors, exact sums of each dimension, largest absolute entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest, high, low = 0, 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), len(batch.column("x")[0]))
                n, largest = n + len(x), max(largest, abs(int(x.min())), abs(int(x.max())))
                high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            sums = [Decimal((int(h) << 32) + int(b)) for h, b in zip(high, low, strict=True)]
            columns = [pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.decimal128(38, 0)), pa.array([n] * len(sums), pa.int64()), pa.array([Decimal(largest)] * len(sums), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["i", "s", "n", "m"])

    parts = rows.select("x").mapInArrow(run, "i int, s decimal(38,0), n long, m decimal(38,0)")
    found = sorted(parts.groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n"), F.max("m").alias("m")).collect(), key=lambda r: r["i"])
    return found[0]["n"], [int(r["s"]) for r in found], int(found[0]["m"])


def _filtered(apply, q: np.ndarray, vq: np.ndarray, ritz: np.ndarray, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V applied to q: small on [0, least Ritz value], 1 at the largest one."""
    centre = half = ritz[-1] / 2
    top = (ritz[0] - centre) / half
    # as high a degree as leaves the block's last column its digits
    degree = max(1, min(degree, int(np.log(GROWTH) / np.arccosh(max(top, 1 + 1e-12)))))
    scale = 1 / top
    before, at = q, (vq - centre * q) * (scale / half)
    for _ in range(degree - 1):
        rescaled = 1 / (2 * top - scale)
        before, at = at, (apply(at) - centre * at) * (2 * rescaled / half) - before * (scale * rescaled)
        scale = rescaled
    return at


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, degree: int = DEGREE) -> Whitening | None:
    """The leading components of ``rows`` (x: integer vectors of one length); None where there is no row."""
    n, sums, largest = _moments(rows) if not rows.isEmpty() else (0, [], 0)
    if not n:
        return None
    d = len(sums)
    model = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0, largest)
    model.trace = float(_added(rows, lambda x: np.square(_centred(_matrix(x, d), model)).sum(axis=0)[None]).sum() / n)

    def apply(q: np.ndarray) -> np.ndarray:
        model.passes += 1

        def product(x: pa.Array) -> np.ndarray:
            centred = _centred(_matrix(x, d), model)
            return centred.T @ (centred @ q)

        return _added(rows, product) / n

    wanted, width = min(components, d), min(components * oversampling, d)
    q = np.linalg.qr(np.random.default_rng(13).standard_normal((d, width)))[0]
    best, still = np.inf, 0
    for _ in range(CYCLES):
        vq = apply(q)
        small = q.T @ vq
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = np.maximum(ritz[::-1], 0), turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = float(np.linalg.norm(vq - q * ritz, axis=0)[:wanted].max() / max(ritz[0], 1e-300))
        still = still + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if ritz[0] <= 1e-12 or residual <= TOLERANCE or (still >= 2 and residual <= ROUNDING):
            break
        if width < d and ritz[-1] > LEAST * ritz[0]:
            q = _filtered(apply, q, vq, ritz, degree)
        else:
            q = vq + q * (LEAST * ritz[0])  # the block already holds every direction with variance
        q = np.linalg.qr(q / np.linalg.norm(q, axis=0))[0]
    else:
        raise ValueError(f"components are not certified: residual {residual}")
    model.vectors, model.values, model.residual = q[:, :wanted], ritz[:wanted], residual
    return model


def _factors(model: Whitening) -> np.ndarray:
    """What a centred vector is multiplied by; a column of NaN for a component without variance."""
    varies = model.values > max(LEAST * model.values[0], 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(varies, model.vectors / np.sqrt(model.values), np.nan)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' own covariance, measured in a pass over them, minus the identity."""
    d = len(model.sums)
    factors = _factors(model)
    factors = factors[:, ~np.isnan(factors[0])]
    k = factors.shape[1]
    if not k:
        return 0.0

    def products(x: pa.Array) -> np.ndarray:
        z = _centred(_matrix(x, d), model) @ factors
        return np.vstack([z.T @ z, z.sum(axis=0)])

    found = _added(rows, products) / model.n
    mean = found[k]
    return float(np.abs(found[:k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, error: float, key: str) -> DataFrame:
    """A row for each of ``rows`` (key, x) and component, with the columns that the module describes."""
    kind = rows.schema["key"].dataType.simpleString()
    d, k = len(model.sums), len(model.values)
    factors, explained = _factors(model), (model.values / model.trace if model.trace > 0 else np.zeros(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            spread = _spread(_matrix(batch.column("x"), d), model.n, model.sums, model.largest)
            z = (spread.astype(np.float64) / model.n) @ factors
            if d * float(2 * model.n * model.largest) ** 2 >= _LONG:
                spread = spread.astype(object)
            exact = [Decimal(int(v)) for v in (spread * spread).sum(axis=1)]
            at = np.repeat(np.arange(batch.num_rows), k)
            columns = [
                batch.column("key").take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(exact, pa.decimal128(38, 0)).take(pa.array(at)),
                pa.array(z.ravel(), mask=np.isnan(z.ravel())),
                pa.array(np.tile(explained, batch.num_rows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "exact", "whitened", "explained"])

    out = rows.mapInArrow(run, f"key {kind}, component int, exact decimal(38,0), whitened double, explained double")
    deviation: Column = F.when(F.col("exact") < F.lit(Decimal(2**63)), F.col("exact")).cast("long")
    return out.select(F.col("key").alias(key), "component", F.lit(model.n).cast("long").alias("n"), deviation.alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"), F.col("exact").alias("deviation_exact"))


def whiten_embeddings(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error, deviation_exact of every row that takes part."""
    rows = written(integer_vectors(df, vector, key), "llm-integers")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size("x") == (lengths[0]["d"] if lengths else 0))
    model = fit_whitening(rows, components)
    if model is None:
        kind = rows.schema["key"].dataType.simpleString()
        names = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
        return df.sparkSession.createDataFrame([], names)
    return whiten(rows, model, identity_error(rows, model), key)
