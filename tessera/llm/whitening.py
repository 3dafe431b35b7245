"""Embedding whitening (operator 12): leading components by matrix-free block Lanczos.

The covariance of the fit list (each different vector once) is never built: a pass over
the list gives V·Q for a block Q of vectors, as the sum of Zᵀ(ZQ) over partitions, with Z
the centred rows. On the driver there are the basis, of at most BASIS columns or the
dimension, and its images. Each block is made orthogonal to the whole basis, twice; columns
that vanish (a breakdown) are replaced by random ones, orthogonal to it too; a full basis
restarts from its best Ritz vectors. The end is told by the residuals of the wanted pairs.

Entries are whole numbers floor(64·c) + 1000000, so that sums and deviations are exact.
Rows are left out if their vector is null or empty, or holds an entry that is null, not
finite or of 2^55 or more; so are vectors of another length than most rows have (of equally
frequent ones the longer). A component without variance can't be whitened: where vectors
have fewer than COMPONENTS dimensions with variance, there are fewer components, and none
for an empty table or a single different vector. Repeated rows and null ids get rows like
others; only the two named columns are read. A deviation beyond 2^63 is null.

The fit list is written as a table, once; a lost executor costs its running tasks of a pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

COMPONENTS = 16
#: Columns of a block, and of the basis at most, before it restarts.
BLOCK, BASIS = 16, 256
#: Residuals, as a share of the largest eigenvalue, and passes after which it is an error.
TOLERANCE, PASSES = 1e-12, 400
#: Eigenvalues below this share of the largest are no variance.
NOTHING = 1e-12
SCALE, OFFSET = 64, 1_000_000


@dataclass(frozen=True)
class Centre:
    """Number of vectors and exact sums of their dimensions."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the means have beyond whole, times n."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n·x - S)² of each row, in whole numbers throughout."""
        u, rest, n = x - self.whole, self.rest, self.n
        most = int(np.abs(u).max(initial=0)) + 1
        if most * most * len(rest) < 2**62 and most * n * len(rest) < 2**62:
            squares, cross, own = (u * u).sum(1).tolist(), (u @ rest).tolist(), sum(r * r for r in rest.tolist())
            made = [n * n * a - 2 * n * b + own for a, b in zip(squares, cross, strict=True)]
        else:
            made = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in u.tolist()]
        return [m if m < 2**63 else None for m in made]


@dataclass(frozen=True)
class Whitening:
    """Components as columns, their eigenvalues, the trace of the covariance and the error on the fit list."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ (self.vectors / np.sqrt(self.values))


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and x, the whole numbers of each vector that counts."""
    vector = F.col(f"`{vector_col}`")
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0**55, F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")) + F.lit(OFFSET).cast("long"))
    made = df.where((F.size(vector) > 0) & fits).select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))
    most = made.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return made.where(F.size("x") == (most["d"] if most else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _summed(fit: DataFrame, function: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """The numbers of function, summed over the batches of fit; tasks send one row for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = function(_matrix(batch))
                total = made if total is None else total + made
        if total is not None:
            values = [Decimal(int(v)) for v in total] if kind != "double" else total
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(values, pa.decimal128(38, 0) if kind != "double" else pa.float64())], ["k", "v"])

    rows = fit.mapInArrow(run, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["k"])]


def centre_of(fit: DataFrame) -> Centre | None:
    def sums(x: np.ndarray) -> np.ndarray:
        # Sums of high and low halves don't overflow; Python's whole numbers put them together.
        high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
        return np.array([len(x), *((h << 32) + b for h, b in zip(high, low, strict=True))], object)

    made = _summed(fit, sums, "decimal(38,0)")
    return Centre(int(made[0]), tuple(int(s) for s in made[1:])) if made else None


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """The block's directions outside the basis; a column without one is replaced by a random one."""
    made: list[np.ndarray] = []
    for column in block.T:
        least = 1e-10 * scale
        while True:
            own = np.column_stack([basis, *made])
            for _ in range(2):
                column = column - own @ (own.T @ column)
            size = np.linalg.norm(column)
            if size > least:
                break
            column, least = rng.standard_normal(len(column)), 1e-6
        column = column / size
        made.append(column - own @ (own.T @ column))
        made[-1] /= np.linalg.norm(made[-1])
    return np.column_stack(made)


def leading(apply: Callable[[np.ndarray], np.ndarray], d: int, want: int, block: int = BLOCK, most: int = BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The `want` largest eigenvalues, falling, and their vectors, of a symmetric matrix of d rows given by its products."""
    want = min(want, d)
    most = min(d, max(most, 2 * want + 2 * block))
    rng = np.random.default_rng(12)
    new = _orthonormal(rng.standard_normal((d, min(block, d))), np.zeros((d, 0)), rng, 0.0)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(PASSES):
        image = apply(new)
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        top = turn[:, :want]
        vectors = basis @ top
        residuals = np.linalg.norm(images @ top - vectors * values[:want], axis=0)
        largest = max(abs(values[0]), abs(values[-1]))
        if basis.shape[1] == d or basis.shape[1] >= want and (residuals <= TOLERANCE * largest).all():
            return values[:want], np.linalg.qr(vectors)[0]
        new = _orthonormal(image[:, : min(block, d - basis.shape[1])], basis, rng, largest)
        if basis.shape[1] + new.shape[1] > most:
            kept = turn[:, : want + block]
            basis, images = basis @ kept, images @ kept
    raise RuntimeError(f"{PASSES} passes left residuals of {residuals.max():.3g}")


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK, basis: int = BASIS) -> Whitening | None:
    """The whitening of the different x of rows (see usable); None if there is none with variance."""
    fit = staged(rows.select("x").distinct(), "fit-list")
    centre = centre_of(fit)
    if centre is None:
        return None
    d, n = len(centre.sums), centre.n
    squares: list[float] = []

    def apply(q: np.ndarray) -> np.ndarray:
        def products(x: np.ndarray) -> np.ndarray:
            z = centre.rows(x)
            return np.append((z.T @ (z @ q)).ravel(), (z * z).sum())

        made = np.array(_summed(fit, products))
        squares.append(made[-1])
        return made[:-1].reshape(d, -1) / n

    values, vectors = leading(apply, d, components, block, basis)
    # The sum of deviations is n² times that of the centred squares.
    trace = squares[0] / n
    used = (values > NOTHING * values[0]) & (values > 0)
    if not used.any():
        return None
    made = Whitening(centre, vectors[:, used], values[used], trace)
    k = int(used.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        w = made.whitened(x)
        return np.append((w.T @ w).ravel(), w.sum(0))

    found = np.array(_summed(fit, moments)) / n
    covariance = found[: k * k].reshape(k, k) - np.outer(found[k * k :], found[k * k :])
    return Whitening(centre, made.vectors, made.values, trace, float(np.abs(covariance - np.eye(k)).max()))


def whiten(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error: a row for each row and component."""
    kind = rows.schema["id"].dataType
    schema = f"`{id_col}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.num_rows
            if not many:
                continue
            x = _matrix(batch)
            repeat = pa.array(np.repeat(np.arange(many), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(repeat),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * k, model.centre.n)),
                    pa.array(model.centre.deviations(x), pa.int64()).take(repeat),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, many)),
                    pa.array(np.full(many * k, model.error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op12(vectors: DataFrame) -> DataFrame:
    rows = usable(vectors)
    return whiten(rows, fit_whitening(rows))
