"""Principal components of wide sparse vectors, without a matrix that is square in their size.

The covariance C is only ever applied to a narrow block of directions: every pass multiplies the rows by the block and
sums the products per slot, so a task holds slots x block numbers and the driver as much per pass. The directions of
all passes span the space in which the components are sought (block Krylov, Rayleigh-Ritz); the passes end when
|C v - variance v| is below `tol` of each component's own variance (or rounding of the largest).
"""

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed package

SPARSE, DENSE = 0, 1  # kinds of vector, as stored
PIECE = 2**16  # entries multiplied at once: 15 MB for a block of 28 columns


@dataclass(frozen=True)
class Components:
    """Directions (slots x k, unit length, largest entry positive), variances along them, the share of the whole
    variance, what is left of the eigenvalue equation, and the mean of all rows."""

    directions: np.ndarray
    variances: np.ndarray
    shares: np.ndarray
    residuals: np.ndarray
    mean: np.ndarray
    passes: int


def entries(features: str | Column) -> Column:
    """The vector as an array of (slot, value); zeros may be left out."""
    stored = F.unwrap_udt(features)
    slots = F.when(stored["type"] == SPARSE, stored["indices"]).otherwise(F.sequence(F.lit(0), F.size(stored["values"]) - 1))
    return F.arrays_zip(slots.alias("slot"), stored["values"].alias("value"))


def _rows(column: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first entry of each row, slots, values) of the sparse and of the dense rows."""
    kind = column.field("type")
    for code in (SPARSE, DENSE):
        some = column.filter(pa.array(np.asarray(kind) == code))
        if not len(some):
            continue
        lists = some.field("values")
        values = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        slots = some.field("indices").flatten().to_numpy(zero_copy_only=False) if code == SPARSE else np.tile(np.arange(lengths[0]), len(some))
        yield lengths.cumsum() - lengths, slots, values


def _products(held: np.ndarray, slots: np.ndarray, values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Each row times the block, some rows at a time: entries times columns is many times what the rows take, for texts
    of hundreds of words some GB a batch. `held` are the first entries of the rows."""
    out, ends = np.empty((len(held), block.shape[1])), np.append(held[1:], len(values))
    cuts = np.flatnonzero(np.diff(held // PIECE, prepend=-1))  # a piece has the rows that begin in the same PIECE entries
    for a, b in zip(cuts, np.append(cuts[1:], len(held))):
        first, last = held[a], ends[b - 1]
        out[a:b] = np.add.reduceat(values[first:last, None] * block[slots[first:last]], held[a:b] - first)
    return out


def times(column: pa.StructArray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each row times the block, beside the rows themselves; rows without entries are left out."""
    for first, slots, values in _rows(column):
        lengths = np.diff(np.append(first, len(values)))
        if len(values):
            held = first[lengths > 0]
            yield _products(held, slots, values, block), lengths[lengths > 0], slots, values


def _applied(vectors: DataFrame, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sum over the rows x of x (x . block); sum of the rows; sum of their squares; their number."""
    size, width = block.shape
    names = ["slot", *(f"s{i}" for i in range(width + 2))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((size, width + 2)), 0
        for batch in batches:
            rows += batch.num_rows
            for product, lengths, slots, values in times(batch.column(0), block):
                spread = np.repeat(product, lengths, axis=0)
                for i in range(width):
                    sums[:, i] += np.bincount(slots, values * spread[:, i], size)
                sums[:, width] += np.bincount(slots, values, size)
                sums[:, width + 1] += np.bincount(slots, values * values, size)
        if rows:
            held = np.flatnonzero(sums.any(1))
            slot = np.append(held, -1)  # slot -1 counts the rows
            out = np.vstack([sums[held], np.eye(1, width + 2) * rows])
            yield pa.RecordBatch.from_arrays([pa.array(slot), *(pa.array(np.ascontiguousarray(c)) for c in out.T)], names=names)

    partial = vectors.mapInArrow(run, ", ".join(f"{n} {'double' if i else 'long'}" for i, n in enumerate(names)))
    merged = partial.groupBy("slot").agg(*(F.sum(n).alias(n) for n in names[1:])).toPandas()  # a row per slot
    out = np.zeros((size, width + 2))
    inside = merged[merged["slot"] >= 0]
    out[inside["slot"]] = inside[names[1:]]
    return out[:, :width], out[:, width], float(out[:, width + 1].sum()), int(merged.loc[merged["slot"] < 0, "s0"].sum())


def _independent(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of what the block adds to the basis."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > least]
    return q - basis @ (basis.T @ q)


def principal_components(vectors: DataFrame, k: int, column: str = "features", tol: float = 1e-5, max_passes: int = 30,
                         extra: int = 6, seed: int = 42) -> Components:
    """The first k components of the vector column. Pass persisted vectors: every pass reads them.

    A table of less than two rows has no variance: its components are unit vectors.
    """
    rows = vectors.select(F.unwrap_udt(column).alias("v")).filter("v is not null")
    width = F.when(F.col("v.type") == SPARSE, F.col("v.size")).otherwise(F.size("v.values"))
    size = rows.agg(F.max(width)).first()[0] or k
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, k + extra))))[0]
    block, images = basis, np.zeros((size, 0))
    for passes in range(1, max_passes + 1):
        product, sums, squares, n = _applied(rows, block)
        mean, scale = sums / max(n, 1), 1 / max(n - 1, 1)
        images = np.hstack([images, scale * (product - n * np.outer(mean, mean @ block))])
        inner = basis.T @ images
        values, vectors_ = np.linalg.eigh((inner + inner.T) / 2)
        best = np.argsort(-values)[:k]
        directions, variances = basis @ vectors_[:, best], np.maximum(values[best], 0)
        residuals = np.linalg.norm(images @ vectors_[:, best] - directions * values[best], axis=0)
        largest = max(float(variances.max(initial=0)), 1e-300)
        if (residuals <= np.maximum(tol * variances, 1e-11 * largest)).all():
            break
        block = _independent(images[:, -block.shape[1]:], basis, 1e-12 * largest)
        if not block.shape[1]:
            break
        basis = np.hstack([basis, block])
    total = scale * (squares - n * float(mean @ mean))
    signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])
    return Components(directions * signs, variances, variances / max(total, 1e-300), residuals, mean, passes)


def projected(df: DataFrame, components: Components, names: list[str], keep: list[str], column: str = "features") -> DataFrame:
    """The columns `keep` and, under `names`, each row times the directions; rows are not centred."""
    directions = components.directions

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column_, out = batch.column(len(keep)), np.zeros((batch.num_rows, len(names)))
            kinds = np.asarray(column_.field("type"))
            for code in (SPARSE, DENSE):
                at = np.flatnonzero(kinds == code)
                some = column_.filter(pa.array(kinds == code))
                filled = at[some.field("values").value_lengths().to_numpy(zero_copy_only=False) > 0] if len(at) else at
                for product, *_ in times(some, directions):
                    out[filled] = product
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(np.ascontiguousarray(c)) for c in out.T)], names=[*keep, *names])

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), *(f"`{n}` double" for n in names)]
    return df.select(*keep, F.unwrap_udt(column).alias("_v")).mapInArrow(run, ", ".join(fields))
