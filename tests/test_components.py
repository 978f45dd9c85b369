"""Products of vectors with a block, and what they take up in memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ticketscope.operators import components, silhouettes


def _vectors(rows: list[tuple[int, list[int], list[float]]], width: int) -> pa.StructArray:
    """Vectors as Spark stores them, from their kind, slots and values."""
    kinds, slots, values = zip(*rows)
    return pa.StructArray.from_arrays(
        [pa.array(kinds, pa.int8()), pa.array([width] * len(rows), pa.int32()), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
        names=["type", "size", "indices", "values"],
    )


@pytest.mark.parametrize("piece", [1, 7, 64, 2**16])
def test_products_do_not_depend_on_the_pieces(monkeypatch, piece):
    draw = np.random.default_rng(3)
    rows, plain = [], np.zeros((120, 30))
    for n in range(120):
        held = np.arange(30) if n % 5 == 0 else np.flatnonzero(draw.random(30) < (0 if n % 7 == 0 else 0.4))
        plain[n, held] = draw.normal(size=len(held))
        rows.append((components.DENSE, None, plain[n].tolist()) if n % 5 == 0 else (components.SPARSE, held.tolist(), plain[n, held].tolist()))
    monkeypatch.setattr(components, "PIECE", piece)
    block = draw.normal(size=(30, 4))
    product, squares = silhouettes.products(_vectors(rows, 30), block)
    assert np.allclose(product, plain @ block) and np.allclose(squares, (plain * plain).sum(1))


def test_a_batch_of_long_texts_is_multiplied_in_bounded_memory():
    """10,000 rows of 100 words against the centres and means of k 2 to 5: entries times columns is 224 MB."""
    slots = np.tile(np.arange(100, dtype=np.int32), 10_000)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(0, 1_000_001, 100), pa.int32()), pa.array(values))
    column = pa.StructArray.from_arrays(
        [pa.array(np.zeros(10_000, np.int8)), pa.array(np.full(10_000, 100, np.int32)), lists(slots), lists(np.ones(1_000_000))],
        names=["type", "size", "indices", "values"],
    )
    tracemalloc.start()
    try:
        product, squares = silhouettes.products(column, np.ones((100, 28)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (product == 100).all() and (squares == 100).all()
    assert most < 100e6
