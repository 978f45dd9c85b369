"""Silhouettes of k-means for many k at once: all k are fitted on one weighted coreset and judged on all rows together.

The coreset draws rows by half their share of the rows and half their share of the squared distances to the mean, and
weighs each by one over its chance; with `size` rows or less it is the table itself. All rows are read twice, whatever
the number of k: once for the sums of each cluster, once for each row's mean squared distances, which follow from them.
"""

import sys
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.operators.components import times
from ticketscope.operators.memory import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed package

CORESET_ROWS = 10_000
CORESET_PARTS = 4


def products(column: pa.StructArray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row times the block, and every row's squared length."""
    out, squares = np.zeros((len(column), block.shape[1])), np.zeros(len(column))
    kinds = np.asarray(column.field("type"))
    for code in np.unique(kinds):
        at = np.flatnonzero(kinds == code)
        some = column.filter(pa.array(kinds == code))
        filled = at[some.field("values").value_lengths().to_numpy(zero_copy_only=False) > 0]
        for product, lengths, _, values in times(some, block):
            out[filled] = product
            squares[filled] = np.add.reduceat(values * values, lengths.cumsum() - lengths)
    return out, squares


def coreset(vectors: DataFrame, size: int = CORESET_ROWS, key: str = "key", seed: int = 42) -> DataFrame:
    """About `size` rows with `features` and a `weight`; the rows' keys decide, so every run draws the same ones."""
    mean, count = vectors.agg(Summarizer.mean(F.col("features")).alias("mean"), F.count("features").alias("n")).first()
    if count <= size:
        return vectors.select("features", F.lit(1.0).alias("weight"))
    middle = mean.toArray()

    def distances(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            product, squares = products(batch.column(1), middle[:, None])
            far = np.maximum(squares - 2 * product[:, 0] + middle @ middle, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far)], names=["key", "far"])

    kind = vectors.schema[key].dataType.simpleString()
    far = vectors.select(F.col(key).alias("key"), F.unwrap_udt("features").alias("v")).mapInArrow(distances, f"key {kind}, far double")
    far = keep(far)
    whole = far.agg(F.sum("far")).first()[0] or 1.0
    chance = F.least(F.lit(1.0), size * (0.5 / count + 0.5 * F.col("far") / whole))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 40)) < chance * float(1 << 40)
    chosen = far.filter(drawn).select(F.col("key").alias("_key"), (1 / chance).alias("weight"))
    return vectors.join(chosen, F.col(key) == F.col("_key")).select("features", "weight")


def fitted(vectors: DataFrame, ks: range | list[int], size: int = CORESET_ROWS, key: str = "key", seed: int = 42,
           parallelism: int = 8) -> dict[int, Model]:
    """A k-means model for each k from one coreset, a few at a time."""
    rows = keep(coreset(vectors, size, key, seed).repartition(CORESET_PARTS))
    rows.count()

    def fit(k: int) -> Model:
        return KMeans(k=k, seed=seed, featuresCol="features", weightCol="weight", initMode="k-means||").fit(rows)

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            return dict(zip(ks, pool.map(inheritable_thread_target(vectors.sparkSession)(fit), ks)))
    finally:
        rows.unpersist()


def silhouettes(vectors: DataFrame, models: dict[int, list[np.ndarray]]) -> dict[int, float]:
    """Mean silhouette (squared Euclidean) of the assignment to the nearest of each model's centres, two passes for all.

    A row alone in its cluster has silhouette 0; a model with one cluster in use has none (NaN).
    """
    names = list(models)
    bounds = np.cumsum([0, *(len(models[n]) for n in names)])
    centres = np.vstack([np.vstack(models[n]) for n in names]).T
    lengths = (centres * centres).sum(0)
    size, width = centres.shape
    rows = vectors.select(F.unwrap_udt("features").alias("v")).filter("v is not null")

    def nearest(product: np.ndarray) -> list[np.ndarray]:
        far = lengths - 2 * product
        return [a + far[:, a:b].argmin(1) for a, b in zip(bounds, bounds[1:])]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares_of, counts = np.zeros((width, size)), np.zeros(width), np.zeros(width)
        for batch in batches:
            product, squares = products(batch.column(0), centres)
            picks = nearest(product)
            kinds = np.asarray(batch.column(0).field("type"))
            for code in np.unique(kinds):
                some = batch.column(0).filter(pa.array(kinds == code))
                at = np.flatnonzero(kinds == code)
                filled = at[some.field("values").value_lengths().to_numpy(zero_copy_only=False) > 0]
                for _, held, slots, values in times(some, np.zeros((size, 1))):
                    for pick in picks:
                        place = np.repeat(pick[filled], held) * size + slots
                        total += np.bincount(place, values, width * size).reshape(width, size)
            for pick in picks:
                squares_of += np.bincount(pick, squares, width)
                counts += np.bincount(pick, minlength=width)
        cluster, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(slot), pa.array(total[cluster, slot])], names=["cluster", "slot", "total"])
        extra = [(i, -1, v) for i, v in enumerate(counts)] + [(i, -2, v) for i, v in enumerate(squares_of)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*extra), (pa.int64(), pa.int64(), pa.float64()))], names=["cluster", "slot", "total"])

    found = rows.mapInArrow(sums, "cluster long, slot long, total double").groupBy("cluster", "slot").agg(F.sum("total").alias("total")).toPandas()  # a row per centre and slot
    total = np.zeros((width, size + 2))
    total[found["cluster"], found["slot"]] = found["total"]  # slots -1 and -2 are the last two columns
    counts, spread, total = total[:, -1], total[:, -2], total[:, :-2]
    used = np.maximum(counts, 1)
    means, spread = (total / used[:, None]).T, spread / used

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = np.zeros(len(names)), 0
        for batch in batches:
            product, squares = products(batch.column(0), np.hstack([centres, means]))
            far = squares[:, None] - 2 * product[:, width:] + spread
            n += len(squares)
            for i, pick in enumerate(nearest(product[:, :width])):
                a, b = bounds[i], bounds[i + 1]
                own, others = counts[pick], far[:, a:b].copy()
                inside = far[np.arange(len(pick)), pick] * own / np.maximum(own - 1, 1)
                others[:, counts[a:b] == 0] = np.inf
                others[np.arange(len(pick)), pick - a] = np.inf
                outside = others.min(1)
                larger = np.maximum(inside, outside)
                score = np.where((own > 1) & (larger > 0), (outside - inside) / np.where(larger > 0, larger, 1), 0.0)
                out[i] += np.nan if np.isinf(outside).any() else score.sum()
        yield pa.RecordBatch.from_arrays([pa.array([i for i in range(len(names))]), pa.array(out), pa.array([n] * len(names))], names=["model", "score", "n"])

    merged = rows.mapInArrow(scores, "model long, score double, n long").groupBy("model").agg((F.sum("score") / F.sum("n")).alias("score")).collect()
    return {names[r["model"]]: float(r["score"]) if r["score"] is not None else float("nan") for r in merged}
