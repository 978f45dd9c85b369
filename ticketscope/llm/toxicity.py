"""Toxicity: a linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio.

Texts are lower-cased, runs of white space become one space, and n-grams of 4 to 6 characters (a space at either end
counts) are hashed to 2^20 places. Among the labelled documents r = log(p / q) of a place compares the shares of toxic
and clean documents that hold it, smoothed by one document each. The places whose ratio is most certain (r by its
standard error) become features; a document's value is r * log(1 + count), and a logistic regression over these values
gives the weights. What tells a score is the text alone.

`Settings.max_rows` bounds the labelled rows that are learnt from: of more, a share of about that size is chosen by a
hash of the id. Up to that bound labels are broadcast, so texts are never shuffled. All documents are scored, whole.

A document counts as toxic if any of its labels says so; labels without id or mark and documents without id are not
learnt from, but scored. Null and empty texts have no n-grams and get the share that the model gives an empty text.
Repeated rows are scored alike and learnt once each. Without labels of both kinds every score is the smoothed share of
toxic ones. An empty table gives an empty result; columns other than those named do not matter.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.storage import stored

_STEP, _MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Settings:
    lengths: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    features: int = 1024
    smoothing: float = 1.0
    penalty: float = 1e-4
    max_iter: int = 100
    max_rows: int = 500_000  # labelled rows learnt from; the broadcast of labels is bounded by it
    chunk_chars: int = 1 << 20


@dataclass(frozen=True)
class Model:
    settings: Settings
    places: np.ndarray  # hashed places of the features
    ratios: np.ndarray
    weights: np.ndarray
    intercept: float


def normal(text: str | None) -> str:
    return " " + " ".join((text or "").lower().split()) + " "


def chunks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `limit` characters together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def grams(texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed place of every n-gram of neighbouring texts, and the text it is from; texts are in order within a length."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner, ends = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes)
    places, owners, rolling = [], [], codes
    for n in range(2, max(settings.lengths) + 1):
        rolling = rolling[:-1] * _STEP + codes[n - 1 :]
        if n in settings.lengths and len(rolling):
            inside = np.arange(len(rolling)) + n <= ends[: len(rolling)]
            hashed = (rolling[inside] + np.uint64(n)) * _MIX
            hashed ^= hashed >> np.uint64(29)
            places.append((hashed * _LAST) >> np.uint64(64 - settings.bits))
            owners.append(owner[: len(rolling)][inside])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


def marked(docs: DataFrame, labels: DataFrame, text: str, settings: Settings) -> DataFrame:
    """(text, label) of the documents to learn from; labels are one row per id and at most about `max_rows`."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    one = stored(one, "toxicity-labels")
    found = one.count()
    if found > settings.max_rows:
        one = one.filter(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30)) < int((1 << 30) * settings.max_rows / found))
    return docs.select("doc_id", docs[text].cast("string").alias("text")).join(F.broadcast(one), "doc_id").select("text", "label")


def counted(rows: DataFrame, settings: Settings) -> DataFrame:
    """Toxic and clean documents that hold each place; place -1 counts all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((2, 1 << settings.bits), np.int64), [0, 0]
        stamp = np.zeros(1 << settings.bits, np.int32)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places, _ = grams([normal(text)], settings)
                order = np.arange(len(places), dtype=np.int32)
                stamp[places] = order  # one of the places that are alike keeps its number
                once = places[stamp[places] == order]
                counts[int(label != 0), once] += 1
                totals[label != 0] += 1
        if sum(totals):
            held = np.flatnonzero(counts.any(0))
            for first in range(0, len(held), 1 << 16):
                some = held[first : first + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])], names=["place", "toxic", "clean"])
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in (-1, totals[1], totals[0])], names=["place", "toxic", "clean"])

    found = rows.mapInArrow(run, "place long, toxic long, clean long")
    return found.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def values(texts: list[str], table: np.ndarray, ratios: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of every feature that a text holds."""
    places, owner = grams(texts, settings)
    feature = table[places]
    held = np.flatnonzero(feature >= 0)
    which, times = np.unique(owner[held] * len(ratios) + feature[held], return_counts=True)
    feature = which % max(1, len(ratios))
    return which // max(1, len(ratios)), feature, ratios[feature] * np.log1p(times)


def _table(places: np.ndarray, settings: Settings) -> np.ndarray:
    table = np.full(1 << settings.bits, -1, np.int32)
    table[places] = np.arange(len(places))
    return table


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", settings: Settings = Settings()) -> Model:
    """Learns ratios and weights from the labelled ones among the documents."""
    rows = marked(docs, labels, text, settings)
    counts = stored(counted(rows, settings), "toxicity-counts")
    total = counts.filter("place = -1").collect()
    toxic, clean = (total[0]["toxic"], total[0]["clean"]) if total else (0, 0)
    if not toxic or not clean:
        nothing = np.zeros(0, np.int64)
        return Model(settings, nothing, np.zeros(0), np.zeros(0), float(np.log((toxic + 1) / (clean + 1))))
    a = settings.smoothing
    p, q = ((F.col(c) + a) / (n + 2 * a) for c, n in (("toxic", toxic), ("clean", clean)))
    ratio = F.log(p / q)
    error = F.sqrt((1 - p) / (p * (toxic + 2 * a)) + (1 - q) / (q * (clean + 2 * a)))
    best = counts.filter("place >= 0").select("place", ratio.alias("ratio"), F.abs(ratio / error).alias("sure"))
    best = best.orderBy(F.desc("sure"), "place").limit(settings.features).collect()  # as many rows as features
    places, ratios = np.array([r["place"] for r in best], np.int64), np.array([r["ratio"] for r in best])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(places, settings)
        for batch in batches:
            texts = [normal(t) for t in batch.column(0).to_pylist()]
            for first, last in chunks(texts, settings.chunk_chars):
                owner, feature, value = values(texts[first:last], table, ratios, settings)
                edges = pa.array(np.searchsorted(owner, np.arange(last - first + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(v)) for v in (feature.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, last - first).cast(pa.float64()), *lists], names=["label", "feature", "value"])

    size = len(places)
    sparse = F.udf(lambda i, v: Vectors.sparse(size, i, v), VectorUDT())
    held = stored(rows.mapInArrow(run, "label double, feature array<int>, value array<double>"), "toxicity-values")
    learner = LogisticRegression(regParam=settings.penalty, maxIter=settings.max_iter, standardization=False)
    model = learner.fit(held.select("label", sparse("feature", "value").alias("features")))
    return Model(settings, places, ratios, model.coefficients.toArray(), float(model.intercept))


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All other columns of the documents than the text, and the score of each, 0 to 1."""
    others = [c for c in docs.columns if c not in (text, into)]
    settings = model.settings

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model.places, settings)
        for batch in batches:
            texts = [normal(t) for t in batch.column(len(others)).to_pylist()]
            sums = np.full(len(texts), model.intercept)
            for first, last in chunks(texts, settings.chunk_chars):
                owner, feature, value = values(texts[first:last], table, model.ratios, settings)
                sums[first:last] += np.bincount(owner, value * model.weights[feature], last - first)
            score = pa.array(1 / (1 + np.exp(-np.clip(sums, -700, 700))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], score], names=[*others, into])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    return docs.select(*(docs[c] for c in others), docs[text].cast("string").alias("__text")).mapInArrow(run, f"{shape}{', ' * bool(others)}`{into}` double")


def report(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), least: float = 0.7) -> DataFrame:
    """Every document's score, learnt from two thirds of the labelled ones by the checksum of the id; `held_out` are the rest."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = docs.select("doc_id", "text")
    model = fitted(docs, labels.filter(~held_out), settings=settings)
    found = scored(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
