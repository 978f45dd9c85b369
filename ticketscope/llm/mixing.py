"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target T and size S should appear T / S times. The whole part of that is certain; the
rest, below one, is a probability. Two open sides trade probability at random, in inverse proportion to their sizes,
until one of the two is decided, so the expected words of the source never change and each document keeps its chance.
Documents are dealt to leaves of bounded size. There they trade in pairs, largest first: the open document meets the
next smaller one. The one left open goes up the tree, where up to `FAN` of them meet and trade likewise, level by level,
until one is left in each source: it is taken with the probability it still has. So every document keeps its chance, the
expected words of a source are its target, and a source misses it by less than one document.

Weights are reshared until no target is above `max_repeats` times its source's size.

Rows with equal id, source and size and equal words are one unit: each gets the same number of copies. Null is a source
and an id like any other. Documents without words are taken as often as the whole part says and carry no words, so
they never trade. A source without any words has target 0. An empty table gives an empty result. All columns of the
input are kept; those named like the added ones (`size`, `source_size`, `target`, `copies`, `taken`) are replaced.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.storage import scratch, small, stored
from ticketscope.llm.words import chunks, text_bytes, word_bounds

LEAF_ROWS = 2000
FAN = 64
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: str | Column) -> Column:
    """Number of words parted by ASCII white space; null has none. One pass over the text, without a copy of it."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and the number of words of each text as `size`: narrow rows for mixing without the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(len(keep)))
            sizes = np.zeros(batch.num_rows, np.int64)
            for first, last in chunks(bounds):
                edges = bounds[first : last + 1] - bounds[first]
                starts, _ = word_bounds(data[bounds[first] : bounds[last]], edges)
                sizes[first:last] = np.diff(np.searchsorted(starts, edges))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes)], names=[*keep, "size"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, docs[text].cast("string").alias("__text")).mapInArrow(run, f"{shape}, size long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """(source, weight): the weights in turn over the sources by code point, null last."""
    ordered = sources.select("source").sort(F.col("source").isNull(), "source")
    schema = ordered.withColumn("weight", F.lit(1.0)).schema
    cycle = [float(w) for w in weights]
    return ordered.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], cycle[x[1] % len(cycle)])), schema)


def targets(sources: DataFrame, weights: DataFrame, max_repeats: float) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above `max_repeats` times its source."""
    joined = sources.join(weights, sources["source"].eqNullSafe(weights["source"]), "left").select(
        sources["source"], "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )
    known, cap = stored(joined, "sources"), F.col("source_size") * F.lit(float(max_repeats))
    full, rate = -1, 0.0
    while True:
        over = (F.lit(rate) * F.col("weight") >= cap) if full >= 0 else F.lit(False)
        row = known.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count_if(over).alias("full"),
        ).first()
        if row["full"] == full or row["weight"] == 0:
            break
        full, rate = row["full"], (row["words"] - row["taken"]) / row["weight"]
    return known.select("source", "source_size", F.least(F.lit(rate) * F.col("weight"), cap).alias("target"))


def trade(p: float, q: float, ratio: float, draw: float) -> tuple[float, float]:
    """Moves mass between two open sides until one is decided; `ratio` is the first one's size by the second one's."""
    up = min(1.0 - p, q / ratio)  # most that the first can gain
    down = min(p, (1.0 - q) / ratio)  # most that it can give
    if draw * (up + down) < down:  # gain, with the chance that leaves both expectations as they are
        return (1.0, q - ratio * up) if up == 1.0 - p else (p + up, 0.0)
    return (0.0, q + ratio * down) if down == p else (p - down, 1.0)


def settle_pairs(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Decides documents in pairs, the open one against the next smaller; (chances, place left open)."""
    out, a = chances.copy(), 0
    for i in range(1, len(sizes)):
        out[a], out[i] = np.clip(trade(out[a], out[i], sizes[a] / sizes[i], draws[i]), 0.0, 1.0)
        if out[a] in (0.0, 1.0):
            a = i
    return out, a


def _node(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "unit"], ascending=[False, True]).reset_index(drop=True)
        draws = np.random.default_rng(int(rows["seed"].iloc[0]) & 0x7FFFFFFFFFFFFFFF).random(len(rows) + 1)
        found, at = settle_pairs(rows["size"].to_numpy(), rows["chance"].to_numpy(), draws)
        undecided = not last and 0.0 < found[at] < 1.0
        if not undecided:
            found[at] = float(draws[-1] < found[at])
        return rows.assign(chance=found, open=np.arange(len(rows)) == at if undecided else False)

    return run


def rounded(units: DataFrame) -> DataFrame:
    """(unit, extra): which of the units (unit, source_key, leaves, size, chance) get one copy more."""
    spark = units.sparkSession
    n_leaves = F.col("leaves")
    rows = units.select("unit", "source_key", "size", "chance", F.pmod(F.xxhash64("unit", F.lit("leaf")), n_leaves).alias("node"))
    width = units.agg(F.max("leaves")).first()[0] or 1
    decided, level = None, 0
    while True:
        last = width <= 1
        keyed = rows.withColumn("seed", F.xxhash64("source_key", "node", F.lit(level)))
        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema) + ", open boolean"
        done = stored(keyed.groupBy("source_key", "node").applyInPandas(_node(last), shape), f"mix-level-{level}")
        closed = done.filter(~F.col("open")).select("unit", F.col("chance").alias("extra"))
        decided = closed if decided is None else decided.unionByName(closed)
        if last:
            return decided
        width, level = -(-width // FAN), level + 1
        node = F.floor(F.col("node") / FAN) if width > 1 else F.lit(0).cast("long")
        rows = done.filter("open").select("unit", "source_key", "size", "chance", node.cast("long").alias("node"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_repeats: float = 3.0, doc_id: str = "doc_id", source: str = "source", text: str | None = "text", size: str | None = None, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Documents with their size, source_size, target, copies and taken words.

    `weights` holds (source, weight); without it the sources weigh 1, 2, 3 in turn by code point, null last. `size`
    names a column that holds the sizes already.
    """
    words = docs[size].cast("long") if size else word_count(docs[text])
    sized = docs.withColumn("size", F.coalesce(words, F.lit(0).cast("long")))
    body = F.xxhash64(sized[text]) if text else F.lit(0).cast("long")
    # Two hashes with different seeds make the key of a unit; equal rows have equal keys.
    parts = [F.hash(sized[doc_id], sized[source], "size"), F.xxhash64(sized[doc_id].isNull(), sized[doc_id], sized[source].isNull(), sized[source], "size", body)]
    keyed = sized.withColumn("__unit", F.concat_ws(":", *(p.cast("string") for p in parts))).withColumn("__key", F.xxhash64(sized[source].isNull(), sized[source]))
    if set(keyed.columns) <= {doc_id, source, "size", "__unit", "__key"}:
        keyed = stored(keyed, "mix-rows")  # narrow rows: whatever their sizes were counted from is read once
    units = stored(
        keyed.groupBy(F.col("__unit").alias("unit"), F.col("__key").alias("source_key"), F.col(source).alias("source"), "size").agg(F.count(F.lit(1)).alias("rows")),
        "mix-units",
    )
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count_if(F.col("size") > 0).alias("units"))
    sources = stored(sources, "mix-sources")
    aims = stored(targets(sources.select("source", "source_size"), weights if weights is not None else cycled_weights(sources), max_repeats), "mix-targets")
    aims = aims.join(sources.select(F.col("source").alias("__source"), "units"), aims["source"].eqNullSafe(F.col("__source"))).drop("__source")
    aims = aims.withColumnRenamed("source", "__source").withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("units") / leaf_rows)).cast("long")
    chance = F.col("rate") - F.floor("rate")
    open_units = (
        units.join(aims, units["source"].eqNullSafe(aims["__source"]))
        .filter((F.col("size") > 0) & (chance > 0))
        .select("unit", "source_key", leaves.alias("leaves"), (F.col("size") * F.col("rows")).cast("double").alias("size"), chance.alias("chance"))
    )
    with scratch(docs.sparkSession):
        extra = stored(rounded(open_units).filter("extra > 0").select(F.col("unit").alias("__unit"), F.col("extra").alias("__extra")), "mix-extra", result=True)
    rates = aims.select("__source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"))
    plain = keyed.drop(*(c for c in ADDED if c != "size"))
    joined = plain.join(rates, plain[source].eqNullSafe(rates["__source"]), "left").join(small(extra), "__unit", "left")
    copies = (F.floor("__rate") + F.coalesce("__extra", F.lit(0.0))).cast("long")
    kept = [c for c in docs.columns if c not in ADDED]
    added = [F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken")]
    return joined.select(*kept, "size", *added)
