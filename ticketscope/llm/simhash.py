"""SimHash near-duplicates through an inverted index over positional bytes.

The fingerprint of a text has 64 bits, each set when more than half of its three-word shingles' hashes have it. Two
fingerprints that differ in at most three bits share at least five of their eight positional bytes. Lists of single
bytes would hold a 256th of all documents each, so the index keeps lists of four positional bytes: the 14 chosen
quadruples are such that any five bytes contain one of them. Pairs that meet in a list tally their shared bytes, those
with five or more are verified bit by bit. Equal fingerprints are one entry, so copies never pair up.

Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Texts with one or
two words have one shingle, all their words. Repeated rows share a fingerprint. Null ids never become a component id
unless all ids of the component are null. An empty table gives an empty result.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.batches import mapped
from ticketscope.llm.components import components
from ticketscope.llm.storage import scratch, small, stored

SEED = 42
MAX_BITS = 3
MIN_SHARED = 5
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = max(0, len(words) - width) + 1
    spans = list(zip(starts[:last].tolist(), ends[len(ends) - last :].tolist()))
    counts = np.zeros(64, np.int64)
    for i in range(0, last, _BLOCK):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans[i : i + _BLOCK]]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last).view(">i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint as a long; a column of that name is replaced."""
    others = [c for c in docs.columns if c != into]
    at = others.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(x.as_py()) for x in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*others, into])

    kept = docs.select(*(docs[c] for c in others))
    shape = kept.withColumn(into, F.lit(0).cast("long")).schema
    return mapped(kept, run, shape)


def quadruples() -> list[tuple[int, ...]]:
    """Fourteen sets of four of the eight bytes, one of them in any set of five.

    Either half of the bytes is one set. The four bytes of a half split into pairs in three ways; a set joins two
    pairs from the same way of both halves. Five bytes hold a whole half, or three of one half and a pair of the other,
    and three bytes contain a pair of every way.
    """
    ways = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    across = [(*low, *(b + 4 for b in high)) for way in ways for low in way for high in way]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *across]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shared_bytes(difference: Column) -> Column:
    """How many of the eight bytes of an exclusive or are zero."""
    zero = [F.when(F.shiftrightunsigned(difference, 8 * k).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for k in range(8)]
    total = zero[0]
    for z in zero[1:]:
        total = total + z
    return total


def links(prints: DataFrame, max_bits: int = MAX_BITS, min_shared: int = MIN_SHARED) -> DataFrame:
    """(u, v) of all different fingerprints within `max_bits` of each other; `prints` holds each `fp` once."""
    lists = F.array(*(
        F.struct(F.lit(n).alias("quad"), F.col("fp").bitwiseAND(F.lit(_signed(sum(255 << (8 * b) for b in quad)))).alias("bytes"))
        for n, quad in enumerate(quadruples())
    ))
    index = prints.select("fp", F.inline(lists))
    a, b = index.alias("a"), index.alias("b")
    difference = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    met = a.join(b, (
        (F.col("a.quad") == F.col("b.quad")) & (F.col("a.bytes") == F.col("b.bytes")) & (F.col("a.fp") < F.col("b.fp"))
        & (shared_bytes(difference) >= min_shared) & (F.bit_count(difference) <= max_bits)
    ))
    return met.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component) for every fingerprint that has a link."""
    found = components(links(prints))
    return found.select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    marked = with_fingerprint(docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))).drop("text")
    marked = stored(marked.withColumnRenamed("fingerprint", "fp"), "prints")
    prints = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    joined = prints.join(classes(prints.select("fp")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = joined.join(ids, "component").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id, null ids last, then by digest; all its columns.

    Rows are known by the digest of all their columns, so texts stay where they are: rows whose digest is not kept are
    dropped, and of equal rows that are kept one is taken.
    """
    others = F.to_json(F.struct(*(docs[c] for c in docs.columns if c != text), docs[text].isNull().alias("__null")))
    key = F.unhex(F.md5(F.concat(F.md5(F.coalesce(docs[text].cast("string"), F.lit(""))), others)))
    keyed = docs.withColumn("__key", key)
    with scratch(docs.sparkSession):
        slim = keyed.select(F.col("__key").alias("key"), docs[doc_id].alias("id"), docs[text].cast("string").alias("text"))
        rows = stored(with_fingerprint(slim, "text", "fp").drop("text"), "prints")
        prints = stored(rows.select("fp").distinct(), "distinct-prints")
        rank = F.struct(F.col("id").isNull().alias("null"), "id", "key")
        firsts = rows.groupBy("fp").agg(F.min(rank).alias("rank")).join(classes(prints), "fp", "left")
        kept = stored(firsts.groupBy(F.coalesce("component", "fp")).agg(F.min("rank").alias("rank")).select("rank.key"), "kept")
        keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        lost = keys.join(kept, "key", "left_anti").select("key", F.lit(False).alias("repeated"))
        repeated = keys.filter("rows > 1").join(kept, "key", "left_semi").select("key", F.lit(True).alias("repeated"))
        odd = stored(lost.unionByName(repeated).withColumnRenamed("key", "__key"), "lost-or-repeated", result=True)
    single = keyed.join(small(odd.select("__key")), "__key", "left_anti")
    several = keyed.join(small(odd.filter("repeated").select("__key")), "__key", "left_semi").dropDuplicates(["__key"])
    return single.unionByName(several).select(*docs.columns)
