"""Removal of long repeated passages: every byte inside a string of `LENGTH` bytes that also starts elsewhere.

Which strings repeat is found without sorting all suffixes (README says why and with which figures):

1. Anchors. In every window of `LENGTH` bytes the smallest hash of `GRAM` consecutive bytes, leftmost on ties, marks an
   anchor. It depends on the window's bytes alone, so equal windows have equal anchors in equal places. Neighbouring
   windows with one anchor form a segment, whose bytes and anchor place again depend on its own bytes and the two next
   to it; inside a passage that occurs twice all segments but the first and last are therefore equal. A first pass
   counts anchors, a second one emits the segments of those that occur twice; a bitmap of fixed size spares most others.
2. Equal segments. A segment whose digest occurs twice lies wholly in repeated windows.
3. Borders. Where an anchor occurs twice in unequal segments, one copy of each is cut into blocks of `BLOCK` windows,
   counted from the anchor. Blocks whose common bytes occur in no other segment are done; the windows of the others are
   compared one by one.

Digests of bytes have 128 bits. All counts are sums over hashed keys, so neither a passage that half of the documents
share nor a large group of copies gathers in one task. Rows are known by the digest of their bytes, so null and repeated
ids do no harm. Null and empty texts have no bytes and lose none; so do texts shorter than `LENGTH`, and copies of a
longer one lose all. An empty table gives an empty result. Further columns are not read, or pass through.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.bitmap import bitmap, has
from ticketscope.llm.storage import scratch, small, stored
from ticketscope.llm.words import mixed, powers, prefix_hashes, text_bytes

LENGTH = 400
GRAM = 200
BLOCK = 32
BITMAP_BITS = 27
HOT_SEGMENTS = 10_000  # segments with one digest from which it is sent to them
_PLACE_BITS = 22


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbours, from running minima inside blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    prefix = prefix_hashes(data)
    _, down = powers(len(data))
    return mixed((prefix[gram:] - prefix[:-gram]) * down[: len(data) - gram + 1])


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, place and hash of the anchor of each segment of one text; none in short texts."""
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64)
    hashes = gram_hashes(data, gram)
    firsts, places, block = [], [], 1 << (_PLACE_BITS - 1)
    for at in range(0, len(data) - length + 1, block):
        part = hashes[at : at + block + length - gram]
        ranked = (part >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(part), dtype=np.uint64)
        least = sliding_minimum(ranked, length - gram + 1)
        place = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + at
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        firsts.append(new + at), places.append(place[new])
    first, place = np.concatenate(firsts), np.concatenate(places)
    once = np.append(True, place[1:] != place[:-1])
    first, place = first[once], place[once]
    last = np.append(first[1:] - 1, len(data) - length)
    return first, last, place, hashes[place]


def _key(docs: DataFrame, text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(docs[text].cast("string"), F.lit(""))))


def anchor_digests(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, digest) of every segment of every text; this digest has 64 bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            anchors, digests = [np.zeros(0, np.int64)], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                first, last, _, anchor = segments(data[a:b], length, gram)
                raw = data[a:b].tobytes()
                anchors.append(anchor.view(np.int64))
                digests.extend(xxhash.xxh3_64_intdigest(raw[i : j + length]) for i, j in zip(first.tolist(), last.tolist()))
            columns = [pa.array(np.concatenate(anchors)), pa.array(np.array(digests, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "digest"])

    return texts.select("text").mapInArrow(run, "anchor long, digest long")


def repeated_segments(texts: DataFrame, held: np.ndarray, bits: int, length: int, gram: int) -> DataFrame:
    """(key, first, last, place, anchor, digest) of the segments whose anchor has its bit set."""
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            keys: list[bytes] = []
            digests: list[bytes] = []
            numbers: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for key, a, b in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:]):
                found = segments(data[a:b], length, gram)
                there = has(known, found[3], bits)
                first, last, place, anchor = (x[there] for x in found)
                raw = data[a:b].tobytes()
                keys.extend([key] * len(first))
                digests.extend(xxhash.xxh3_128_digest(raw[i : j + length]) for i, j in zip(first.tolist(), last.tolist()))
                for held_numbers, x in zip(numbers, (first, last, place, anchor.view(np.int64))):
                    held_numbers.append(x)
            columns = [pa.array(np.concatenate(x).astype(t)) for x, t in zip(numbers, (np.int32, np.int32, np.int32, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *columns, pa.array(digests, pa.binary())], names=["key", "first", "last", "place", "anchor", "digest"])

    return texts.select("key", "text").mapInArrow(run, "key binary, first int, last int, place int, anchor long, digest binary")


def border_bodies(sources: DataFrame, length: int) -> DataFrame:
    """(id, lead, body): the bytes of the listed segments, with how far their anchor is from the first byte."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                rows += [(s["id"], s["place"] - s["first"], raw[s["first"] : s["last"] + length]) for s in listed]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lead", "body"])

    return sources.mapInArrow(run, "id long, lead int, body binary")


def block_cores(bodies: DataFrame, length: int, block: int) -> DataFrame:
    """(id, block, core): for each block of windows, counted back from the anchor, the digest of the bytes all share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, lead, body in zip(*(c.to_pylist() for c in batch.columns)):
                nearest = max(0, lead - (len(body) - length))
                for b in range(nearest // block, lead // block + 1):
                    at = lead - b * block
                    rows.append((i, b, xxhash.xxh3_128_digest(body[at : at - block + 1 + length], seed=b)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "block", "core"])

    return bodies.mapInArrow(run, "id long, block int, core binary")


def block_windows(bodies: DataFrame, length: int, block: int) -> DataFrame:
    """(id, offset, window): digest and place of every window of the blocks listed in (id, lead, body, blocks)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, lead, body, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                for b in blocks:
                    for at in range(max(0, lead - b * block - block + 1), min(lead - b * block, len(body) - length) + 1):
                        rows.append((i, at, xxhash.xxh3_128_digest(body[at : at + length])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "offset", "window"])

    return bodies.mapInArrow(run, "id long, offset int, window binary")


def spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, bits: int = BITMAP_BITS) -> DataFrame:
    """(key, windows): for each text that loses bytes, the first and last of its repeated windows, run by run.

    A text that several rows hold has the one run of all its windows.
    """
    with scratch(docs.sparkSession):
        texts = docs.select(_key(docs, text).alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
        long_ones = texts.filter(F.octet_length("text") >= length)
        copied = long_ones.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.octet_length("text")).alias("bytes")).filter("n > 1")
        copied = stored(copied.drop("n"), "copied")
        # An anchor seen once has no repeated window; where all its segments are equal, all of them repeat.
        seen = anchor_digests(long_ones, length, gram).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
        repeated = stored(seen.filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "repeated-anchors")
        found = repeated_segments(long_ones, bitmap(repeated.select("anchor"), bits), bits, length, gram)
        known = stored(found.join(repeated, "anchor").drop("anchor"), "repeated-segments")
        kinds = known.filter("mixed").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "last", "place")).alias("one"))
        kinds = stored(kinds.select("digest", "n", (F.col("n") > 1).alias("doubled"), "one.*", F.monotonically_increasing_id().alias("id")), "segment-kinds")
        # Of unequal segments with one anchor, one copy each is compared in blocks, then window by window.
        listed = stored(kinds.groupBy("key").agg(F.collect_list(F.struct("id", "first", "last", "place")).alias("listed")), "borders")
        near = texts.join(small(listed.select("key")), "key", "left_semi").join(listed, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("listed").alias("listed"))
        bodies = stored(border_bodies(near.select("text", "listed"), length), "border-bodies")
        cores = stored(block_cores(bodies, length, block), "block-cores")
        shared = cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
        blocks = cores.join(shared, "core", "left_semi").groupBy("id").agg(F.collect_list("block").alias("blocks"))
        windows = stored(block_windows(bodies.join(blocks, "id").select("id", "lead", "body", "blocks"), length, block), "border-windows")
        again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
        single = kinds.filter("not doubled").select("id", "key", F.col("first").alias("base"))
        met = windows.join(again, "window", "left_semi").groupBy("id").agg(F.collect_list("offset").alias("offsets"))
        place = lambda o: F.struct((F.col("base") + o).alias("first"), (F.col("base") + o).alias("last"))
        partial = met.join(single, "id").select("key", F.inline(F.transform("offsets", place)))
        # Segments that very many texts hold meet their digest where they are; only the others are dealt by digest.
        many = small(kinds.filter(F.col("doubled") & (F.col("n") >= HOT_SEGMENTS)).select("digest"))
        few = small(kinds.filter(F.col("doubled") & (F.col("n") < HOT_SEGMENTS)).select("digest"))
        doubled = known.join(many, "digest", "left_semi").unionByName(known.join(many, "digest", "left_anti").join(few, "digest", "left_semi")).select("key", "first", "last")
        whole = known.filter("not mixed").select("key", "first", "last").unionByName(doubled).join(copied, "key", "left_anti")
        runs = whole.unionByName(partial.join(copied, "key", "left_anti")).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("windows"))
        all_of = F.array(F.struct(F.lit(0).alias("first"), (F.col("bytes") - length).cast("int").alias("last")))
        return stored(runs.unionByName(copied.select("key", all_of.alias("windows"))), "removed-windows", result=True)


def _merged(windows: list[dict], length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for w in sorted(windows, key=lambda w: w["first"]):
        a, b = w["first"], w["last"] + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, **settings) -> DataFrame:
    """All columns and a struct `repeats`: n_bytes, n_removed, spans (from, to) and the bytes that remain."""
    others = [c for c in docs.columns if c != "repeats"]
    at = others.index(text)
    lost = spans(docs, text, length, gram, **settings).withColumnRenamed("key", "__key")
    keyed = docs.select(*others, _key(docs, text).alias("__key"))
    keys = small(lost.select("__key"))
    # Only texts that lose bytes are shuffled to meet their windows.
    touched = keyed.join(keys, "__key", "left_semi").join(lost, "__key").select(*others, F.col("windows").alias("__windows"))
    untouched = keyed.join(keys, "__key", "left_anti").select(*others, F.lit(None).cast(lost.schema["windows"].dataType).alias("__windows"))
    joined = touched.unionByName(untouched)
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("rest", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, windows in zip(batch.column(at), batch.column(len(others))):
                raw = (body.as_py() or "").encode()
                cut = _merged(windows.as_py() or [], length)
                edges = [0, *(x for pair in cut for x in pair), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append({"n_bytes": len(raw), "n_removed": len(raw) - len(rest), "spans": [{"from": a, "to": b} for a, b in cut], "rest": rest})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=[*others, "repeats"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    return joined.mapInArrow(run, shape + ", repeats struct<n_bytes: bigint, n_removed: bigint, spans: array<struct<from: bigint, to: bigint>>, rest: binary>")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per document the numbers of bytes, removed bytes and spans, and the SHA-256 of what remains."""
    done = removed(docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text")), "text", **settings)
    return done.select(
        "doc_id", "repeats.n_bytes", "repeats.n_removed", F.size("repeats.spans").cast("long").alias("n_spans"), F.sha2("repeats.rest", 256).alias("kept_sha256")
    )
