"""Near-duplicate lines: an exact set-similarity join with prefix, positional and length filters.

A line is the set of its lower-cased words. It is removed when an earlier line has a Jaccard similarity of at least
`Settings.threshold` with it; lines of fewer than `min_words` different words are left alone, by default only those
without words. Lines too short to be similar without being equal have no entries in the lists. Lines are in the order of
document id (nulls last; ids that are no integers by hash), line number, then digest. Earlier lines count whether or not
they are removed themselves. Equal sets are one entry at the place of the earliest, so copies never pair up: one pass over the
texts packs the lines by their digests and counts the words, and the copies of a line that a task holds at once leave it
as one. A line that repeats an earlier one goes whatever becomes of that one, so only first lines are looked up later.

Words are ordered by rarity (quantised counts of hashed words in a table of fixed size, ties by hash): of n words the
first n - ceil(t n) + 1 are looked up among the first n - ceil(2 t n / (1 + t)) + 1 of the shorter line. Pairs that meet
must fit in length, in the words left after the places where they meet, and in a 64-bit parity map of their words,
which bounds their difference from below. A line takes only its `candidates` earliest partners from a list at first,
which settles groups of variants without pairing them all; a line that these leave open, and that had more, takes all
of that list in a second round, which reads the stored lists that were cut short. Entries travel packed, by buckets of
words; a bucket of more than `list_entries` is cut into blocks of lines that meet in pairs of blocks, each pair in a task
of its own, so a word of a third of all lines fills many tasks. Pairs are verified on the full sets of words, so every decision is exact
up to equal hashes: 64 bits for a word, 128 bits (`id` and `twin`, two independent sums) for a line's set. Lists and
pairs know lines by the `id` alone; two lines that share it without sharing the twin are never taken for copies.

Rows with equal id and text are one document. Null and empty texts have no lines to remove. An empty table gives an
empty result. Columns besides id and text pass through.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.batches import mapped
from ticketscope.llm.bitmap import bitmap, has
from ticketscope.llm.storage import scratch, small, stored
from ticketscope.llm.words import chunks, mixed, prefix_hashes, range_hashes, text_bytes, word_bounds



@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    min_words: int = 1
    table_bits: int = 24
    candidates: int = 8
    bitmap_bits: int = 27
    list_entries: int = 1 << 21


def needed(n: int | np.ndarray, threshold: float) -> tuple:
    """Lengths of the probing and the indexing prefix of a set of n words."""
    n = np.asarray(n)
    overlap = np.ceil(n * threshold - 1e-9)
    equal = np.ceil(2 * n * threshold / (1 + threshold) - 1e-9)
    return (n - overlap + 1).astype(np.int64), (n - equal + 1).astype(np.int64)


_MAP_BITS = 2
PAIR_MAPS = 1 << _MAP_BITS
_MAPS = [f"m{k}" for k in range(PAIR_MAPS)]
_WORD_BITS = np.uint64(20)  # the lowest bits of a word's hash give way to the number of its line, for sorting only
_TWIN = np.uint64(0xC2B2AE3D27D4EB4F)
_CACHED = 1 << 16  # bytes of text that are hashed at once, so that what is made of them stays in the processor's cache
_WINDOWED = 64  # words of more bytes are hashed byte by byte
_WINDOWS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_HELD_SLOTS = 1 << 20  # counts of words that a task gathers before it merges them
_LEVELS = 6  # levels of the rarity table for each doubling of a count
_FAN_IN = 64  # partial counts that are merged at once
_PAGE_BITS = 8  # of the rarity table
_CLASS_BITS = 10  # leading bits of a line's id by which its copies meet


def word_hashes(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts and where they begin."""
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in chunks(own, _CACHED):
        low = np.frombuffer(data[own[a] : own[b]].tobytes().lower() + bytes(8), np.uint8)
        begin, end = word_bounds(low[:-8], own[a : b + 1] - own[a])
        hashes.append(hashed(low, begin, end)), starts.append(begin + own[a])
    return np.concatenate(hashes), np.concatenate(starts)


def hashed(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes at a time; eight bytes must follow the last range."""
    windows = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
    n = end - begin
    out = mixed((np.take(windows, begin) & _WINDOWS[np.minimum(n, 8)]) + n.astype(np.uint64) * _LENGTH)
    rest, done = np.flatnonzero((n > 8) & (n <= _WINDOWED)), 8
    while len(rest):
        out[rest] = mixed(out[rest] ^ (np.take(windows, begin[rest] + done) & _WINDOWS[np.minimum(n[rest] - done, 8)]))
        done += 8
        rest = rest[n[rest] > done]
    long = np.flatnonzero(n > _WINDOWED)
    if len(long):
        out[long] = range_hashes(prefix_hashes(low), begin[long], end[long])
    return out


def word_sets(hashes: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different words of each line, ordered by line, then hash; line numbers must not fall."""
    if not len(hashes):
        return hashes, lines
    new = np.append(True, lines[1:] != lines[:-1])
    dense, number = np.cumsum(new) - 1, lines[new]
    if dense[-1] < 1 << int(_WORD_BITS):
        both = (dense.astype(np.uint64) << np.uint64(44)) | (hashes >> _WORD_BITS)
        order = np.argsort(both)
        both, h, d = both[order], hashes[order], dense[order]
        same = both[1:] == both[:-1]
        if (same & (h[1:] != h[:-1])).any():  # different words of a line that agree in 44 bits
            order = np.lexsort((hashes, dense))
            h, d = hashes[order], dense[order]
    else:
        order = np.lexsort((hashes, dense))
        h, d = hashes[order], dense[order]
    once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
    return h[once], number[d[once]]


class WordCounts:
    """How often words occur, by the leading `bits` bits of their hashes. Only slots that occur are held."""

    def __init__(self, bits: int):
        self.bits, self.held, self.size = bits, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """Counts the words; once too many slots are held, yields what `pages` does and begins anew."""
        slots = np.sort((hashes >> np.uint64(64 - self.bits)).astype(np.uint32))
        first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])[: len(slots)])
        self._hold(slots[first], np.diff(np.append(first, len(slots))))
        if self.size >= _HELD_SLOTS:
            self._merge()
            if self.size >= _HELD_SLOTS // 2:
                yield from self.pages()

    def _hold(self, slots: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((slots.astype(np.uint64) << np.uint64(32)) | counts.astype(np.uint64))
        self.size += len(slots)

    def _merge(self) -> None:
        both = np.sort(np.concatenate(self.held))
        slots = both >> np.uint64(32)
        first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])[: len(slots)])
        counts = np.add.reduceat(both & np.uint64(0xFFFFFFFF), first) if len(first) else both
        self.held, self.size = [], 0
        self._hold(slots[first], counts)

    def pages(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Number, slots and counts of every page that is not empty; nothing is held afterwards."""
        if self.held:
            self._merge()
            slots, counts = (self.held[0] >> np.uint64(32)).astype(np.uint32), self.held[0] & np.uint64(0xFFFFFFFF)
            page_bits = self.bits - _PAGE_BITS
            edges = np.searchsorted(slots, np.arange(1 << _PAGE_BITS).astype(np.uint32) << np.uint32(page_bits))
            for page, (a, b) in enumerate(zip(edges, np.append(edges[1:], len(slots)))):
                if a < b:
                    yield page, (slots[a:b] & np.uint32((1 << page_bits) - 1)).tobytes(), counts[a:b].tobytes()
        self.held, self.size = [], 0


def rarity_table(texts: DataFrame, bits: int) -> np.ndarray:
    """Log-quantised counts of all words by the leading `bits` bits of their hashes: 2**bits bytes."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(bits)

        def pages() -> Iterator[tuple[int, bytes, bytes]]:
            for batch in batches:
                data, bounds = text_bytes(batch.column(0))
                for i, j in chunks(bounds):
                    yield from counts.add(word_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[0])
            yield from counts.pages()

        for row in pages():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], names=["page", "slots", "counts"])

    counted = mapped(texts.select("text"), count, "page int, slots binary, counts binary")
    return merged_rarity(stored(counted.withColumn("part", F.spark_partition_id()), "rarity"), bits)


def merged_rarity(parts: DataFrame, bits: int) -> np.ndarray:
    """The table of all stored (page, slots, counts, part), merged as a tree."""
    pages, page_bits = 1 << _PAGE_BITS, bits - _PAGE_BITS

    def summed(rows: pd.DataFrame) -> np.ndarray:
        total = np.zeros(1 << page_bits, np.uint64)
        for slots, counts in zip(rows["slots"], rows["counts"]):
            total[np.frombuffer(slots, np.uint32)] += np.frombuffer(counts, np.uint64)
        return total

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = summed(rows)
        at = np.flatnonzero(total)
        return pd.DataFrame({"page": rows["page"].iloc[:1], "part": rows["part"].iloc[:1] // _FAN_IN, "slots": [at.astype(np.uint32).tobytes()], "counts": [total[at].tobytes()]})

    def quantised(rows: pd.DataFrame) -> pd.DataFrame:
        levels = np.minimum(255, np.ceil(np.log2(summed(rows) + 1.0) * _LEVELS)).astype(np.uint8)
        return pd.DataFrame({"page": rows["page"].iloc[:1], "levels": [levels.tobytes()]})

    shape = "page int, slots binary, counts binary"
    while (parts.agg(F.max("part")).first()[0] or 0) >= _FAN_IN:
        parts = stored(parts.groupBy("page", F.floor(F.col("part") / _FAN_IN)).applyInPandas(merge, f"{shape}, part int"), "rarity")
    out = np.zeros((pages, 1 << page_bits), np.uint8)
    for row in parts.groupBy("page").applyInPandas(quantised, "page int, levels binary").toLocalIterator():
        out[row["page"]] = np.frombuffer(row["levels"], np.uint8)
    return out.ravel()


def _order(doc_id: Column, kind: str) -> Column:
    whole = doc_id.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(doc_id)
    return F.when(doc_id.isNull(), F.lit((1 << 63) - 1)).otherwise(whole)


def texts_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, order, text) of all rows; equal keys are equal documents."""
    order = _order(docs[doc_id], docs.schema[doc_id].dataType.simpleString())
    return docs.select(_key(docs, doc_id, text).alias("key"), order.alias("order"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def _key(docs: DataFrame, doc_id: str, text: str) -> Column:
    parts = [F.coalesce(docs[doc_id].cast("string"), F.lit("\0")), F.coalesce(docs[text].cast("string"), F.lit(""))]
    return F.unhex(F.md5(F.concat_ws("\n", *parts)))


def sets_of_lines(data: np.ndarray, own: np.ndarray, min_words: int, twins: bool = True) -> tuple[np.ndarray, ...]:
    """Words with their line, and for each line with enough words: its first word, size, text, number, digest and, if asked for, twin."""
    line_starts = np.union1d(own[:-1], np.flatnonzero(data == 0x0A) + 1)
    hashes, starts = word_hashes(data, own)
    words, at = word_sets(hashes, np.searchsorted(line_starts, starts, side="right") - 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    n = np.diff(np.append(first, len(at)))
    if min_words > 1:
        keep = np.repeat(n >= min_words, n)
        words, at = words[keep], at[keep]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        n = np.diff(np.append(first, len(at)))
    line = at[first]
    text = np.searchsorted(own, line_starts[line], side="right") - 1
    number = line - np.searchsorted(line_starts, own[text])
    digest = mixed(np.add.reduceat(words, first) + n.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    if not twins:
        return words, at, first, n, text, number, digest
    twin = mixed(np.add.reduceat(mixed(words ^ _TWIN), first) + n.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    return words, at, first, n, text, number, digest, twin


def plausible(pairs: DataFrame, kinds: DataFrame, threshold: float) -> DataFrame:
    """The pairs that the finer parity maps of both lines do not rule out."""
    side = lambda name: kinds.select(F.col("id").alias(name), F.struct("n", *_MAPS).alias(f"__{name}"))
    both = pairs.join(side("later"), "later").join(side("earlier"), "earlier")
    a, b = F.col("__later"), F.col("__earlier")
    apart = sum((F.bit_count(a[m].bitwiseXOR(b[m])) for m in _MAPS), F.lit(0))
    total = a["n"] + b["n"]
    return both.filter(total - apart >= 2 * F.ceil(total * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))).select(*pairs.columns)


_COLUMNS = {"word": np.uint64, "order": np.int64, "id": np.int64, "map": np.uint64, "line": np.int32, "n": np.int32, "place": np.int32}
_PACKED = ", ".join(f"{c} binary" for c in _COLUMNS)
_FLUSH = 1 << 17  # entries that a task gathers before it packs them
_CLASSES = 1 << 12  # finest parts, by id, into which a long list can be cut


def packed(columns: list[np.ndarray], edges: np.ndarray, kinds: dict = _COLUMNS) -> list[pa.Array]:
    """One binary value for each column and stretch of entries between neighbouring edges."""
    out = []
    for values, kind in zip(columns, kinds.values()):
        values = np.ascontiguousarray(values, kind)
        offsets = (edges * values.itemsize).astype(np.int32)
        out.append(pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
    return out


def unpacked(columns: list, first: int, last: int, kinds: dict = _COLUMNS) -> list[np.ndarray]:
    """The entries of rows `first` to `last`; columns are arrays, or what `text_bytes` makes of them once for many rows."""
    out = []
    for column, kind in zip(columns, kinds.values()):
        data, bounds = column if isinstance(column, tuple) else text_bytes(column)
        out.append(data[bounds[first] : bounds[last]].view(kind))
    return out


LINES, REPEAT, WORDS = range(3)
_LINES = {"order": np.int64, "number": np.int32, "high": np.uint64, "low": np.uint64, "id": np.int64, "twin": np.int64, "n": np.int32, **{m: np.int64 for m in _MAPS}}


def earliest(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are the first of their set of words, and which others repeat one from another place."""
    order, number, high, low, ids, twin = columns[:6]
    first, again = np.ones(len(ids), bool), np.zeros(len(ids), bool)
    by_id = np.argsort(ids)
    tied = ids[by_id][1:] == ids[by_id][:-1]
    among = by_id[np.append(tied, False) | np.append(False, tied)] if len(ids) else by_id
    if len(among):
        among = among[np.lexsort([c[among] for c in (low, high, number, order, twin, ids)])]
        new = np.append(True, (ids[among][1:] != ids[among][:-1]) | (twin[among][1:] != twin[among][:-1]))
        lead = among[new][np.cumsum(new) - 1]
        first[among[~new]] = False
        again[among] = (number[among] != number[lead]) | (high[among] != high[lead]) | (low[among] != low[lead])
    return first, again


def _halves(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes of each key as two numbers in the same order."""
    data, bounds = text_bytes(keys)
    both = data[bounds[0] : bounds[-1]].view(">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _keys(high: np.ndarray, low: np.ndarray) -> pa.Array:
    data = np.stack([high, low], axis=1).astype(">u8")
    offsets = np.arange(0, 16 * len(high) + 1, 16, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def parity_maps(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The maps of each line; a word falls to one by its leading bits, so the words of a map stand together in its line."""
    group = np.repeat(np.arange(len(first)) * PAIR_MAPS, n) + (words >> np.uint64(64 - _MAP_BITS)).astype(np.int64)
    new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    out = np.zeros(len(first) * PAIR_MAPS, np.uint64)
    out[group[new]] = np.bitwise_xor.reduceat(np.uint64(1) << ((words >> _WORD_BITS) & np.uint64(63)), new)
    return [out[k::PAIR_MAPS].view(np.int64) for k in range(PAIR_MAPS)]


def lines_of(texts: DataFrame, min_words: int, bits: int) -> DataFrame:
    """One pass over all texts. Rows of three kinds: packed lines, lines that repeat one of them, counts of words.

    Lines are packed by leading bits of `id`; id and twin are digests of a line's set of words. Of equal lines that a task
    holds at once only the first is packed, so a line that stands everywhere is one entry for each of these stretches.
    The maps are `PAIR_MAPS` parity maps of 64 bits, each of the words that fall to it: finer than the one in the lists.
    """
    types = {"class": pa.int32(), "key": pa.binary(), "line": pa.int32(), "slots": pa.binary(), "counts": pa.binary(), **{c: pa.binary() for c in _LINES}}

    def row(kind: int, rows: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int8)), *(columns.get(c, pa.nulls(rows, t)) for c, t in types.items())], names=["kind", *types])

    def flushed(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held)]
        first, again = earliest(columns)
        number, high, low = (c[again] for c in columns[1:4])
        yield row(REPEAT, len(number), {"key": _keys(high, low), "line": pa.array(number)})
        of = (columns[4].view(np.uint64) >> np.uint64(64 - _CLASS_BITS)).astype(np.int32)
        by_class = np.flatnonzero(first)[np.argsort(of[first], kind="stable")]
        of = of[by_class]
        new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        parts = packed([c[by_class] for c in columns], np.append(new, len(of)), _LINES)
        yield row(LINES, len(new), {"class": pa.array(of[new]), **dict(zip(_LINES, parts))})

    def counted(page: tuple[int, bytes, bytes]) -> pa.RecordBatch:
        return row(WORDS, 1, {c: pa.array([x], types[c]) for c, x in zip(("class", "slots", "counts"), page)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = WordCounts(bits), [], 0
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            high, low = _halves(batch.column(0))
            orders = batch.column(1).to_numpy()
            for i, j in chunks(bounds):
                words, _, first, n, text, number, digest, twin = sets_of_lines(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], min_words)
                if not len(first):
                    continue
                for page in counts.add(words):
                    yield counted(page)
                maps = parity_maps(words, first, n)
                at = text + i
                held.append([orders[at], number.astype(np.int32), high[at], low[at], digest.view(np.int64), twin.view(np.int64), n.astype(np.int32), *maps])
                size += len(first)
                if size >= _FLUSH:
                    yield from flushed(held)
                    held, size = [], 0
        if size:
            yield from flushed(held)
        for page in counts.pages():
            yield counted(page)

    shape = "kind byte, class int, key binary, line int, slots binary, counts binary, " + ", ".join(f"{c} binary" for c in _LINES)
    return mapped(texts, run, shape).withColumn("part", F.spark_partition_id())


def kinds_of(lines: DataFrame) -> DataFrame:
    """(first, key, line, order, id, twin, n, maps): every set of words at its first line, and packed lines that repeat it."""
    names = ["first", "key", "line", "order", *list(_LINES)[4:]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                columns = [np.concatenate(c) for c in zip(*held)]
                first, again = earliest(columns)
                order, number, high, low, *rest = (c[first | again] for c in columns)
                arrays = [pa.array(first[first | again]), _keys(high, low), *map(pa.array, (number, order, *rest))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            parts = [text_bytes(batch.column(c)) for c in _LINES]
            for i, of in enumerate(batch.column("class").to_pylist()):
                if of != now:
                    yield from done()
                    now, held = of, []
                held.append(unpacked(parts, i, i + 1, _LINES))
        yield from done()

    dealt = lines.filter(F.col("kind") == LINES).select("class", *_LINES).repartition("class").sortWithinPartitions("class")
    return mapped(dealt, run, "first boolean, key binary, line int, order long, id long, twin long, n int, " + ", ".join(f"{m} long" for m in _MAPS))


def bucket_bits(table: np.ndarray, threshold: float) -> int:
    """Bits of a word's hash that name its bucket, so that buckets stay at some 2**18 entries however large the input."""
    counts = np.bincount(table, minlength=256)
    total = float(np.sum(counts * (2.0 ** (np.arange(256) / _LEVELS) - 1)))
    return max(8, int(np.ceil(np.log2(1 + total * (1 - threshold)))) - 18)


def prefix_entries(texts: DataFrame, table: np.ndarray, settings: Settings) -> DataFrame:
    """The probing prefixes of all lines, packed by bucket: words whose hashes have the same leading bits."""
    shared = texts.sparkSession.sparkContext.broadcast(table)
    bits = bucket_bits(table, settings.threshold)

    def rows(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.argsort(columns[0])
        columns = [c[order] for c in columns]
        bucket = (columns[0] >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        arrays = [pa.array(bucket[first]), *packed(columns, np.append(first, len(bucket)))]
        return pa.RecordBatch.from_arrays(arrays, names=["bucket", *_COLUMNS])

    shift = np.uint64(64 - settings.table_bits)
    once = _LEVELS  # level of a slot that was counted once: its word is in no other line

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        held, size = [], 0
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            orders = batch.column(0).to_numpy()
            for i, j in chunks(bounds):
                words, _, first, n, text, number, digest = sets_of_lines(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], settings.min_words, twins=False)
                if not len(first):
                    continue
                words = words >> _WORD_BITS << _WORD_BITS
                order = orders[i:j][text]
                group = np.repeat(np.arange(len(first)), n)
                maps = np.bitwise_xor.reduceat(np.uint64(1) << ((words >> _WORD_BITS) & np.uint64(63)), first)
                rare = levels[(words >> shift).astype(np.int64)]
                # By line, then rarity, then hash: words stand in hash order, so their place breaks ties.
                sorted_ = np.sort((((group << 8) | rare) << 32) | np.arange(len(words)))
                words, rare = words[sorted_ & 0xFFFFFFFF], (sorted_ >> 32) & 0xFF
                place = np.arange(len(words)) - first[group]
                # Of equal lines in a chunk the earliest speaks for all.
                by_rank = np.lexsort((number, order, digest))
                same = np.append(False, digest[by_rank][1:] == digest[by_rank][:-1])
                speaks = np.ones(len(first), bool)
                speaks[by_rank[same]] = False
                near = n >= (n + 1) * settings.threshold - 1e-9  # shorter lines are similar to equal ones only
                keep = (speaks & near)[group] & (place < needed(n, settings.threshold)[0][group]) & (rare > once)
                g = group[keep]
                held.append([words[keep], order[g], digest[g].view(np.int64), maps[g], number[g].astype(np.int32), n[g].astype(np.int32), place[keep].astype(np.int32)])
                size += len(g)
                if size >= _FLUSH:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    return mapped(texts.select("order", "text"), run, f"bucket long, {_PACKED}")


def ranked(word: np.ndarray, order: np.ndarray, line: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The entries of words that several lines hold, ordered by word, then order, line and id."""
    by_word = np.argsort(word)
    new = np.append(True, word[by_word][1:] != word[by_word][:-1])[: len(word)]
    by_word = by_word[~(new & np.append(new[1:], True)[: len(word)])]
    if not len(by_word):
        return by_word
    word, order, line, ids = word[by_word], order[by_word], line[by_word], ids[by_word]
    if int(order.max()) - int(order.min()) >= 1 << 40 or int(line.max()) >= 1 << 23:
        return by_word[np.lexsort((ids, line, order, word))]
    place = ((order - order.min()).astype(np.uint64) << np.uint64(23)) | line.astype(np.uint64)
    place = np.unique(place, return_inverse=True)[1].astype(np.uint64)
    group = np.cumsum(np.append(True, word[1:] != word[:-1])).astype(np.uint64)
    both = (group << np.uint64(32)) | place
    by_rank = np.argsort(both)
    tied = both[by_rank][1:] == both[by_rank][:-1]
    if (ids[by_rank][1:][tied] != ids[by_rank][:-1][tied]).any():  # lines of documents that share an id
        by_rank = np.lexsort((ids, both))
    return by_word[by_rank]


class Lists:
    """Inverted lists side by side, each ordered by rank; every word and line once.

    Entries of sides 1 and 2 pair with those of the other side only; side 0 pairs with all.
    """

    def __init__(self, columns: list[np.ndarray], side: np.ndarray, t: float):
        word, order, ids, maps, line, n, place = columns
        by_rank = ranked(word, order, line, ids)
        word, ids = word[by_rank], ids[by_rank]
        # Equal lines are neighbours only where ranks are equal, so copies are found by id: all of one id in their order.
        number = np.unique(ids, return_inverse=True)[1].astype(np.uint64)
        by_id = np.sort((number << np.uint64(32)) | np.arange(len(ids), dtype=np.uint64))
        by_id, number = (by_id & np.uint64(0xFFFFFFFF)).astype(np.int64), by_id >> np.uint64(32)
        copy = np.append(False, (number[1:] == number[:-1]) & (word[by_id][1:] == word[by_id][:-1]))[: len(ids)]
        first = np.ones(len(ids), bool)
        first[by_id[copy]] = False
        at = by_rank[first]
        self.at, self.word, self.ids, self.maps = at, word[first], ids[first], maps[at]
        self.n, self.place, self.side = n[at], place[at], side[at]
        self.rest = self.n - self.place
        self.indexed = self.place < needed(self.n, t)[1]
        self.t = t

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs can be similar, by their lengths, the places where they meet and the parity maps of their words."""
        n, m = self.n[a], self.n[b]
        overlap = np.ceil((n + m) * (self.t / (1 + self.t)) - 1e-6).astype(np.int32)
        out = (self.side[a] == 0) | (self.side[a] != self.side[b])
        out &= (np.minimum(self.rest[a], self.rest[b]) >= overlap) & (np.minimum(n, m) >= np.maximum(n, m) * self.t - 1e-6)
        left = np.flatnonzero(out)
        a, b, n, m = a[left], b[left], n[left], m[left]
        apart = np.bitwise_count(self.maps[a] ^ self.maps[b]).astype(np.int32)
        out[left] = (n + m - apart >= 2 * overlap[left]) & np.where(n <= m, self.indexed[a], self.indexed[b])
        return out

    def pairs(self, limit: int | None, only: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (later, earlier) in parts of about `_FLUSH`; after the last, `cut` names the entries that `limit` cut short in a list."""
        new = np.flatnonzero(np.append(True, self.word[1:] != self.word[:-1])[: len(self.word)])
        base = np.repeat(new, np.diff(np.append(new, len(self.word))))
        place = np.arange(len(self.word)) - base
        found = np.zeros(len(self.word), np.int32)
        active = np.flatnonzero(place > 0)
        if only is not None:
            active = active[has(only, self.ids[active].view(np.uint64), bits)]
        held, size, step = [], 0, 0
        while len(active):
            other = base[active] + step
            fit = np.flatnonzero(self.fits(active, other))
            if len(fit):
                held.append((self.ids[active[fit]], self.ids[other[fit]]))
                found[active[fit]] += 1
                size += len(fit)
            if size >= _FLUSH:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
            step += 1
            active = active[(place[active] > step) & ((found[active] < limit) if limit else True)]
        if size:
            yield tuple(map(np.concatenate, zip(*held)))
        self.cut = np.flatnonzero((found >= limit) & (place > 0)) if limit else np.zeros(0, np.int64)


_MET = f"later long, earlier long, word_cut long, bucket long, class int, sides binary, {_PACKED}"


def _met(kind: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of `candidate_pairs` with the given columns, all others null."""
    types = {"later": pa.int64(), "earlier": pa.int64(), "word_cut": pa.int64(), "bucket": pa.int64(), "class": pa.int32(), "sides": pa.binary()} | {c: pa.binary() for c in _COLUMNS}
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int8)), *(columns.get(c, pa.nulls(rows, t)) for c, t in types.items())], names=["kind", *types])


PAIR, CUT, LIST, LONG = range(4)


def _paired(columns: list[np.ndarray], sides: np.ndarray, settings: Settings) -> Iterator[pa.RecordBatch]:
    """The first partners in these lists; lines cut short, and the whole lists that they were cut short in."""
    lists = Lists(columns, sides, settings.threshold)
    for later, earlier in lists.pairs(settings.candidates, None, settings.bitmap_bits):
        yield _met(PAIR, len(later), later=pa.array(later), earlier=pa.array(earlier))
    if len(lists.cut):
        word = lists.word[lists.cut]
        yield _met(CUT, len(word), later=pa.array(lists.ids[lists.cut]), word_cut=pa.array(word.view(np.int64)))
        at = lists.at[np.isin(lists.word, word)]
        whole = packed([c[at] for c in columns], np.array([0, len(at)]))
        yield _met(LIST, 1, sides=pa.array([sides[at].tobytes()], pa.binary()), **dict(zip(_COLUMNS, whole)))


def _by_class(bucket: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A part of a bucket too long for one task, cut by the ids of its lines."""
    of = (mixed(columns[2].view(np.uint64)) % np.uint64(_CLASSES)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    of = of[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    cut = packed([c[order] for c in columns], np.append(first, len(of)))
    return _met(LONG, len(first), bucket=pa.array(np.full(len(first), bucket, np.int64)), **{"class": pa.array(of[first])}, **dict(zip(_COLUMNS, cut)))


def candidate_pairs(entries: DataFrame, settings: Settings) -> DataFrame:
    """Rows of four kinds: candidate pairs, lines cut short in a list, those lists, and parts of buckets too long for a task.

    `entries` hold a bucket, and for cells of long buckets the block of the row and the two blocks that meet there.
    """
    cells = "low" in entries.columns
    keys = ["bucket", "low", "high"] if cells else ["bucket"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, long = None, [], 0, False

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                columns = [np.concatenate(c) for c in zip(*(part for part, _ in held))]
                if long:
                    yield _by_class(now[0], columns)
                else:
                    yield from _paired(columns, np.concatenate([np.full(len(part[0]), side, np.int8) for part, side in held]), settings)

        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            blocks = batch.column("block").to_pylist() if cells else None
            columns = [text_bytes(batch.column(c)) for c in _COLUMNS]
            for i, name in enumerate(names):
                if name != now:
                    yield from done()
                    now, held, size, long = name, [], 0, False
                part = unpacked(columns, i, i + 1)
                side = 0 if not cells or name[1] == name[2] else 1 if blocks[i] == name[1] else 2
                held.append((part, side))
                size += len(part[0])
                if size > settings.list_entries and not cells:
                    long = True
                    yield from done()
                    held, size = [], 0
        yield from done()

    return mapped(entries.repartition(*keys).sortWithinPartitions(*keys), run, f"kind byte, {_MET}")


def cells_of(parts: DataFrame, settings: Settings) -> DataFrame:
    """Long buckets cut into blocks of lines by id, each block sent to the cells where it meets itself and the others.

    Equal lines share a block, so the earliest of them is known in every cell. A cell is about as large as a whole list
    may be, and the number of blocks follows the bucket's size.
    """
    sizes = parts.groupBy("bucket").agg(F.sum(F.octet_length("word") / 8).alias("entries"))
    blocks = F.least(F.lit(_CLASSES), F.ceil(F.col("entries") * 2 / settings.list_entries)).cast("int")
    sized = parts.join(sizes.select("bucket", blocks.alias("blocks")), "bucket")
    own = sized.withColumn("block", F.floor(F.col("class") * F.col("blocks") / _CLASSES).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *_COLUMNS)


def more_pairs(lists: DataFrame, words: np.ndarray, ids: np.ndarray, settings: Settings) -> DataFrame:
    """(later, earlier): all candidates of the lines in the bitmap `ids` in the stored lists of the words in the other one."""
    shared = lists.sparkSession.sparkContext.broadcast((words, ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, open_ = shared.value
        for batch in batches:
            parts, sides = [text_bytes(batch.column(c)) for c in _COLUMNS], batch.column("sides")
            for i in range(batch.num_rows):
                columns, side = unpacked(parts, i, i + 1), np.frombuffer(sides[i].as_py(), np.int8)
                keep = has(wanted, columns[0], settings.bitmap_bits)
                if keep.any():
                    for pair in Lists([c[keep] for c in columns], side[keep], settings.threshold).pairs(None, open_, settings.bitmap_bits):
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, pair)), names=["later", "earlier"])

    return mapped(lists, run, "later long, earlier long")


def line_sets(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, twin, words): the whole sets of words of the listed lines (key, order, line, id, twin), as 64-bit hashes."""
    per_text = stored(listed.groupBy("key", "order").agg(F.collect_list(F.struct("line", "id", "twin")).alias("listed")), "listed-lines")
    # Equal documents list equal lines, so any one of them will do; they stand side by side after the join.
    # Most are told apart by their order, before a digest of their text is made.
    near = texts.join(small(per_text.select("order")), "order", "left_semi").select("key", "text")
    held = near.join(small(per_text.select("key")), "key", "left_semi").join(per_text.drop("order").hint("shuffle_merge"), "key")
    held = held.dropDuplicates(["key"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            ids, twins, lines = [], [], [np.zeros(0, np.uint8)]
            for k, wanted in enumerate(batch.column(1).to_pylist()):
                raw = data[bounds[k] : bounds[k + 1]]
                breaks = np.append(np.append(-1, np.flatnonzero(raw == 0x0A)), len(raw))
                for line in wanted:
                    ids.append(line["id"])
                    twins.append(line["twin"])
                    lines.append(raw[breaks[line["line"]] + 1 : breaks[line["line"] + 1]])
            own = np.cumsum([len(x) for x in lines])
            hashes, starts = word_hashes(np.concatenate(lines), own)
            sets, at = word_sets(hashes, np.searchsorted(own, starts, side="right") - 1)
            edges = np.searchsorted(at, np.arange(len(own))).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(edges), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(twins, pa.int64()), words], names=["id", "twin", "words"])

    return mapped(held.select("text", "listed"), run, "id long, twin long, words array<long>")


def paired_sets(pairs: DataFrame, texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """`line_sets` of all lines of the pairs (later, earlier), stored."""
    named = stored(pairs.select(F.explode(F.array("later", "earlier")).alias("id")).distinct(), "paired-lines")
    return stored(line_sets(texts, kinds.select("id", "twin", "key", "order", "line").join(named, "id", "left_semi")), "line-sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id, twin) of the later lines of the pairs (later, earlier) whose sets of words are similar; stored, and outlives the scratch block."""
    later = sets.select(F.col("id").alias("later"), "twin", F.col("words").alias("w"))
    earlier = sets.select(F.col("id").alias("earlier"), F.col("words").alias("x"))
    common = F.size(F.array_intersect("w", "x"))
    similar = common >= (F.size("w") + F.size("x") - common) * F.lit(threshold) - F.lit(1e-9)
    return stored(pairs.join(later, "later").join(earlier, "earlier").filter(similar).select(F.col("later").alias("id"), "twin").distinct(), "similar", result=True)


def similar_lines(texts: DataFrame, kinds: DataFrame, table: np.ndarray, settings: Settings) -> DataFrame:
    """(id, twin) of the different lines that an earlier one is similar to; `kinds` says where each id stands first."""
    met = stored(candidate_pairs(prefix_entries(texts, table, settings), settings), "line-pairs")
    long = met.filter(F.col("kind") == LONG)
    if not long.isEmpty():
        met = met.unionByName(stored(candidate_pairs(cells_of(long, settings), settings), "long-line-pairs"))
    counted = met.filter(F.col("kind") == PAIR).groupBy("later", "earlier").agg(F.count(F.lit(1)).alias("lists"))
    pairs = stored(plausible(counted, kinds, settings.threshold), "first-pairs")
    # One similar line is enough: each line tries the partner it met in most lists, then, if need be, the others.
    likely = pairs.groupBy("later").agg(F.max_by("earlier", F.struct("lists", "earlier")).alias("earlier"))
    with scratch(texts.sparkSession):
        likely, sets = stored(likely, "likely-pairs"), paired_sets(pairs, texts, kinds)
        similar = verified(likely, sets, settings.threshold)
        others = pairs.select("later", "earlier").join(likely, ["later", "earlier"], "left_anti")
        others = stored(others.join(similar.select(F.col("id").alias("later")), "later", "left_anti"), "other-pairs")
        similar = stored(similar.unionByName(verified(others, sets, settings.threshold)), "similar-lines", result=True)
    left = stored(met.filter(F.col("kind") == CUT).select(F.col("later").alias("id"), F.col("word_cut").alias("word")).distinct().join(similar, "id", "left_anti"), "cut-short")
    if left.isEmpty():
        return similar
    words, ids = (bitmap(left.select(c), settings.bitmap_bits) for c in ("word", "id"))
    lists = met.filter(F.col("kind") == LIST).select("sides", *_COLUMNS)
    rest = more_pairs(lists, words, ids, settings).distinct()
    rest = rest.join(left.select(F.col("id").alias("later")).distinct(), "later", "left_semi").join(pairs, ["later", "earlier"], "left_anti")
    rest = stored(plausible(rest, kinds, settings.threshold), "second-pairs")
    with scratch(texts.sparkSession):
        return similar.unionByName(verified(rest, paired_sets(rest, texts, kinds), settings.threshold))


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, lines): the numbers of the lines each document loses, from zero."""
    with scratch(docs.sparkSession):
        texts = texts_of(docs, doc_id, text)
        lines = stored(lines_of(texts, settings.min_words, settings.table_bits), "lines")
        counts = lines.filter(F.col("kind") == WORDS).select(F.col("class").alias("page"), "slots", "counts", "part")
        table = merged_rarity(counts, settings.table_bits)
        found = stored(kinds_of(lines), "line-kinds")
        kinds = found.filter("first").drop("first")
        similar = similar_lines(texts, kinds, table, settings)
        # Every line that repeats an earlier one, and the first line of every kind that goes.
        gone = kinds.select("id", "twin", "key", "line").join(similar, ["id", "twin"], "left_semi").select("key", "line")
        lost = lines.filter(F.col("kind") == REPEAT).select("key", "line").unionByName(found.filter(~F.col("first")).select("key", "line")).unionByName(gone)
        return stored(lost.groupBy("key").agg(F.collect_set("line").alias("lines")), "lost-lines", result=True)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """All columns, the text without the removed lines, and the added columns `n_lines` and `n_removed`."""
    lost = removed_lines(docs, doc_id, text, settings).select(F.col("key").alias("__key"), F.col("lines").alias("__lines"))
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*others, _key(docs, doc_id, text).alias("__key"))
    keys = small(lost.select("__key"))
    # Only documents that lose lines are shuffled to meet them.
    touched = keyed.join(keys, "__key", "left_semi").join(lost.hint("shuffle_hash"), "__key").select(*others, "__lines")
    untouched = keyed.join(keys, "__key", "left_anti").select(*others, F.lit(None).cast("array<int>").alias("__lines"))
    raw = F.col(text).cast("string")
    split = F.split(raw, "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains("__lines", i))
    rest = F.when(F.col("__lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    breaks = F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit("\n"), F.lit("")))
    n_lines, n_removed = F.coalesce(breaks + 1, F.lit(0)), F.coalesce(F.size("__lines"), F.lit(0))
    return touched.unionByName(untouched).select(
        *(rest.alias(c) if c == text else F.col(c) for c in others),
        n_lines.cast("long").alias("n_lines"), F.greatest(n_removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def keep_unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The documents without the removed lines; those that lose every line with words are dropped."""
    done = deduplicated(docs, doc_id, text, settings)
    return done.filter((F.col("n_removed") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
