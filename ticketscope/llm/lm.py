"""Language-model scores from a log-frequency Bloom filter of word pairs.

Tokens are lower-cased words and one end mark per text. Counts of tokens and of pairs are gathered from all training
texts, merged by hash page, and quantised: levels are one per doubling for pairs and four for tokens. An entry with
level q is inserted once for each level 1..q, so a count is read back by probing levels: doubling steps until one is
missing, then halving. A level stands for the mean of the training counts that share it, so the read counts of all
tokens sum to what they should. The pages together are the filter: they hold all entries and their number follows the
training bytes. Workers get them in groups of at most `Settings.filter_bytes` (or one page). What fits in one group is
scored in one pass; otherwise each group is probed in a pass of its own over the texts, and the levels found for every
token are put together per text afterwards.

The probability of a token w behind c is (n(c, w) + m * p(w)) / (n(c) + f + m): the counts of pair and context, m
(`Settings.prior`) backed-off tokens of the add-one share p(w), and f, the number of false pairs the filter is expected
to show behind any context (its rate of false positives times the vocabulary). Over all w the pairs seen and the
expected false ones make n(c) + f, so the probabilities sum to about one, behind rare contexts too. A pair never counts
more than its context or its word, and none is looked for unless both are known. Next to it stands the exact base:
add-one unigram scores, for which the commonest tokens are looked up in a broadcast table of at most
`Settings.head_tokens` rows and all other occurrences are joined with the counts.

Tokens are known by 64-bit hashes. Null and empty texts are one end mark. Repeated rows are counted and scored each. A
null id counts as empty text when the held-out rows are chosen. An empty table gives an empty result; without training
rows all counts are zero. Further columns are not read.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.storage import stored
from ticketscope.llm.words import LOWER, chunks, mixed, prefix_hashes, range_hashes, text_bytes, word_bounds

END = np.uint64(0x9D39247E33776D41)
_LEVEL = 0xD6E8FEB86659FD93
_PAIR = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Settings:
    filter_bytes: int = 76 << 20
    pages: int = 0  # a power of two; 0: one per `page_text` bytes of training text
    page_text: int = 4 << 20
    bits_per_entry: int = 16
    probes: int = 11
    steps: tuple[int, int] = (4, 1)  # levels per doubling, of tokens and of pairs
    prior: float = 100.0
    head_tokens: int = 1 << 20
    flush_tokens: int = 2_000_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text closed by the end mark, and the number of tokens per text."""
    low = LOWER[data]
    starts, ends = word_bounds(low, bounds)
    hashes = range_hashes(prefix_hashes(low), starts, ends)
    per_text = np.diff(np.searchsorted(starts, bounds))
    last = np.cumsum(per_text + 1) - 1
    out = np.empty(len(hashes) + len(per_text), np.uint64)
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[inside], out[last] = hashes, END
    return out, per_text + 1


def pairs(found: np.ndarray) -> np.ndarray:
    """Hash of every token with the one before it; the end mark stands before each text."""
    before = np.empty_like(found)
    before[:1], before[1:] = END, found[:-1]
    return mixed(before * _PAIR + found)


TOP = 255  # levels are stored in one byte


def levels(counts: np.ndarray, steps: int) -> np.ndarray:
    """One for a count of one, `steps` more with each doubling."""
    return np.minimum(1 + np.floor(np.log2(counts.astype(np.float64)) * steps + 1e-9).astype(np.int64), TOP)


def places(keys: np.ndarray, level: int, bits: np.ndarray | int, probes: int) -> list[np.ndarray]:
    """Bit positions inside a page for keys at one level."""
    a = mixed(keys + np.uint64(level * _LEVEL % (1 << 64)))
    b = mixed(a) | np.uint64(1)
    return [((a + np.uint64(i) * b) % bits).astype(np.int64) for i in range(probes)]


def page_filter(keys: np.ndarray, level: np.ndarray, settings: Settings) -> tuple[bytes, float]:
    """One page with all levels of the keys, and its rate of false positives."""
    bits = max(64, -(-int(level.sum()) * settings.bits_per_entry // 64) * 64)
    page = np.zeros(bits, bool)
    order = np.argsort(-level, kind="stable")
    keys, level = keys[order], level[order]
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in places(keys[: np.searchsorted(-level, -q, side="right")], q, np.uint64(bits), settings.probes):
            page[at] = True
    return np.packbits(page, bitorder="little").tobytes(), float(page.mean() ** settings.probes)


class Filter:
    """The pages side by side, with where each begins."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, settings: Settings):
        self.starts = np.append(0, np.cumsum(sizes))[:-1] * 8
        self.bits = np.maximum(sizes * 8, 1).astype(np.uint64)
        self.data = data
        self.empty = sizes == 0
        self.shift = np.uint64(64 - (settings.pages - 1).bit_length())
        self.probes = settings.probes

    def holds(self, keys: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Whether each key is there at its level; most that are not fall out at the first few bits."""
        page = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        a = mixed(keys + level.astype(np.uint64) * np.uint64(_LEVEL))
        b = mixed(a) | np.uint64(1)
        base, bits = self.starts[page], self.bits[page]
        for i in range(self.probes):
            at = ((a[left] + np.uint64(i) * b[left]) % bits[left]).astype(np.int64) + base[left]
            left = left[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Probed level of each key: levels 1, 2, 4, ... until one is missing, then halves between the last two."""
        out = np.zeros(len(keys), np.int64)
        active = np.flatnonzero(~self.empty[(keys >> self.shift).astype(np.int64)])
        step = 1
        while len(active) and step <= TOP:
            active = active[self.holds(keys[active], np.full(len(active), step))]
            out[active] = step
            step *= 2
        step = out // 2
        while step.any():
            between = np.flatnonzero(step)
            there = between[self.holds(keys[between], out[between] + step[between])]
            out[there] += step[there]
            step //= 2
        return out


def _by_page(kind: int, keys: np.ndarray, pages: int) -> Iterator[tuple]:
    found, counts = np.unique(keys, return_counts=True)
    shift = np.uint64(64 - (pages - 1).bit_length())
    edges = np.searchsorted((found >> shift).astype(np.int64), np.arange(pages + 1))
    for page in range(pages):
        a, b = edges[page], edges[page + 1]
        if b > a:
            yield kind, page, found[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()


_PARTS = "kind int, page int, keys binary, counts binary"


def counted(train: DataFrame, settings: Settings) -> DataFrame:
    """(kind, page, keys, counts, bits): tokens (kind 0) with their counts and both kinds' filter pages."""
    shape = pa.schema([("kind", pa.int32()), ("page", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles, doubles, n = [], [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for kind, held in enumerate((singles, doubles)):  # one kind at a time: a worker holds one kind's copies
                keys = np.concatenate(held)
                held.clear()
                rows = list(_by_page(kind, keys, settings.pages))
                del keys
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), shape)]
                del rows
                yield pa.RecordBatch.from_arrays(columns, schema=shape)
                del columns

        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            for i, j in chunks(bounds):
                found, _ = tokens(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                singles.append(found), doubles.append(pairs(found))
                n += len(found)
                if n >= settings.flush_tokens:
                    yield from flushed()
                    n = 0
        if n:
            yield from flushed()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in rows["keys"]])
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in rows["counts"]]).astype(np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        kind, page = int(rows["kind"].iloc[0]), int(rows["page"].iloc[0])
        level = levels(counts, settings.steps[kind])
        bits, rate = page_filter(keys, level, settings)
        both = (keys.tobytes(), counts.tobytes()) if kind == 0 else (b"", b"")
        row = (kind, page, *both, bits, rate, np.bincount(level).tolist(), np.bincount(level, counts).tolist())
        return pd.DataFrame([row], columns=["kind", "page", "keys", "counts", "bits", "rate", "entries", "sums"])

    parts = train.select("text").mapInArrow(gather, _PARTS)
    return stored(parts.groupBy("kind", "page").applyInPandas(merge, _PARTS + ", bits binary, rate double, entries array<long>, sums array<double>"), "lm-pages")


def token_counts(pages: DataFrame) -> DataFrame:
    """(token, c) of all training tokens."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                columns = [pa.array(np.frombuffer(x, np.int64)) for x in (keys, counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "c"])

    return stored(pages.filter("kind = 0").select("keys", "counts").mapInArrow(spread, "token long, c long"), "lm-tokens")


def commonest(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens above the lowest count that leaves at most `limit` of them, sorted, and their counts.

    Counts are looked at in fine log steps, so the driver sees at most 16 sizes a doubling before it takes the tokens.
    """
    step = F.floor(F.log2("c") * 16).cast("long")
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    lowest, n = None, 0
    for row in sizes:
        n += row["count"]
        if n > limit:
            break
        lowest = row["step"]
    if lowest is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = counts.filter(step >= lowest).toArrow()
    keys = head["token"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], head["c"].to_numpy()[order]


def page_groups(pages: DataFrame, settings: Settings) -> list[list[tuple[int, int, int]]]:
    """The (kind, page, bytes) of all pages in groups of at most `filter_bytes`, or of one page that is larger."""
    groups: list[list[tuple[int, int, int]]] = [[]]
    taken = 0
    sizes = pages.select("kind", "page", F.octet_length("bits").alias("n")).collect()  # three numbers a page
    for kind, page, n in sorted(tuple(r) for r in sizes):
        if groups[-1] and taken + n > settings.filter_bytes:
            groups.append([])
            taken = 0
        groups[-1].append((kind, page, n))
        taken += n
    return groups


def gathered(pages: DataFrame, group: list[tuple[int, int, int]], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both filters with the pages of a group as one array each, and the sizes of their pages, zero outside the group."""
    sizes = np.zeros((2, settings.pages), np.int64)
    for kind, page, n in group:
        sizes[kind, page] = n
    ends = np.cumsum(sizes, axis=1)
    data = [np.zeros(int(e[-1]), np.uint8) for e in ends]
    if group:
        code = F.col("kind") * settings.pages + F.col("page")
        first, last = (k * settings.pages + p for k, p, _ in (group[0], group[-1]))
        for row in pages.filter(code.between(first, last)).select("kind", "page", "bits").toLocalIterator():
            end = ends[row["kind"], row["page"]]
            data[row["kind"]][end - len(row["bits"]) : end] = np.frombuffer(row["bits"], np.uint8)
    return list(zip(data, sizes))


@dataclass(frozen=True)
class Smoothing:
    """What probabilities rest on besides the levels: means of token and pair levels, expected false pairs, prior, floor."""

    means: tuple[np.ndarray, np.ndarray]
    false: float
    prior: float
    floor: float

    def counts(self, token_levels: np.ndarray, pair_levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.means[0][token_levels], self.means[1][pair_levels]

    def probability(self, context: np.ndarray, single: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Of each token, from the read counts of its context, of itself and of the pair."""
        own = (single + 1.0) / self.floor
        pair = np.minimum(np.minimum(pair, context), single)
        return np.where(context > 0, (pair + self.prior * own) / (context + self.false + self.prior), own)

    def of_texts(self, single: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Probability of every token of whole texts: the last is an end mark, as is the context of the first."""
        return self.probability(np.roll(single, 1), single, pair)


def smoothing(pages: DataFrame, total: int, distinct: int, settings: Settings) -> Smoothing:
    """Level means and false positives over all pages."""
    listed = pages.select("kind", F.posexplode(F.arrays_zip("entries", "sums")))
    means = [np.zeros(TOP + 1), np.zeros(TOP + 1)]
    for row in listed.groupBy("kind", "pos").agg(F.sum("col.entries").alias("n"), F.sum("col.sums").alias("sum")).collect():  # a row per level
        means[row["kind"]][row["pos"]] = row["sum"] / max(row["n"], 1)
    for values in means:  # levels that only a false positive shows stand for the nearest below
        for i in range(1, TOP + 1):
            values[i] = values[i] or values[i - 1]
    rate = pages.filter("kind = 1").agg(F.sum("rate")).first()[0] or 0.0
    return Smoothing((means[0], means[1]), rate / settings.pages * distinct, settings.prior, float(total + distinct + 1))


def probed_apart(rows: DataFrame, pages: DataFrame, groups: list, smooth: Smoothing, settings: Settings) -> DataFrame:
    """(key, score) of every different text, the groups of pages probed one after the other."""
    context = rows.sparkSession.sparkContext
    keyed = rows.select("key", "text")
    found_levels = []
    for group in groups:
        shared = context.broadcast(gathered(pages, group, settings))

        def probe(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            # A group shows few of all levels, the more groups the fewer, and zeros take no room once compressed.
            smaller = zstandard.ZstdCompressor(level=1).compress
            singles, doubles = (Filter(data, sizes, settings) for data, sizes in shared.value)
            for batch in batches:
                data, bounds = text_bytes(batch.column(1))
                out = []
                for i, j in chunks(bounds):
                    found, per_text = tokens(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                    both = []
                    for held, wanted in ((singles, found), (doubles, pairs(found))):
                        keys, place = np.unique(wanted, return_inverse=True)
                        both.append(held.level(keys).astype(np.uint8)[place])
                    ends = np.cumsum(per_text)
                    out += [smaller(b"".join(x[e - n : e].tobytes() for x in both)) for e, n in zip(ends, per_text)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "levels"])

        found_levels.append(stored(keyed.mapInArrow(probe, "key binary, levels binary"), "lm-levels"))
        shared.destroy()
    together = found_levels[0]
    for more in found_levels[1:]:
        together = together.unionByName(more)
    # Equal texts have equal levels, so a set holds at most one entry a group however often a text repeats.
    together = together.groupBy("key").agg(F.collect_set("levels").alias("levels"))

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for entries in batch.column(1).to_pylist():
                both = np.maximum.reduce([np.frombuffer(whole(x), np.uint8) for x in entries]).astype(np.int64)
                out.append(float(np.log10(smooth.of_texts(*smooth.counts(*np.split(both, 2)))).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["key", "score"])

    return stored(together.mapInArrow(combine, "key binary, score double"), "lm-apart")


def scores(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), held_out(docs[doc_id]).alias("held_out"))
    train = rows.filter(~F.col("held_out"))
    if not settings.pages:
        size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        settings = replace(settings, pages=max(16, 1 << (size // settings.page_text).bit_length()))
    pages = counted(train, settings)
    counts = token_counts(pages)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    smooth = smoothing(pages, total, distinct, settings)
    groups = page_groups(pages, settings)
    apart = len(groups) > 1
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")))) if apart else F.lit(None).cast("binary")
    rows = rows.select("doc_id", "text", "held_out", key.alias("key"))
    whole = gathered(pages, [] if apart else groups[0], settings)
    shared = spark.sparkContext.broadcast((*commonest(counts, settings.head_tokens), *whole))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, common_counts, *held = shared.value
        singles, doubles = (Filter(data, sizes, settings) for data, sizes in held)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            parts = []
            for i, j in chunks(bounds):
                found, per_text = tokens(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                owner = np.repeat(np.arange(j - i), per_text)
                keys, place = np.unique(found, return_inverse=True)
                if apart:
                    score_of = np.zeros(j - i)
                else:
                    pair_keys, pair_place = np.unique(pairs(found), return_inverse=True)
                    p = smooth.of_texts(*smooth.counts(singles.level(keys)[place], doubles.level(pair_keys)[pair_place]))
                    score_of = np.bincount(owner, np.log10(p), j - i)
                at = np.minimum(np.searchsorted(common, keys), max(0, len(common) - 1))
                in_head = common[at] == keys if len(common) else np.zeros(len(keys), bool)
                exact = np.where(in_head, common_counts[at] if len(common) else 0, 0)
                logs, seen = np.log10(exact + 1.0), (exact > 0).astype(np.int64)
                rest = ~in_head[place]
                edges = np.append(0, np.cumsum(np.bincount(owner[rest], minlength=j - i))).astype(np.int32)
                parts.append((
                    per_text, np.bincount(owner, seen[place], j - i).astype(np.int64), np.bincount(owner, logs[place], j - i),
                    score_of, pa.ListArray.from_arrays(pa.array(edges), pa.array(found[rest].view(np.int64))),
                ))
            if parts:
                joined = [np.concatenate(x) for x in list(zip(*parts))[:4]]
                tails = pa.concat_arrays([x[4] for x in parts])
                columns = [batch.column(0), batch.column(2), pa.array(joined[0].astype(np.int64)), *map(pa.array, joined[1:]), tails, batch.column(3)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "known", "logs", "score", "tail", "key"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, score double, tail array<long>, key binary"
    scored = stored(rows.mapInArrow(score, shape).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    tails = scored.select("row", F.explode("tail").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("times"))
    rare = tails.join(counts, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    if apart:
        scored = scored.drop("score").join(probed_apart(rows, pages, groups, smooth, settings), "key")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(smooth.floor))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
