"""Quality rules: word counts and compression bands decide which documents stay.

A text passes when it has enough words, is not mostly repeated three-word windows, and its zstandard ratio
(compressed by raw bytes) lies inside the band for its length. Fixed chunks of the text are held against the band for
their own length too; a text goes when more than `max_bad_chunks` of its bytes lie in chunks outside theirs. Low ratios mean
repetition, high ones noise. The bands of `Rules` are wide outer bounds. `fitted` adds limits taken from the table: all
different texts and chunks that pass the word rules are put into classes of half a doubling of length. The medians of the
classes and their median deviations are smoothed over length, weighed by the number of texts, so a class with few or no
texts borrows from its neighbours; accepted is what lies within `spread` smoothed deviations of the smoothed median.
One rule holds for tables of any size.

Null and empty texts have no words and are rejected. Every text is read whole, whatever its length. Repeated rows are
judged one by one and alike; an empty table gives an empty result; further columns pass through untouched.
"""

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.batches import mapped


@dataclass(frozen=True)
class Band:
    """Accepted compression ratios of texts of at least `min_bytes` bytes."""

    min_bytes: int
    low: float
    high: float


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    chunk_bytes: int = 4096
    max_bad_chunks: float = 1 / 3
    level: int = 3
    bands: tuple[Band, ...] = (
        Band(0, 0.20, 1.10),
        Band(256, 0.20, 0.92),
        Band(1024, 0.16, 0.74),
        Band(8192, 0.13, 0.68),
        Band(65536, 0.11, 0.66),
    )
    limits: dict[tuple[bool, int], tuple[float, float]] = field(default_factory=dict)  # by chunk or text, and length class


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, bad_chunks double, base_failed boolean, kept boolean"
_WORD = re.compile(rb"[^\x20\x09-\x0D]")
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    inside = np.zeros(len(words), bool)
    at = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    for shift in range(3):
        inside[shift : len(windows) + shift] |= at
    return int(inside.sum())


def fails(n: int, repeats: int, rules: Rules) -> bool:
    """Whether the word rules reject a text of n words."""
    return n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n


def length_class(n: int) -> int:
    """Half a doubling of length each: 2 * log2(n), rounded down."""
    return (n * n).bit_length() - 1


def within(raw: bytes, size: int, rules: Rules, chunk: bool) -> bool:
    band = max((b for b in rules.bands if b.min_bytes <= len(raw)), key=lambda b: b.min_bytes)
    low, high = rules.limits.get((chunk, length_class(len(raw))), (band.low, band.high))
    return max(low, band.low) <= size / len(raw) <= min(high, band.high)


def pieces(raw: bytes, rules: Rules) -> list[bytes]:
    return [raw[i : i + rules.chunk_bytes] for i in range(0, len(raw), rules.chunk_bytes)]


def judged(text: str | None, rules: Rules, compressor: zstandard.ZstdCompressor) -> dict:
    """The measures of one text and the verdict."""
    raw = (text or "").encode()
    words = raw.split()
    joined = b"".join(words)
    counts = Counter(line for line in raw.split(b"\n") if _WORD.search(line))
    n, repeats = len(words), repeated_words(words)
    failed = fails(n, repeats, rules)
    whole = len(compressor.compress(raw)) if raw else 0
    bad = sum(len(p) for p in pieces(raw, rules) if not within(p, len(compressor.compress(p)), rules, True)) / max(1, len(raw))
    return {
        "n_words": n,
        "word_chars": len(joined.decode()),
        "n_symbols": sum(raw.count(bytes([c])) for c in _SYMBOLS),
        "n_dup_lines": sum(counts.values()) - len(counts),
        "n_repeat_words": repeats,
        "zstd_ratio": whole / len(raw) if raw else 0.0,
        "bad_chunks": bad,
        "base_failed": failed,
        "kept": not failed and within(raw, whole, rules, False) and bad <= rules.max_bad_chunks,
    }


STEPS = 1000  # ratios are counted to a thousandth
CLASSES = 64  # length classes up to 4 GB


def smoothed(values: np.ndarray, weights: np.ndarray, stiffness: float) -> np.ndarray:
    """The curve nearest to the weighted values whose slope changes little: a Whittaker smoother of second differences."""
    bend = np.diff(np.eye(len(values)), 2, axis=0)
    return np.linalg.solve(np.diag(weights) + stiffness * bend.T @ bend + 1e-9 * np.eye(len(values)), weights * values)


def middle(steps: np.ndarray, counts: np.ndarray) -> float:
    """Median of values with counts."""
    order = np.argsort(steps)
    upto = np.cumsum(counts[order])
    return float(steps[order][np.searchsorted(upto, upto[-1] / 2)])


def limits_of(sizes: dict[int, dict[int, int]], spread: float, stiffness: float, least: float) -> dict[int, tuple[float, float]]:
    """Accepted ratios of every length class from the counts (class, step) of a table."""
    curve, weights = np.zeros((2, CLASSES)), np.zeros(CLASSES)
    cells = {c: (np.array(list(n)) / STEPS, np.array(list(n.values()))) for c, n in sizes.items()}
    for c, (steps, counts) in cells.items():
        curve[0, c], weights[c] = middle(steps, counts), counts.sum()
    centre = smoothed(curve[0], weights, stiffness)
    for c, (steps, counts) in cells.items():
        curve[1, c] = max(middle(np.abs(steps - centre[c]), counts), least)
    wide = np.maximum(smoothed(curve[1], weights, stiffness), least)
    return {c: (float(centre[c] - spread * wide[c]), float(centre[c] + spread * wide[c])) for c in range(CLASSES)}


def fitted(docs: DataFrame, text: str = "text", rules: Rules = Rules(), spread: float = 5.0, stiffness: float = 20.0, least: float = 0.008, max_bad_chunks: float = 0.1) -> Rules:
    """The rules with limits from the ratios of all different texts and chunks of the table; an empty table gives none."""
    names = ["piece", "chunk", "class", "step"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=rules.level)
        for batch in batches:
            rows = []
            for value in batch.column(0).to_pylist():
                raw = (value or "").encode()
                words = raw.split()
                if fails(len(words), repeated_words(words), rules):
                    continue
                for chunk, piece in [(False, raw), *((True, p) for p in pieces(raw, rules))]:
                    step = len(compressor.compress(piece)) * STEPS // len(piece)
                    rows.append((xxhash.xxh64_intdigest(piece) >> 1, chunk, length_class(len(piece)), step))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64())], names=names)

    found = mapped(docs.select(docs[text].cast("string")), run, "piece long, chunk boolean, class long, step long").distinct()
    sizes: dict[tuple[bool, int], dict[int, int]] = {}
    for row in found.groupBy("chunk", "class", "step").agg(F.count("*").alias("n")).collect():  # a row per class and thousandth
        sizes.setdefault((row["chunk"], row["class"]), {})[row["step"]] = row["n"]
    limits = {}
    for chunk in (False, True):
        of_kind = {c: n for (kind, c), n in sizes.items() if kind is chunk}
        if of_kind:
            limits |= {(chunk, c): both for c, both in limits_of(of_kind, spread, stiffness, least).items()}
    return replace(rules, limits=limits, max_bad_chunks=min(rules.max_bad_chunks, max_bad_chunks))


def _struct() -> pa.StructType:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.struct([(n, kinds[k]) for n, k in (f.split() for f in FIELDS.split(", "))])


def _verdicts(column: pa.Array, rules: Rules) -> list[dict]:
    compressor = zstandard.ZstdCompressor(level=rules.level)
    return [judged(x.as_py(), rules, compressor) for x in column]


def measure(docs: DataFrame, keep: list[str], text: str = "text", into: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """The columns `keep` and a struct column `into` with every measure and the verdict, one row per document."""
    others = [c for c in keep if c not in (into, text)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(_verdicts(batch.column(len(others)), rules), _struct())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], found], names=[*others, into])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    inner = ", ".join(":".join(f.split()) for f in FIELDS.split(", "))
    source = docs.select(*(docs[c] for c in others), docs[text].cast("string").alias("__text"))
    return mapped(source, run, f"{shape}{', ' * bool(others)}`{into}` struct<{inner}>")


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([v["kept"] for v in _verdicts(batch.column(at), rules)], pa.bool_()))

    return mapped(docs, run, docs.schema)
