"""Periodic runs of words, found tile by tile and stitched over the whole document.

A run is a stretch of words with smallest period q (words q apart are alike), at least `min_periods` periods and
`min_words` words long, that no neighbouring word extends. Periods are handled by octave [2^k, 2^(k+1)). A document is
laid out in boundaries 2^(k+1) words apart, with a tile around each that overlaps its neighbours. As a run has four
periods, the first boundary inside it is followed by alike windows one period apart; hashes of windows tell at which
boundaries that can be, and those tiles are dealt over all tasks. Each is solved alone: Z-functions to both sides of the
boundary give for every period of the octave how far words stay alike. The intervals are shuffled by document and
period, stitched where they overlap by a period, and those whose period is a multiple of a smaller one of the same interval go.

Words are `[^\\x20\\x09-\\x0D]+` and alike when two 64-bit hashes agree. A null text has no words and is an empty one.
Texts are read whole at any length. Repeated rows are handled one by one and alike; an empty table gives an empty result;
columns other than the two named do not matter.
"""

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.llm import words
from ticketscope.llm.storage import stored


@dataclass(frozen=True)
class Settings:
    min_periods: int = 4  # at least 3: the first boundary in a run needs a window and a period behind it
    min_words: int = 6
    drill: bool = False  # plants runs in every tenth document, by the checksum of its id


def drilled(doc_id: object, n: int) -> tuple[int, int] | None:
    """First word and period of the run planted in a document of n words, if any."""
    mark = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if mark % 10 or not n or doc_id is None:
        return None
    start = mark // 10 % n
    return start, 1 + (n - start) // (3 + mark // 10 % 8)


def order_of(doc_id: object, n: int, settings: Settings) -> np.ndarray:
    """Which original word stands at each place."""
    order = np.arange(n)
    planted = drilled(doc_id, n) if settings.drill else None
    if planted:
        start, period = planted
        order[start:] = start + (order[start:] - start) % period
    return order


def window(octave: int, settings: Settings) -> int:
    """Least number of words that stand again one period behind the first boundary in a run of the octave.

    That boundary lies less than 2^(octave + 1) words behind the start of the run, which is `min_periods` periods and
    `min_words` words long.
    """
    low = 1 << octave
    lost = 2 * low - 1
    return max(settings.min_words - lost - (2 * low - 1), (settings.min_periods - 1) * low - lost)


def anchored(ids: np.ndarray, ends: np.ndarray, octave: int, settings: Settings) -> np.ndarray:
    """Boundaries, 2^(octave + 1) apart, behind which a window stands again at one period of the octave."""
    low = 1 << octave
    step, size = 2 * low, window(octave, settings)
    n = len(ids)
    rows = n // step
    if n < low + size:
        return np.zeros(0, np.int64)
    up, down = words.powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(ids * up[:n], out=total[1:])
    hashes = (total[size:] - total[:-size]) * down[: n + 1 - size]
    padded = np.zeros((rows + 1) * step, np.uint64)
    padded[: len(hashes)] = hashes
    grid = padded.reshape(-1, step)
    row, ahead = np.nonzero(grid[:, low:] == grid[:, :1])
    at = row * step
    fits = at + low + ahead + size <= ends[np.minimum(at, n - 1)]
    return np.unique(at[fits])


def z_function(x: list) -> list[int]:
    """How far each suffix agrees with the whole."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def solved(tile: np.ndarray, centre: int, octave: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the intervals around the tile's boundary that hold two periods of the octave."""
    before, after = tile[:centre].tolist(), tile[centre:].tolist()
    forward = z_function(after)
    found = []
    reach = min(len(after), (2 << octave) - 1)
    candidates = [q for q in range(1 << octave, reach + 1) if q < len(after) and forward[q]]
    if not candidates:
        return found
    # How far the words before the boundary agree with those before boundary + q, read backwards.
    head = after[:reach]
    backward = z_function([*reversed(before), -1, *reversed(head), *reversed(before)])
    for q in candidates:
        left = min(backward[len(before) + 1 + len(head) - q], len(before)) if before else 0
        right = q + forward[q]
        if left + right >= 2 * q:
            found.append((q, centre - left, centre + right))
    return found


TILES = "key long, doc_id {id}, text binary, plain string, n long, octave int, centre int, offset long, tile binary"


def tiles(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """Per document a row with its words' digest, or its text if it has tiles; and a row per tile."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, bounds = words.text_bytes(batch.column(2))
            for first, last in words.chunks(bounds):
                yield from solve_chunk(batch, whole, bounds, first, last)

    def solve_chunk(batch: pa.RecordBatch, whole: np.ndarray, bounds: np.ndarray, first: int, last: int) -> Iterator[pa.RecordBatch]:
        data, edges = whole[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        starts, stops = words.word_bounds(data, edges)
        ids = words.range_hashes(words.prefix_hashes(data), starts, stops) if len(starts) else np.zeros(0, np.uint64)
        limits = np.searchsorted(starts, edges)
        names = batch.column(1).slice(first, last - first).to_pylist()
        keys = batch.column(0).slice(first, last - first).to_pylist()
        order = np.arange(len(ids))
        for i in range(last - first if settings.drill else 0):
            a, b = limits[i], limits[i + 1]
            order[a:b] = a + order_of(names[i], b - a, settings)
        ids = ids[order]
        owner = np.repeat(np.arange(last - first), np.diff(limits))
        ends = limits[1:][owner]
        rows, busy = [], set()
        longest = int(np.diff(limits).max(initial=0))
        octave = 0
        while settings.min_periods << octave <= longest:
            step = 2 << octave
            for at in anchored(ids, ends, octave, settings).tolist():
                doc = int(owner[at])
                begin, end = max(int(limits[doc]), at - step), min(int(limits[doc + 1]), at + 2 * step + window(octave, settings))
                local = np.unique(ids[begin:end], return_inverse=True)[1].astype(np.int32)
                rows.append((keys[doc], None, None, None, None, octave, at - begin, begin - int(limits[doc]), local.tobytes()))
                busy.add(doc)
            octave += 1
        raw = data.tobytes()
        for i in range(last - first):
            said = raw[edges[i] : edges[i + 1]]
            n = int(limits[i + 1] - limits[i])
            plain = None if i in busy else hashlib.sha256(b" ".join(ordered(said, names[i], settings))).hexdigest()
            rows.append((keys[i], names[i], said if i in busy else None, plain, n, None, None, None, None))
        types = [pa.int64(), batch.column(1).type, pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names=[f.split()[0] for f in TILES.split(", ")])

    source = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", docs[text].cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, TILES.format(id=kind))


def ordered(raw: bytes, doc_id: object, settings: Settings) -> list[bytes]:
    """The words of a text in the order that counts."""
    said = raw.split()
    planted = drilled(doc_id, len(said)) if settings.drill else None
    if planted:
        start, period = planted
        said = [w if i < start else said[start + (i - start) % period] for i, w in enumerate(said)]
    return said


def intervals(found: DataFrame) -> DataFrame:
    """(key, period, start, end) of every tile, solved where it was dealt to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, octave, centre, offset, tile in zip(*(batch.column(i).to_pylist() for i in range(5))):
                rows += [(key, q, offset + a, offset + b) for q, a, b in solved(np.frombuffer(tile, np.int32), centre, octave)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["key", "period", "start", "end"])

    dealt = found.filter("octave is not null").select("key", "octave", "centre", "offset", "tile").repartition("key", "octave", "offset")
    return dealt.mapInArrow(run, "key long, period long, start long, end long")


def stitched(pieces: DataFrame, settings: Settings) -> DataFrame:
    """Maximal runs (key, start, length, period) from overlapping intervals."""
    sorted_ = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(sorted_.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.withColumn("opens", (before.isNull() | (F.col("start") > before - F.col("period"))).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("key", "period", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    long = joined.filter(F.col("length") >= F.greatest(F.lit(settings.min_words), settings.min_periods * F.col("period")))
    return long.groupBy("key", "start", "length").agg(F.min("period").alias("period"))


REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapsed(said: list[bytes], runs: list[dict]) -> list[bytes]:
    """Words outside every run's repeats."""
    gone = np.zeros(len(said) + 1, np.int64)
    for r in runs:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    dropped = np.cumsum(gone) > 0
    return [w for w, d in zip(said, dropped) if not d]


def analysed(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Documents with their runs: key, doc_id, n, `plain` (digest of all words) or `text` of those that may have runs, runs."""
    found = stored(tiles(docs, text, settings), "periodic-tiles")
    runs = stitched(intervals(found), settings).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    heads = found.filter("octave is null").select("key", "doc_id", "text", "plain", "n")
    quiet = heads.filter("text is null").withColumn("runs", F.lit(None).cast(RUNS))
    return heads.filter("text is not null").join(runs, "key", "left").select(*quiet.columns).unionByName(quiet)


def runs(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A row per run: doc_id, start, length, period."""
    return analysed(docs, text, settings).select("doc_id", F.inline("runs"))


def digest(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Number of runs, the run of the greatest exponent, and digests of all runs and of the words outside their repeats."""
    found = analysed(docs, text, settings)
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw, plain, listed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                listed = sorted(listed or [], key=lambda r: (r["start"], r["period"]))
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in listed)
                best = min(listed, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)
                shape = (None,) * 4 if best is None else (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"])
                if plain is None:
                    plain = hashlib.sha256(b" ".join(collapsed(ordered(raw, doc_id, settings), listed))).hexdigest()
                rows.append((doc_id, len(listed), *shape, hashlib.sha256(lines.encode()).hexdigest(), plain))
            types = [batch.column(0).type, *[pa.int64()] * 5, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names=["doc_id", *(f.split()[0] for f in REPORT.split(", "))])

    return found.select("doc_id", "text", "plain", "runs").mapInArrow(run, f"doc_id {kind}, {REPORT}")
