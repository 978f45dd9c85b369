"""Structure repair of conversations: the cheapest edits that give `(system? (user assistant)+)?`.

Every row is a symbol of its role (s, u, a, other) and first fault: a blank text, a duplicate of an earlier row's role
and text, or a truncated text. Blank and duplicate rows must be deleted. A machine of four states (nothing yet, after
the system turn, after a user, after an assistant) reads the symbols; each symbol has a 4 x 4 min-plus matrix of the
costs from state to state, insertions before the row included. Equal neighbours are one run, and a run of n rows is
taken at once with the powers of two of its matrix. Costs to the end are taken backwards over the runs; the choices are
then unrolled forwards, the least letter first: among equally cheap edits the audit is the ASCII-least.

Min-plus products can be bracketed at will, so no conversation has to fit one task: rows without their texts are sorted
over all partitions, cut into segments of at most `SEGMENT_ROWS` rows, each segment becomes one matrix, a conversation's
matrices are multiplied, and segments are unrolled apart for each state they may start in. Only the audit is one value.
Texts are shuffled once, to be read beside the audit as a stream.

Rows are taken by turn, nulls first, then role, then MD5 of the text; repeated rows are duplicates of the first. A null
role or text is one space; a row without conversation id belongs to the conversation null. A conversation all of whose
rows have `copies` 0 has no rows and gives zeros and an empty audit. An empty table gives an empty result; columns
besides conv_id, turn, role, text and `copies` are not read. Texts may be of any length.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.storage import stored

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs of the edits; CUT is what an undeleted truncated row adds
SEGMENT_ROWS = 1 << 20
STATES, FAR = 4, 1 << 40
BAD = 8  # the symbol of a row that must go; others are the class of the role, and 4 more if truncated
CLASSES = "sua"
AFTER = (2, 2, 3, 2)  # the state behind a user or assistant turn, by the state before it
END = (0, 2 * INSERT, INSERT, 0)  # cost of ending in a state, by insertions
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"
_POWERS: dict[tuple[int, int], np.ndarray] = {}
_RUNS: dict[tuple[int, int], np.ndarray] = {}
_CHOICES: dict[tuple[int, int, tuple[int, ...]], tuple[str, int]] = {}  # levels differ by a few costs, so there are few
SEGMENT = ("conv_id {id}, seg long, codes binary, lengths binary, matrix array<long>, n long, blank long, duplicate long, "
           "truncated long, illegal long, first string, last string, low long, high long, n_turns long")
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a matrix or vector."""
    return np.minimum((a[:, :, None] + b[None]).min(1), FAR) if b.ndim == 2 else np.minimum((a + b).min(1), FAR)


def moved(state: int, symbol: int) -> int | None:
    """The state after keeping a row, None where its role may not stand."""
    if symbol == BAD:
        return None
    kind = symbol & 3
    if kind == 0:
        return 1 if state == 0 else None
    return AFTER[state] if kind == (2 if state == 2 else 1) else None


def power(symbol: int, bit: int) -> np.ndarray:
    """Costs from state to state over 2**bit rows of one symbol, computed once."""
    if (symbol, bit) not in _POWERS:
        _POWERS[symbol, bit] = times(power(symbol, bit - 1), power(symbol, bit - 1)) if bit else one_row(symbol)
    return _POWERS[symbol, bit]


def one_row(symbol: int) -> np.ndarray:
    """Costs from state to state over a row and the insertions before it."""
    more = CUT if symbol & 4 else 0
    step, insert = (np.full((STATES, STATES), FAR, np.int64) for _ in range(2))
    for i in range(STATES):
        step[i, i] = DELETE
        insert[i, i] = 0
        if symbol != BAD:
            step[i, AFTER[i]] = min(step[i, AFTER[i]], REROLE + more)
            if (to := moved(i, symbol)) is not None:
                step[i, to] = min(step[i, to], KEEP + more)
    once = insert.copy()
    for i in range(STATES):
        once[i, AFTER[i]] = min(once[i, AFTER[i]], INSERT)
    for _ in range(STATES):
        insert = times(insert, once)
    return times(insert, step)


def run_matrix(symbol: int, length: int) -> np.ndarray:
    """Costs from state to state over a run, computed once."""
    if (symbol, length) not in _RUNS:
        out = None
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                out = power(symbol, bit) if out is None else times(power(symbol, bit), out)
        _RUNS[symbol, length] = out
    return _RUNS[symbol, length]


def before_run(symbol: int, length: int, costs: np.ndarray) -> np.ndarray:
    """Costs to the end before a run, from those behind it."""
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            costs = times(power(symbol, bit), costs)
    return costs


def choice(symbol: int, state: int, behind: tuple[int, ...]) -> tuple[str, int]:
    """Insertions and edit of one row, the least letters among the cheapest, and the state after it; computed once."""
    if (symbol, state, behind) not in _CHOICES:
        _CHOICES[symbol, state, behind] = cheapest(symbol, state, behind)
    return _CHOICES[symbol, state, behind]


def cheapest(symbol: int, state: int, behind: tuple[int, ...]) -> tuple[str, int]:
    before = times(power(symbol, 0), np.array(behind, np.int64))
    more, letters = (CUT if symbol & 4 else 0), ""
    while True:
        if DELETE + behind[state] == before[state]:
            return letters + "D", state
        if INSERT + before[AFTER[state]] == before[state]:
            letters, state = letters + "I", AFTER[state]
            continue
        to = moved(state, symbol)
        if to is not None and KEEP + more + behind[to] == before[state]:
            return letters + "K", to
        return letters + "R", AFTER[state]


def unrolled(codes: bytes, lengths: np.ndarray, behind: np.ndarray, starts: Iterable[int]) -> dict[int, tuple[str, int]]:
    """Edits of a segment and the state after it, by the state before it; `behind` are the costs after the segment."""
    edges = [behind]
    for symbol, length in zip(reversed(codes), reversed(lengths)):
        edges.append(before_run(symbol, int(length), edges[-1]))
    edges.reverse()
    letters, states = {s: [] for s in starts}, {s: s for s in starts}
    for at, (symbol, length) in enumerate(zip(codes, lengths)):
        inside = [edges[at + 1]]
        for _ in range(int(length) - 1):
            inside.append(times(power(symbol, 0), inside[-1]))
        for costs in reversed(inside):
            level = tuple(int(c) for c in np.minimum(costs - costs.min(), FAR))
            for s in letters:
                said, states[s] = choice(symbol, states[s], level)
                letters[s].append(said)
    return {s: ("".join(letters[s]), states[s]) for s in letters}


def _rows(turns: DataFrame, copies: str | None) -> DataFrame:
    spaced = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    return turns.select("conv_id", turns["turn"].cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), (turns[copies] if copies else F.lit(1)).cast("long").alias("copies"))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def symbols(rows: DataFrame) -> DataFrame:
    """A row per conversation, turn, role and text digest: how often it stands, its fault and whether it came earlier."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    shape = F.when(trimmed == "", 0).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 2).otherwise(1)
    narrow = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), shape.alias("shape"), "copies")
    narrow = narrow.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.max("shape").alias("shape"))
    first = narrow.filter("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull().cast("int")).alias("no_turn"))
    first = first.select(F.col("conv_id").alias("id1"), F.when(F.col("no_turn") == 0, F.col("turn")).alias("turn1"), F.col("role").alias("role1"), F.col("digest").alias("digest1"))
    same = [F.col(c).eqNullSafe(F.col(d)) for c, d in (("conv_id", "id1"), ("turn", "turn1"), ("role", "role1"), ("digest", "digest1"))]
    return narrow.join(first, same, "left").select(*narrow.columns, F.col("digest1").isNotNull().alias("first"))


def segments(found: DataFrame, limit: int = SEGMENT_ROWS) -> DataFrame:
    """Sorted symbols cut into segments: runs, one matrix and what counts need, a row each."""
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    kind = found.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, current = TaskContext.get().partitionId() << 32, None
        kinds = None

        def closed(c: dict) -> tuple:
            lengths, total = np.array(c["lengths"], np.int64), np.zeros(0, np.int64)
            for symbol, length in zip(c["codes"], c["lengths"]):
                total = run_matrix(symbol, length) if not total.size else times(total, run_matrix(symbol, length))
            return (c["conv_id"], c["seg"], bytes(c["codes"]), lengths.tobytes(), total.ravel().tolist(), int(lengths.sum()),
                    *(c[k] for k in ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "n_turns")))

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            types = [kinds, pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            kinds, done = batch.column(0).type, []
            for conv, turn, role, copies, shape, first in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if current is None or current["conv_id"] != conv or current["rows"] >= limit:
                    if current is not None:
                        done.append(closed(current))
                    current = {"conv_id": conv, "seg": seg, "codes": bytearray(), "lengths": [], "rows": 0, "blank": 0, "duplicate": 0,
                               "truncated": 0, "illegal": 0, "first": None, "last": None, "low": None, "high": None, "n_turns": 0}
                    seg += 1
                if not copies:
                    continue
                c, initial = current, role[:1]
                c["rows"] += 1
                symbol = max(0, CLASSES.find(initial) if initial in CLASSES and initial else 3) + 4 * (shape == 1)
                read = [(BAD, copies)] if shape == 0 or not first else [(symbol, 1), (BAD, copies - 1)]
                c["blank"] += copies if shape == 0 else 0
                c["duplicate"] += 0 if shape == 0 else copies - first
                c["truncated"] += int(shape == 1 and first)
                for code, times_read in read:
                    if times_read and c["codes"] and c["codes"][-1] == code:
                        c["lengths"][-1] += times_read
                    elif times_read:
                        c["codes"].append(code)
                        c["lengths"].append(times_read)
                c["illegal"] += (c["last"] is not None and c["last"] + initial not in LEGAL) + (copies - 1) * (initial * 2 not in LEGAL)
                c["first"], c["last"] = initial if c["first"] is None else c["first"], initial
                if turn is not None and turn != c["high"]:
                    c["low"], c["high"], c["n_turns"] = turn if c["low"] is None else c["low"], turn, c["n_turns"] + 1
            if done:
                yield packed(done)
        if current is not None:
            yield packed([closed(current)])

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    lines = found.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "copies", "shape", "first")
    return lines.mapInArrow(run, SEGMENT.format(id=kind))


def audits(cut: DataFrame) -> DataFrame:
    """A row per conversation from its stored segments: counts, cost and audit."""
    kind = cut.schema["conv_id"].dataType.simpleString()
    inner = ("seg", "matrix", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "n_turns")

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [p for p in sorted(parts, key=lambda p: p["seg"]) if p["n"]]
                if not parts:
                    rows.append((conv, None, True, None, *[0] * 6))
                    continue
                counts = [sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")]
                turns, low, high, last = 0, None, None, None
                for p in parts:
                    counts[3] += last is not None and last + p["first"] not in LEGAL
                    last = p["last"]
                    if p["low"] is not None:
                        turns += p["n_turns"] - (p["low"] == high)
                        low, high = p["low"] if low is None else low, p["high"]
                gaps = 0 if low is None else high - low + 1 - turns
                costs, after = np.array(END, np.int64), []
                for p in reversed(parts):
                    after.append(costs)
                    costs = times(np.array(p["matrix"], np.int64).reshape(STATES, STATES), costs)
                for i, (p, behind) in enumerate(zip(parts, reversed(after))):
                    rows.append((conv, p["seg"], i == 0, behind.tolist(), gaps, *counts, int(costs[0])))
            types = [batch.column(0).type, pa.int64(), pa.bool_(), pa.list_(pa.int64()), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names=["conv_id", "part", "leads", "behind", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"])

    def unroll(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for codes, lengths, behind, leads in zip(*(batch.column(n).to_pylist() for n in ("codes", "lengths", "behind", "leads"))):
                if behind is None:
                    pieces.append([])
                    continue
                found = unrolled(codes, np.frombuffer(lengths, np.int64), np.array(behind, np.int64), [0] if leads else range(STATES))
                pieces.append([{"start": s, "edits": e, "state": t} for s, (e, t) in found.items()])
            kept = [batch.column(n) for n in ("conv_id", "seg", *counts)]
            shape = pa.list_(pa.struct([("start", pa.int32()), ("edits", pa.string()), ("state", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pieces, shape)], names=["conv_id", "seg", *counts, "pieces"])

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for parts in batch.column("parts").to_pylist():
                state, edits = 0, []
                for part in sorted(parts, key=lambda p: -1 if p["seg"] is None else p["seg"]):
                    for piece in part["pieces"]:
                        if piece["start"] == state:
                            edits.append(piece["edits"])
                            state = piece["state"]
                            break
                said.append("".join(edits) + "I" * (END[state] // INSERT))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("conv_id", *counts)), pa.array(said, pa.string())], names=["conv_id", *counts, "audit"])

    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    numbers = ", ".join(f"{c} long" for c in counts)
    heads = cut.groupBy("conv_id").agg(F.collect_list(F.struct(*inner)).alias("parts"))
    behind = heads.mapInArrow(combine, f"conv_id {kind}, part long, leads boolean, behind array<long>, {numbers}")
    joined = behind.join(cut.select("seg", "codes", "lengths"), behind["part"] == cut["seg"], "left")
    done = joined.mapInArrow(unroll, f"conv_id {kind}, seg long, {numbers}, pieces array<struct<start:int,edits:string,state:int>>")
    whole = done.groupBy("conv_id", *counts).agg(F.collect_list(F.struct("seg", "pieces")).alias("parts"))
    return whole.mapInArrow(chain, f"conv_id {kind}, {REPORT}").select("conv_id", *(f.split()[0] for f in REPORT.split(", ")))


class Edits:
    """Reads the rows of conversations beside their audits; `take` gives what each step leaves."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, bytes, bytes]]:
        """Insertions that stand next in the audit."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = b"assistant" if self.state == 2 else b"user"
            self.at, self.state = self.at + 1, AFTER[self.state]
            yield "I", role, b""

    def take(self, role: bytes, text: bytes) -> Iterator[tuple[str, bytes, bytes]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = 1 if role.startswith(b"s") else AFTER[self.state]
            yield "K", role, text
        elif letter == "R":
            kept = b"assistant" if self.state == 2 else b"user"
            self.state = AFTER[self.state]
            yield "R", kept, text


def _beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Conversations whole and in order, each behind its audit."""
    names = [f.split()[0] for f in REPORT.split(", ")]
    texts = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), _digest("text").alias("digest"), "copies", F.lit(None).cast(found.select(F.struct(*names)).schema[0].dataType).alias("report"))
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(b"").alias("role"), F.lit(b"").alias("text"), F.lit(b"").alias("digest"), F.lit(1).cast("long").alias("copies"), F.struct(*names).alias("report"))
    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    both = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "kind", "turn", "role", "text", "copies", "report")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch end, conv_id, report or None, edits of the step, turn) of every step; the last step of a conversation is ('end')."""
    conv = report = edits = None
    for batch in batches:
        for c, kind, turn, role, text, copies, head in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if kind == 0:
                if edits is not None:
                    yield conv, report, None, [*edits.inserted()], True
                conv, report, edits = c, head, Edits(head["audit"])
                continue
            for _ in range(copies):
                yield conv, None, turn, [*edits.take(role, text)], False
    if edits is not None:
        yield conv, report, None, [*edits.inserted()], True


def analysed(turns: DataFrame, copies: str | None = None, limit: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows as read, and the report (counts, cost, audit) of every conversation."""
    rows = _rows(turns, copies)
    return rows, audits(stored(segments(symbols(rows), limit), "repair-segments"))


def repaired(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired conversations: a row per turn that stands, with its place, the edit and the turn it came from."""
    rows, found = analysed(turns, copies)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, size, kinds = [], 0, 0, None

        def typed(steps: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in steps:
                kinds = batch.column(0).type
                yield batch

        def packed() -> pa.RecordBatch:
            types = [kinds, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), types)], names=["conv_id", "place", "turn", "role", "text", "edit"])

        for conv, _, turn, steps, last in _read(typed(batches)):
            for edit, role, text in steps:
                out.append((conv, place, None if edit == "I" else turn, role.decode(), text.decode(), edit))
                place, size = place + 1, size + len(text)
            if last:
                place = 0
            if size > 1 << 22 or len(out) >= 4096:
                yield packed()
                out, size = [], 0
        if out:
            yield packed()

    return _beside(rows, found).mapInArrow(run, f"conv_id {kind}, place long, turn long, role string, text string, edit string")


def digest(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """Report of every conversation and the hash of its repaired `role:text` lines."""
    rows, found = analysed(turns, copies)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = [f.split()[0] for f in REPORT.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, hashed, any_line, kinds = [], hashlib.sha256(), False, None

        def typed(steps: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in steps:
                kinds = batch.column(0).type
                yield batch

        def packed() -> pa.RecordBatch:
            types = [kinds, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), types)], names=["conv_id", *names, "repaired_sha256"])

        for conv, report, _, steps, last in _read(typed(batches)):
            for _, role, text in steps:
                hashed.update(b"\n" * any_line + role + b":" + text)
                any_line = True
            if last:
                out.append((conv, *(report[n] for n in names), hashed.hexdigest()))
                hashed, any_line = hashlib.sha256(), False
                if len(out) >= 4096:
                    yield packed()
                    out = []
        if out:
            yield packed()

    fields = f"conv_id {kind}, {REPORT}, repaired_sha256 string"
    return _beside(rows, found).mapInArrow(run, fields)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with planted faults, by the checksum of conversation and turn: dropped (copies 0), emptied, unfinished, repeated, rerolled."""
    spaced = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(fault == 4, "user").otherwise(spaced("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
