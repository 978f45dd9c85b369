"""Repair of conversations against a row-by-row search, odd rows, and segments of any size."""

import hashlib
import random
import re
import zlib

from fixtures import SMALL, none_of
from pyspark.sql import functions as F

from ticketscope.llm import repair

SHAPE = "conv_id long, turn long, role string, text string"


def initial_ok(letters):
    return re.fullmatch("(s?(ua)+)?", letters) is not None


def plain(rows):
    """Report of one conversation by keeping the best (cost, audit, lines) per state, row after row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        spoken = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not spoken else "duplicate" if (role, text) in seen else "truncated" if spoken[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserts(states):
        out = dict(states)
        for _ in range(4):
            for state, (cost, said, lines) in list(out.items()):
                role = after[state]
                new = (cost + 3, said + "I", (*lines, ({"u": "user", "a": "assistant"}[role], "")))
                out[role] = min(out.get(role, new), new)
        return out

    for (_, role, text), fault in zip(rows, faults):
        found, more = {}, 3 * (fault == "truncated")
        for state, (cost, said, lines) in inserts(best).items():
            ways = [(state, 4, "D", lines)]
            if fault not in ("blank", "duplicate"):
                to = after[state]
                ways.append((to, 3 + more, "R", (*lines, ({"u": "user", "a": "assistant"}[to], text))))
                if role[:1] == to or (state == "" and role[:1] == "s"):
                    ways.append((role[:1], more, "K", (*lines, (role, text))))
            for to, price, letter, kept in ways:
                new = (cost + price, said + letter, kept)
                found[to] = min(found.get(to, new), new)
        best = found
    cost, audit, lines = min(v for k, v in inserts(best).items() if k in ("", "a"))
    assert initial_ok("".join(r[:1] for r, _ in lines))
    repaired = "\n".join(f"{r}:{t}" for r, t in lines)
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()), lines


def expected(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: plain(r) for c, r in talks.items()}


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def many(seed, talks, longest):
    rng, rows = random.Random(seed), []
    for conv in range(talks):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No", "", " \n", None, f"So {turn}!", f"And {turn}", f"Well {turn}?\t", "Ünd…", "x" * 50_000 if turn == 3 else "ok."])
            rows.append((None if conv == 3 else conv, rng.choice([turn, turn, turn, turn // 2, None, turn + 7]), role, text))
    return rows + rows[:5]


def test_against_row_by_row(spark):
    rows = many(1, 60, 14) + many(2, 3, 400)
    df = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit(1) for c in ("copies", "seg", "audit", "digest", "kind")}).repartition(5)
    want = expected(rows)
    assert found(repair.digest(df)) == {c: w for c, (w, _) in want.items()}
    kept = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: r.place):
        kept.setdefault(r.conv_id, []).append((r.role, r.text))
    assert kept == {c: list(lines) for c, (_, lines) in want.items() if lines}


def test_segments_of_any_size(spark):
    rows = [(1, *r[1:]) for r in many(5, 40, 30)] + many(6, 4, 9)
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    want = {c: w for c, (w, _) in expected(rows).items()}
    for limit in (1, 2, 7, 1 << 20):
        read, audits = repair.analysed(df, limit=limit)
        assert {r.conv_id: tuple(r)[1:] for r in audits.collect()} == {c: w[:-1] for c, w in want.items()}, limit
    assert read.count() == len(rows)


def test_long_runs():
    # A run is taken by the powers of its matrix; step by step gives the same.
    import numpy as np

    for symbol in range(9):
        costs = slow = np.array(repair.END, np.int64)
        for n in range(1, 70):
            slow = repair.times(repair.power(symbol, 0), slow)
            assert (repair.before_run(symbol, n, costs) == slow).all()
            assert (repair.times(repair.run_matrix(symbol, n), costs) == slow).all()
    audit, state = repair.unrolled(bytes([1, 2]), np.array([500, 500]), costs, [0])[0]
    assert len(audit.replace("I", "")) == 1000 and state in range(4)


def test_damage_and_dropped_conversations(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text {t}. Is it?") for c in range(40) for t in range(3)]
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(lost + 10**6, 0, "user", "x."), (None, None, None, None)] if zlib.crc32(f"{lost + 10**6}:0".encode()) % 20 == 0 else [(lost, 0, "user", "x.")] * (lost >= 40)
    df = spark.createDataFrame(rows, SHAPE)
    after = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text or " ") if fault == 2 else text
        after += [(c, t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    want = {c: w for c, (w, _) in expected(after).items()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(repair.digest(repair.damaged(df), "copies")) == {c: want.get(c, none) for c in {r[0] for r in rows}}


def test_empty(spark):
    df = none_of(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    assert repair.digest(repair.damaged(df), "copies").count() == 0 and repair.repaired(df).count() == 0
