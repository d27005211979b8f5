import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest

from riskline.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, c string, part int, seg string, audit long, cost string"
sys.setrecursionlimit(20_000)
INITIAL = {"s": 1, "u": 2, "a": 3}


def cheapest(symbols):
    """Cost and edits by trying every edit of every state; three inserts in a row never help."""
    n = len(symbols)

    @cache
    def best(i, state, inserted):
        found = [(0, "")] if i == n and state in (0, 3) else []
        put = 3 if state == 2 else 2
        if inserted < 3:
            cost, rest = best(i, put, inserted + 1)
            found.append((cost + 3, "I" + rest))
        if i < n:
            role, fault = symbols[i] % 4, symbols[i] // 4
            cost, rest = best(i + 1, state, 0)
            found.append((cost + 4, "D" + rest))
            if fault != 2:
                extra = 3 * fault
                cost, rest = best(i + 1, put, 0)
                found.append((cost + 3 + extra, "R" + rest))
                if (state, role) in ((0, 1), (0, 2), (1, 2), (3, 2), (2, 3)):
                    cost, rest = best(i + 1, role, 0)
                    found.append((cost + extra, "K" + rest))
        return min(found, default=(10**6, ""))

    return best(0, 0, 0)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """The contract for rows after damage, turns in order, rows of one turn by role and digest."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
    seen, counts, symbols, illegal = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, [], 0
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        symbols.append(INITIAL.get(role[:1], 0) + 4 * (0 if fault is None else 1 if fault == "truncated" else 2))
    for (*_, a, _), (*_, b, _) in zip(rows, rows[1:]):
        illegal += a[:1] + b[:1] not in ("su", "ua", "au")
    cost, audit = cheapest(tuple(symbols))
    state, at, out = 0, 0, []
    for edit in audit:
        role, text = (rows[at][2], rows[at][3]) if edit in "KRD" else (None, "")
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = INITIAL[role[0]]
        out.append(f"{role}:{text}")
    turns = {t for _, t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(-1, 60)]:
        turns = rng.choice((0, 1, 2, 5, 8, 30, 200)) if conv != 7 else 700
        for turn in range(turns):
            role = rng.choice(("user", "assistant", "system", "tool", None, "")) if rng.random() < 0.2 else ("user", "assistant")[turn % 2]
            text = rng.choice((None, "", " \n", "Yes", "Done.", "Done. ", "word " * rng.randint(1, 9) + "?", "é…", "a\nb!\t"))
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice((0, 0, 0, 1)), role, text))
    rows += rows[:3] + [(3, None, None, None), (61, None, None, None), (62, 5, "user", "Hi."), (63, 1, "assistant", "x" * 100_000 + ".")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("symbols", [6, 12, 40])
def test_search_equals_trying_everything(symbols):
    rng = random.Random(symbols)
    for n in range(250):
        rows = bytes(rng.choice((1, 2, 2, 3, 3, 6, 7, 0, 4, 9, 10, 11)) for _ in range(rng.randint(0, symbols)))
        cost, audit = dialogue.search(rows)
        assert (cost, audit) == cheapest(tuple(rows)), rows


def test_least_ahead_is_never_too_high():
    rng = random.Random(5)
    for n in range(400):
        rows = bytes(rng.randrange(12) for _ in range(rng.randint(0, 14)))
        assert dialogue.least_ahead(rows)[0] <= cheapest(tuple(rows))[0]


@pytest.mark.parametrize("segment", [5, 64])
def test_equals_brute_force(spark, segment):
    """Short and long conversations, those of several segments too, with nulls, ties and copies."""
    rows = conversations(segment)
    docs = frame(spark, rows)
    hurt = dialogue.damage(docs)
    faults, segments = dialogue.edits(hurt, segment=segment)
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.summary(docs, faults, segments).collect()}
    groups = {r[0]: [] for r in rows}
    for row in damaged(rows):
        groups[row[0]].append(row)
    assert got.keys() == groups.keys()
    assert {k for k, v in groups.items() if got[k] != brute(v)} == set()
    turns = {}
    for r in dialogue.repaired_turns(segments).orderBy("part", "seg", "n").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, found in turns.items():
        assert hashlib.sha256("\n".join(found).encode()).hexdigest() == got[conv][-1]


def test_empty_table(spark):
    docs = frame(spark, [(1, 1, "user", "Hi.")]).limit(0)
    assert dialogue.summary(docs, *dialogue.edits(dialogue.damage(docs))).collect() == []


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    docs = frame(spark, [(conv, 0, "user", "Hi.")])
    got = dialogue.summary(docs, *dialogue.edits(dialogue.damage(docs))).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
