"""Repair of conversation structure by iterative-deepening A*.

A conversation is laid out by turn and read as a string of row symbols (the initial of the role and
the first fault). Edits keep, rerole or delete a row or insert one; the cheapest edits that
give role initials ``(s?(ua)+)?`` are searched depth first, edits in ASCII order, under a rising
cost bound. A table remembers for every state (row, last role) how much it is known to cost at
least, so a state that failed is entered again only with more to spend; the first path that is
accepted is the answer.

Rows are sorted by a range exchange on conversation and turn, which splits a conversation of any
length over tasks, and cut into segments. Short conversations are one segment and one search. For the
others every segment is searched from each role that may stand before it to each that may stand
at its end; choosing among those by cost, then by ASCII order, gives the same edits as one search,
as no segment's edits begin another's from the same start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.text import batches
from riskline.session import materialize, ship

ship(__name__)

SEGMENT = 64
# Segments that one task searches, and that Python holds at once with their texts.
SEARCHES = 2_000
BATCH = 500
WHITE_ONLY = r"^[\x20\x09-\x0D]*$"
ENDS_WHOLE = r"[.!?][\x20\x09-\x0D]*$"
# Row symbols: initial (0 any other, 1 s, 2 u, 3 a) + 4 * fault (0 none, 1 truncated, 2 has to go).
OTHER, S, U, A = range(4)
TRUNCATED, GONE = 1, 2
# States: the last role placed, 0 for none. What follows it, and where that leads.
PLACED = (U, U, A, U)
LEGAL = {(0, S): S, (0, U): U, (S, U): U, (A, U): U, (U, A): A}
FINAL = (0, A)
ROLES = {U: "user", A: "assistant"}
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {REROLE: 3, DELETE: 4, INSERT: 3, TRUNCATED: 3}


def _moves(symbol: int | None) -> list[list[tuple[str, int, int, int]]]:
    """For each state the edits in ASCII order: (initial, cost, rows passed, next state)."""
    out = []
    for state in range(4):
        found = []
        if symbol is not None:
            role, fault = symbol % 4, symbol // 4
            extra = COSTS[TRUNCATED] if fault == TRUNCATED else 0
            found.append((DELETE, COSTS[DELETE], 1, state))
            if fault != GONE:
                if (state, role) in LEGAL:
                    found.append((KEEP, extra, 1, LEGAL[state, role]))
                found.append((REROLE, COSTS[REROLE] + extra, 1, PLACED[state]))
        found.append((INSERT, COSTS[INSERT], 0, PLACED[state]))
        out.append(sorted(found))
    return out


MOVES = [_moves(symbol) for symbol in range(12)]
AT_END = _moves(None)
NO_MOVES: list[list] = [[], [], [], []]


def least_ahead(symbols: bytes) -> list[float]:
    """For every row a cost that the rows from it on cannot go below.

    What a row costs whatever is done to it, and a share for every two neighbours that cannot both
    stay: editing either or a row between them pays for it, and no edit pays for more than its cost.
    """
    out = [0.0] * (len(symbols) + 1)
    follows = None
    for i in range(len(symbols) - 1, -1, -1):
        role, fault = symbols[i] % 4, symbols[i] // 4
        if fault == GONE:
            # A row that has to go lets its neighbours meet; it is no end of a pair.
            out[i] = out[i + 1] + COSTS[DELETE]
            continue
        own = COSTS[TRUNCATED] if fault == TRUNCATED else 0
        if role == OTHER:
            own = min(COSTS[REROLE] + own, COSTS[DELETE])
        pair = 0.0
        if follows is not None and role != OTHER and follows[0] != OTHER and LEGAL.get((role, follows[0])) is None:
            pair = 0.5 if TRUNCATED in (fault, follows[1]) else 1.5
        out[i] = out[i + 1] + own + pair
        follows = (role, fault)
    return out


def _reachable(symbols: bytes, entry: int, goals: tuple[int, ...], last: bool) -> bool:
    states = {entry}
    for symbol in symbols:
        opened = set(states)
        for _ in range(3):
            opened |= {PLACED[s] for s in opened}
        states = {move[3] for s in opened for move in MOVES[symbol][s] if move[2]}
    if last:
        for _ in range(3):
            states |= {PLACED[s] for s in states}
    return bool(states & set(goals))


def search(symbols: bytes, entry: int = 0, goals: tuple[int, ...] = FINAL, last: bool = True) -> tuple[int, str] | None:
    """Cost and edits of the cheapest way through the rows from a state to one of ``goals``.

    The ASCII-least of equally cheap ones. Rows are inserted in front of a row and, in the ``last`` segment,
    at the end. None where no edits lead there.
    """
    if not _reachable(symbols, entry, goals, last):
        return None
    n = len(symbols)
    ahead = least_ahead(symbols)
    tail = AT_END if last else NO_MOVES
    moves = [MOVES[s] for s in symbols] + [tail]
    known: dict[tuple[int, int], float] = {}
    bound = ahead[0]
    while True:
        path: list[str] = []
        # Row, state, what may be spent from here, next edit, least that is known to be missing.
        stack = [[0, entry, bound, 0, inf]]
        while stack:
            frame = stack[-1]
            i, state, left, k, _ = frame
            if i == n and state in goals and k == 0:
                spent = bound - left
                return int(spent), "".join(path)
            here = moves[i][state]
            if k < len(here):
                frame[3] += 1
                edit, cost, step, to = here[k]
                need = known.get((i + step, to))
                need = cost + (ahead[i + step] if need is None else need)
                if need > left:
                    frame[4] = min(frame[4], need)
                else:
                    path.append(edit)
                    stack.append([i + step, to, left - cost, 0, inf])
                continue
            stack.pop()
            known[i, state] = max(frame[4], known.get((i, state), 0))
            if stack:
                path.pop()
                # The edit that led here, and what is still missing after it.
                edit = moves[stack[-1][0]][stack[-1][1]][stack[-1][3] - 1]
                stack[-1][4] = min(stack[-1][4], edit[1] + frame[4])
            else:
                bound = frame[4]


def applied(audit: str, roles: list[str], texts: list[str], entry: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that the edits leave, in order."""
    state, at = entry, 0
    for edit in audit:
        if edit == DELETE:
            at += 1
            continue
        if edit == KEEP:
            role, text = roles[at], texts[at]
            state = LEGAL[state, _initial(role)]
        else:
            state = PLACED[state]
            role, text = ROLES[state], "" if edit == INSERT else texts[at]
        at += edit != INSERT
        yield edit, role, text


def _initial(role: str) -> int:
    return {"s": S, "u": U, "a": A}.get(role[:1], OTHER)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` with faults put in by a hash of conversation and turn; nulls count as one space.

    Of twenty hashes 0 drops the row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it and
    4 makes it the user's. Only the four columns come back.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    texts = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text))
    out = rows.where(kind != 0).select(
        F.col(conv),
        F.col(turn),
        F.when(kind == 4, "user").otherwise(filled(role)).alias(role),
        texts.alias(text),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("again"),
    )
    return out.drop("again")


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for equal rows: conversation (c, none), turn, role, text, fault of the first, copies."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    plain = rows.select(
        F.coalesce(F.col(conv).cast("long"), F.lit(0)).alias("c"),
        F.col(conv).isNull().alias("none"),
        F.col(turn).cast("long").alias("turn"),
        filled(role).alias("role"),
        filled(text).alias("text"),
    )
    # The digest stands for the text in keys, so texts move only where rows are equal or sorted.
    plain = plain.groupBy("c", "none", "turn", "role", F.md5("text").alias("h")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    plain = materialize(plain, "dialogue-rows")
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    said = plain.groupBy("c", "none", "role", "h").agg(F.min(place).alias("opening"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = plain.join(materialize(said, "dialogue-said"), ["c", "none", "role", "h"], "left")
    blank = F.col("text").rlike(WHITE_ONLY)
    again = F.col("opening").isNotNull() & (place != F.col("opening"))
    cut = ~F.col("text").rlike(ENDS_WHOLE)
    fault = F.when(blank, "blank").when(again, "duplicate").when(cut, "truncated").otherwise("none")
    return joined.select("c", "none", "turn", "role", "h", "text", "copies", fault.alias("fault"))


def _segments(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Segments of sorted rows: symbols, roles and texts; copies of a row are rows that have to go."""
    part, number, open_ = TaskContext.get().partitionId(), 0, None
    done: list[tuple] = []

    def close() -> None:
        nonlocal open_, number
        if open_ is not None:
            key, symbols, roles, texts = open_
            done.append((*key, part, number, bytes(symbols), roles, texts))
            number += 1
        open_ = None

    columns = ["c", "none", "part", "seg", "symbols", "roles", "texts"]
    for frame in frames:
        for c, none, role, text, copies, fault in frame[["c", "none", "role", "text", "copies", "fault"]].itertuples(index=False):
            key, initial = (c, none), _initial(role)
            for n in range(copies):
                if open_ is None or open_[0] != key or len(open_[1]) >= size:
                    close()
                    if len(done) >= 1000:
                        yield pd.DataFrame(done, columns=columns)
                        done.clear()
                    open_ = (key, bytearray(), [], [])
                goes = n > 0 or fault in ("blank", "duplicate")
                open_[1].append(initial + 4 * (GONE if goes else TRUNCATED if fault == "truncated" else 0))
                open_[2].append(role)
                open_[3].append("" if goes else text)
        if done:
            yield pd.DataFrame(done, columns=columns)
            done.clear()
    close()
    yield pd.DataFrame(done, columns=columns)


def _illegal(symbols: bytes) -> int:
    return sum((a % 4, b % 4) not in ((S, U), (U, A), (A, U)) for a, b in zip(symbols, symbols[1:]))


def _searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole conversations: their edits. Segments: those for every first and last state."""
    for frame in frames:
        out = []
        for key in frame.itertuples(index=False):
            symbols = bytes(key.symbols)
            alone = key.first and key.last
            entries = (0,) if key.first else range(4)
            ends = (FINAL,) if key.last else [(s,) for s in range(4)]
            known = {}
            for entry in entries:
                for goals in ends:
                    if not alone and (symbols, entry, goals) in known:
                        continue
                    found = search(symbols, entry, goals, key.last)
                    if found:
                        out.append((key.c, key.none, key.part, key.seg, alone, entry, -1 if key.last else goals[0], *found, _illegal(symbols), symbols[0] % 4, symbols[-1] % 4))
        yield pd.DataFrame(out, columns=["c", "none", "part", "seg", "alone", "entry", "leaves", "cost", "audit", "illegal", "head", "tail"])


def _chosen(frame: pd.DataFrame) -> pd.DataFrame:
    """The ways through the segments of one conversation that are cheapest together."""
    order = frame.sort_values(["part", "seg"], kind="stable")
    segments = [g for _, g in order.groupby(["part", "seg"], sort=True)]
    ahead: dict[int, tuple[int, tuple]] = {-1: (0, ())}
    best: list[dict[int, tuple]] = []
    for segment in reversed(segments):
        now: dict[int, tuple] = {}
        for way in segment.itertuples(index=False):
            if way.leaves in ahead:
                total = (way.cost + ahead[way.leaves][0], way.audit)
                if way.entry not in now or total < now[way.entry][:2]:
                    now[way.entry] = (*total, way)
        best.append(now)
        ahead = {entry: (x[0], ()) for entry, x in now.items()}
    out, state, before = [], 0, None
    for now in reversed(best):
        way = now[state][2]
        edge = before is not None and (before, way.head) not in ((S, U), (U, A), (A, U))
        out.append((way.c, way.none, way.part, way.seg, way.entry, way.cost, way.audit, way.illegal + edge))
        state, before = way.leaves, way.tail
    return pd.DataFrame(out, columns=["c", "none", "part", "seg", "entry", "cost", "audit", "illegal"])


SEG = "c long, none boolean, part int, seg long"
WAYS = f"{SEG}, alone boolean, entry int, leaves int, cost long, audit string, illegal long, head int, tail int"


def edits(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT
) -> tuple[DataFrame, DataFrame]:
    """(rows with their faults, segments with the edits of each): two written tables.

    A null role or text is one space; rows without a turn come first; rows of one turn are ordered by role
    and a digest of the text; rows that are equal in all of these stand together and all but
    the first are duplicates. A null conversation is one like others. Any role is told by its initial, an empty
    one has none and cannot stay. Other columns are not looked at. Texts of any length are moved,
    never searched; an empty table gives empty tables.

    A conversation takes 16 bytes a row in the task that chooses among its segments, and nothing
    else of it has to fit anywhere.
    """
    faults = materialize(_prepared(rows, conv, turn, role, text), "dialogue-faults")
    laid = faults.repartitionByRange("c", "none", F.col("turn").asc_nulls_first(), "role", "h")
    laid = laid.sortWithinPartitions("c", "none", F.col("turn").asc_nulls_first(), "role", "h")
    laid = laid.select("c", "none", "role", "text", "copies", "fault")
    cut = laid.mapInPandas(lambda x: _segments(x, segment), f"{SEG}, symbols binary, roles array<string>, texts array<string>")
    cut = materialize(cut, "dialogue-segments")
    place = F.struct("part", "seg")
    ends = materialize(cut.groupBy("c", "none").agg(F.min(place).alias("lo"), F.max(place).alias("hi")), "dialogue-ends")
    asked = cut.select("c", "none", "part", "seg", "symbols").join(ends, ["c", "none"])
    asked = asked.select("c", "none", "part", "seg", "symbols", (place == F.col("lo")).alias("first"), (place == F.col("hi")).alias("last"))
    # Searches are what takes time: spread them by row, not by the size of the files.
    spread = cut.count() // SEARCHES + 1
    ways = materialize(asked.repartition(spread, "c", "none", "part", "seg").mapInPandas(_searched, WAYS), "dialogue-ways")
    columns = ["c", "none", "part", "seg", "entry", "cost", "audit", "illegal"]
    joint = ways.where("NOT alone").groupBy("c", "none").applyInPandas(_chosen, f"{SEG}, entry int, cost long, audit string, illegal long")
    chosen = ways.where("alone").select("alone", *columns).unionByName(joint.select(F.lit(False).alias("alone"), *columns))
    return faults, materialize(cut.join(chosen, ["c", "none", "part", "seg"]), "dialogue-edits")


def _turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = [
            (x.c, x.none, x.part, x.seg, n, *turn)
            for x in frame.itertuples(index=False)
            for n, turn in enumerate(applied(x.audit, list(x.roles), list(x.texts), x.entry))
        ]
        yield pd.DataFrame(out, columns=["c", "none", "part", "seg", "n", "edit", "role", "text"])


def repaired_turns(segments: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The repaired conversations: conversation, part, seg, n (their order), edit, role, text."""
    turns = segments.mapInPandas(_turns, f"{SEG}, n int, edit string, role string, text string")
    return turns.select(F.when(~F.col("none"), F.col("c")).alias(conv), "part", "seg", "n", "edit", "role", "text")


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits and digest of conversations whose segments come in order, a segment at a time."""
    key, digest, audit, empty = None, None, [], True
    columns = ["c", "none", "audit", "repaired_sha256"]
    for frame in frames:
        out = []
        for x in frame.itertuples(index=False):
            if key != (x.c, x.none):
                if key is not None:
                    out.append((*key, "".join(audit), digest.hexdigest()))
                key, digest, audit, empty = (x.c, x.none), hashlib.sha256(), [], True
            audit.append(x.audit)
            for _, role, text in applied(x.audit, list(x.roles), list(x.texts), x.entry):
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        if out:
            yield pd.DataFrame(out, columns=columns)
    if key is not None:
        yield pd.DataFrame([(*key, "".join(audit), digest.hexdigest())], columns=columns)


def summary(rows: DataFrame, faults: DataFrame, segments: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row per conversation of ``rows``: gaps, faults, illegal neighbours, cost, edits and digest.

    Conversations without a row in ``faults`` have zeros, no edits and the digest of nothing. The digest is
    over the repaired rows in order, so each conversation's text is read by one task, a segment at a time.
    """
    def count(fault: str, extra: Column) -> Column:
        return F.sum(F.when(F.col("fault") == fault, F.col("copies")).otherwise(extra)).alias(fault)

    zero = F.lit(0).cast("long")
    # Copies of a row are duplicates, unless the row is blank: then they are blank like it.
    stats = faults.groupBy("c", "none").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        count("blank", zero),
        F.sum(F.when(F.col("fault") == "blank", zero).when(F.col("fault") == "duplicate", F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum((F.col("fault") == "truncated").cast("long")).alias("truncated"),
    )
    costs = segments.groupBy("c", "none").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("inner"))
    short = segments.where("alone")
    long = segments.where("NOT alone").repartition("c", "none").sortWithinPartitions("c", "none", "part", "seg")
    read = [s.select("c", "none", "entry", "audit", "roles", "texts").mapInPandas(_hashed, "c long, none boolean, audit string, repaired_sha256 string") for s in (short, long)]
    with batches(rows.sparkSession, BATCH):
        read = materialize(read[0].unionByName(read[1]), "dialogue-digests")
    found = stats.join(costs, ["c", "none"]).join(read, ["c", "none"])
    every = rows.select(F.coalesce(F.col(conv).cast("long"), F.lit(0)).alias("c"), F.col(conv).isNull().alias("none")).distinct()
    out = every.join(found, ["c", "none"], "left")
    return out.select(
        F.when(~F.col("none"), F.col("c")).alias(conv),
        *[F.coalesce(name, zero).alias(name) for name in ("gaps", "blank", "duplicate", "truncated")],
        F.coalesce("inner", zero).alias("illegal"),
        F.coalesce("cost", zero).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op13_conversation_repair(spark, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    faults, segments = edits(damage(rows))
    return summary(rows, faults, segments)
