"""Risk scoring of a stream from what a user's history adds up to.

A user's state holds counts, sums and last values, whatever the history's length, so a batch costs its own
rows: the sums of the entropy, last rows, the failures and resources that windows still reach,
the devices, addresses and resources seen, and the lengths of the runs of night and day events, from
which the night share of each half of the history follows. Addresses keep users that logged in
from them, as many as the rule asks for. Users and addresses are dealt to buckets, as in ``keyed``. Batch features and rules over the whole history up to a batch give the same columns for its
rows, as far as batches come in order of time.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import asdict
from math import log, log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskline.config import RuleConfig
from riskline.functions import scalar as S
from riskline.operators import rules as R
from riskline.operators.features import event_type_onehot, temporal_features
from riskline.plans.scoring import ScoringModel
from riskline.schema import FEATURES, TRANSITIONS
from riskline.session import ship
from riskline.streaming.jobs import _each_batch, _write
from riskline.streaming.keyed import INLINE, _bucket, _keyed, _plain, named

ship(__name__)

HIT_NAMES = ("brute_force_login", "impossible_travel", "lateral_movement", "device_spoofing", "low_and_slow_exfiltration", "insider_drift")
# What a row gets from its user's state, as DDL.
GIVEN = (
    "event_id string, events_in_window long, unique_ips long, unique_devices long, unique_resources long, _logins long, _failed long, "
    "total_bytes_user long, max_bytes_user long, event_type_entropy double, seconds_since_prev double, seconds_since_prev_same_type double, "
    "cumulative_event_count long, is_first_event_of_day int, is_last_event_of_day int, _prev_type string, cumulative_devices_seen long, "
    "is_new_device int, is_new_ip int, prefix array<string>, " + ", ".join(f"hit_{n} boolean" for n in HIT_NAMES)
)
NAMES = [part.split()[0] for part in GIVEN.split(", ")]
# What the state takes from a row.
Event = namedtuple(
    "Event", "user_id at day night login transfer event_id event_type source_ip device_id resource success bytes_transferred"
)


class Addresses(StatefulProcessor):
    """Adds to rows how many users have logged in from their address by the end of the batch, up to ``enough``.

    Only logins need the number. ``columns`` names the frames' columns; Spark renames those that begin with an
    underscore.
    """

    def __init__(self, columns: list[str], enough: int):
        self.columns, self.enough = columns, enough

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getMapState("users", "address string", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [f.set_axis(self.columns, axis=1) for f in rows]
        came: dict[str, set] = {}
        for frame in frames:
            some = frame[frame["_login"] & frame["source_ip"].notna()]
            for address, user in zip(some["source_ip"], _plain(some["user_id"])):
                mine = came.setdefault(address, set())
                if user is not None and len(mine) < self.enough:
                    mine.add(user)
        counts = {}
        for address, users in came.items():
            stored = self.users.getValue((named(address),))
            known = [] if stored is None else json.loads(stored[0])
            more = [u for u in users if u not in known][: max(self.enough - len(known), 0)]
            if more:
                known += more
                self.users.updateValue((named(address),), (json.dumps(known),))
            counts[address] = len(known)
        for frame in frames:
            yield frame.assign(_users=[counts.get(a, 0) for a in _plain(frame["source_ip"])])

    def close(self) -> None:
        pass


class History(StatefulProcessor):
    """The stateful columns of a user's rows beside the events' own; rows of a batch are taken in order of time and id."""

    def __init__(self, cfg: dict, order: int, columns: list[str], names: list[str]):
        self.cfg, self.order, self.columns, self.names = cfg, order, columns, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A user's entry holds sums, last values and up to INLINE names of things seen; the others have entries of
        # their own. i: addresses, d: devices, r: resources, l: devices of logins, each with a value behind it.
        self.facts = handle.getMapState("facts", "user string", "json string")
        self.seen = handle.getMapState("seen", "user string, name string", "n int")

    def _fresh(self, kind: str, value) -> bool:
        """Whether the value is seen for the first time, which is remembered."""
        name = f"{kind}0" if value is None else f"{kind}={value}"
        if name in self._known:
            return False
        if self._more and self.seen.containsKey((self._who, name)):
            return False
        if len(self._known) < INLINE:
            self._known[name] = 1
        else:
            self._more = True
            self.seen.updateValue((self._who, name), (1,))
        return True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat([f.set_axis(self.names, axis=1) for f in rows], ignore_index=True)
        columns = [_plain(own[c]) for c in Event._fields]
        for whole in ("at", "bytes_transferred"):
            i = Event._fields.index(whole)
            columns[i] = [None if v is None else int(v) for v in columns[i]]
        users: dict = {}
        for place, event in enumerate(map(Event._make, zip(*columns))):
            users.setdefault(event.user_id, []).append((place, event))
        out, places = [], []
        for user, events in users.items():
            events.sort(key=lambda e: (e[1].at is not None, e[1].at or 0, e[1].event_id or ""))
            places += [place for place, _ in events]
            out += self._user(named(user), [e for _, e in events])
        frame = pd.DataFrame(out, columns=NAMES)
        for column in ("total_bytes_user", "max_bytes_user"):
            frame[column] = frame[column].astype("Int64")
        carried = own[[*self.columns, "_users"]].iloc[places].reset_index(drop=True)
        yield pd.concat([frame, carried.rename(columns={c: f"e_{c}" for c in self.columns})], axis=1)

    def _user(self, who: str, events: list) -> list[dict]:
        stored = self.facts.getValue((who,))
        state = json.loads(stored[0]) if stored is not None else {
            "n": 0, "ips": 0, "devices": 0, "resources": 0, "logins": 0, "failed": 0, "bytes": None, "largest": None, "clogc": 0.0,
            "types": {}, "last_of": {}, "last": None, "day": None, "type": None, "login": None, "fails": [], "recent": {}, "moved": {},
            "runs": [], "prefix": [], "seen": [], "more": False,
        }
        self._who, self._known, self._more = who, dict.fromkeys(state["seen"], 1), state["more"]
        out, i = [], 0
        while i < len(events):
            j = i + 1
            while j < len(events) and events[j].at == events[i].at:
                j += 1
            self._instant(state, events[i:j])
            out += [self._row(state, e) for e in events[i:j]]
            i = j
        # Rows of days the stream has left are in no later total.
        days = {str(e.day) for e in events} | {str(state["day"])}
        half, nights = self._halves(state["runs"])
        for n, (e, row) in enumerate(zip(events, out)):
            later = events[n + 1] if n + 1 < len(events) else None
            row |= {
                "events_in_window": state["n"], "unique_ips": state["ips"], "unique_devices": state["devices"], "unique_resources": state["resources"],
                "_logins": state["logins"], "_failed": state["failed"], "total_bytes_user": state["bytes"], "max_bytes_user": state["largest"],
                "is_last_event_of_day": int(later is None or later.day is None or later.day != e.day),
                "hit_low_and_slow_exfiltration": bool(e.transfer) and state["moved"].get(str(e.day), 0) > self.cfg["exfiltration_kb"] * 1024,
                "hit_insider_drift": state["n"] >= self.cfg["drift_min_events"] and row["cumulative_event_count"] > half and e.night == 1
                and half > 0 and nights[1] / (state["n"] - half) > nights[0] / half + self.cfg["drift_rate_increase"],
            }
        state["moved"] = {d: b for d, b in state["moved"].items() if d in days}
        state["seen"], state["more"] = list(self._known), self._more
        self.facts.updateValue((who,), (json.dumps(state),))
        return out

    def _instant(self, state: dict, events: list) -> None:
        """What rows of one instant see of each other: failures and resources."""
        at = events[0].at
        if at is None:
            return
        fails = [at for e in events if e.login and e.success is False]
        state["fails"] = [*state["fails"], *fails][-self.cfg["brute_force_failures"] :]
        state["recent"] |= {e.resource: at for e in events if e.resource is not None}
        span = self.cfg["lateral_hours"] * R.HOUR
        state["recent"] = {r: t for r, t in state["recent"].items() if t >= at - span}

    def _row(self, state: dict, e) -> dict:
        kind = "0" if e.event_type is None else f"={e.event_type}"
        state["n"] += 1
        count = state["types"].get(kind, 0) + 1
        state["types"][kind] = count
        state["clogc"] += count * log2(count) - ((count - 1) * log2(count - 1) if count > 1 else 0.0)
        entropy = log2(state["n"]) - state["clogc"] / state["n"] - len(state["types"]) * S.LOG_FLOOR / log(2.0)
        gap, own_gap = (-1.0 if e.at is None or t is None else (e.at - t) / float(S.MICROS) for t in (state["last"], state["last_of"].get(kind)))
        new_ip = e.source_ip is not None and self._fresh("i", e.source_ip)
        new_device = e.device_id is not None and self._fresh("d", e.device_id)
        state["ips"] += new_ip
        state["devices"] += new_device
        state["resources"] += e.resource is not None and self._fresh("r", e.resource)
        if e.bytes_transferred is not None:
            moved = int(e.bytes_transferred)
            state["bytes"] = (state["bytes"] or 0) + moved
            state["largest"] = moved if state["largest"] is None else max(state["largest"], moved)
            if e.transfer and e.day is not None:
                state["moved"][str(e.day)] = state["moved"].get(str(e.day), 0) + moved
        login, before = bool(e.login), state["login"]
        fails, need = state["fails"], self.cfg["brute_force_failures"]
        soon = before is not None and e.at is not None and before[0] is not None and 0 < e.at - before[0] < self.cfg["travel_max_hours"] * R.HOUR
        # Lateral movement looks at any row, the others at logins.
        row = {
            "event_id": e.event_id, "event_type_entropy": entropy, "seconds_since_prev": gap, "seconds_since_prev_same_type": own_gap,
            "cumulative_event_count": state["n"], "is_first_event_of_day": int(state["day"] is None or e.day is None or state["day"] != e.day),
            "_prev_type": state["type"], "cumulative_devices_seen": state["devices"], "is_new_device": int(new_device), "is_new_ip": int(new_ip),
            "prefix": list(state["prefix"]) if len(state["prefix"]) == self.order else None,
            "hit_brute_force_login": login and e.at is not None and len(fails) == need and fails[0] >= e.at - self.cfg["brute_force_minutes"] * R.MINUTE,
            "hit_impossible_travel": login and soon and None not in (e.source_ip, before[1]) and e.source_ip != before[1],
            "hit_lateral_movement": e.at is not None and len(state["recent"]) >= self.cfg["lateral_resources"],
            "hit_device_spoofing": login and self._fresh("l", e.device_id) and before is not None,
        }
        if login:
            state["logins"] += 1
            state["failed"] += e.success is False
            state["login"] = [e.at, e.source_ip]
        state["last"], state["last_of"][kind], state["day"], state["type"] = e.at, e.at, e.day, e.event_type
        state["prefix"] = [*state["prefix"], e.event_type][-self.order :]
        night = int(e.night or 0)
        if state["runs"] and state["runs"][-1][0] == night:
            state["runs"][-1][1] += 1
        else:
            state["runs"].append([night, 1])
        return row

    @staticmethod
    def _halves(runs: list) -> tuple[int, tuple[int, int]]:
        """Events in the first half, and the night events in it and after it."""
        half, at, first, rest = sum(n for _, n in runs) // 2, 0, 0, 0
        for night, n in runs:
            inside = min(max(half - at, 0), n)
            first += night * inside
            rest += night * (n - inside)
            at += n
        return half, (first, rest)

    def close(self) -> None:
        pass


def risk_scores(events: DataFrame, out: str, model: ScoringModel, trigger: str | None = None, partitions: int | None = None) -> StreamingQuery:
    """Full risk scoring of each micro-batch with fitted detectors and frozen bounds.

    Rows of a batch are taken in order of time, after all earlier batches: a row that comes in a later batch than
    rows it should precede is scored as the next of its user. Lifetime counts, users of an address
    and daily totals are as of the batch; days before the user's last one in the stream are not added to. Rows
    without a user are a user, rows without a time come first in their batch. The seven default rules apply.
    """
    columns = [*events.columns]
    ready = events.withColumn("_login", F.coalesce(S.is_login(), F.lit(False)))
    ready = ready.withColumn("bucket", _bucket("source_ip"))
    names = ready.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in ready.schema)}, _users long"
    rules = R.default_rules(model.cfg.rules)
    cfg = asdict(model.cfg.rules)
    with _keyed(events.sparkSession, partitions):
        counted = ready.groupBy("bucket").transformWithStateInPandas(Addresses(names, model.cfg.rules.stuffing_users), schema, "Append", "None")
        prepared = counted.withColumns(
            {
                "bucket": _bucket("user_id"),
                "at": F.unix_micros("timestamp"), "day": F.unix_date(F.to_date("timestamp")), "night": S.is_night(),
                "login": F.col("_login"), "transfer": F.coalesce(S.is_transfer(), F.lit(False)),
            }
        )
        passed = f"{GIVEN}, {', '.join(f'`e_{f.name}` {f.dataType.simpleString()}' for f in events.schema)}, _users long"
        processor = History(cfg, model.cfg.markov.order, columns, prepared.columns)
        rows = prepared.groupBy("bucket").transformWithStateInPandas(processor, passed, "Append", "None")
        return _each_batch(rows, out, lambda df, i: _write(_finished(df, columns, model, rules), out, "alerts", i), "append", trigger)


def _finished(df: DataFrame, columns: list[str], model: ScoringModel, rules: list[R.Rule]) -> DataFrame:
    """Features and rules of a batch's rows from their state's columns, then the fitted detectors."""
    rows = df.drop("event_id").withColumnsRenamed({f"e_{c}": c for c in columns})
    login = S.is_login()
    rows = rows.withColumns({**temporal_features().early, **event_type_onehot().early})
    rows = rows.withColumns(
        {
            "login_failure_rate": F.when(login, S.safe_divide_positive("_failed", "_logins")).otherwise(0.0),
            "mean_bytes_user": S.safe_divide_positive("total_bytes_user", "events_in_window"),
            "minutes_since_prev": F.col("seconds_since_prev") / 60.0,
            "hit_credential_stuffing": F.coalesce(login & F.col("source_ip").isNotNull() & (F.col("_users") >= model.cfg.rules.stuffing_users), F.lit(False)),
            **{f"trans_{a}_to_{b}": F.coalesce(((F.col("_prev_type") == a) & (F.col("event_type") == b)).cast("int"), F.lit(0)) for a, b in TRANSITIONS},
        }
    )
    scored = model.markov.score(R.combine(rows, rules))
    added = [c for c in FEATURES if c not in columns]
    scored = scored.select(*columns, *added, *R.RULE_COLUMNS, "markov_raw")
    return model.finish(model.forest.score(scored))
