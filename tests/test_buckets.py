"""Processors of keyed state on a bucket of several users, with state kept in plain dictionaries."""

import numpy as np
import pandas as pd

from riskline.operators.forest import WALK_ROWS, grow_tree, walk
from riskline.streaming import keyed, scoring


class Map(dict):
    calls = 0

    def getValue(self, key):
        Map.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        Map.calls += 1
        self[key] = value

    def containsKey(self, key):
        Map.calls += 1
        return key in self


class Handle:
    def getMapState(self, *_):
        return Map()


def run(processor, frame):
    frames = list(processor.handleInputRows((0,), iter([frame]), None))
    return pd.concat(frames) if frames else None


def logins(users, devices, at=0):
    rows = [(u, d, at + i, f"e{at + i}") for i, (u, d) in enumerate((u, d) for u in users for d in devices)]
    return pd.DataFrame(rows, columns=["user_id", "device_id", "at", "event_id"])


def test_devices_of_several_users_cost_a_few_calls_each():
    processor = keyed.Devices(None)
    processor.init(Handle())
    Map.calls = 0
    out = run(processor, logins(["a", "b", None], ["x", "y", "z", None]))
    assert len(out) == 12 and out["withdrawn"].sum() == 3
    assert Map.calls == 3 * 4
    assert run(processor, logins(["a", "b", None], ["x", None], 100)) is None


def test_devices_beyond_an_entry_are_known_too():
    processor = keyed.Devices(None)
    processor.init(Handle())
    devices = [f"d{i}" for i in range(keyed.INLINE + 20)]
    assert len(run(processor, logins(["a"], devices, 1000))) == len(devices)
    assert run(processor, logins(["a"], devices, 9000)) is None
    # Earlier logins from known devices, inside the entry and beyond it.
    again = run(processor, logins(["a"], [devices[3], devices[-1]], 0))
    assert set(zip(again["device_id"], again["withdrawn"])) == {(devices[3], True), (devices[-1], False), (devices[0], False)}


def test_an_address_keeps_no_more_users_than_the_rule_asks_for():
    columns = ["source_ip", "user_id", "_login"]
    processor = scoring.Addresses(columns, 3)
    processor.init(Handle())
    rows = [("1.1.1.1", f"u{i}", True) for i in range(10)] + [("2.2.2.2", "u1", True), ("2.2.2.2", "u2", False), (None, "u1", True)]
    out = run(processor, pd.DataFrame(rows, columns=columns))
    assert list(out["_users"]) == [3] * 10 + [1, 1, 0]
    assert run(processor, pd.DataFrame([("2.2.2.2", "u2", True), ("2.2.2.2", "u1", True)], columns=columns))["_users"].tolist() == [2, 2]


def test_rows_walk_the_trees_alike_in_blocks():
    rng = np.random.default_rng(1)
    trees = [tuple(np.array(c) for c in zip(*grow_tree(rng.random((64, 5)), (1, t), 6))) for t in range(5)]
    x = rng.random((WALK_ROWS + 100, 5))
    assert np.array_equal(walk(x, trees, 6), np.concatenate([walk(x[i : i + 1], trees, 6) for i in range(len(x))]))
