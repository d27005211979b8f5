import hashlib
import random

import numpy as np
import pytest

from riskline.llm import passages
from tests.llm import corpus


def brute(rows, window=13):
    """(id, words, removed, digest, kept) of each row by a table of all windows."""
    order = [(float("inf") if i is None else i, corpus.WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, words in order:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for (id, *_), (i, words) in zip(rows, order):
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < i:
                gone[at : at + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    shared = [corpus.prose(rng, 120) for _ in range(4)]
    out = [t for _, t, _ in corpus.rows(seed, 20)]
    out += [corpus.prose(rng, 30) + " " + " ".join(rng.choice(shared).split()[rng.randint(0, 60) :]) + "\n" + corpus.prose(rng, 30) for _ in range(40)]
    common = corpus.prose(rng, 16)
    out += [f"{corpus.prose(rng, 14)}  {common}\t{corpus.prose(rng, 14)}" for _ in range(40)]
    out += ["la " * 40, "la " * 13, "la " * 12, "a b " * 30, shared[0] + " " + shared[0], " ".join(shared[1].split()[:13]), " ".join(shared[1].split()[:12]), common, "x\x00y " * 20, "a\xa0b " * 20]
    return out


@pytest.mark.parametrize("group", [50_000, 12, 3])
def test_equals_brute_force(spark, group, monkeypatch):
    """One group, many, and prefixes that grow to whole windows; several batches."""
    monkeypatch.setattr(passages, "BATCH", 17)
    rng = random.Random(group)
    rows = [(i, t, "s") for i, t in enumerate(texts(group))]
    rows += [(3, rows[3][1], "s"), (None, rows[45][1], "s"), (None, rows[46][1], "s"), (-7, rows[50][1], "s"), (50, f"another {rows[51][1]}", "s"), (None, None, "s")]
    rng.shuffle(rows)
    docs = corpus.frame(spark, rows)
    got = sorted((tuple(r) for r in passages.strip_passages(docs, group=group, keep_text=True).collect()), key=str)
    want = brute(rows)
    assert [(g[:3], w[:3]) for g, w in zip(got, want) if g != w] == [] and len(got) == len(want)


def test_other_lengths(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts(8)) if t is None or len(t) < 20_000]
    docs = corpus.frame(spark, rows)
    got = sorted((tuple(r) for r in passages.strip_passages(docs, window=5, gram=2, keep_text=True).collect()), key=str)
    assert got == brute(rows, 5)


def test_tree_finds_all_repeats():
    rng = np.random.default_rng(1)
    strings = [rng.integers(0, 3, rng.integers(5, 30)).astype(np.uint64) for _ in range(200)]
    least = rng.integers(0, 50, 200)
    owner, start, under = passages.repeats(strings, least, 5)
    first = {}
    for s, n in zip(strings, least):
        for i in range(len(s) - 4):
            key = s[i : i + 5].tobytes()
            first[key] = min(n, first.get(key, n))
    want = [(o, i, first[s[i : i + 5].tobytes()]) for o, s in enumerate(strings) for i in range(len(s) - 4)]
    assert list(zip(owner.tolist(), start.tolist(), under.tolist())) == want


def test_long_texts_are_hashed_in_parts(monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 100)
    monkeypatch.setattr(passages, "STEP", 40)
    rng = random.Random(3)
    raws = [corpus.prose(rng, n).encode() for n in (300, 0, 1, 12, 13, 700)] + [b"x" * 500]
    parts = passages.fragments(raws)
    monkeypatch.undo()
    windows = {(int(t), int(s) + o) for t, s, w, *_ in zip(*parts) for o in range(w)}
    assert windows == {(t, s) for t, raw in enumerate(raws) for s in range(len(raw.split()) - 12)}
    whole = passages.word_hashes(raws)
    monkeypatch.setattr(passages, "CHUNK", 100)
    assert all((a == b).all() for a, b in zip(whole, passages.word_hashes(raws)))


def test_a_common_gram_is_no_hot_key(spark):
    """What many texts of a batch share leaves one mark a batch under its own key."""
    import pandas as pd

    rng = random.Random(4)
    common = corpus.prose(rng, 14)
    frame = pd.DataFrame({"id": range(300), "text": [f"{corpus.prose(rng, 20)} {common} {corpus.prose(rng, 20)}" for _ in range(300)]})
    out = pd.concat(passages._parts(iter([frame]), 13, 6))
    assert out["key"].value_counts().max() == 1 and (out["kind"] == 1).sum() >= 300 and (out["kind"] == 2).sum() >= 1


def test_empty_table(spark):
    assert passages.strip_passages(corpus.frame(spark, [(1, "a", "s")]).limit(0)).collect() == []
