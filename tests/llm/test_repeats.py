import random

import pytest

from riskline.llm import repeats
from tests.llm import corpus


def texts(seed):
    rng = random.Random(seed)
    shared = [corpus.prose(rng, 120) for _ in range(4)]
    out = [t for _, t, _ in corpus.rows(seed, 20) if t is None or len(t) < 20_000]
    out += [corpus.prose(rng, 30) + " " + rng.choice(shared)[rng.randint(0, 60) :] + " " + corpus.prose(rng, 30) for _ in range(25)]
    out += ["z" * 450, "z" * 399, "q" * 399, "ab" * 260, "é" * 500, shared[0] + shared[0], shared[1][:400], shared[1][:399]]
    return out


@pytest.mark.parametrize("hot,bins", [(4 << 20, 1 << 20), (4 << 20, 3000), (1500, 1 << 20)])
def test_equals_brute_force(spark, hot, bins):
    """With one bin, many bins, and grams whose windows are counted."""
    found = texts(4)
    docs = corpus.frame(spark, [(i, t, "s") for i, t in enumerate(found)])
    got = {r.doc_id: tuple(r)[1:] for r in repeats.strip_repeats(docs, hot_bytes=hot, bin_bytes=bins).collect()}
    want = corpus.without_repeats(found, 400)
    assert [i for i in range(len(found)) if got[i] != want[i]] == []


def test_merged_transforms_find_all_repeats():
    rng = random.Random(9)
    core = "".join(rng.choice("abcd") for _ in range(600)).encode()
    strings = [bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 40))) + core[a : a + 450] + bytes(rng.choice(b"xyz") for _ in range(30)) for a in (0, 10, 60, 140, 0)]
    strings += [b"p" * 400, b"p" * 399, b"q" * 600]
    got = repeats.repeated_starts(strings, 400, shard_bytes=900)
    places = {}
    for n, s in enumerate(strings):
        for i in range(len(s) - 399):
            places.setdefault(s[i : i + 400], []).append((n, i))
    want = sorted(p for ps in places.values() if len(ps) > 1 for p in ps)
    assert sorted((n, int(i)) for n, starts in enumerate(got) for i in starts) == want


def test_long_texts_null_ids_repeated_rows_empty_table(spark):
    rng = random.Random(2)
    long = corpus.prose(rng, 120_000)
    rows = [(1, long, "s"), (2, corpus.prose(rng, 50) + long[700_000:701_000], "s"), (None, "k" * 500, "s"), (3, long[:100], "s"), (3, long[:100], "s")]
    docs = corpus.frame(spark, rows)
    got = sorted(map(tuple, repeats.strip_repeats(docs).collect()), key=str)
    # The long text repeats only what the second quotes.
    want = corpus.without_repeats([t for _, t, _ in rows[1:]] + [long[699_000:702_000]], 400)
    by_id = {g[0]: g for g in got}
    assert by_id[1][2:4] == want[-1][1:3] and by_id[2][1:] == want[0] and by_id[None][1:] == want[1]
    assert repeats.strip_repeats(docs.limit(0)).collect() == []
