import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskline.llm import near
from riskline.llm.links import components
from tests.llm import corpus


@pytest.mark.parametrize("shingle,percent,limit", [(3, 90, 32 << 20), (5, 80, 32 << 20), (3, 60, 2000)])
def test_components_equal_brute_force(spark, tmp_path, shingle, percent, limit):
    """Also with regions cut by distributed pivots (small limit)."""
    found = [r for r in corpus.rows() if r[0] is not None]
    docs = corpus.written(corpus.frame(spark, found), tmp_path)
    got = near.near_components(docs, shingle, percent, region_bytes=limit).collect()
    groups = corpus.jaccard_groups([t for _, t, _ in found], shingle, percent)
    least = {}
    for (id, _, _), g in zip(found, groups):
        least[g] = min(least.get(g, id), id)
    want = sorted((id, len(corpus.shingles(t, shingle)), least[g]) for (id, t, _), g in zip(found, groups))
    assert sorted(map(tuple, got)) == want


def _drifting(rng, chains, length):
    """Chains of texts that change by a few words a step, so far ends share nothing; stars and cliques."""
    out = []
    for _ in range(chains):
        words = corpus.prose(rng, 80).split()
        for _ in range(length):
            out.append(" ".join(words))
            at = rng.randrange(len(words))
            words[at : at + 2] = corpus.prose(rng, 2).split()
    center = corpus.prose(rng, 90)
    return out + [corpus.near_copy(rng, center, e) for e in (0, 1, 2, 3) for _ in range(6)] + [center] * 5


@pytest.mark.parametrize("limit,bins", [(2_000, 8 << 20), (12_000, 8 << 20), (12_000, 1), (60_000, 8 << 20), (100_000, 8 << 20)])
def test_cut_regions_lose_no_link_and_do_not_grow(spark, tmp_path, monkeypatch, limit, bins):
    rng = random.Random(limit)
    found = [(i, t, "s") for i, t in enumerate(_drifting(rng, 4, 40))]
    docs = corpus.written(corpus.frame(spark, found), tmp_path)
    dealt = []
    split = near._split_hot

    def counted(members, rule, limit):
        before = members.count()
        out, links = split(members, rule, limit)
        sizes = out.groupBy("region").agg(F.sum(F.size("items") * 8).alias("b"), F.count("*").alias("n")).agg(F.max("b"), F.sum("n")).first()
        dealt.append((before, *sizes))
        return out, links

    monkeypatch.setattr(near, "_split_hot", counted)
    got = near.near_components(docs, 3, 60, region_bytes=limit, bin_bytes=bins).collect()
    groups = corpus.jaccard_groups([t for _, t, _ in found], 3, 60)
    least = {g: i for i, g in reversed(list(enumerate(groups)))}
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, least[g]) for i, g in enumerate(groups)]
    before, largest, after = dealt[0]
    # Two halves of a task, which hashing does not fill quite evenly.
    assert largest is None or largest <= 2 * limit + 4_000


def test_region_join_is_exact():
    rng = random.Random(3)
    base = [rng.sample(range(400), 60) for _ in range(6)]
    sets = [np.unique(np.array(b[: rng.randint(50, 60)] + rng.sample(range(400), rng.randint(0, 9)))) for b in base for _ in range(40)]
    region = near._Region(sets, near.Threshold(80))
    region.join(np.arange(len(sets)))
    plain = [frozenset(s.tolist()) for s in sets]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert region.root.tolist() == root


def test_a_crowded_region_costs_less_than_all_pairs(monkeypatch):
    """Sets that pivots do not part: all share some of one passage, in groups of near copies."""
    rng = np.random.default_rng(8)
    passage, sets = rng.integers(0, 1 << 63, 120, dtype=np.uint64), []
    for _ in range(500):
        own = np.concatenate((passage[: rng.integers(0, 121)], rng.integers(0, 1 << 63, 60, dtype=np.uint64)))
        sets += [np.unique(np.concatenate((own[e:], rng.integers(0, 1 << 63, e, dtype=np.uint64)))).view(np.int64) for e in (0, 2)]
    asked, shared = [], near._Region.shared
    monkeypatch.setattr(near._Region, "shared", lambda self, pivot, others: asked.append(len(others)) or shared(self, pivot, others))
    region = near._Region(sets, near.Threshold(80))
    region.join(np.arange(len(sets)))
    assert sum(asked) < len(sets) ** 2 / 10
    plain = near._Region(sets, near.Threshold(80))
    for p in range(len(sets) - 1):
        plain.against(p, np.arange(p + 1, len(sets)))
    assert region.root.tolist() == plain.root.tolist()


def test_no_more_names_than_linked_sets_can_differ_in():
    rng, rule, none = np.random.default_rng(6), near.Threshold(80), np.zeros(0, dtype=np.uint64)
    for n in (100, 300, 580):
        items = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        # Linked sets of n and m differ in (n + m) / 9 at most: m up to 1.25 n, and to n as the larger one of two.
        assert len(rule.buckets(items, none)) <= (2.25 + 2) * n / 9 + 2


def test_linked_sets_share_a_bucket():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        rule = near.Threshold(percent)
        for n in (1, 2, 5, 9, 10, 11, 40, 300):
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                b = np.unique(np.concatenate((rng.permutation(a)[: max(1, rng.integers(int(n * 0.8), n + 1))], rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1), dtype=np.uint64))))
                inter = len(np.intersect1d(a, b))
                if inter and 100 * inter >= percent * (len(a) + len(b) - inter):
                    for common in (a[:0], a[::2], a[1:], np.union1d(a, b)):
                        assert np.intersect1d(rule.buckets(a, common), rule.buckets(b, common)).size


@pytest.mark.parametrize("ranges", [1, 7])
def test_names_move_in_six_bytes_and_meet_as_whole_ones(ranges):
    """Sets with a bucket in common, in one batch or in two, are connected; what moves is less than half of key and name."""
    rng, rule, none = random.Random(12), near.Threshold(80), np.zeros(0, dtype=np.uint64)
    base = [corpus.prose(rng, rng.randint(1, 200)) for _ in range(120)]
    texts = base + base[:5] + [corpus.near_copy(rng, t, e) for t in base[:60] for e in (1, 2)] + [""]
    rng.shuffle(texts)
    frames = [pd.DataFrame({"text": texts[:150]}), pd.DataFrame({"text": texts[150:]}), pd.DataFrame({"text": [""]}), pd.DataFrame({"text": texts[:150]})]
    sent = pd.concat(list(near._sketch(iter(frames), 5, 80, none, ranges)))
    names = sent[sent["part"] >= 0]
    moved = names["owners"].map(len).sum() + names["names"].map(len).sum()
    assert set(names["part"]) == set(range(ranges)) and moved < 8 * names["names"].map(len).sum() / near.NAME_BYTES
    met = pd.concat([near._meet(part) for _, part in sent.groupby("part")])
    key = dict(met.loc[met["named"], ["node", "to"]].itertuples(index=False))
    sets = {near._key(s): s for s in near.shingle_sets(texts, 5) if len(s)}
    assert set(key.values()) == set(sets)

    def groups(links):
        root = {k: k for k in sets}
        for a, b in links:
            x, y = sorted((root[a], root[b]))
            root = {k: x if r == y else r for k, r in root.items()}
        return root

    first, want = {}, []
    for k, items in sets.items():
        want += [(k, first.setdefault(n, k)) for n in rule.buckets(items, none).tolist()]
    got = [(key[a], key[b]) for a, b in met.loc[~met["named"], ["node", "to"]].itertuples(index=False)]
    assert groups(got) == groups(want)


def test_what_is_smaller_moves_text_or_set():
    rng = random.Random(13)
    texts = [corpus.prose(rng, 100), "a b c " * 900, "", "one", "😀 " * 40, corpus.prose(rng, 3)]
    frame = pd.DataFrame({"text": texts, "at": range(len(texts))})
    bits = np.full(1 << (near.FILTER_BITS - 6), -1, dtype=np.int64)
    (out,) = near._members(iter([frame]), 3, bits)
    found = list(near.shingle_sets(texts, 3))
    assert out["n"].tolist() == [len(s) for s in found]
    for text, items, s in zip(out["text"], out["items"], found):
        assert (text is None) != (items is None)
        assert len(text.encode() if text is not None else b"") <= 8 * len(s)
    assert [s.view(np.uint64).tolist() for s in near._sets(out, 3)] == [s.tolist() for s in found]


@pytest.mark.parametrize("limit", [4_000, 32 << 20])
def test_components_with_names_in_many_ranges(spark, tmp_path, monkeypatch, limit):
    """Texts and sets side by side, with null ids, repeated rows and null texts."""
    monkeypatch.setattr(near, "RANGE", 300)
    rng = random.Random(14)
    base = [corpus.prose(rng, 60) for _ in range(12)]
    texts = [corpus.near_copy(rng, t, e) for t in base for e in (0, 0, 1, 2)] + ["x y z " * 300, "x y z " * 310, None, "", "one"]
    found = [(i, t, "s") for i, t in enumerate(texts)]
    found += [found[0], (None, texts[4], "s")]
    docs = corpus.written(corpus.frame(spark, found), tmp_path)
    got = near.near_components(docs, 3, 80, region_bytes=limit).collect()
    groups = corpus.jaccard_groups([t for _, t, _ in found], 3, 80)
    least = {}
    for (id, t, _), g in zip(found, groups):
        least[g] = min(least.get(g, 1 << 40), 1 << 40 if id is None else id)
    want = [(id, len(corpus.shingles(t, 3)), least[g]) for (id, t, _), g in zip(found, groups)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_the_least_id_stays(spark, tmp_path):
    """Whatever the files are called, so a second run keeps the same rows."""
    rng = random.Random(6)
    base = [corpus.prose(rng, 60) for _ in range(5)]
    found = [(i, base[i % 5], "s") for i in range(40)] + [(None, base[0], "s"), (None, corpus.prose(rng, 50), "s")]
    rng.shuffle(found)
    docs = corpus.frame(spark, found)
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        kept = near.keep_one(corpus.written(docs, tmp_path / folder)).collect()
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == [-1, 0, 1, 2, 3, 4]


def test_keep_one_and_columns(spark, tmp_path):
    found = corpus.rows(2)
    docs = corpus.written(corpus.frame(spark, found), tmp_path)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    groups = corpus.jaccard_groups([t for _, t, _ in found], 5, 80)
    assert kept.count() == len(set(groups))
    number = {}
    for (_, t, _), g in zip(found, groups):
        number[t] = g
    assert len({number[r.text] if corpus.shingles(r.text, 5) else object() for r in kept.collect()}) == len(set(groups))


def test_keep_one_with_other_splits_in_the_last_scan(spark, tmp_path):
    """Row numbers that follow the splits of the files would name other rows in the anti join."""
    rng = random.Random(4)
    texts = [corpus.prose(rng, 200) for _ in range(150)]
    copies = [corpus.near_copy(rng, t, 1) for t in texts]
    docs = corpus.written(corpus.frame(spark, [(i, t, "s") for i, t in enumerate(texts + copies)], 2), tmp_path)
    limit, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(limit)
    kept = near.keep_one(docs)
    try:
        spark.conf.set(limit, "20000")
        spark.conf.set(cost, "0")
        got = [r.doc_id % 150 for r in kept.collect()]
    finally:
        spark.conf.set(limit, before)
        spark.conf.unset(cost)
    assert sorted(got) == list(range(150))


def test_null_ids_and_empty_table(spark, tmp_path):
    docs = corpus.frame(spark, [(None, "a b c d e f", "s"), (7, "a b c d e f", "s"), (None, None, None)])
    got = near.near_components(docs, 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 4, 7), (7, 4, 7), (None, 0, None)], key=str)
    assert near.near_components(docs.limit(0), 3, 90).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "key long, to long"))
    assert sorted(map(tuple, got.collect())) == sorted([(i, 0) for i in range(41)] + [(100 + i, 100) for i in range(30)])
    assert components(got.where(F.lit(False))).collect() == []
