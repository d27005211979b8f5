"""Packing, fingerprints, resampling and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from riskline.llm import fingerprint, packing, pii, quality, resample
from tests.llm import corpus


def token_ids(text):
    return np.array([*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing_is_whole_and_tight(spark, capacity):
    found = [(n, t, s) for n, (_, t, s) in enumerate(corpus.rows(4, 200))]
    got = packing.pack(corpus.frame(spark, found), capacity=capacity, keep_ids=True).toPandas()
    for id, t, _ in found:
        ids = token_ids(t)
        mine = got[got.doc_id == id].sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine))) and len(mine) == -(-len(ids) // capacity)
        assert np.concatenate(mine["ids"].tolist()).tolist() == ids.tolist()
        assert (mine.length.iloc[1:] == capacity).all()
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length)]
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= capacity
    assert got.sequence_id.nunique() <= -(-got.length.sum() // capacity) * 1.03 + 1
    assert packing.pack(corpus.frame(spark, found).limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    hist = {x: rng.choice((1, 2, 50, 10**6)) for x in rng.sample(range(1, 1025), rng.choice((1, 3, 200, 1024)))}
    layout = packing.plan(hist)
    used = Counter()
    for lengths, n in layout:
        assert sum(lengths) <= 1024 and n > 0
        for x in lengths:
            used[x] += n
    assert used == Counter(hist)


def test_ids_of_odd_texts():
    """White space of all kinds, signs, other scripts: looked up by parts as the tokenizer has them."""
    rng = random.Random(2)
    signs = [" ", "  ", "a", "B", "\x85", "\xa0", "\u3000", "\n", "\t", "_", "½", "é", "e\u0301", "中", "😀", "-", "'s", "\0", "12", ". "]
    encode = packing._Encoder(packing.VOCABULARY)
    plain = Tokenizer.from_file(packing.VOCABULARY)
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert encode.ids(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "a<|endoftext|>b  \n it's 12 é😀 ", "<|endoftext|><|endoftext|>", "<|endoftext|", "x <|endoftext|>\n\n y"])
def test_special_words_are_those_of_the_tokenizer(text):
    """The ids of the named tokenizer at its defaults."""
    plain = Tokenizer.from_file(packing.VOCABULARY)
    assert packing._Encoder(packing.VOCABULARY).ids(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_next_documents(spark):
    found = sorted((r for r in corpus.rows(5) if r[0] is not None and r[0] >= 0 and r[0] != 3 and r[0] != 5), key=lambda r: r[0])
    for size in (4 << 20, 3000):
        got = sorted(fingerprint.with_next(corpus.frame(spark, found), bucket_bytes=size).collect())
        assert [r.doc_id for r in got] == [r[0] for r in found]
        for i, r in enumerate(got):
            own, after = found[i][1] or "", found[(i + 1) % len(found)][1] or ""
            half = len(own) // 2
            edited = own[: len(own) - half] + after[:half]
            assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.fingerprint == fingerprint.fingerprint(own) and r.edited_fingerprint == fingerprint.fingerprint(edited)
            assert r.near_next == fingerprint.likeness(fingerprint.fingerprint(own), fingerprint.fingerprint(after))


def test_rows_of_one_id_null_ids_and_single_rows(spark):
    docs = corpus.frame(spark, [(1, "a", "s"), (1, "b", "s"), (1, "a", "s"), (None, None, "s")])
    got = fingerprint.with_next(docs, bucket_bytes=1).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (1, 1)]
    one = fingerprint.with_next(docs.where("doc_id IS NULL")).collect()
    assert [(r.doc_id, r.near_edited, r.near_next) for r in one] == [(None, 1.0, 1.0)]
    assert fingerprint.with_next(docs.limit(0)).collect() == []


def test_other_splits_in_the_second_scan_lose_no_row(spark, tmp_path):
    """Row numbers that follow the splits of the files would shift between the two scans."""
    rng = random.Random(8)
    found = [(i // 2, corpus.prose(rng, 200), "s") for i in range(300)]
    docs = corpus.written(corpus.frame(spark, found, 2), tmp_path)
    limit, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    result = fingerprint.with_next(docs, bucket_bytes=3000)
    try:
        # The result has not been planned; the keys and heads have been written.
        spark.conf.set(limit, "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = result.collect()
    finally:
        spark.conf.set(limit, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in found)


def test_a_lost_row_is_an_error(spark, tmp_path):
    frame = pd.DataFrame({"bucket": [0, 0, 0, 1, 1], "id": [1, 2, 3, 3, 1], "text": list("abcca"), "copy": [False, False, True, False, True]})
    assert sum(len(f) for f in fingerprint._pairs(iter([frame]), {0: 2, 1: 1})) == 3
    for lost in range(5):
        with pytest.raises(RuntimeError):
            list(fingerprint._pairs(iter([frame.drop(index=lost)]), {0: 2, 1: 1}))


def test_fingerprints_locate_edits():
    rng = random.Random(3)
    lines = [corpus.prose(rng, 30) + ".\n" for _ in range(40)]
    text = "".join(lines)
    lines[17] = lines[17][:-9] + "changed.\n"
    a, b = fingerprint.fingerprint(text), fingerprint.fingerprint("".join(lines))
    assert a != b and 0.95 < fingerprint.likeness(a, b) < 1
    assert len(fingerprint.edits(a, b)) == 1 and fingerprint.edits(a, a) == []
    for t in (text, "", "\n\n", " x  y\n", "é😀" * 300, "a.b!c? d"):
        assert "".join(fingerprint.leaves(t)) == t
    assert 0.4 < fingerprint.likeness(a, fingerprint.fingerprint(text[: len(text) // 2] + corpus.prose(rng, 700))) < 0.6


def test_resampling_finds_held_out_quality(spark):
    rng = random.Random(1)
    found, labels = [], []
    for i in range(600):
        kind = i % 5
        text = corpus.prose(rng, 80) if kind else " ".join(w + rng.choice(("$$", " idiot", "&&")) for w in corpus.prose(rng, 80).split())
        found.append((i, text, "s"))
        if i % 2:
            labels.append((i, int(kind > 0), 0))
    docs = corpus.frame(spark, found + [(None, None, "s"), (7000, "", "s")])
    table = spark.createDataFrame(labels + [(1, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in resample.resample(docs, table).collect()}
    held_out = [i for i in range(600) if i % 2 == 0]
    right = sum(got[i].kept == (i % 5 > 0) for i in held_out)
    assert right >= 0.97 * len(held_out)
    assert sum(r.kept for r in got.values()) == round(602 * 0.8)
    again = {r.doc_id: r.kept for r in resample.resample(docs.repartition(7), table).collect()}
    assert again == {i: r.kept for i, r in got.items()}
    assert resample.resample(docs.limit(0), table).collect() == []
    assert all(r.kept for r in resample.resample(docs, table.limit(0)).collect())


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    found = [(n, t, s) for n, (_, t, s) in enumerate(corpus.rows(11, 80))]
    found += [(900 + i, f"{corpus.prose(random.Random(i), 40)} mail a{i}.b@example.org", "c") for i in range(5)]
    docs = corpus.written(corpus.frame(spark, found), tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "pii", "mix", "pack"]
    text = {i: t for i, t, _ in found}
    state, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, str(tmp_path))
        if name != "pack":
            assert out.columns == docs.columns
            (tmp_path / name).mkdir()
            out = corpus.written(out, tmp_path / name)
        kept[name], state = out.collect(), out
    passed = {r.doc_id for r in quality.ledger(docs).where(quality.verdict()).collect()}
    assert {r.doc_id for r in kept["quality"]} == passed and 20 < len(passed) < len(found)
    ids = sorted(passed)
    groups = dict(zip(ids, corpus.jaccard_groups([text[i] for i in ids], 5, 80)))
    left = [r.doc_id for r in kept["near_duplicates"]]
    assert sorted(groups[i] for i in left) == sorted(set(groups.values()))
    assert {r.doc_id for r in kept["pii"]} == set(left)
    assert not any("@example.org" in r.text and r.text == text[r.doc_id] for r in kept["pii"])
    size = {r.doc_id: len(r.text.split()) for r in kept["pii"]}
    assert set(r.doc_id for r in kept["mix"]) <= set(left)
    words = sum(size[r.doc_id] for r in kept["mix"])
    assert abs(words - sum(size.values())) <= 3 * max(size.values())
    packed = Counter()
    for r in kept["pack"]:
        packed[r.doc_id] += r.length
    assert packed == Counter({i: n * len(token_ids(next(r.text for r in kept["mix"] if r.doc_id == i))) for i, n in Counter(r.doc_id for r in kept["mix"]).items()})
    assert pii.KEY


def test_pipeline_ends_with_token_ids(spark, tmp_path):
    docs = corpus.written(corpus.frame(spark, [(i, t, "s") for i, t in enumerate(["one two", "", "more  words\n" * 900])]), tmp_path)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    for r in docs.collect():
        pieces = sorted((p for p in got if p.doc_id == r.doc_id), key=lambda p: p.piece)
        assert [i for p in pieces for i in p.ids] == token_ids(r.text).tolist()
