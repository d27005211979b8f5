import hashlib
from collections import Counter

import public_tokenizers
import pytest

from riskline.llm import alignment
from tests.llm import corpus


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(sides, text):
    """(id, bytes) of both sides over the whole text at once."""
    a, b = sides
    # The usual table of byte-level vocabularies, made anew.
    signs = {chr(n): n for n in range(256) if 33 <= n < 127 or 161 <= n < 173 or n > 173}
    for n in range(256):
        if n not in signs.values():
            signs[chr(256 + sum(v >= 256 for v in map(ord, signs)))] = n
    left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return left, right


def brute(sides, texts):
    found = []
    for text in texts:
        left, right = tokens(sides, text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(t for _, t in left) != raw or b"".join(t for _, t in right) != raw:
            left, right = [], []
        places = [{}, {}]
        for side, place in zip((left, right), places):
            at = 0
            for id, token in side:
                at += len(token)
                place[at] = id
        groups, links, open_ = [], [], [[], []]
        for end in sorted({*places[0], *places[1]}):
            for place, ids in zip(places, open_):
                ids += [place[end]] if end in place else []
            if end in places[0] and end in places[1]:
                links.append((places[0][end], places[1][end]))
                groups.append("|".join(",".join(map(str, ids)) for ids in open_))
                open_ = [[], []]
        found.append((len(left), len(right), len(groups), links, ";".join(groups)))
    count = Counter(x for *_, links, _ in found for x in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (a, b, g, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else "", text)
        for a, b, g, links, text in found
    ]


def texts():
    out = [t for _, t, _ in corpus.rows(3, 25)]
    out += ["  two  in front", "ends with blanks  ", "\tx\n y \n\n z", "it's 5 o'clock, don't!", "a▁b", "▁", "<|endoftext|> <s>x</s> <unk> <0x41>", "nul\0byte", " no break 　 wide", "한국어 中文 \U0001f600\U0001f468‍\U0001f469", "x" * 5000, " ", "\n", "a b", ";\r\n {\r\n", "é \x1c \x85 q"]
    return out


def test_equals_brute_force(spark, sides):
    """Whole texts through both tokenizers against spans: counts, digests and the groups themselves."""
    found = texts()
    docs = corpus.frame(spark, [(i, t, "s") for i, t in enumerate(found)])
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(docs, keep_groups=True).collect()}
    want = brute(sides, found)
    assert [i for i in range(len(found)) if got[i] != want[i]] == []


def test_small_memory_and_joins_without_broadcast(spark, sides, monkeypatch):
    found = texts()[:40]
    docs = corpus.frame(spark, [(i, t, "s") for i, t in enumerate(found)], 2)
    monkeypatch.setattr(alignment, "CACHE_BYTES", 1000)
    monkeypatch.setattr(alignment, "BATCH", 7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [got[i] for i in range(len(found))] == [w[:-1] for w in brute(sides, found)]


def test_null_ids_repeated_rows_empty_table(spark, sides):
    rows = [(None, "one two", "s"), (None, "one two", "s"), (4, "one two", "s"), (4, None, "s")]
    docs = corpus.frame(spark, rows)
    got = sorted((tuple(r) for r in alignment.aligned(docs).collect()), key=str)
    want = brute(sides, [t for _, t, _ in rows])
    assert got == sorted(((i, *w[:-1]) for (i, _, _), w in zip(rows, want)), key=str)
    assert alignment.aligned(docs.limit(0)).collect() == []
