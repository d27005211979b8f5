"""Exact repeated byte strings by merged Burrows-Wheeler transforms.

Removes every byte covered by a string of ``length`` bytes that also starts somewhere else. A window
of that length picks its least hashed gram, so equal windows pick the same gram, and windows with
a gram that occurs at one place only cannot repeat. Consecutive windows with one gram form a
fragment. Fragments that occur as a whole more than once are settled by counting. The
other fragments of a gram are compared by suffix order: bins of them are indexed in shards, each
by its own Burrows-Wheeler transform, and the shards are interleaved without sorting their
suffixes again: every round reads the symbols in front of the suffixes in the present order
and deals them out stably, after which the order is right for one symbol more. Where neighbours part
tells their common prefix; what has not parted after ``length`` bytes is a repeated interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.session import materialize, ship

ship(__name__)

LENGTH = 400
GRAM = 128
CHUNK = 1 << 19
# Symbols of the transform: words of this many bytes, a divisor of the length.
WORD = 80
FILTER_BITS = 23
_U = np.uint64
_TABLES = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_KEPT: dict[int, np.ndarray] = {}


def _powers(size: int, base: int) -> np.ndarray:
    if len(_KEPT.get(base, ())) < size:
        out = np.full(max(size, CHUNK + 1024), base, dtype=np.uint64)
        out[0] = 1
        _KEPT[base] = np.multiply.accumulate(out)
    return _KEPT[base][:size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[which][data] * _powers(len(data), _BASES[which]), out=out[1:])
    return out


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def fragments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First and last window start, gram and content hash of the fragments of texts laid end to end.

    ``ends``: for every byte, where its text ends. At most 2 ** 20 bytes. The leftmost of the least
    grams decides, so two equal windows are never in one fragment.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none
    sums = _sums(data, 0)
    back = _powers(len(data) + 1, pow(_BASES[0], -1, 1 << 64))
    grams = _mix((sums[gram:] - sums[:-gram]) * back[: len(data) - gram + 1])
    at = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least((grams >> _U(20) << _U(20)) | at, length - gram + 1)
    pick = (least & _U((1 << 20) - 1)).astype(np.int64)
    start = np.arange(len(pick))
    fits = start + length <= ends[: len(pick)]
    head = fits.copy()
    head[1:] &= (pick[1:] != pick[:-1]) | ~fits[:-1]
    first = np.flatnonzero(head)
    if not len(first):
        return none, none, none, none
    # A run ends before the next head or where windows stop to fit.
    stop = np.flatnonzero(fits & ~np.concatenate((fits[1:] & ~head[1:], [False])))
    other = _sums(data, 1)
    content = (other[stop + length] - other[first]) * _powers(len(data) + 1, pow(_BASES[1], -1, 1 << 64))[first]
    content = _mix(content + (stop - first).astype(np.uint64))
    return first, stop, grams[pick[first]].view(np.int64), content.view(np.int64)


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text ends, owners of the texts, their offsets); long texts come in overlapping parts."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def packed():
        lengths = np.array([len(b) for _, _, b in parts])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(b for _, _, b in parts), dtype=np.uint8)
        return data, np.repeat(ends, lengths), np.repeat([o for o, _, _ in parts], lengths), np.repeat(np.array([a for _, a, _ in parts]) - (ends - lengths), lengths)

    for owner, text in enumerate(texts):
        if len(text) < length:
            continue
        for a in range(0, len(text) - length + 1, CHUNK):
            piece = text[a : a + CHUNK + length - 1]
            if parts and size + len(piece) > CHUNK + length:
                yield packed()
                parts, size = [], 0
            parts.append((owner, a, piece))
            size += len(piece)
    if parts:
        yield packed()


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _text_key(raw: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).view(np.int64))


def _scan(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """id, text key, bytes, digest of the whole and fragments; copies in a batch send them once."""
    for frame in frames:
        raws = [_raw(x) for x in frame["text"]]
        keys = [_text_key(r) for r in raws]
        out = pd.DataFrame({"id": pd.array([None if pd.isna(x) else int(x) for x in frame["id"]], dtype="Int64"), "t": keys, "n": [len(r) for r in raws]})
        out["sha"] = [hashlib.sha256(r).hexdigest() for r in raws]
        lists: list[list] = [[[] for _ in raws] for _ in range(4)]
        seen = set()
        once = [b"" if k in seen or seen.add(k) else r for k, r in zip(keys, raws)]
        for data, ends, owners, offsets in _chunks(once, length):
            first, stop, gram, content = fragments(data, ends, length)
            if not len(first):
                continue
            cuts = np.flatnonzero(np.diff(owners[first])) + 1
            columns = (first + offsets[first], stop + offsets[first], gram, content)
            for c, column in enumerate(columns):
                for o, part in zip(owners[first][np.concatenate(([0], cuts))], np.split(column, cuts)):
                    lists[c][o].append(part)
        for name, column in zip(("s", "e", "g", "f"), lists):
            out[name] = [np.concatenate(x) if x else [] for x in column]
        yield out.astype({"t": "int64", "n": "int64"})


def _texts(frames: Iterator[pd.DataFrame], bits: np.ndarray) -> Iterator[pd.DataFrame]:
    """Text key and bytes of the texts that the bit filter lets through, once in a batch."""
    for frame in frames:
        raws = [_raw(x) for x in frame["text"]]
        keys = np.array([_text_key(r) for r in raws], dtype=np.int64)
        at = keys & ((1 << FILTER_BITS) - 1)
        pick = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
        pick = pick[np.sort(np.unique(keys[pick], return_index=True)[1])]
        yield pd.DataFrame({"t": keys[pick], "raw": [raws[i] for i in pick]})


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of the keys, and the keys in it.

    Keys and positions are sorted as one number where they fit, which numpy does fastest.
    """
    bits = max(1, len(keys).bit_length())
    if len(keys) and int(keys.max()).bit_length() + bits > 64:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    packed = np.sort(keys.astype(np.uint64) << _U(bits) | np.arange(len(keys), dtype=np.uint64))
    return (packed & _U((1 << bits) - 1)).astype(np.int64), (packed >> _U(bits)).astype(np.int64)


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys, equal for equal ones."""
    order, ordered = _sorted(keys)
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
    return ranks


def _ahead(begin: np.ndarray, size: np.ndarray, rel: np.ndarray, step: int) -> np.ndarray:
    """Positions ``step`` symbols on, around the end of each string; ``step`` is below its size."""
    on = rel + step
    return begin + np.where(on < size, on, on - size)


class _Shard:
    """Suffix order of a shard to the depth of the length, and its transform."""

    def __init__(self, words: np.ndarray, begin: np.ndarray, size: np.ndarray, rel: np.ndarray, length: int):
        rank, depth = _dense(words), WORD
        while depth < length:
            rank = _dense(rank * (int(rank.max()) + 1) + rank[_ahead(begin, size, rel, depth)])
            depth *= 2
        self.order = _sorted(rank)[0]
        before = rel - WORD
        self.transform = words[(begin + np.where(before >= 0, before, before + size))[self.order]]


def _interleave(shards: list[_Shard], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged order of the shards' suffixes: shard, rank in the shard, and block number.

    Suffixes of one block share ``length`` bytes, those of different blocks do not.
    """
    owner = np.concatenate([np.full(len(s.order), i) for i, s in enumerate(shards)])
    symbols = np.concatenate([s.transform for s in shards])
    bases = np.cumsum([0] + [len(s.order) for s in shards])
    block = np.zeros(len(owner), dtype=np.int64)

    def ranks() -> np.ndarray:
        out = np.empty(len(owner), dtype=np.int64)
        for i in range(len(shards)):
            where = np.flatnonzero(owner == i)
            out[where] = np.arange(len(where))
        return out

    for _ in range(length // WORD):
        symbol = symbols[bases[owner] + ranks()]
        deal, symbol = _sorted(symbol)
        owner, block = owner[deal], block[deal]
        parted = np.concatenate(([False], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])))
        block = np.cumsum(parted)
    return owner, ranks(), block


def repeated_starts(strings: list[bytes], length: int = LENGTH, shard_bytes: int = 1 << 16) -> list[np.ndarray]:
    """For each string the starts of its windows that also start elsewhere in these strings."""
    sizes = np.array([len(s) + WORD for s in strings])
    ends = np.cumsum(sizes)
    symbols = np.zeros(ends[-1], dtype=np.int64)
    for s, end, size in zip(strings, ends, sizes):
        symbols[end - size : end - WORD] = np.frombuffer(s, dtype=np.uint8).astype(np.int64) + 1
    begin, size = np.repeat(ends - sizes, sizes), np.repeat(sizes, sizes)
    rel = np.arange(len(symbols)) - begin
    # Four symbols of nine bits, then the dictionary of words by doubling, at last by what is left.
    rank = symbols
    for step in range(1, 4):
        rank = rank * 512 + symbols[_ahead(begin, size, rel, step)]
    width, ranks = 4, {}
    while True:
        ranks[width] = rank = _dense(rank)
        if width == WORD:
            break
        more = width if 2 * width <= WORD else max(w for w in ranks if w <= WORD - width)
        rank = rank * (int(ranks[more].max()) + 1) + ranks[more][_ahead(begin, size, rel, width)]
        width += more
    shards, bases, a = [], [], 0
    while a < len(strings):
        b = int(max(a + 1, np.searchsorted(ends, ends[a] - sizes[a] + shard_bytes)))
        lo, hi = ends[a] - sizes[a], ends[b - 1] if b <= len(strings) else ends[-1]
        shards.append(_Shard(rank[lo:hi], begin[lo:hi] - lo, size[lo:hi], rel[lo:hi], length))
        bases.append(lo)
        a = b
    owner, place, block = _interleave(shards, length)
    starts = np.cumsum([0] + [len(s.order) for s in shards])
    position = np.concatenate([s.order for s in shards])[starts[owner] + place] + np.array(bases)[owner]
    many = np.bincount(block)[block] > 1
    found = np.sort(position[many])
    found = found[rel[found] + length <= size[found] - WORD]
    cut = np.searchsorted(found, np.concatenate((ends - sizes, ends[-1:])))
    return [found[x:y] - (end - n) for x, y, end, n in zip(cut[:-1], cut[1:], ends, sizes)]


def _covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that windows at ``starts`` cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(starts, cuts)]


def _bin(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    frame = frame.drop_duplicates(["g", "f"])
    runs = []
    for (t, s, whole), starts in zip(frame[["t", "s", "whole"]].itertuples(index=False), repeated_starts(frame["content"].tolist(), length)):
        if not whole:
            runs += [(t, s + a, s + b) for a, b in _covered(starts, length)]
    return pd.DataFrame(runs, columns=["t", "a", "b"]).astype("int64")


def _strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Removed bytes, maximal removed runs and digest of the rest."""
    for frame in frames:
        rows = []
        for t, raw, spans in zip(frame["t"], frame["raw"], frame["spans"]):
            edges = np.array(sorted((x["a"], x["b"]) for x in spans), dtype=np.int64)
            upto = np.maximum.accumulate(edges[:, 1])
            new = np.concatenate(([True], edges[1:, 0] > upto[:-1]))
            lows, highs = edges[new, 0], upto[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(upto) - 1]))]
            kept = hashlib.sha256()
            at = 0
            for a, b in zip(lows.tolist(), highs.tolist()):
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((t, int((highs - lows).sum()), len(lows), kept.hexdigest()))
        yield pd.DataFrame(rows, columns=["t", "removed", "spans", "kept"])


def _bit_filter(keys: DataFrame) -> np.ndarray:
    """2 ** FILTER_BITS bits, one for each low part of a key: a constant size."""
    at = F.col("t").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for r in words.collect():
        bits[r.word] = r.bits
    return bits


def _hot_windows(hot: DataFrame, length: int) -> DataFrame:
    """Runs of grams with too many fragments for a task: their windows, counted by digest.

    A window is covered if its digest occurs in another fragment; grams keep equal windows together
    and a fragment has no window twice, so counting rows is exact up to MD5.
    """
    starts = F.sequence(F.lit(0), F.length("content") - length)
    windows = hot.dropDuplicates(["g", "f"]).select("g", "t", "s", "whole", "content", F.explode(starts).alias("i"))
    windows = windows.select("g", "t", "s", "whole", "i", F.md5(F.substring("content", F.col("i") + 1, F.lit(length))).alias("digest"))
    windows = materialize(windows, "repeat-windows")
    again = windows.groupBy("g", "digest").agg(F.count("*").alias("n")).where("n > 1").select("g", "digest")
    found = windows.where("NOT whole").join(again, ["g", "digest"], "left_semi")
    return found.select("t", (F.col("s") + F.col("i")).alias("a"), (F.col("s") + F.col("i") + length).alias("b"))


def strip_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, bin_bytes: int = 1 << 18, hot_bytes: int = 1 << 20
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, a row per row of ``docs``.

    Strings are judged on the input, never across texts. A null text is empty; a text shorter
    than ``length`` keeps all; rows with equal texts lose everything if long enough, whether or
    not their ids are equal; null ids are rows like others; an empty table gives an empty
    result; other columns are not looked at. Ids are integers, ``length`` is a multiple of WORD and
    at least GRAM. Equal texts are told by 64-bit hashes and their size.

    What moves is a few numbers for every 130 bytes, the texts that share a gram with another, and
    the fragments that differ around a shared gram. A gram whose fragments exceed ``hot_bytes``
    is resolved by counting its windows, spread over all tasks.
    """
    source = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "id long, t long, n long, sha string, s array<long>, e array<long>, g array<long>, f array<long>"
    rows = materialize(source.mapInPandas(lambda x: _scan(x, length), schema), "repeat-rows")
    parts = rows.select("t", F.explode(F.arrays_zip("s", "e", "g", "f")).alias("x")).select("t", "x.*")
    place = F.xxhash64("t", "s")
    shared = parts.groupBy("g").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("g")
    # Copies of a text are one place each.
    shared = materialize(parts.join(shared, "g", "left_semi"), "repeat-shared")
    where = F.struct("t", "s", "e")
    unique = shared.groupBy("g", "f").agg(F.min(where).alias("a"), F.max(where).alias("b"))
    unique = materialize(unique.select("g", "f", "a.t", "a.s", "a.e", (F.col("a") != F.col("b")).alias("whole")), "repeat-unique")
    settled = shared.join(unique.where("whole").select("g", "f"), ["g", "f"], "left_semi").select("t", F.col("s").alias("a"), (F.col("e") + length).alias("b"))
    size = F.sum(F.col("e") - F.col("s") + length + WORD).alias("bytes")
    open_ = unique.groupBy("g").agg(F.count("*").alias("n"), F.min("whole").alias("done"), size).where("n > 1 AND NOT done").select("g", "bytes")
    asked = materialize(unique.join(open_, "g"), "repeat-asked")

    bits = _bit_filter(shared.select("t"))
    texts = source.mapInPandas(lambda x: _texts(x, bits), "t long, raw binary").dropDuplicates(["t"])
    texts = materialize(texts, "repeat-texts")
    content = F.substring("raw", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s") + length).cast("int"))
    asked = texts.join(asked, "t").select("g", "f", "t", "s", "whole", "bytes", content.alias("content"))
    asked = materialize(asked, "repeat-content")
    total = asked.where(F.col("bytes") <= hot_bytes).agg(F.sum(F.length("content"))).first()[0] or 0
    bins = F.pmod(F.xxhash64("g"), F.lit(total // bin_bytes + 1))
    cool = asked.where(F.col("bytes") <= hot_bytes).withColumn("bin", bins)
    merged = cool.groupBy("bin").applyInPandas(lambda x: _bin(x, length), "t long, a long, b long")
    spans = settled.unionByName(merged).unionByName(_hot_windows(asked.where(F.col("bytes") > hot_bytes), length))

    copies = rows.where(F.col("n") >= length).groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
    copies = materialize(copies, "repeat-copies")
    by_text = spans.join(copies, "t", "left_anti").groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    stripped = texts.join(by_text, "t").select("t", "raw", "spans").mapInPandas(_strip, "t long, removed long, spans long, kept string")
    all_gone = copies.select("t", F.lit(-1).cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept"))
    known = materialize(stripped.unionByName(all_gone), "repeat-known")
    out = rows.select("id", "t", "n", "sha").join(known, "t", "left")
    return out.select(
        F.col("id").alias(id),
        F.col("n").alias("n_bytes"),
        F.when(F.col("removed") < 0, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
    )


def op5_suffix_dedup(spark, folder: str) -> DataFrame:
    return strip_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
