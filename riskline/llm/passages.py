"""Repeated word passages by prefix-partitioned suffix trees.

Removes every word covered by a window of words whose sequence also starts in a document with a smaller id.
A window is anchored at its least hashed gram of a few words, so equal windows have one anchor, and
windows with a gram that only one text has cannot repeat. Consecutive windows with one anchor
are a fragment; equal fragments are one string with the least id of their documents. The suffixes of
these strings are split by prefix: first by the anchor's gram, and where that leaves more strings than a
group may have, suffix by suffix, by ever longer prefixes until a group is small enough or its
prefix is a whole window, which then is a node of the tree itself. Every group gets its own
suffix tree, as sorted suffixes with the nodes of depth ``window`` and more; the leaves under such a
node are a repeat, and the least id among them is the document that may keep it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.llm.text import batches
from riskline.session import materialize, ship

ship(__name__)

WINDOW = 13
GRAM = 6
# Bytes of text, and words, that are hashed at once.
CHUNK = 1 << 20
STEP = (1 << 20) - 64
BATCH = 2_000
# Strings of a group.
GROUP = 50_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
# A missing id counts as larger than every id.
NO_ID = (1 << 63) - 1
_U = np.uint64
_TABLE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_KEPT: dict[int, np.ndarray] = {}


def _powers(size: int, base: int) -> np.ndarray:
    if len(_KEPT.get(base, ())) < size:
        out = np.full(max(size, CHUNK + 4096), base, dtype=np.uint64)
        out[0] = 1
        _KEPT[base] = np.multiply.accumulate(out)
    return _KEPT[base][:size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _hashed(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of some bytes."""
    signs = np.frombuffer(data + b" ", dtype=np.uint8)
    sums = np.zeros(len(signs) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[signs] * _powers(len(signs), _BASE), out=sums[1:])
    gap = _IS_SPACE[signs]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    stops = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    back = _powers(len(signs), pow(_BASE, -1, 1 << 64))[starts]
    return _mix((sums[stops] - sums[starts]) * back + (stops - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words end; long texts go in parts."""
    parts, waiting, size = [], [], 0
    for text in texts:
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > CHUNK:
                space = SPACE.search(text, at + CHUNK)
                stop = space.end() if space else stop
            if waiting and size + stop - at > CHUNK:
                parts.append(_hashed(b" ".join(waiting)))
                waiting, size = [], 0
            waiting.append(text[at:stop])
            size += stop - at + 1
            at = stop
    if waiting:
        parts.append(_hashed(b" ".join(waiting)))
    words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    # Texts are joined by single spaces inside, so their words are counted by those.
    return words, np.cumsum([t.count(b" ") + 1 if t else 0 for t in texts])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _fragments(words: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First window, windows, gram and content hash of the fragments of at most 2 ** 20 words.

    ``ends``: for every word, where its text ends. The leftmost of the least grams is the anchor.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(words) < window:
        return none, none, none, none
    grams = np.zeros(len(words) - gram + 1, dtype=np.uint64)
    for j in range(gram):
        grams = grams * _U(_BASE) + words[j : j + len(grams)]
    grams = _mix(grams)
    at = np.arange(len(grams), dtype=np.uint64)
    pick = (_sliding_least((grams >> _U(20) << _U(20)) | at, window - gram + 1) & _U((1 << 20) - 1)).astype(np.int64)
    start = np.arange(len(pick))
    fits = start + window <= ends[: len(pick)]
    head = fits.copy()
    head[1:] &= (pick[1:] != pick[:-1]) | ~fits[:-1]
    first = np.flatnonzero(head)
    stop = np.flatnonzero(fits & ~np.concatenate((fits[1:] & ~head[1:], [False])))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _powers(len(words), _OTHER), out=sums[1:])
    content = (sums[stop + window] - sums[first]) * _powers(len(words), pow(_OTHER, -1, 1 << 64))[first]
    content = _mix(content + (stop - first).astype(np.uint64) * _U(_BASE))
    return first, stop - first + 1, grams[pick[first]].view(np.int64), content.view(np.int64)


def fragments(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, first window, windows, gram and content hash of all fragments of some texts."""
    words, ends = word_hashes(texts)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    sizes = ends - begins
    owner = np.repeat(np.arange(len(texts)), sizes)
    end = np.repeat(ends, sizes)
    found = []
    for a in range(0, len(words), STEP):
        b = min(len(words), a + STEP + window - 1)
        first, count, g, f = _fragments(words[a:b], end[a:b] - a, window, gram)
        text = owner[first + a] if len(first) else first
        found.append((text, first + a - begins[text], count, g, f))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(5))


def _plain(text: str | None) -> bytes:
    """The words of a text, joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


def _key(words: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(words)).view(np.int64))


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        plain = [_plain(t) for t in frame["text"]]
        out = pd.DataFrame({"id": pd.array(frame["id"], dtype="Int64"), "t": [_key(p) for p in plain]})
        out["n"] = [p.count(b" ") + 1 if p else 0 for p in plain]
        out["sha"] = [hashlib.sha256(p).hexdigest() for p in plain]
        yield out


def _once(frame: pd.DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct texts of a batch with their keys and least ids."""
    least: dict[bytes, int] = {}
    for id, text in zip(frame["id"].fillna(NO_ID).astype("int64"), frame["text"]):
        plain = _plain(text)
        least[plain] = min(id, least.get(plain, NO_ID))
    texts = list(least)
    return texts, np.array([_key(t) for t in texts], dtype=np.int64), np.array(list(least.values()), dtype=np.int64)


def _parts(frames: Iterator[pd.DataFrame], window: int, gram: int) -> Iterator[pd.DataFrame]:
    """Fragments. A gram that two texts of the batch have is known to be shared: its rows are dealt
    out evenly, and one mark tells the other tasks, so a gram that every text has is no hot key."""
    for frame in frames:
        texts, keys, ids = _once(frame)
        text, s, w, g, f = fragments(texts, window, gram)
        order = np.argsort(g, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], g[order][1:] != g[order][:-1]))) if len(g) else order
        sizes = np.diff(np.append(heads, len(g)))
        many = np.minimum.reduceat(text[order], heads) != np.maximum.reduceat(text[order], heads) if len(g) else np.zeros(0, dtype=bool)
        known = np.zeros(len(g), dtype=bool)
        known[order] = np.repeat(many, sizes)
        t = keys[text]
        own = _mix(g.view(np.uint64) ^ _mix(t.view(np.uint64) + s.astype(np.uint64))).view(np.int64)
        out = pd.DataFrame({"key": np.where(known, own, g), "kind": known.astype("int8"), "g": g, "f": f, "t": t, "s": s.astype("int32"), "w": w.astype("int8"), "id": ids[text]})
        marks = pd.DataFrame({c: g[order][heads[many]] if c == "key" else 0 for c in out.columns}, index=range(int(many.sum()))).astype(out.dtypes)
        yield out
        yield marks.assign(kind=np.int8(2))


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, keys, _ = _once(frame)
        yield pd.DataFrame({"t": keys, "raw": texts})


def _strings(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """The word hashes of the wanted fragments of each text."""
    for frame in frames:
        found = []
        for raw, wanted in zip(frame["raw"], frame["wanted"]):
            words, _ = word_hashes([raw])
            found += [(x["g"], x["f"], x["least"], words[x["s"] : x["s"] + x["w"] + window - 1].tobytes()) for x in wanted]
        yield pd.DataFrame(found, columns=["g", "f", "least", "words"]).astype({"g": "int64", "f": "int64", "least": "int64"})


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys, equal for equal ones."""
    return np.unique(keys, return_inverse=True)[1]


def repeats(strings: list[np.ndarray], least: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, least number under its node) of the suffixes of at least ``window`` words.

    The suffix tree of the strings to that depth, as ranks: doubled from one word until they order
    suffixes by ``window`` words. Suffixes of one rank are the leaves under one node of that depth.
    """
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    rank, depth = _dense(np.concatenate(strings)), 1
    while depth < window:
        step = min(depth, window - depth)
        rank = _dense(rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:])
        depth += step
    owner, at = np.repeat(np.arange(len(strings)), sizes), np.arange(ends[-1])
    start = at - (ends - sizes)[owner]
    whole = np.flatnonzero(start + window <= sizes[owner])
    owner, start, node = owner[whole], start[whole], rank[whole]
    under = np.full(int(node.max()) + 1, NO_ID, dtype=np.int64)
    np.minimum.at(under, node, least[owner])
    return owner, start, under[node]


def _tree(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """Suffixes under a node with a smaller id than their own string's."""
    frame = frame.drop_duplicates(["f", "o"])
    own = frame["least"].to_numpy()
    owner, start, least = repeats([np.frombuffer(x, dtype=np.uint64) for x in frame["words"]], own, window)
    less = least < own[owner]
    owner = owner[less]
    return pd.DataFrame({"f": frame["f"].to_numpy()[owner], "o": (frame["o"].to_numpy()[owner] + start[less]).astype("int32"), "least": least[less]})


def _suffixes(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        size = 8 * window
        found = [(f, o, least, words[8 * o : 8 * o + size]) for f, least, words in zip(frame["f"], frame["least"], frame["words"]) for o in range(len(words) // 8 - window + 1)]
        yield pd.DataFrame(found, columns=["f", "o", "least", "words"]).astype({"f": "int64", "o": "int32", "least": "int64"})


LEAST = "f long, o int, least long"


def _lengthened(suffixes: DataFrame, window: int, group: int) -> DataFrame:
    """Repeats among suffixes that are split by prefixes of growing length.

    What has more than ``group`` suffixes under a prefix gets a prefix of one word more. Under a prefix
    of a whole window there is nothing left to order: the least id is an aggregate.
    """
    rest, done = materialize(suffixes, "passage-suffixes"), []
    for depth in range(1, window):
        prefix = F.xxhash64(F.substring("words", 1, 8 * depth))
        counts = rest.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"))
        full = materialize(counts.where(F.col("n") > group).select("p"), "passage-prefixes")
        ready = rest.withColumn("p", prefix).join(full, "p", "left_anti")
        done.append(ready.groupBy("p").applyInPandas(lambda x: _tree(x, window), LEAST))
        if full.isEmpty():
            break
        rest = materialize(rest.withColumn("p", prefix).join(full, "p", "left_semi").drop("p"), "passage-suffixes")
    else:
        node = rest.groupBy("words").agg(F.min("least").alias("under"))
        done.append(rest.join(node, "words").where("under < least").select("f", "o", F.col("under").alias("least")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _stripped(frames: Iterator[pd.DataFrame], window: int, keep: bool) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for t, raw, spans in zip(frame["t"], frame["raw"], frame["spans"]):
            words = raw.split(b" ")
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            for x in spans:
                for o in range(int(x["mask"]).bit_length()):
                    if x["mask"] >> o & 1:
                        edge[x["s"] + o] += 1
                        edge[x["s"] + o + window] -= 1
            stays = np.cumsum(edge[:-1]) == 0
            kept = b" ".join([w for w, stay in zip(words, stays.tolist()) if stay])
            rows.append((t, int((~stays).sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if keep else [])))
        yield pd.DataFrame(rows, columns=["t", "removed", "kept_sha", *(["kept"] if keep else [])])


def _mask(width: Column, test) -> Column:
    """A bit for each window of a fragment that passes."""
    places = F.filter(F.sequence(F.lit(0), width - 1), test)
    return F.aggregate(places, F.lit(0), lambda bits, o: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1), o)))


def strip_passages(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, keep_text: bool = False
) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (and kept_text), a row per row of ``docs``.

    Words are what ASCII white space divides; windows are judged on the input. A null text has no words; a text
    of fewer than ``window`` words keeps all, and so does what repeats within one document only. Of rows
    with one id none removes from the other. A null id is larger than all ids and equal to other nulls.
    Of equal texts the one with the least id is judged, those with larger ids lose all. An
    empty table gives an empty result; other columns are not looked at. Ids are integers below
    2 ** 63 - 1; ``window`` is at most 30 words more than ``gram``. Words are compared by 64-bit hashes, whole texts too.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    with batches(spark, BATCH):
        rows = materialize(source.mapInPandas(_rows, "id long, t long, n long, sha string"), "passage-rows")
        number = F.coalesce("id", F.lit(NO_ID))
        copies = rows.groupBy("t").agg(F.min(number).alias("first"), F.count("*").alias("c")).where("c > 1").select("t", "first")
        copies = materialize(copies, "passage-copies")

        parts = source.mapInPandas(lambda x: _parts(x, window, gram), "key long, kind byte, g long, f long, t long, s int, w byte, id long")
        same = Window.partitionBy("key")
        parts = parts.select("*", F.min("t").over(same).alias("lo"), F.max("t").over(same).alias("hi"), F.max("kind").over(same).alias("top"))
        shared = parts.where("kind < 2 AND (kind = 1 OR lo != hi OR top = 2)").select("g", "f", "t", "s", F.col("w").cast("int").alias("w"), "id")
        shared = materialize(shared, "passage-shared")
        shared = shared.join(copies, "t", "left").select("g", "f", "t", "s", "w", F.coalesce("first", "id").alias("m"))

        one = F.min(F.struct("m", "t", "s", "w")).alias("x")
        strings = shared.groupBy("g", "f").agg(one).select("g", "f", F.col("x.m").alias("least"), "x.t", "x.s", "x.w")
        strings = materialize(strings, "passage-strings")
        total = strings.count()
        hot = strings.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > group).select("g")
        hot = materialize(hot, "passage-hot")

        texts = source.mapInPandas(_texts, "t long, raw binary")
        wanted = strings.groupBy("t").agg(F.collect_list(F.struct("g", "f", "least", "s", "w")).alias("wanted"))
        # A narrow list of the texts first: where it is small, the others never move.
        asked = texts.join(strings.select("t").distinct(), "t", "left_semi").join(wanted, "t")
        content = asked.select("raw", "wanted").mapInPandas(lambda x: _strings(x, window), "g long, f long, least long, words binary")
        bins = F.pmod(F.xxhash64("g"), F.lit(total // group + 1)).alias("bin")
        if hot.isEmpty():
            cool = content.select("f", F.lit(0).alias("o"), "least", "words", bins)
            found = cool.groupBy("bin").applyInPandas(lambda x: _tree(x, window), LEAST)
        else:
            content = materialize(content, "passage-content")
            cool = content.join(hot, "g", "left_anti").select("f", F.lit(0).alias("o"), "least", "words", bins)
            found = cool.groupBy("bin").applyInPandas(lambda x: _tree(x, window), LEAST)
            split = content.join(hot, "g", "left_semi").select("f", "least", "words")
            found = found.unionByName(_lengthened(split.mapInPandas(lambda x: _suffixes(x, window), "f long, o int, least long, words binary"), window, group))
        found = materialize(found, "passage-repeats")

        lists = found.groupBy("f").agg(F.collect_set(F.struct("o", "least")).alias("under"))
        by_string = materialize(strings.select("f", "least").join(lists, "f", "left"), "passage-least")

        def smaller(o: Column) -> Column:
            known = F.array_min(F.transform(F.filter("under", lambda x: x["o"] == o), lambda x: x["least"]))
            return F.coalesce(known, F.col("least")) < F.col("m")

        members = shared.select("f", "t", "s", "w", "m").join(by_string, "f").where((F.col("least") < F.col("m")) | F.col("under").isNotNull())
        members = members.select("t", "s", _mask(F.col("w"), smaller).alias("mask")).where("mask != 0")
        spans = materialize(members.groupBy("t").agg(F.collect_set(F.struct("s", "mask")).alias("spans")), "passage-spans")

        texts = texts.join(spans.select("t"), "t", "left_semi").dropDuplicates(["t"])
        stripped = texts.join(spans, "t").select("t", "raw", "spans")
        known = stripped.mapInPandas(lambda x: _stripped(x, window, keep_text), "t long, removed long, kept_sha string" + (", kept string" if keep_text else ""))
        known = materialize(known, "passage-known")
        out = rows.join(copies, "t", "left").join(known, "t", "left")
        if keep_text:
            # The words of what lost nothing come from the table itself.
            plain = source.mapInPandas(_texts, "t long, raw binary").dropDuplicates(["t"]).select("t", F.col("raw").cast("string").alias("plain"))
            out = out.join(materialize(plain, "passage-plain"), "t")
    gone = (number > F.col("first")) & (F.col("n") >= window)
    return out.select(
        F.col("id").alias(id),
        F.col("n").alias("n_words"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        *([F.when(gone, "").otherwise(F.coalesce("kept", "plain")).alias("kept_text")] if keep_text else []),
    )


def op11_suffix_tree_dedup(spark, folder: str) -> DataFrame:
    return strip_passages(spark.read.parquet(f"{folder}/documents.parquet"))
