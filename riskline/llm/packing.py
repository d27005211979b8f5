"""Best-fit packing of tokenized documents into sequences of fixed length.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` bins whatever
the corpus: patterns of a few lengths that fill a sequence are enumerated, their repeat counts
fitted to the histogram by non-negative least squares and rounded, and what is left is packed by
best fit, again on counts. The n-th piece of a length then finds its place by its number.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskline.llm.text import batches, byte_signs
from riskline.session import materialize, ship

CAPACITY = 1024
END = 2
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Documents that come to a worker at once, and ids after which it hands its pieces on.
BATCH = 1_000
BATCH_IDS = 1 << 20

ship(__name__)


class _Encoder:
    """Token ids of a byte-level vocabulary file, special words of its own read as such.

    In these files merges have the order of the ids they make, so the bytes with their ids are all
    an encoder needs; the tests hold its ids to those of the library that the file is made for.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        signs = byte_signs()
        ranks = {bytes(signs[s] for s in token): id for token, id in vocabulary["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text and the end id."""
        return np.append(self.encoding.encode_to_numpy(text, allowed_special="all"), END).astype("<u4")


def _encoder(path: str) -> _Encoder:
    """The encoder of this worker process, kept for its next tasks."""
    kept = sys.modules.setdefault("_riskline_worker", types.ModuleType("_riskline_worker")).__dict__
    if path not in kept:
        kept[path] = _Encoder(path)
    return kept[path]


def _cut(frames: Iterator[pd.DataFrame], path: str, capacity: int, keep_ids: bool) -> Iterator[pd.DataFrame]:
    """Pieces of the documents; ``rank`` numbers those of one length within the task."""
    encoder, seen, part = _encoder(path), defaultdict(int), TaskContext.get().partitionId()
    columns = ["part", "id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if keep_ids else [])]
    for frame in frames:
        rows, size = [], 0
        for id, text in zip(frame["id"], frame["text"]):
            ids = encoder.ids(text)
            n = len(ids)
            first = n % capacity or capacity if n > capacity else n
            for piece, (a, b) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n + 1, capacity)])):
                rows.append((part, None if pd.isna(id) else int(id), piece, a, b - a, zlib.crc32(ids[a:b]), seen[b - a], *([ids[a:b].astype("int32")] if keep_ids else [])))
                seen[b - a] += 1
            size += n
            if size >= BATCH_IDS:
                yield _frame(rows, columns)
                rows, size = [], 0
        yield _frame(rows, columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["id"] = pd.array(out["id"], dtype="Int64")
    return out.astype({"part": "int32", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64", "rank": "int64"})


def patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to four lengths that fill a sequence, 0 for none; lengths that occur only."""
    have = np.flatnonzero(counts)
    fits = np.zeros(capacity + 1, dtype=bool)
    fits[have] = True
    fits[0] = True
    rows = [(capacity, 0, 0, 0)] if fits[capacity] else []
    common = have[np.argsort(-counts[have], kind="stable")][:48]
    for a in have[have < capacity].tolist():
        b = capacity - a
        if a >= b and fits[b]:
            rows.append((a, b, 0, 0))
        for c in {*common.tolist(), *range(1 + a % 13, b // 2 + 1, 13)}:
            if fits[c] and a >= b - c >= c and fits[b - c]:
                rows.append((a, b - c, c, 0))
            if 3 * c <= b and fits[c] and (b - c) % 2 == 0 and a >= (b - c) // 2 >= c and fits[(b - c) // 2]:
                rows.append((a, (b - c) // 2, (b - c) // 2, c))
    return np.array(rows or np.zeros((0, 4)), dtype=np.int64).reshape(-1, 4)


def fit(table: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with least squared difference from the histogram (accelerated
    projected gradient, one Lipschitz bound for the step)."""
    used = table > 0
    size = len(counts)

    def product(x: np.ndarray) -> np.ndarray:
        return np.bincount(table.ravel(), weights=(x[:, None] * used).ravel(), minlength=size)

    def transposed(r: np.ndarray) -> np.ndarray:
        return (r[table] * used).sum(axis=1)

    v = np.ones(len(table))
    for _ in range(20):
        v = transposed(product(v))
        bound = np.linalg.norm(v) or 1.0
        v /= bound
    x = y = np.zeros(len(table))
    t = 1.0
    target = counts.astype(float)
    target[0] = 0
    for _ in range(rounds):
        new = np.maximum(0, y - transposed(product(y) - target) / (bound * 1.05))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences with the same content stay one entry."""
    spaces: dict[int, list[list]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        many = int(left[length])
        space = length
        while many and space <= capacity:
            if not spaces[space]:
                space += 1
                continue
            content, n = spaces[space].pop()
            took = min(n, many)
            if n > took:
                spaces[space].append([content, n - took])
            spaces[space - length].append([(*content, length), took])
            many -= took
            if space - length >= length:
                space -= length
        each = capacity // length
        if many >= each:
            spaces[capacity - each * length].append([(length,) * each, many // each])
        if many % each:
            spaces[capacity - many % each * length].append([(length,) * (many % each), 1])
    return [(tuple(c), n) for group in spaces.values() for c, n in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in order, how many such sequences), using every piece once."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out, left = [], counts.copy()
    table = patterns(counts, capacity)
    if len(table):
        wanted = np.floor(fit(table, counts)).astype(np.int64)
        for i in np.argsort(-wanted, kind="stable"):
            lengths, times = np.unique(table[i][table[i] > 0], return_counts=True)
            n = int(min(wanted[i], (left[lengths] // times).min()))
            if n <= 0:
                continue
            left[lengths] -= n * times
            out.append((tuple(int(x) for x in table[i] if x), n))
    return out + _best_fit(left, capacity)


def _places(layout: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence and offset of every slot."""
    slots, sequence, used = defaultdict(list), 0, defaultdict(int)
    for lengths, n in layout:
        offset = 0
        for x in lengths:
            slots[x].append((used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*s)) for x, s in slots.items()}


def pack(
    docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = VOCABULARY, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset (and ids), a row per piece.

    A document is its ids followed by the end id; a null text is empty and so only the end id.
    Longer ones than ``capacity`` are cut into full pieces behind a first piece that holds the
    rest. Repeated rows and null ids are documents of their own, an empty table gives no piece,
    columns other than id and text are not looked at. Ids are integers. A special word of the vocabulary
    in a text is its id, as for the tokenizer at its defaults. Texts never move;
    pieces move once, as numbers. Only the histogram comes to the driver.
    """
    cut = "part int, id long, piece int, start long, length long, ids_crc32 long, rank long" + (", ids array<int>" if keep_ids else "")
    source = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with batches(docs.sparkSession, BATCH):
        pieces = materialize(source.mapInPandas(lambda frames: _cut(frames, path, capacity, keep_ids), cut), "pieces")
    in_part = materialize(pieces.groupBy("part", "length").count(), "piece-counts")
    # At most ``capacity`` rows.
    histogram = {r.length: r.n for r in in_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = _places(plan(histogram, capacity))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = in_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
    extra = ["ids"] if keep_ids else []
    numbered = numbered.select("id", "piece", "start", "length", "ids_crc32", "rank", *extra)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        """Only the two numbers come to Python, whatever else a row carries."""
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(sizes, kind="stable")
        out = np.zeros((2, len(order)), dtype=np.int64)
        for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if len(rows):
                firsts, sequences, offsets = places[int(sizes[rows[0]])]
                at = np.searchsorted(firsts, ranks[rows], side="right") - 1
                out[0, rows], out[1, rows] = sequences[at] + ranks[rows] - firsts[at], offsets[at]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    placed = numbered.withColumn("at", place("length", "rank"))
    return placed.select(F.col("id").alias(id), "piece", "start", "length", "ids_crc32", *extra, "at.sequence_id", "at.offset")


def op4_best_fit_packing(spark, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"))
