"""Alignment of two tokenizers' tokens over the same bytes.

The ends of the tokens of both sides, in bytes from the start, are keys of two dictionaries that give the
tokens ending there. The keys that both have, in order, cut the two id lists into groups of the
same bytes, and every pair of tokens of both sides that end together is a link. A text is
aligned in spans: both tokenizers always cut before a lone space between two signs that are no white
space, so spans between such places are aligned by themselves, once for every distinct span in a
worker's memory, and a text's groups and links are those of its spans in turn.

How often an id pair is linked in the corpus is counted over all texts and joined back to them.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.llm.text import batches, byte_signs
from riskline.session import materialize, ship

ship(__name__)

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# Bytes of aligned spans that a worker keeps, spans up to LONGEST characters.
CACHE_BYTES = 320 << 20
LONGEST = 200
# Missing spans that are encoded in one piece.
BLOCK = 2_000
# Documents a worker holds at once.
BATCH = 1_000
WHITE_RUN = re.compile(r"\s\s|\s\Z")
CUT = re.compile(r"(?<=\S) (?=\S)")
BLANK_SIGN = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class ByteLevel:
    """A byte-level vocabulary file: ids of texts and the bytes of an id. Special words are text.

    In these files merges have the order of the ids they make, so the bytes with their ids are all an encoder
    needs; the tests hold its ids to those of the library that the file is made for.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        special = {t["id"] for t in vocabulary["added_tokens"]}
        signs = byte_signs()
        self.bytes = {id: bytes(signs[s] for s in token) for token, id in vocabulary["model"]["vocab"].items() if id not in special}
        self.encode = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={raw: id for id, raw in self.bytes.items()}, special_tokens={}).encode_ordinary

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.encode(f" {t}") for t in texts]


class Pieces:
    """A sentence piece model, which puts a space in front of a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for id in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(id)
            byte = BYTE_PIECE.match(piece) if self.model.is_byte(id) else None
            self.bytes[id] = bytes([int(byte[1], 16)]) if byte else piece.replace(BLANK_SIGN, " ").encode()
        # A piece with a blank behind another sign could cross the border of two spans.
        self.crosses = any(BLANK_SIGN in self.model.id_to_piece(id).lstrip(BLANK_SIGN) for id in self.bytes)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def align(a: list[int], b: list[int], a_sizes: dict[int, int], b_sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """The common ends of two id lists over the same bytes, with the tokens of a and of b before each.

    These are the ends of the groups, and the last tokens of a group are a link: no token is without
    bytes, so one token of each side ends at an offset.
    """
    a_ends = dict(zip(accumulate([a_sizes[id] for id in a]), range(1, len(a) + 1)))
    b_ends = dict(zip(accumulate([b_sizes[id] for id in b]), range(1, len(b) + 1)))
    return [(end, a_ends[end], b_ends[end]) for end in sorted(a_ends.keys() & b_ends.keys())]


def spans(text: str) -> list[str]:
    """The text cut at lone spaces; each span has a space before it that is not part of the string."""
    if WHITE_RUN.search(text) or text[:1].isspace():
        first, *rest = CUT.split(f" {text}")
        return [first[1:], *rest]
    return text.split(" ")


class _Spans(dict):
    """Aligned spans: (tokens of a, of b, groups, their string, links as 64-bit numbers: id of a, then of b) or None.

    None for a span whose tokens do not give its bytes. Missing spans are encoded together, as a
    text of which they are the spans; beyond its size the memory starts anew.
    """

    def __init__(self, a: str, b: str):
        super().__init__()
        self.a, self.b, self.size = ByteLevel(a), Pieces(b), 0
        self.sizes = [{id: len(raw) for id, raw in side.bytes.items()} for side in (self.a, self.b)]
        if any(0 in sizes.values() for sizes in self.sizes):
            raise ValueError("a token without bytes has no end of its own")
        # Every id with each sign that can stand behind it.
        self.signs = [f"{id}{sign}" for id in range(max(map(max, self.sizes)) + 1) for sign in ",|;"]
        self.widths = np.array([len(s) for s in self.signs])

    def learn(self, wanted: set[str]) -> dict:
        """The long spans among ``wanted``, which are not kept; the others are in memory afterwards."""
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = 0
        passing: dict[str, tuple | None] = {}
        blocks: list[list[str]] = [[]]
        for span in wanted:
            if span in self:
                continue
            if len(span) > LONGEST or not span or span[0].isspace() or span[-1].isspace():
                blocks.insert(0, [span])
                continue
            if len(blocks[-1]) == BLOCK:
                blocks.append([])
            blocks[-1].append(span)
        for block in blocks:
            for span, found in zip(block, self._each(block)):
                if len(span) > LONGEST:
                    passing[span] = found
                    continue
                self[span] = found
                self.size += 350 + 2 * len(span) + (len(found[3]) + len(found[4]) if found else 0)
        return passing

    def _each(self, block: list[str]) -> list[tuple | None]:
        """The spans of a block; one whose tokens do not give its bytes is found by halves."""
        found = self._aligned(block) if block else []
        if found is not None or len(block) == 1:
            return [None] if found is None else found
        half = len(block) // 2
        return self._each(block[:half]) + self._each(block[half:])

    def _aligned(self, block: list[str]) -> list[tuple] | None:
        """The spans one after the other, as in a text; None if the tokens of either side give other bytes."""
        text = " ".join(block)
        a, b = self.a.ids([text])[0], [id for ids in self.b.ids(block) for id in ids]
        raw = f" {text}".encode("utf-8", "surrogatepass")
        names, pieces = self.a.bytes, self.b.bytes
        if b"".join([names[id] for id in a]) != raw or b"".join([pieces[id] for id in b]) != raw:
            return None
        common, x, y = np.array(align(a, b, *self.sizes), dtype=np.int64).T
        stops = np.cumsum([len(s.encode("utf-8", "surrogatepass")) + 1 for s in block])
        at = np.searchsorted(common, stops)
        if (common[np.minimum(at, len(common) - 1)] != stops).any():
            return None
        left, right = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        # Tokens in the order of the string, those of a group's a before those of its b, with the sign behind each.
        signs = np.empty(len(a) + len(b), dtype=np.int64)
        behind_a, behind_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        behind_a[x - 1], behind_b[y - 1] = 1, 2
        before = np.concatenate(([0], y[:-1]))
        signs[np.arange(len(a)) + np.repeat(before, np.diff(x, prepend=0))] = 3 * left + behind_a
        signs[np.arange(len(b)) + np.repeat(x, np.diff(y, prepend=0))] = 3 * right + behind_b
        groups = "".join(map(self.signs.__getitem__, signs.tolist())).encode()
        links = np.stack((right[y - 1], left[x - 1]), axis=1).astype("<i4").tobytes()
        # Where every span ends: in tokens, groups and signs.
        n_a, n_b, n = x[at], y[at], at + 1
        ends = np.cumsum(self.widths[signs])[n_a + n_b - 1].tolist()
        counts = [np.diff(v, prepend=0).tolist() for v in (n_a, n_b, n)]
        texts = [groups[i : j - 1] for i, j in zip([0, *ends], ends)]
        stop = (8 * n).tolist()
        return list(zip(*counts, texts, [links[i:j] for i, j in zip([0, *stop], stop)]))


def _spans(a: str, b: str) -> _Spans:
    """The memory of this worker process, kept for its next tasks."""
    kept = sys.modules.setdefault("_riskline_worker", types.ModuleType("_riskline_worker")).__dict__
    if ("spans", a, b) not in kept:
        kept["spans", a, b] = _Spans(a, b)
    return kept["spans", a, b]


def _rows(frames: Iterator[pd.DataFrame], a: str, b: str, keep: bool) -> Iterator[pd.DataFrame]:
    """A row per document: its number, counts, digest of its groups, distinct linked pairs and how often."""
    memory, part, number = _spans(a, b), TaskContext.get().partitionId() << 40, 0
    for frame in frames:
        cut = [None if not t else [t] if memory.b.crosses else spans(t) for t in frame["text"]]
        passing = memory.learn(set().union(*(c for c in cut if c)))
        found = []
        for id, parts in zip(frame["id"], cut):
            known = [memory[s] if s in memory else passing[s] for s in parts] if passing and parts else [memory[s] for s in parts or ()]
            row = [part + number, None if pd.isna(id) else int(id)]
            number += 1
            if not known or None in known:
                found.append((*row, 0, 0, 0, 0, "", [], [], *([""] if keep else [])))
                continue
            n_a, n_b, n_groups, texts, links = zip(*known)
            whole = b";".join(texts)
            codes = np.frombuffer(b"".join(links), dtype="<i8")
            pairs, counts = np.unique(codes, return_counts=True)
            found.append((*row, sum(n_a), sum(n_b), sum(n_groups), len(codes), hashlib.sha256(whole).hexdigest(), pairs, counts.astype("int32"), *([whole.decode()] if keep else [])))
        out = pd.DataFrame(found, columns=["row", "id", "n_a", "n_b", "n_groups", "n_links", "sha", "pairs", "counts", *(["groups"] if keep else [])])
        out["id"] = pd.array(out["id"], dtype="Int64")
        yield out


def aligned(docs: DataFrame, id: str = "doc_id", text: str = "text", a: str = BYTE_LEVEL, b: str = PIECES, keep_groups: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups), a row per row.

    ``groups`` is the alignment itself, ids of both sides: ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and those
    whose tokens do not give back their bytes (with the sign that stands for a blank in pieces, say)
    have zeros and empty strings. Texts are aligned whole, whatever their length. Repeated rows and null
    ids are rows of their own, and their links count; columns other than id and text are not
    looked at; an empty table gives no rows. Ties: all pairs that are counted most for an id
    of b are its best. Ids are integers.

    What moves is the distinct pairs of every document, two numbers each, and only where the table of
    pairs, one row per pair that occurs, is beyond Spark's limit for broadcasts.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "row long, id long, n_a long, n_b long, n_groups long, n_links long, sha string, pairs array<long>, counts array<int>" + (", groups string" if keep_groups else "")
    with batches(spark, BATCH):
        rows = materialize(source.mapInPandas(lambda x: _rows(x, a, b, keep_groups), schema), "aligned")
    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = materialize(linked.groupBy("pair").agg(F.sum("n").alias("count")), "aligned-pairs")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = counts.groupBy(of_b).agg(F.max("count").alias("most"))
    counts = counts.select("pair", "count", of_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    counts = materialize(counts, "aligned-counts")
    sums = linked.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = rows.drop("pairs", "counts").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).cast("long").alias("n_best"),
        F.coalesce("count_sum", zero).cast("long").alias("count_sum"),
        F.col("sha").alias("groups_sha256"),
        *(["groups"] if keep_groups else []),
    )


def op12_tokenizer_alignment(spark, folder: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{folder}/documents.parquet"))
