"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

Leaves cut the whole text without gaps, so equal roots mean equal texts. A fingerprint is the
root and the leaves' tokens by paragraph and section. Likeness and the places of edits are read
from two fingerprints: equal branches are passed over, leaves of the others are matched.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.llm.sharding import KEYS, LEAST, locate, splitters
from riskline.llm.text import file_place, whole
from riskline.session import materialize, ship

# Up to eight words to the end of a sentence or line, or what lies between words.
LEAF = re.compile(r"(?:[^\s.!?]{1,64}[^\S\n]*){1,8}[.!?]{0,8}[^\S\n]*\n?|[.!?]{1,64}[^\S\n]*\n?|[^\S\n]+\n?|\n")
#: A paragraph whose digest has these bits at zero ends a section, as an empty line does.
SECTION_BITS = 7
MAX_BUCKETS = 16_384

ship(__name__)


def leaves(text: str) -> list[str]:
    """The pieces of a text; joined they are the text."""
    return LEAF.findall(text)


def _token(piece: str) -> int:
    """28 bits of the piece's hash and, as its weight, its words up to 15."""
    h = xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass"))
    return (h >> 36) << 4 | min(15, piece.count(" ") + 1)


def fingerprint(text: str | None) -> str:
    """``root:section/section...``, a section being ``paragraph;paragraph``; null is as empty.

    The root is the digest of the sections' digests, those of their paragraphs', those of the
    paragraphs' leaves in full. A paragraph is written as base64 of its tokens.
    """
    sections: list[list[str]] = [[]]
    tops, paragraphs, whole_leaves, tokens = [], [], [], []

    def end_section() -> None:
        tops.append(xxhash.xxh3_128_digest(b"s" + b"".join(paragraphs)))
        paragraphs.clear()

    def end_paragraph() -> bool:
        digest = xxhash.xxh3_128_digest(b"p" + b"".join(whole_leaves))
        paragraphs.append(digest)
        sections[-1].append(base64.urlsafe_b64encode(np.array(tokens, dtype="<u4").tobytes()).decode().rstrip("="))
        empty = len(tokens) == 1 and last == "\n"
        whole_leaves.clear()
        tokens.clear()
        return empty or not digest[0] & SECTION_BITS

    last = ""
    for last in leaves(text or ""):
        whole_leaves.append(xxhash.xxh3_128_digest(last.encode("utf-8", "surrogatepass")))
        tokens.append(_token(last))
        if last.endswith("\n") and end_paragraph():
            end_section()
            sections.append([])
    if tokens:
        end_paragraph()
    if paragraphs:
        end_section()
    root = xxhash.xxh3_128_hexdigest(b"r" + b"".join(tops))
    return root + ":" + "/".join(";".join(s) for s in sections if s)


def _tokens(part: str) -> np.ndarray:
    return np.frombuffer(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)), dtype="<u4")


def _branches(print_: str) -> list[list[str]]:
    body = print_.partition(":")[2]
    return [s.split(";") for s in body.split("/")] if body else []


def likeness(a: str, b: str) -> float:
    """Share of words in leaves that both have, 1 for equal roots."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    one, two = (Counter(p for s in _branches(x) for p in s) for x in (a, b))
    same = one & two  # equal paragraphs need no look at their leaves
    weight = lambda c: sum(int((_tokens(p) & 15).sum()) * n for p, n in c.items())
    shared = weight(same)
    rest = [Counter() for _ in range(2)]
    for c, into in zip((one - same, two - same), rest):
        for p, n in c.items():
            for t in _tokens(p).tolist():
                into[t] += n
    loose = sum((t & 15) * n for t, n in (rest[0] & rest[1]).items())
    every = 2 * shared + sum((t & 15) * n for c in rest for t, n in c.items())
    return 2 * (shared + loose) / every if every else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` whose branch ``b`` does not have."""
    known_sections = Counter(";".join(s) for s in _branches(b))
    known = Counter(p for s in _branches(b) for p in s)
    out = []
    for i, section in enumerate(_branches(a)):
        if known_sections[";".join(section)]:
            continue
        out += [(i, j) for j, p in enumerate(section) if not known[p]]
    return out


def _pairs(frames: Iterator[pd.DataFrame], counts: dict[int, int]) -> Iterator[pd.DataFrame]:
    """Rows in order, each with the fingerprint of the row after it in its bucket.

    ``counts``: the rows each bucket has to have besides a copy, which it has to end with.
    """
    held, own_rows = None, 0

    def ended() -> None:
        if held is not None and not (held[3] and own_rows == counts[held[0]]):
            raise RuntimeError(f"range {held[0]} has {own_rows} rows of {counts[held[0]]} and {'a' if held[3] else 'no'} row after them: the table changed between two scans")

    def result(row, after):
        _, id, text, _, own = row
        n, half = len(text), len(text) // 2
        edited = text[: n - half] + after[2][:half]
        other = fingerprint(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return id, n, sha, own, other, likeness(own, other), likeness(own, after[4])

    for frame in frames:
        rows = []
        for bucket, id, text, copy in zip(frame["bucket"], frame["id"], frame["text"], frame["copy"]):
            row = (bucket, id, text, copy, fingerprint(text))
            if held is None or held[0] != bucket:
                ended()
                own_rows = 0
            own_rows += not copy
            if held is not None and held[0] == bucket and not held[3]:
                rows.append(result(held, row))
            held = row
        out = pd.DataFrame(rows, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        out["id"] = pd.array([None if pd.isna(i) else int(i) for i in out["id"]], dtype="Int64")
        yield out.astype({"n_chars": "int64", "near_edited": "float64", "near_next": "float64"})
    ended()


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", bucket_bytes: int = 4 << 20) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Each document meets the next by id, the last one the first; rows of one id follow by hash
    of the text, null ids come first, a null text is empty, a single row follows itself, an
    empty table gives no rows. Ids are integers; other columns are not looked at. The order is
    cut into ranges of even bytes, and the first row of a range goes to the range before as well,
    so the texts are exchanged once and no task needs all ids. Both scans must give a row the same
    key: its place in its file is part of it, and a table that is more than a read of files is
    written first. A range that lacks a row in the second scan is an error.
    """
    place = file_place(docs)
    keys = docs.select(
        F.col(id).cast("long").alias("id"),
        whole(text).alias("text"),
        F.coalesce(F.col(id).cast("long"), F.lit(LEAST)).alias("k1"),
        F.xxhash64(whole(text)).alias("k2"),
        (F.monotonically_increasing_id() if place is None else place).alias("k3"),
    )
    if place is None:
        keys = materialize(keys, "fingerprint-rows")
    narrow = materialize(keys.select(*KEYS, (F.octet_length("text") + 1).cast("long").alias("size")), "fingerprint-keys")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    cuts = min(MAX_BUCKETS, total // bucket_bytes + 1)
    bounds = sorted(set(splitters(narrow, "size", [(total * i / cuts, total / cuts / 2) for i in range(1, cuts)]))) if total else []
    key = tuple(map(F.col, KEYS))
    first = F.min(F.struct(*KEYS))
    ranges = narrow.groupBy(locate(bounds, key).alias("bucket")).agg(first.alias("min"), F.count("*").alias("n")).collect()
    heads, counts = {r.bucket: tuple(r["min"]) for r in ranges}, {r.bucket: r.n for r in ranges}
    used = sorted(heads)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    # One entry for each bucket, of which there are at most MAX_BUCKETS.
    count = max(used, default=0) + 1
    nobody = (0, 0, 0)
    head = F.array(*[F.struct(*[F.lit(k).cast("long").alias(n) for k, n in zip(heads.get(b, nobody), KEYS)]) for b in range(count)])
    prior = F.array(*[F.lit(before.get(b, 0)).cast("int") for b in range(count)])
    placed = keys.withColumn("own", locate(bounds, key))
    is_head = F.struct(*KEYS) == F.get(head, F.col("own"))
    places = F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("copy")), F.struct(F.get(prior, F.col("own")).alias("bucket"), F.lit(True).alias("copy")))
    spread = placed.withColumn("place", F.explode(F.when(is_head, places).otherwise(F.slice(places, 1, 1))))
    rows = spread.select("place.bucket", "id", "text", "place.copy", *KEYS).repartition("bucket")
    rows = rows.sortWithinPartitions("bucket", "copy", *KEYS).select("bucket", "id", "text", "copy")
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInPandas(lambda frames: _pairs(frames, counts), schema).withColumnRenamed("id", id)


def op8_merkle_fingerprints(spark, folder: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{folder}/documents.parquet"))
