"""Small corpora with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, size string, bucket int, key string, doc string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("ba", "ko", "li", "mu", "ter", "sön", "an")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def near_copy(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1) + "x"
    return " ".join(words)


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): prose, copies, near copies, passages, and edge cases."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(n)]
    passage = prose(rng, 90)
    texts = list(base)
    texts += [base[0]] * 4 + [near_copy(rng, base[i % 7], e) for i in range(14) for e in (1, 3)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(5)]
    texts += [None, "", " \n\t ", "one", "One", "two words", "Two WORDS", "a b c", "a\nb\nb\nb", "😀 é ü", "x" * 3000, "ab " * 700, "y " * 3]
    texts += ["code under CC BY 4.0, all rights\nreserved", "GNU General Public License version 2 or later; general public license", "cc by cc by"]
    texts += ["mail Ann.Lee@example.org or +1 (415) 555-0100, 10.1.2.3", "key token=abcdef123456 Mrs. Anna Berg and Mr Jon Berg", prose(rng, 20_000)]
    found = [(i, t, rng.choice(("a", "b", "c", "d", "ä", None)) if i % 3 else "hot") for i, t in enumerate(texts)]
    found += [found[3], found[3], (None, base[5], "a"), (None, None, None), (5, "another text under a known id", "b"), (-9, base[8], "Z")]
    rng.shuffle(found)
    return found


def frame(spark: SparkSession, found: list[tuple], parts: int = 3) -> DataFrame:
    """A corpus table whose other columns have names that operators might use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 7, "big", 1, None, "d") for i, t, s in found]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def written(df: DataFrame, folder) -> DataFrame:
    path = str(folder / "documents.parquet")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, k: int) -> frozenset:
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard_groups(texts: list[str | None], k: int, percent: int) -> list[int]:
    """For each text the least position that links reach."""
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if inter and 100 * inter >= percent * (len(a) + len(sets[j]) - inter):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def without_repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, runs, digest of the rest) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
