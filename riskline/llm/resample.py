"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs: one of labelled good documents, one of
the whole corpus. A document's importance is the ratio of its likelihoods, and a sample without
replacement by importance is the k largest of log importance plus Gumbel noise. k is the share
of good documents among the labelled times the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.llm.sharding import KEYS, locate, splitters
from riskline.session import materialize, ship

ship(__name__)

BUCKETS = 1 << 18
# Labelled documents the target model is fitted on at most, the first by hash.
MAX_LABELLED = 50_000
# A document's mean log ratio counts as that of a document with so many n-grams.
SHARPNESS = 400.0
# Counts added to every bucket, for words and for pairs, and the weights of their means.
PRIOR = (3.0, 10.0)
WEIGHT = (1.0, 0.5)
CHUNK = 1 << 20
_U = np.uint64
_TABLE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Blank, part of a word (letters, digits, bytes of other scripts) or a sign of its own.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[:33] = 0
_KIND[48:58] = _KIND[97:123] = _KIND[65:91] = _KIND[128:] = 1
_BASE = 0x9E3779B97F4A7C15
_KEPT: dict[int, np.ndarray] = {}


def _powers(size: int, base: int) -> np.ndarray:
    if len(_KEPT.get(base, ())) < size:
        out = np.full(max(size, CHUNK + 1024), base, dtype=np.uint64)
        out[0] = 1
        _KEPT[base] = np.multiply.accumulate(out)
    return _KEPT[base][:size]


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of the texts: buckets of words, buckets of pairs (from BUCKETS on, -1 after the
    last word of a text) and the number of words of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < CHUNK):
            size += len(raw[end]) + 1
            end += 1
        data = _LOWER[np.frombuffer(b" ".join(raw[at:end]) + b" ", dtype=np.uint8)]
        kind = _KIND[data]
        before, after = np.concatenate(([0], kind[:-1])), np.concatenate((kind[1:], [0]))
        starts = np.flatnonzero((kind == 2) | ((kind == 1) & (before != 1)))
        stops = np.flatnonzero((kind == 2) | ((kind == 1) & (after != 1))) + 1
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * _powers(len(data), _BASE), out=sums[1:])
        h = (sums[stops] - sums[starts]) * _powers(len(data) + 1, pow(_BASE, -1, 1 << 64))[starts]
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        h ^= h >> _U(33)
        counts = np.diff(np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw[at:end]])))
        one = (h % _U(BUCKETS)).astype(np.int64)
        pair = np.full(len(h), -1, dtype=np.int64)
        pair[:-1] = BUCKETS + (((h[:-1] * _U(_BASE) + h[1:]) >> _U(20)) % _U(BUCKETS)).astype(np.int64)
        last = np.cumsum(counts)[counts > 0] - 1
        pair[last] = -1
        yield one, pair, counts
        at = end


def _count(frames: Iterator[pd.DataFrame], good: frozenset) -> Iterator[pd.DataFrame]:
    """Per task: documents' n-grams by bucket, of all rows and of the labelled good ones."""
    every, target = np.zeros(2 * BUCKETS, dtype=np.int64), np.zeros(2 * BUCKETS, dtype=np.int64)
    for frame in frames:
        chosen = frame["id"].isin(good).to_numpy()
        for mask, into in ((chosen, target), (~chosen, every)):
            for one, pair, _ in ngrams(frame["text"][mask].tolist()):
                into += np.bincount(one, minlength=2 * BUCKETS) + np.bincount(pair[pair >= 0], minlength=2 * BUCKETS)
    every += target
    used = np.flatnonzero(every)
    yield pd.DataFrame({"bucket": used, "n": every[used], "good": target[used]})


def log_ratios(every: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log likelihood ratio of each bucket, words and pairs each a model of its own."""
    out = np.zeros(2 * BUCKETS)
    for half, prior in zip((slice(0, BUCKETS), slice(BUCKETS, None)), PRIOR):
        expected = every[half] / max(1, every[half].sum()) * target[half].sum()
        out[half] = np.log((target[half] + prior) / (expected + prior))
    return out


def _score(frames: Iterator[pd.DataFrame], ratios: np.ndarray) -> Iterator[pd.DataFrame]:
    for frame in frames:
        scores, sizes = [], []
        for one, pair, counts in ngrams(frame["text"].tolist()):
            own = np.concatenate(([0.0], np.cumsum(ratios[one])))
            both = np.concatenate(([0.0], np.cumsum(np.where(pair >= 0, ratios[pair], 0.0))))
            edges = np.concatenate(([0], np.cumsum(counts)))
            mean = lambda sums, n: (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(n, 1)  # noqa: E731, B023
            scores.append(WEIGHT[0] * mean(own, counts) + WEIGHT[1] * mean(both, counts - 1))
            sizes.append(counts)
        out = pd.DataFrame({"id": frame["id"].astype("Int64")})
        out["n_words"] = np.concatenate(sizes).astype("int64") if sizes else pd.Series(dtype="int64")
        out["score"] = np.round(np.concatenate(scores), 9) if scores else pd.Series(dtype="float64")
        yield out


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Log ratios by bucket, and the share of good documents among the labelled.

    ``labels``: id, quality, toxic. A document is good if all its rows say quality 1 and
    toxic 0; null labels do not count. Corpus counts cover all documents.
    """
    judged = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col(id).cast("long").alias("id"))
    judged = judged.agg((F.min((F.col("quality") == 1) & (F.col("toxic") == 0))).alias("good"))
    share = judged.agg(F.avg(F.col("good").cast("double"))).first()[0]
    # At most max_labelled ids.
    sample = judged.where("good AND id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(max_labelled).collect()
    good = frozenset(r.id for r in sample)
    source = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = source.mapInPandas(lambda f: _count(f, good), "bucket int, n long, good long")
    every, target = np.zeros(2 * BUCKETS, dtype=np.int64), np.zeros(2 * BUCKETS, dtype=np.int64)
    # One row for each bucket, whatever the corpus.
    table = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toPandas()
    every[table["bucket"]], target[table["bucket"]] = table["n"], table["good"]
    return log_ratios(every, target), 1.0 if share is None else share


def resample(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", seed: str = "resample-1", share: float | None = None) -> DataFrame:
    """id, n_words, score (mean log ratio), weight (log importance plus noise), kept.

    One row per row of ``docs``. ``share`` of the rows are kept, by default that of the good
    among the labelled. A null or empty text has no n-gram and a log importance of 0. Rows with one
    id draw the same noise; ties go by hash of the id and row number. Without labels all ratios are
    0 and everything is kept; an empty table gives an empty result; other columns are not
    looked at. Ids are integers. The k-th weight is found by counting, not by a sort.
    """
    ratios, found = fit(docs, labels, id, text)
    share = found if share is None else share
    source = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scored = source.mapInPandas(lambda f: _score(f, ratios), "id long, n_words long, score double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) + 0.5) / float(1 << 53)
    weight = F.col("score") * SHARPNESS - F.log(-F.log(uniform))
    keyed = scored.withColumn("weight", weight).withColumns(
        {"k1": F.round(F.col("weight") * 1e9).cast("long"), "k2": F.xxhash64("id"), "k3": F.monotonically_increasing_id(), "one": F.lit(1).cast("long")}
    )
    keyed = materialize(keyed, "resample-scores")
    rows = keyed.count()
    out = rows - round(rows * share)
    bound = splitters(keyed, "one", [(out, 0.0)]) if 0 < out < rows else []
    kept = locate(bound, tuple(map(F.col, KEYS))) == 1 if bound else F.lit(out == 0)
    return keyed.select(F.col("id").alias(id), "n_words", "score", "weight", kept.alias("kept"))


def op6_importance_resampling(spark, folder: str) -> DataFrame:
    return resample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
