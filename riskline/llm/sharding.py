"""Even shards by histogram sort.

Rows are ordered by (hash of the text, hash of the id, row number): equal texts stand together
and no two rows share a key. The splitters between shards are found by counting exact bytes in
bins of the key's leading bits, for all splitters at once; a splitter whose bin edge misses its
tolerance is refined inside that bin only, so a group of copies is cut just where keeping it
whole would make the shards uneven. Then the rows are exchanged once.
"""

from __future__ import annotations

import json
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.llm.text import let, whole
from riskline.session import materialize

KEYS = ("k1", "k2", "k3")
DIGIT = 16
LEAST = -(1 << 63)


def _ordered(keys: tuple) -> Column:
    return F.struct(*[(F.lit(k).cast("long") if isinstance(k, int) else k).alias(n) for k, n in zip(keys, KEYS)])


def locate(bounds: list[tuple[int, int, int]], keys: tuple) -> Column:
    """How many of the sorted ``bounds`` are at or below the key, in about 2 * sqrt(n) steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    firsts = F.array(*[_ordered(g[0]) for g in groups])
    rests = F.array(*[F.array(*[_ordered(b) for b in g]) for g in groups])

    def search(key: Column) -> Column:
        coarse = F.size(F.filter(firsts, lambda b: b <= key))
        inside = lambda c: F.when(c == 0, F.lit(0)).otherwise(
            (c - 1) * step + F.size(F.filter(F.get(rests, c - 1), lambda b: b <= key))
        )
        return let(coarse, inside)

    return let(_ordered(keys), search)


def _crossings(bins: DataFrame, wanted: list[tuple[int, int, float]]) -> DataFrame:
    """One row per (open bin i, target t, weight x wanted of it): the bin b that reaches x, its weight w and
    rows n, and the weight before it. The bins of one open bin, 2 ** DIGIT at most, meet in a window."""
    asked = [{"i": i, "t": t, "x": x} for i, t, x in wanted]
    rows = F.explode(F.from_json(F.lit(json.dumps(asked)), "array<struct<i:int,t:int,x:double>>"))
    asked = bins.sparkSession.range(1).select(rows.alias("a")).select("a.*")
    upto = F.sum("w").over(Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("x", upto).withColumn("bin", F.struct("b", "w", "n", (F.col("x") - F.col("w")).alias("before")))
    both = bins.select("i", F.col("x").cast("double").alias("x"), "bin").unionByName(asked, allowMissingColumns=True)
    down = Window.partitionBy("i").orderBy(F.desc("x"), F.col("t").isNotNull(), F.desc("bin.b"))
    reached = F.last("bin", True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    top = F.max("bin").over(Window.partitionBy("i"))
    return both.withColumn("bin", F.coalesce(reached, top)).where("t IS NOT NULL").select("t", "bin.*")


def splitters(rows: DataFrame, weight: str, targets: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Key bounds with, below each, ``target`` of the weight up to its slack or to one row.

    One pass for each refinement, for all targets together. A pass counts up to 2 ** DIGIT bins
    in every open bin, and brings to the driver the one bin that each target falls in, so one row per
    target, whatever the keys. After the first pass only bins that hold more than the slack are open,
    which are fewer than 1 / slack in a share of the whole.
    """
    found: dict[int, tuple[int, int, int]] = {}
    # Open bins: fixed leading keys, key in work, shift and value of its bin, weight below the bin.
    work = {(): ((), 0, 64, 0, 0)}
    asks = {(): list(range(len(targets)))}
    while asks:
        states = {k: work[k] for k in asks}
        hist: dict = {}
        for at, depth in {(s[1], s[2]): None for s in states.values()}.keys():
            edges = {}
            for k, (fixed, a, d, value, _) in states.items():
                if (a, d) == (at, depth):
                    edges[(*fixed, value << depth if depth < 64 else LEAST, *(LEAST,) * (len(KEYS) - at - 1))] = k
            lows = sorted(edges)
            opened = F.array(*map(_ordered, lows))
            numbered = rows.select(*KEYS, F.col(weight).alias("w"), (locate(lows, tuple(map(F.col, KEYS))) - 1).alias("i"))
            mine = numbered.where("i >= 0").withColumn("low", F.get(opened, F.col("i")))
            inside = F.lit(True)
            for name in KEYS[:at]:
                inside &= F.col(name) == F.col(f"low.{name}")
            if depth < 64:
                inside &= F.shiftright(KEYS[at], depth) == F.shiftright(F.col(f"low.{KEYS[at]}"), depth)
            bins = mine.where(inside).groupBy("i", F.shiftright(KEYS[at], depth - DIGIT).alias("b")).agg(F.sum("w").alias("w"), F.count("*").alias("n"))
            wanted = [(i, t, float(targets[t][0] - states[edges[low]][4])) for i, low in enumerate(lows) for t in asks[edges[low]]]
            for r in _crossings(bins, wanted).collect():
                hist[r.t] = (r.b, r.w, r.n, r.before)
        asks_next: dict = {}
        for k, wanted in asks.items():
            fixed, at, depth, _, below = states[k]
            for t in wanted:
                target, slack = targets[t]
                b, w, n, inner = hist[t]
                before = below + inner
                after = before + w
                near_low = target - before <= after - target
                tail = (LEAST,) * (len(KEYS) - len(fixed) - 1)
                low = (*fixed, b << (depth - DIGIT), *tail)
                # The key after the bin: its lower edge plus its width, or the end of all keys.
                top = (b + 1) << (depth - DIGIT)
                high = (*fixed, top, *tail) if top < 1 << 63 else None
                if n == 1 or min(target - before, after - target) <= slack:
                    if near_low or high is not None:
                        found[t] = low if near_low else high
                        continue
                if depth > DIGIT:
                    key = (fixed, at, depth - DIGIT, b)
                    work[key] = (fixed, at, depth - DIGIT, b, before)
                elif at + 1 < len(KEYS):
                    key = ((*fixed, b), at + 1, 64, 0)
                    work[key] = ((*fixed, b), at + 1, 64, 0, before)
                else:
                    found[t] = low
                    continue
                asks_next.setdefault(key, []).append(t)
        asks = asks_next
    return [found[t] for t in sorted(found)]


def shard(
    docs: DataFrame,
    shards: int = 16,
    id: str = "doc_id",
    text: str = "text",
    tolerance: float = 0.01,
    rows_per_bucket: int = 1_000_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep``, size, text_crc32, shard and slot.

    A row weighs the UTF-8 bytes of its text (none for null) plus one. Every shard holds an
    equal part of the weight up to ``tolerance`` of a shard, or to the weight of one row where
    single rows are larger than that. Equal texts share a shard except where a border has to
    cut their group. Slots count from 0 without gaps. Repeated rows and null ids are rows like
    others; an empty table gives an empty result; columns outside id, text and ``keep`` are
    not looked at. Numbering works in buckets of about ``rows_per_bucket`` rows, each a range of
    the key inside one shard, so that no shard has to pass through one task.
    """
    clash = {c.lower() for c in keep} & {"size", "text_crc32", "shard", "slot", id.lower()}
    if clash:
        raise ValueError(f"keep has names of result columns: {sorted(clash)}")
    value = whole(text)
    rows = materialize(
        docs.select(
            F.struct(F.col(id).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("kept"),
            (F.octet_length(value) + 1).cast("long").alias("size"),
            F.crc32(value.cast("binary")).alias("text_crc32"),
            F.xxhash64(value).alias("k1"),
            F.xxhash64(F.col(id)).alias("k2"),
            F.monotonically_increasing_id().alias("k3"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size").alias("w"), F.count("*").alias("n")).first()
    parts = max(1, ceil(total.n / shards / rows_per_bucket))
    weight, cuts = total.w or 0, shards * parts
    targets = [(weight * i / cuts, weight / shards * tolerance if i % parts == 0 else weight / cuts / 2) for i in range(1, cuts)]
    bounds = sorted(splitters(rows, "size", targets)) if total.n else []
    rows = rows.withColumn("bucket", locate(bounds, tuple(map(F.col, KEYS))))
    counts = {r.bucket: r["count"] for r in rows.groupBy("bucket").count().collect()}
    starts, at = [], 0
    for bucket in range(cuts):
        at = 0 if bucket % parts == 0 else at
        starts.append((bucket, at))
        at += counts.get(bucket, 0)
    # One small row for each bucket; Spark broadcasts it while it is below its own limit.
    offsets = docs.sparkSession.createDataFrame(starts, "bucket int, start long")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*KEYS)) - 1
    return rows.withColumn("place", place).join(offsets, "bucket").select(
        F.col("kept.id").alias(id),
        *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep)],
        "size",
        "text_crc32",
        F.floor(F.col("bucket") / parts).cast("int").alias("shard"),
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
    )


def op9_histogram_shards(spark, folder: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{folder}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
