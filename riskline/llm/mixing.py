"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source's share of the mix is the documents below a
threshold on that hash, so a larger budget always contains a smaller one. The threshold is
found from histograms of words over (source, leading hash bits): only the bin that the budget
ends in is counted again, with more bits, until one document decides. Nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.llm.text import file_place, whole, word_count
from riskline.session import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
DIGIT = 12
BITS = 60


def unit_hash(id: Column) -> Column:
    """60 bits of the id's MD5, a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` with ``target``: a row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share the whole size; a
    target stops at ``most`` times its source and the excess goes to the others by weight.
    With sources in order of size per weight, those that stop are a prefix, so one running sum
    finds the level. The windows here run over sources, not documents.
    """
    named = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    priced = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    level = (
        F.sum("source_size").over(Window.partitionBy()).cast("double")
        - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    ) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    stops = F.col("level") * F.col("weight") >= F.col("cap")
    shared = F.max(F.when(~F.col("stops"), F.col("level"))).over(Window.partitionBy())
    filled = priced.withColumn("level", level).withColumn("stops", stops).withColumn("shared", shared)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("shared") * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, below, row_below``: take rows with ``u < below``, or ``u = below`` and
    ``row < row_below``, to come nearest to ``need`` words of ``budgets``.

    ``rows``: source, size, u (60 bits), row (unique). One pass of the open sources per 12 bits.
    """
    steps = [("u", s) for s in range(BITS - DIGIT, -1, -DIGIT)] + [("row", s) for s in range(BITS - DIGIT, -1, -DIGIT)]
    state = budgets.where("need > 0").select(
        "source", "need", F.lit(0).cast("long").alias("at_u"), F.lit(0).cast("long").alias("at_row")
    )
    done = None
    for key, shift in steps:
        here = f"at_{key}"
        r, s = rows.alias("r"), state.alias("s")
        inside = F.shiftright(F.col(f"r.{key}"), shift + DIGIT) == F.col(f"s.{here}")
        if key == "row":
            inside &= F.col("r.u") == F.col("s.at_u")
        bins = (
            r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & inside)
            .groupBy("s.source", "s.need", "s.at_u", F.shiftright(F.col(f"r.{key}"), shift).alias("bin"))
            .agg(F.sum("r.size").alias("words"), F.sum((F.col("r.size") > 0).cast("long")).alias("docs"))
        )
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        edge = bins.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
        edge = materialize(edge.where("before < need AND need <= upto"), "mix-edge")
        take = (F.col("upto") - F.col("need") <= F.col("need") - F.col("before")).cast("long")
        bound = F.shiftleft(F.col("bin") + take, shift)
        closed = edge.where("docs = 1").select(
            "source",
            (bound if key == "u" else F.col("at_u")).alias("below"),
            (F.lit(0).cast("long") if key == "u" else bound).alias("row_below"),
        )
        done = closed if done is None else done.unionByName(closed)
        state = edge.where("docs > 1").select(
            "source", (F.col("need") - F.col("before")).alias("need"),
            (F.col("bin") if key == "u" else F.col("at_u")).alias("at_u"),
            (F.lit(0).cast("long") if key == "u" else F.col("bin")).alias("at_row"),
        )
        if state.isEmpty():
            break
    return done


def mix_plan(docs: DataFrame, id: str, text: str, source: str, weights: tuple[int, ...], most: int, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents as numbers (id, source, size, u, row), and a row of the plan per source:
    source_size, target, times every document is taken, and the threshold for once more.
    ``row`` tells rows of one id apart, by default their number in this scan."""
    row = F.monotonically_increasing_id() if row is None else row
    rows = materialize(
        docs.select(
            F.col(id).alias("id"), F.col(source).cast("string").alias("source"), word_count(whole(text)).alias("size"),
            unit_hash(F.col(id)).alias("u"), row.alias("row"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets(sizes, weights, most).withColumn("times", times)
    plan = materialize(plan.withColumn("need", F.col("target") - F.col("times") * F.col("source_size")), "mix-plan")
    cut = materialize(thresholds(rows, plan), "mix-cut").alias("t")
    plan = plan.alias("p").join(cut, F.col("p.source").eqNullSafe(F.col("t.source")), "left")
    return rows, materialize(plan.select("p.*", "below", "row_below"), "mix-cuts")


def _copies(u: Column, row: Column) -> Column:
    """How often a document of a joined plan row is taken."""
    more = (u < F.col("p.below")) | ((u == F.col("p.below")) & (row < F.col("p.row_below")))
    return F.col("p.times") + F.coalesce(more, F.lit(False)).cast("long")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """id, source, size, source_size, target and ``taken`` words, one row per row of ``docs``.

    A source whose target is t times its size gives every document floor(t) times and the
    hash-selected rest once more, so no document exceeds ``most`` times its size and a source
    misses its target by at most half of one document. A null text has no words and is never
    taken; a null source is a source. Rows that repeat an id share a hash and are then told
    apart by their row number, so identical rows are interchangeable and reruns agree. An
    empty table gives an empty mix. Columns outside id, text and source are not looked at.
    """
    rows, plan = mix_plan(docs, id, text, source, weights, most)
    # The plan is a small written table: Spark broadcasts it while it is below its own limit.
    return rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        F.col("id").alias(id), F.col("r.source").alias(source), "size", "source_size", "target",
        (F.col("size") * _copies(F.col("r.u"), F.col("r.row"))).alias("taken"),
    )


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, columns unchanged.

    Both scans must tell rows of one id apart alike: by their place in their file, or, in a table
    that is more than a read of files, by a number that is written with the rows first. A null text
    has no words and is never taken, nor is an empty one; a null source is a source; repeated rows are
    interchangeable; an empty table gives an empty one; columns may have any names. Texts do not
    move but for the join with the plan, which is broadcast while it is small.
    """
    place = file_place(docs)
    # 60 bits, as the search for thresholds takes them.
    row = F.monotonically_increasing_id() if place is None else F.shiftrightunsigned(place, 64 - BITS)
    held = docs.select(F.struct("*").alias("doc"), row.alias("row"))
    if place is None:
        held = materialize(held, "mix-docs")
    id, text, source = (f"doc.`{c}`" for c in (id, text, source))
    _, plan = mix_plan(held, id, text, source, weights, most, F.col("row"))
    numbered = held.select("doc", F.col(source).cast("string").alias("source"), unit_hash(F.col(id)).alias("u"), "row")
    joined = numbered.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    copies = _copies(F.col("r.u"), F.col("r.row")).cast("int")
    return joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select("doc.*")


def op2_source_mix(spark, folder: str) -> DataFrame:
    return mix(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
w AS (SELECT *, [5, 2, 1][CAST((n - 1) % 3 + 1 AS INT)] AS weight, source_size * 3 AS cap FROM n),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
    - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN level * weight >= cap THEN CAST(cap AS DOUBLE)
    ELSE max(CASE WHEN level * weight < cap THEN level END) OVER () * weight END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
c AS (SELECT d.*, source_size, target, times, target - times * source_size AS need,
    sum(size) OVER (PARTITION BY d.source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN need <= 0 THEN 0 WHEN upto < need THEN 1
    WHEN upto - size < need AND upto - need <= need - (upto - size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
