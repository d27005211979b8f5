"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda in the body uses it."""
    return F.transform(F.array(value), body)[0]


def whole(column: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def word_count(text: Column) -> Column:
    """Number of words without building them: word characters that follow none."""
    return F.size(words(text)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name close to ``stem`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name in taken:
        n += 1
        name = f"__{stem}_{n}"
    return name


def file_place(df: DataFrame) -> Column | None:
    """A hash of file and row number in it, where ``df`` only reads, selects and filters files.

    It is the same in every scan, however the files are split into tasks. None for other tables.
    """
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return None
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    try:
        at = df.metadataColumn("_metadata")
        place = F.xxhash64(at["file_path"], at["row_index"])
        df.select(place)
    except AnalysisException:
        return None
    return place


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Send at most so many rows at once to Python in the jobs that run inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before))) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
