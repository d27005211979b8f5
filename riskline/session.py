"""Session settings and the shared work folder."""

from __future__ import annotations

import json
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Set when a plan with cut users is made, as it needs it: a join on (user, slice, x) may use the
# layout by (user, slice). Slices are of even size, and shuffling the log again for every
# such join is what it would cost.
CUT_SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
# Settings that only a new session takes.
STARTUP = {
    # Recording the call site of every column expression makes wide plans slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Room for the compiled code of all stages of a scoring run.
    "spark.sql.codegen.cache.maxEntries": "1000",
}
WORK_DIR = "spark.checkpoint.dir"
# Scratch folders of local sessions without a setting, by application.
_SCRATCH: dict[str, str] = {}
# Tables written so far, in order.
_WRITTEN: list[str] = []


def start(app: str = "riskline", master: str | None = None, **settings: str) -> SparkSession:
    """A new session; setting names are given with ``__`` for each dot."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    named = {key.replace("__", "."): value for key, value in settings.items()}
    for key, value in {**STARTUP, **named}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the engine relies on to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, a scratch one in local mode."""
    folder = spark.conf.get(WORK_DIR, None) or spark.sparkContext.getConf().get(WORK_DIR)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {WORK_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="riskline-")
    return _SCRATCH[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the work folder and return a reader of it.

    A written table cuts the lineage, survives lost executors and, unlike an RDD
    checkpoint, still lets later reads prune columns and push filters down.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_facts(spark: SparkSession, facts: dict, path: str) -> None:
    """Store the numbers and settings of a model as JSON."""
    row = spark.createDataFrame([(json.dumps(facts),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_facts(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the intermediate tables that are written inside the block when it ends.

    For code whose results are written elsewhere by then, such as a micro-batch. What the block gives is
    :func:`materialize` for a table that outlives it.
    """
    mark, kept = len(_WRITTEN), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept.append(_WRITTEN.pop())
        return out

    try:
        yield keep
    finally:
        gone = _WRITTEN[mark:]
        _WRITTEN[mark:] = kept
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in gone:
            folder = hadoop(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, of which its cleaner learns when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def ship(module_name: str) -> None:
    """Send a module's functions inside the tasks that use them.

    Executors then need no copy of this package, only numpy, pandas and pyarrow.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
